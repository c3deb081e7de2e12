"""Order books: rows (symbol, row_index, class_text, price_text, size_text) to sides and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import js_round, parse_price

MOST_RAW = 50


def classify_depth(rows: DataFrame) -> DataFrame:
    """symbol, row_index, side, price, size of rows with a price.

    bid or buy in the text makes a bid, else ask or sell an ask; of other rows those in the
    first half of the book are asks. A missing size is 0, one that isn't a number is NaN.
    """
    w = Window.partitionBy("symbol")
    at = rows.withColumns({"_i": F.row_number().over(w.orderBy("row_index")) - 1, "_n": F.count(F.lit(1)).over(w), "price": parse_price(F.col("price_text"))})
    text = F.coalesce("class_text", F.lit(""))
    side = F.when(text.rlike("(?i)bid|buy"), "bid").when(text.rlike("(?i)ask|sell"), "ask").when(F.col("_i") < F.col("_n") / 2, "ask").otherwise("bid")
    size = F.when(F.col("size_text").isNull(), 0.0).otherwise(F.coalesce(parse_price(F.col("size_text")), F.lit(float("nan"))))
    return at.where(F.col("price").isNotNull()).select("symbol", "row_index", side.alias("side"), "price", size.alias("size"))


def depth_summary(levels: DataFrame) -> DataFrame:
    """symbol, best_bid, best_ask, bid_levels, ask_levels, spread (six decimals, null without both sides)."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    out = levels.groupBy("symbol").agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"), F.count_if(bid).alias("bid_levels"), F.count_if(ask).alias("ask_levels"))
    return out.withColumn("spread", js_round(F.col("best_ask") - F.col("best_bid"), 6))


def depth_book(levels: DataFrame) -> DataFrame:
    """symbol, bids (falling prices), asks (rising prices), as arrays of struct(price, size)."""
    level = F.struct("price", "size")
    bids = F.sort_array(F.collect_list(F.when(F.col("side") == "bid", level)), asc=False)
    asks = F.sort_array(F.collect_list(F.when(F.col("side") == "ask", level)))
    return levels.groupBy("symbol").agg(bids.alias("bids"), asks.alias("asks"))


def raw_values(cells: DataFrame) -> DataFrame:
    """symbol, row_index, price: the first positive prices of a book whose rows can't be told apart."""
    some = cells.withColumn("price", parse_price(F.col("price_text"))).where(F.col("price") > 0)
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy("row_index")))
    return ranked.where(F.col("_r") <= MOST_RAW).select("symbol", "row_index", "price")


def levels_or_raw(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The levels of classify_depth; of books that have none, raw_values of their cells, without side and size."""
    levels = classify_depth(rows)
    raw = raw_values(cells).join(levels.select("symbol").distinct(), "symbol", "left_anti")
    return levels.unionByName(raw, allowMissingColumns=True)
