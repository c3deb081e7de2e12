"""Schemas and adapters: market-data shapes out of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import js_round

BAR = "symbol string, resolution string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
CANDLE_PAYLOAD = "data array<array<string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """symbol, ts, price, size, id of events; symbol is the event type or another of its columns."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col(symbol).cast("string").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("size"),
        F.col("event_id").alias("id"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a strategy for each supplier, with exact pnl and a key that orders them."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_suppkey").cast("string").alias("strategy"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("side"),
        (F.col("l_shipdate") - F.expr("make_dt_interval(l_linenumber)")).alias("entry_ts"),
        F.col("l_shipdate").alias("exit_ts"),
        F.col("l_quantity").alias("qty"),
        js_round(F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount")), 2).cast("decimal(18,2)").alias("pnl"),
        F.format_string("%012d.%03d.%012d", "l_orderkey", "l_linenumber", "l_partkey").alias("trade_id"),
    )


def drawn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, id, seq, y1, y2: level where the return flag is A, sloped otherwise."""
    line = table(spark, sf_dir, "lineitem")
    flat = F.col("l_returnflag") == "A"
    return line.select(
        F.concat(F.lit("Study "), F.col("l_suppkey").cast("string")).alias("study"),
        F.format_string("%012d.%03d.%012d", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        (F.col("l_quantity") + F.col("l_tax") / 1000).alias("y1"),
        F.when(flat, F.col("l_quantity") + F.col("l_tax") / 1000).otherwise(F.col("l_linenumber").cast("double")).alias("y2"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, seq, text, price of conversations."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("Study "), F.col("conv_id").cast("string")).alias("study"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("text"),
        F.when(F.col("turn") % 3 != 1, F.length("text") / 7).alias("price"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, tid, row, col, text, seq of line items; later writes of a cell have larger seq."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_suppkey") % 10).cast("string").alias("study"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("tid"),
        F.col("l_linenumber").alias("row"),
        (F.col("l_partkey") % 4).cast("int").alias("col"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("text"),
        F.format_string("%012d.%012d.%012d", "l_orderkey", "l_partkey", "l_suppkey").alias("seq"),
    )


def depth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, row_index, class_text, price_text, size_text of an order book for each supplier."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.format_string("%012d.%03d.%012d", "l_orderkey", "l_linenumber", "l_partkey").alias("row_index"),
        F.when(F.col("l_returnflag") == "A", "row ask-level").when(F.col("l_returnflag") == "R", "row BUY").otherwise("row").alias("class_text"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"), F.lit(".25"))).alias("price_text"),
        F.when(F.col("l_linenumber") != 3, F.col("l_partkey").cast("string")).alias("size_text"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol metadata of parts: symbol, description, exchange, prefix, type."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("<em>P</em>"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("description"),
        F.when(F.col("p_partkey") % 3 != 0, F.regexp_replace("p_brand", "#", "")).alias("exchange"),
        F.regexp_replace("p_brand", "#", "").alias("prefix"),
        F.col("p_type").alias("type"),
        F.col("p_partkey").alias("seq"),
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script_id, source: a small script of each part, some of them faulty."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    version = F.when(F.col("p_size") % 5 == 0, "//@version=4\n").when(F.col("p_size") % 5 == 1, "").otherwise("//@version=6\n")
    head = F.when(F.col("p_size") % 3 == 0, 'strategy("s")\n').otherwise('indicator("s")\n')
    array = F.when(F.col("p_size") % 4 == 0, "a = array.from()\n").when(F.col("p_size") % 4 == 1, "a = array.new_float(3)\n").when(F.col("p_size") % 4 == 2, "a = array.new<int>(n)\n").otherwise("a = array.from(1, 2, 3, 4)\n")
    use = F.concat(F.lit("x = array.get(a, "), size, F.lit(") + array.get(a, -1)\n  y = a.first() + a.last()\n"))
    order = F.when(F.col("p_size") % 2 == 0, 'strategy.entry("L", strategy.long)\nstrategy.close("L")').otherwise("plot(x)")
    return p.select(F.col("p_partkey").alias("script_id"), F.concat(version, head, array, use, order).alias("source"))
