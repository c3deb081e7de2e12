"""Look-up of symbols, scripts and layouts; text statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import strip_em

GRAM = 3  # characters of a query that find what may hold it


def dedupe_keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def _runs(text: Column, lengths: range) -> Column:
    """Every run of these numbers of characters of a text; none for null."""
    none = F.array().cast("array<string>")

    def of_length(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda at: F.substring(text, at, F.lit(n)))
        return F.when(F.length(text) >= n, runs).otherwise(none)

    return F.array_distinct(F.concat(*(of_length(n) for n in lengths)))


def _holding(rows: DataFrame, texts: tuple[Column, Column], asked: DataFrame, what: Column) -> DataFrame:
    """rows joined with those of asked that are found in either text.

    A text that holds a query has all of its runs of GRAM characters (of a shorter query: itself).
    Only runs that some query has become postings; their numbers tell each query's rarest run,
    and that is what it meets texts by. The empty query, which every text holds, has no run: its
    one row is broadcast.
    """
    queries = asked.select(what.alias("_q")).where("_q != ''").distinct()
    parts = queries.withColumn("_gram", F.explode(F.when(F.length("_q") < GRAM, F.array("_q")).otherwise(_runs(F.col("_q"), range(GRAM, GRAM + 1)))))
    each = rows.withColumn("_gram", F.explode(F.array_distinct(F.concat(*(_runs(t, range(1, GRAM + 1)) for t in texts)))))
    postings = each.join(parts.select("_gram").distinct(), "_gram", "left_semi")
    numbers = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows"))
    rarest = parts.join(numbers, "_gram").groupBy("_q").agg(F.min_by("_gram", F.struct("_rows", "_gram")).alias("_gram"))
    near = asked.withColumn("_q", what).join(rarest, "_q").drop("_q")
    found = postings.join(near, "_gram").where(texts[0].contains(what) | texts[1].contains(what)).drop("_gram")
    all_of_them = asked.where(what == "").distinct().withColumn("_gram", F.lit(""))
    whole = rows.withColumn("_gram", F.lit("")).join(F.broadcast(all_of_them), "_gram").drop("_gram")
    return found.unionByName(whole.where(texts[0].isNotNull() | texts[1].isNotNull()))


def search_symbols(catalog: DataFrame, queries: DataFrame, kind: str | None = None, limit: int = 15) -> DataFrame:
    """For each query the first limit symbols whose symbol or description holds it, exact ones first, then beginnings.

    queries: one column, query; of equal ones one is answered. The empty one finds every symbol.
    """
    c = catalog if kind is None else catalog.where(F.col("type") == kind)
    named = c.select(
        strip_em(F.col("symbol")).alias("symbol"),
        strip_em(F.col("description")).alias("description"),
        F.coalesce(F.nullif("exchange", F.lit("")), F.col("prefix"), F.lit("")).alias("exchange"),
        F.coalesce("type", F.lit("")).alias("type"),
        F.when(F.coalesce("exchange", F.lit("")) != "", F.concat("exchange", F.lit(":"), strip_em(F.col("symbol")))).otherwise(strip_em(F.col("symbol"))).alias("full_name"),
        "seq",
    )
    q, s, d = F.lower("query"), F.lower("symbol"), F.lower("description")
    hits = _holding(named, (s, d), queries.select("query").distinct(), q)
    order = F.when(s == q, 0).when(s.startswith(q), 1).when(s.contains(q), 2).otherwise(3)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "seq")))
    return ranked.where(F.col("rank") <= limit).drop("seq")


def resolve_name(names: DataFrame, targets: DataFrame, order: str = "seq") -> DataFrame:
    """For each target the first name or title equal to it without case, else the first that holds it; null if none."""
    t = F.lower("target")
    n, title = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    exact = (n == t) | (title == t)
    hits = _holding(names, (n, title), targets.select("target").distinct(), t)
    best = hits.groupBy("target").agg(F.min_by(F.struct("id", "name"), F.struct(F.when(exact, 0).otherwise(1).alias("p"), order)).alias("b"))
    return targets.join(best, "target", "left").select("target", F.col("b.id").alias("id"), F.col("b.name").alias("name"))


def list_scripts(df: DataFrame) -> DataFrame:
    """id, name, title, version, modified: the name falls back to the title, then to 'Untitled'; empty ones are null."""
    text = lambda c: F.nullif(c, F.lit(""))
    return df.select(
        text("id").alias("id"),
        F.coalesce(text("script_name"), text("script_title"), F.lit("Untitled")).alias("name"),
        text("script_title").alias("title"),
        F.nullif("version", F.lit(0)).alias("version"),
        F.nullif("modified", F.lit(0)).alias("modified"),
    )


def text_stats(scripts: DataFrame, source: str = "source") -> DataFrame:
    """script_id, line_count, char_count."""
    return scripts.select("script_id", F.size(F.split(source, "\n")).alias("line_count"), F.length(source).alias("char_count"))
