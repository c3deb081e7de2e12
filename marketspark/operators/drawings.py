"""What studies draw: lines, labels, tables and boxes, as long tables with one row for each primitive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import js_round


def study_filter(df: DataFrame, text: str = "", case_sensitive: bool = True, study: str = "study") -> DataFrame:
    """Rows whose study's name holds the text; an empty text passes all, blank names go."""
    named = df.where(F.coalesce(F.col(study), F.lit("")) != "")
    if not text:
        return named
    return named.where(F.col(study).contains(text) if case_sensitive else F.lower(study).contains(text.lower()))


def horizontal_levels(lines: DataFrame) -> DataFrame:
    """study, levels (distinct, two decimals, falling) of level lines, total_lines of all."""
    level = F.when(F.col("y1") == F.col("y2"), js_round(F.col("y1"), 2))
    return lines.groupBy("study").agg(F.sort_array(F.collect_set(level), asc=False).alias("levels"), F.count(F.lit(1)).alias("total_lines"))


def stream_levels(lines: DataFrame, keys: tuple[str, ...] = ("study",)) -> DataFrame:
    """study (or other keys), levels (distinct, as they are, falling): the first end's price, the second's where that is 0 or null."""
    level = F.when(F.col("y1") == F.col("y2"), F.col("y1")).otherwise(F.coalesce(F.nullif("y1", F.lit(0.0)), F.col("y2")))
    found = lines.groupBy(*keys).agg(F.sort_array(F.collect_set(level), asc=False).alias("levels"))
    return found.where(F.size("levels") > 0)


def price_zones(boxes: DataFrame) -> DataFrame:
    """study, zones (distinct high and low, two decimals, the highest first), total_boxes."""
    zone = F.struct(js_round(F.greatest("y1", "y2"), 2).alias("high"), js_round(F.least("y1", "y2"), 2).alias("low"))
    whole = F.when(F.col("y1").isNotNull() & F.col("y2").isNotNull(), zone)
    return boxes.groupBy("study").agg(F.sort_array(F.collect_set(whole), asc=False).alias("zones"), F.count(F.lit(1)).alias("total_boxes"))


def latest_labels(labels: DataFrame, n: int = 50) -> DataFrame:
    """The last n labels of each study with text or price, with total_labels; price of two decimals."""
    some = labels.where((F.coalesce("text", F.lit("")) != "") | F.col("price").isNotNull())
    w = Window.partitionBy("study")
    ranked = some.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("seq"))), "total_labels": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("_r") <= n).drop("_r").withColumn("price", js_round(F.col("price"), 2))


def stream_labels(labels: DataFrame, n: int = 50) -> DataFrame:
    """The first n labels of each study that have text."""
    ranked = labels.where(F.coalesce("text", F.lit("")) != "").withColumn("_r", F.row_number().over(Window.partitionBy("study").orderBy("seq")))
    return ranked.where(F.col("_r") <= n).drop("_r")


def _written(cells: DataFrame) -> DataFrame:
    """The last write of each cell; a null table is table 0."""
    at = cells.withColumn("tid", F.coalesce("tid", F.lit(0)))
    return at.groupBy("study", "tid", "row", "col").agg(F.max_by("text", "seq").alias("text"))


def table_rows(cells: DataFrame) -> DataFrame:
    """study, tid, row, line: a row's texts that aren't empty, by column, joined by ' | '; empty rows go."""
    some = _written(cells).where(F.coalesce("text", F.lit("")) != "")
    rows = some.groupBy("study", "tid", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("_c"))
    return rows.select("study", "tid", "row", F.array_join(F.transform("_c", lambda c: c["text"]), " | ").alias("line"))


def stream_table_rows(cells: DataFrame) -> DataFrame:
    """study, tid, row, texts: all of a row's texts by column, empty ones too."""
    rows = _written(cells).groupBy("study", "tid", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("_c"))
    return rows.select("study", "tid", "row", F.transform("_c", lambda c: c["text"]).alias("texts"))


def remove_entity(drawings: DataFrame, entity_id) -> DataFrame:
    """drawings without one; and, as columns, whether it was there and how many remain."""
    gone = F.coalesce(F.col("id") == F.lit(entity_id), F.lit(False))
    return drawings.agg(F.coalesce(F.max(gone), F.lit(False)).alias("removed"), F.count_if(~gone).alias("remaining_count"))


def remaining_drawings(drawings: DataFrame, removals: DataFrame, study: str = "study") -> DataFrame:
    """drawings without those that removals (study, id) name; drawings without an id stay, and removals may repeat."""
    return drawings.join(removals.select(study, "id"), [study, "id"], "left_anti").select(*drawings.columns)


def removal_outcomes(drawings: DataFrame, removals: DataFrame, study: str = "study") -> DataFrame:
    """A row for each study that removals (study, id) name: asked (distinct ids), removed of them, not_found, remaining_count of its drawings."""
    asked = removals.select(study, "id").where(F.col("id").isNotNull()).distinct().withColumn("_asked", F.lit(1))
    there = drawings.groupBy(study, "id").agg(F.count(F.lit(1)).alias("_n"))
    both = there.join(asked, [study, "id"], "full_outer")
    hit = F.col("_asked").isNotNull()
    counts = both.groupBy(study).agg(
        F.count("_asked").alias("asked"), F.count_if(hit & F.col("_n").isNotNull()).alias("removed"), F.count_if(hit & F.col("_n").isNull()).alias("not_found"),
        F.coalesce(F.sum(F.when(~hit, F.col("_n"))), F.lit(0).cast("long")).alias("remaining_count"),
    )
    return counts.where("asked > 0")
