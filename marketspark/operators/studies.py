"""Study values and inputs, free-form records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_only(df: DataFrame) -> DataFrame:
    return df.where("visible")


def clean_study_values(df: DataFrame) -> DataFrame:
    """Rows (study, title, value as text) with a title and a value other than '' and the empty-set sign."""
    value = F.coalesce("value", F.lit(""))
    return df.where((F.coalesce("title", F.lit("")) != "") & (value != "") & (value != "∅"))


def numeric_values(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is a number and not NaN."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value))


def study_map(df: DataFrame, order: str = "seq") -> DataFrame:
    """symbol, study, values (map of title to value), study_count of the symbol; of equal titles the last wins."""
    last = df.groupBy("symbol", "study", "title").agg(F.max_by("value", order).alias("value"))
    maps = last.groupBy("symbol", "study").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("title", "value")))).alias("values"))
    return maps.withColumn("study_count", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def trim_inputs(inputs: Column) -> Column:
    """An array of struct(id, value) without texts of over 200 characters at id 'text', or over 500 anywhere."""
    return F.filter(inputs, lambda i: ~F.coalesce(((i["id"] == "text") & (F.length(i["value"]) > 200)) | (F.length(i["value"]) > 500), F.lit(False)))


def override_inputs(df: DataFrame, overrides: dict[str, str], inputs: str = "inputs") -> DataFrame:
    """df with the values of existing ids replaced, and updated (their ids). No overrides: ValueError."""
    if not overrides:
        raise ValueError("there is nothing to override")
    new = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))
    ids = F.transform(inputs, lambda i: i["id"])
    replaced = F.transform(inputs, lambda i: F.struct(i["id"].alias("id"), F.when(F.map_contains_key(new, i["id"]), F.try_element_at(new, i["id"])).otherwise(i["value"]).alias("value")))
    return df.withColumns({inputs: replaced, "updated": F.array_intersect(ids, F.array(*map(F.lit, overrides)))})


def scalar_fields(record: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(record, lambda k, v: v.isNotNull())


def equity_summary(record: Column) -> Column:
    """Those entries of a map whose key tells of equity, drawdown, profit or net."""
    return F.map_filter(record, lambda k, v: k.rlike("(?i)equity|drawdown|profit|net"))
