"""Linear recurrences y[t] = a[t] * y[t-1] + b[t] over each key's rows in order.

Steps compose: after (a1, b1), (a2, b2) is (a1 a2, a2 b1 + b2). So a long history is cut into
chunks of time: a first pass reduces each chunk to one row, these rows are folded to carry
values over, and a second pass goes through each chunk from what it starts with. No task
holds more than a chunk, however long one symbol's history is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bars import KEY


def month(order: str = "ts") -> Column:
    return F.date_trunc("month", order)


def places(df: DataFrame, value: str, chunk: Column | None = None, keys: tuple[str, ...] = KEY, order: str = "ts") -> DataFrame:
    """df with _chunk, _n (the row's place in its key, from 1) and _before (value of the row before it).

    Rows are numbered inside their chunk; only one row for each chunk meets the others of its key.
    """
    work = df.withColumn("_chunk", month(order) if chunk is None else chunk)
    ends = work.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"), F.max_by(value, order).alias("_end"))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select(*keys, "_chunk", earlier.alias("_earlier"), F.lag("_end").over(w).alias("_held"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    at = F.row_number().over(inside)
    out = work.join(starts, [*keys, "_chunk"]).withColumns({"_n": F.col("_earlier") + at, "_before": F.when(at == 1, F.col("_held")).otherwise(F.lag(value).over(inside))})
    return out.drop("_earlier", "_held")


def scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the product of all steps up to it, and the value that they make of 0."""
    missing = np.isnan(a) | np.isnan(b)
    p, v = np.where(missing, 1.0, a), np.where(missing, 0.0, b)
    reach = 1  # rows that each step stands for by now
    while reach < len(p):
        v[reach:] = p[reach:] * v[:-reach] + v[reach:]
        p[reach:] = p[reach:] * p[:-reach]
        reach *= 2
    return p, v


def linrec(df: DataFrame, steps: list[tuple[Column, Column, str]], chunk: Column | None = None, keys: tuple[str, ...] = KEY, order: str = "ts") -> DataFrame:
    """df with a column for each (a, b, name) of steps, all in the same two passes over the chunks.

    The first row of a key must have a = 0, or its recurrence starts from 0. chunk: a column
    that cuts each key's rows into consecutive runs and sorts like them; by default the month
    of order. A null a or b makes nothing of its row: the value before it stays in force, and
    its own is null.
    """
    columns, names, n = df.columns, [name for _, _, name in steps], range(len(steps))
    chunk = month(order) if chunk is None else chunk
    work = df.withColumn("_part", chunk).withColumns({f"_a{k}": a.cast("double") for k, (a, _, _) in enumerate(steps)} | {f"_b{k}": b.cast("double") for k, (_, b, _) in enumerate(steps)})

    def of(pdf: pd.DataFrame, k: int, a: str = "_a", b: str = "_b") -> tuple[np.ndarray, np.ndarray]:
        return scan(pdf[f"{a}{k}"].to_numpy(float), pdf[f"{b}{k}"].to_numpy(float))

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out = pdf[[*keys, "_part"]].head(1).copy()
        for k in n:
            p, v = of(pdf, k)
            out[f"_p{k}"], out[f"_v{k}"] = p[-1], v[-1]
        return out

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part", kind="stable")
        out = pdf[[*keys, "_part"]].copy()
        for k in n:
            out[f"_c{k}"] = np.concatenate([[0.0], of(pdf, k, "_p", "_v")[1][:-1]])
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        found = {}
        for k in n:
            p, v = of(pdf, k)
            value = p * pdf[f"_c{k}"].to_numpy(float) + v
            value[pdf[f"_a{k}"].isna().to_numpy() | pdf[f"_b{k}"].isna().to_numpy()] = np.nan
            found[names[k]] = value
        return pdf[columns].assign(**found)

    def doubles(names: list[str]) -> list[T.StructField]:
        return [T.StructField(name, T.DoubleType()) for name in names]

    by = [work.schema[k] for k in (*keys, "_part")]
    slim = work.select(*keys, "_part", *({order} - {*keys}), *(f"_{x}{k}" for k in n for x in "ab"))
    ends = slim.groupBy(*keys, "_part").applyInPandas(reduced, T.StructType([*by, *doubles([f"_{x}{k}" for k in n for x in "pv"])]))
    carry = ends.groupBy(*keys).applyInPandas(carried, T.StructType([*by, *doubles([f"_c{k}" for k in n])]))
    return work.join(carry, [*keys, "_part"]).groupBy(*keys, "_part").applyInPandas(run, T.StructType([*df.schema, *doubles(names)]))
