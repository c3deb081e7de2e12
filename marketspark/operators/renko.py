"""Renko bricks, from chunks of each symbol's history.

On the grid of bricks from the first close on, the last brick's lower edge follows each close
by a clamp: up to the brick under the close, down to the one above it, else unmoved. Clamps
compose to clamps, so a chunk is two numbers for all that may come before it; these are folded
over the chunks, and a second pass goes through each chunk from the edge it starts with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEY
from .recurrence import month


def clamps(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the clamp that all rows up to it make together."""
    low, high = low.copy(), high.copy()
    reach = 1
    while reach < len(low):
        a, b = low[reach:].copy(), high[reach:].copy()
        low[reach:], high[reach:] = np.maximum(a, np.minimum(b, low[:-reach])), np.maximum(a, np.minimum(b, high[:-reach]))
        reach *= 2
    return low, high


def edges_after(floor: np.ndarray, ceil: np.ndarray, start: float) -> np.ndarray:
    """The lower edge after each close between these grid lines, from ``start``; nan while there is no brick."""
    low, high = (floor - 1).astype(float), ceil.astype(float)
    out = np.full(len(low), np.nan)
    first = 0
    if np.isnan(start):  # the first close a brick away from the first of all
        moved = np.flatnonzero((floor >= 1) | (ceil <= -1))
        if not len(moved):
            return out
        first = moved[0]
        start = low[first] if floor[first] >= 1 else high[first]
    lo, hi = clamps(low[first:], high[first:])
    out[first:] = np.maximum(lo, np.minimum(hi, start))
    return out


def renko_on_grid(bars: DataFrame, brick: float, chunk: Column | None = None) -> DataFrame:
    """symbol, resolution, ts, brick_no, open, close of the bricks that each symbol's closes fill.

    Edges are the first close plus whole numbers of bricks, so they don't drift, as sums of brick
    after brick do: a close just on a line always counts. A close at least one brick beyond the
    last edge makes bricks towards it, and two bricks are needed to turn. Null and nan closes take no part.
    chunk: a column that cuts each symbol's bars into consecutive runs and sorts like them.
    """
    rows = bars.where("close is not null and not isnan(close)").select(*KEY, "ts", "close").withColumn("_part", month("ts") if chunk is None else chunk)
    parts = [*KEY, "_part"]
    in_time = Window.partitionBy(*KEY).orderBy("_part")
    first = rows.groupBy(*parts).agg(F.min_by("close", "ts").alias("_f")).select(*parts, F.first("_f").over(in_time).alias("_first"))
    edge = lambda k: F.col("_first") + k * F.lit(brick)
    guess = F.floor((F.col("close") - F.col("_first")) / brick)
    # Grid lines themselves decide, so a quotient's rounding doesn't.
    floor = guess + (F.col("close") >= edge(guess + 1)).cast("long") - (F.col("close") < edge(guess)).cast("long")
    rows = rows.join(first, parts).withColumn("_floor", floor).withColumn("_ceil", F.col("_floor") + (F.col("close") > edge(F.col("_floor"))).cast("long"))

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        floor, ceil = pdf["_floor"].to_numpy(), pdf["_ceil"].to_numpy()
        low, high = clamps(floor - 1, ceil)
        return pdf[parts].head(1).assign(_low=low[-1].astype(float), _high=high[-1].astype(float), _fresh=edges_after(floor, ceil, np.nan)[-1])

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part", kind="stable")
        at, held = np.nan, []
        for low, high, fresh in pdf[["_low", "_high", "_fresh"]].itertuples(index=False):
            held.append(at)
            at = fresh if np.isnan(at) else max(low, min(high, at))
        return pdf[parts].assign(_start=held)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        after = edges_after(pdf["_floor"].to_numpy(), pdf["_ceil"].to_numpy(), pdf["_start"].iloc[0])
        before = np.concatenate([pdf["_start"].to_numpy(float)[:1], after[:-1]])
        # (from, to) of the edge that moves: the upper one upwards, the lower one downwards; both are 0 before any brick.
        up = np.where(np.isnan(before), after >= 0, after > before)
        begin = np.where(np.isnan(before), 0, np.where(up, before + 1, before))
        end = np.where(up, after + 1, after)
        some = ~np.isnan(after) & (np.isnan(before) | (after != before))
        out = pdf.loc[some, [*parts, "ts", "_first"]]
        return out.assign(_from=begin[some].astype(np.int64), _to=end[some].astype(np.int64))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in parts)
    ends = rows.groupBy(*parts).applyInPandas(reduced, f"{kinds}, _low double, _high double, _fresh double")
    starts = ends.groupBy(*KEY).applyInPandas(carried, f"{kinds}, _start double")
    moves = rows.join(starts, parts).groupBy(*parts).applyInPandas(run, f"{kinds}, ts {rows.schema['ts'].dataType.simpleString()}, _first double, _from long, _to long")

    made = F.abs(F.col("_to") - F.col("_from"))
    earlier = F.coalesce(F.sum("_made").over(in_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = moves.groupBy(*parts).agg(F.sum(made).alias("_made")).select(*parts, earlier.alias("_earlier"))
    inside = Window.partitionBy(*parts).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    numbered = moves.join(counts, parts).withColumn("_last", F.col("_earlier") + F.sum(made).over(inside) - made)
    way = F.when(F.col("_to") > F.col("_from"), 1).otherwise(-1)
    each = numbered.withColumns({"_way": way, "_j": F.explode(F.sequence(F.lit(0).cast("long"), made - 1))})
    open_edge = F.col("_from") + F.col("_way") * F.col("_j")
    return each.select(*KEY, "ts", (F.col("_last") + F.col("_j")).alias("brick_no"), edge(open_edge).alias("open"), edge(open_edge + F.col("_way")).alias("close"))
