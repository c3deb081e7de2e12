"""Running values and trailing windows without a task that holds a whole key.

A key's history is cut into chunks of consecutive rows. Running values (sum, maximum, last)
take two passes: chunks are summed up, one row for each chunk goes over the key's whole time,
and inside a chunk rows start from what is carried. Trailing windows run in blocks that also
hold the rows just before their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bars import KEY
from .recurrence import places

BLOCK_ROWS = 50_000


def parted(df: DataFrame, keys: Sequence[str], chunk: Column) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """df in parts by key and chunk: columns that are never null in place of keys, their names with _chunk last, and what gives the keys back.

    Windows, sums and plain joins on these names share one shuffle; the keys of a null-safe join would be shuffled anew.
    chunk is a time or a whole number. Rows without one go before all others, as they do in order.
    """
    work = df.withColumn("_chunk", chunk)

    def instead(name: str, time: str, number: int) -> Column:
        kind = work.schema[name].dataType
        return F.coalesce(name, F.lit(time if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else str(number)).cast(kind))

    names = [f"_k{i}" for i in range(len(keys))]
    nulls = sum((F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    work = work.withColumns({n: instead(k, "1970-01-01", 0) for n, k in zip(names, keys, strict=True)} | {"_nulls": nulls, "_chunk": instead("_chunk", "0001-01-01", -(2**63))})
    back = {k: F.when(F.col("_nulls").bitwiseAND(1 << i) == 0, F.col(n)).alias(k) for i, (n, k) in enumerate(zip(names, keys, strict=True))}
    return work.drop(*keys), [*names, "_nulls", "_chunk"], back


def running(df: DataFrame, columns: dict[str, tuple[str, Column]], keys: Sequence[str], order: Sequence[str], chunk: Column, before: bool = False, peers: bool = False) -> DataFrame:
    """df with columns {name: (kind, value)}: sum, max or last (passing over nulls) of a key's rows up to this one, or before it.

    chunk cuts each key's rows into consecutive runs and sorts like them. Without values so far a
    column is null. Null keys are keys of their own. With peers a place in order gives one
    row, after all that have it.
    """
    work, by, back = parted(df.withColumns({f"_x_{n}": value for n, (_, value) in columns.items()}), keys, chunk)
    place = F.struct(*order)

    def total(kind: str, x: str) -> Column:
        return F.sum(x) if kind == "sum" else F.max(x) if kind == "max" else F.max_by(x, F.when(F.col(x).isNotNull(), place))

    def over(kind: str, x: str, w: WindowSpec) -> Column:
        return (F.last(x, ignorenulls=True) if kind == "last" else F.sum(x) if kind == "sum" else F.max(x)).over(w)

    inside = Window.partitionBy(*by).orderBy(*order)
    frame = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    here = work.withColumns({f"_h_{n}": over(kind, f"_x_{n}", frame) for n, (kind, _) in columns.items()})
    if peers:
        # What a chunk has at its last place is its total, so both passes read one shuffle and no scan holds sums of chunks.
        here = here.withColumn("_next", F.lead(place).over(inside)).where(~F.col("_next").eqNullSafe(place))
        totals = here.groupBy(*by).agg(*(F.max_by(f"_h_{n}", place).alias(f"_x_{n}") for n in columns))
    else:
        totals = work.groupBy(*by).agg(*(total(kind, f"_x_{n}").alias(f"_x_{n}") for n, (kind, _) in columns.items()))
    earlier = Window.partitionBy(*by[:-1]).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, *(over(kind, f"_x_{n}", earlier).alias(f"_c_{n}") for n, (kind, _) in columns.items()))
    joined = here.join(carried, by, "left")
    found = []
    for n, (kind, _) in columns.items():
        own, held = F.col(f"_h_{n}"), F.col(f"_c_{n}")
        found.append((F.coalesce(held + own, own, held) if kind == "sum" else F.greatest(held, own) if kind == "max" else F.coalesce(own, held)).alias(n))
    return joined.select(*(back.get(c, c) for c in df.columns if c not in columns), *found)


def longest_runs(df: DataFrame, conditions: dict[str, Column], keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """A row for each key: the most rows in a row, in order, that meet each condition (null counts as not met)."""
    work, by, back = parted(df.withColumns({f"_met_{n}": c for n, c in conditions.items()}), keys, chunk)
    runs = runs_in(with_runs(work, by, {n: F.col(f"_met_{n}") for n in conditions}, order), by, list(conditions))
    return runs.select(*(back[k] for k in keys), *conditions)


def with_runs(work: DataFrame, by: Sequence[str], conditions: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """Rows in parts with _at (place in the part, from 1) and, for each condition, _stop_ (the place, if it isn't met) and _run_ (rows since the last stop)."""
    inside = Window.partitionBy(*by).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("_at", F.row_number().over(inside).cast("long"))
    work = work.withColumns({f"_stop_{n}": F.when(~F.coalesce(c, F.lit(False)), F.col("_at")) for n, c in conditions.items()})
    return work.withColumns({f"_run_{n}": F.col("_at") - F.coalesce(F.max(f"_stop_{n}").over(so_far), F.lit(0)) for n in conditions})


def runs_in(work: DataFrame, by: Sequence[str], names: Sequence[str], least: Sequence[str] = ()) -> DataFrame:
    """Longest runs for each key out of what with_runs gives, and the least value of some columns.

    A chunk tells its longest run and where conditions were first and last not met, so a run that
    goes on over chunks is known from one row for each chunk.
    """
    each = [x for n in names for x in (F.max(f"_run_{n}").alias(f"_run_{n}"), F.min(f"_stop_{n}").alias(f"_first_{n}"), F.max(f"_stop_{n}").alias(f"_last_{n}"))]
    parts = work.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *each, *(F.min(c).alias(c) for c in least))
    earlier = Window.partitionBy(*by[:-1]).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_rows_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    for n in names:
        stopped = F.coalesce(F.max(F.col("_rows_before") + F.col(f"_last_{n}")).over(earlier), F.lit(0))
        lead = F.coalesce(F.col(f"_first_{n}") - 1, F.col("_rows"))
        parts = parts.withColumn(n, F.greatest(F.col(f"_run_{n}"), lead + F.col("_rows_before") - stopped))
    return parts.groupBy(*by[:-1]).agg(*(F.max(n).cast("long").alias(n) for n in names), *(F.min(c).alias(c) for c in least))


def joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with right's further columns, by equal keys, nulls too; right has each key once."""
    other = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(other, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def in_blocks(bars: DataFrame, rows_before: int, f: Callable[[DataFrame, WindowSpec], DataFrame], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """f(bars, window) in blocks of block_rows bars of a symbol and resolution, for windows over rows_before bars and the present one.

    A block holds the rows_before bars in front of it as well; what f gives for these is dropped.
    """
    if rows_before >= block_rows:
        raise ValueError(f"windows of {rows_before} rows and more don't fit blocks of {block_rows}")
    at = F.col("_n") - 1
    number = F.floor(at / block_rows)
    blocks = F.when(at % block_rows >= block_rows - rows_before, F.array(number, number + 1)).otherwise(F.array(number))
    cut = places(bars, "close").drop("_before", "_chunk").withColumns({"_own": number, "_block": F.explode(blocks)}).drop("_n")
    out = f(cut, Window.partitionBy(*KEY, "_block").orderBy("ts"))
    return out.where("_block = _own").drop("_own", "_block")
