"""Bars, quotes and time frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import js_round, or_zero, pct_text

KEY = ("symbol", "resolution")
MAX_BARS = 500
PRICES = ("open", "high", "low", "close", "volume")


def bar_window() -> Window:
    return Window.partitionBy(*KEY).orderBy("ts")


def bucket(ts: Column | str, resolution: str) -> Column:
    """Start of the bar that holds ts: minutes, D, W (from Monday) or M, in UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if resolution in ("W", "1W", "M", "1M"):
        unit = "week" if "W" in resolution else "month"
        return F.date_trunc(unit, ts).cast("timestamp_ntz")
    if resolution in ("D", "1D"):
        return F.window(ts, "1 day")["start"].cast("timestamp_ntz")
    if not resolution.isdigit() or int(resolution) == 0:
        raise ValueError(f"unknown resolution: {resolution}")
    return F.window(ts, f"{int(resolution)} minutes")["start"].cast("timestamp_ntz")


def in_order(ts: Column | str = "ts", tie: Column | str = "id") -> Column:
    """One number that sorts like ts and, among equal ones, like the whole number tie.

    min_by and max_by of it are hashed; of a struct they would be sorted. Any 64-bit tie fits: two
    of them are less than the factor apart.
    """
    ts, tie = (F.col(c) if isinstance(c, str) else c for c in (ts, tie))
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.expr("20000000000000000000BD") + F.coalesce(tie, F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)")


def build_bars(ticks: DataFrame, resolution: str) -> DataFrame:
    """Bars of ticks (symbol, ts, price, size, id). Ties of ts go by id. Partial sums are combined before the shuffle."""
    at = in_order()
    return (
        ticks.withColumn("bar", bucket("ts", resolution))
        .groupBy("symbol", "bar")
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.lit(resolution).alias("resolution"), F.col("bar").alias("ts"), *PRICES)
    )


def resample(bars: DataFrame, resolution: str) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, total volume."""
    return (
        bars.withColumn("bar", bucket("ts", resolution))
        .groupBy("symbol", "bar")
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.lit(resolution).alias("resolution"), F.col("bar").alias("ts"), *PRICES)
    )


def _newest(bars: DataFrame, n: int | None) -> DataFrame:
    """The newest n bars (500 at most) of each symbol and resolution with their rank _r; each task keeps that many before the shuffle."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("ts"))
    return bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= min(n or 100, MAX_BARS))


def last_n_bars(bars: DataFrame, n: int | None = 100) -> DataFrame:
    """The newest n bars (500 at most) of each symbol and resolution, with total_available."""
    totals = bars.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_available"))
    return _newest(bars, n).drop("_r").join(totals, list(KEY)).select(*bars.columns, "total_available")


def ohlcv_summary(bars: DataFrame, n: int | None = 100) -> DataFrame:
    """A row for each symbol: counts, period, prices, change, average volume, last_5_bars (array, oldest first)."""
    ranked = _newest(bars, n)
    five = F.when(F.col("_r") <= 5, F.struct("ts", *PRICES))
    out = ranked.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("bar_count"),
        F.min("ts").alias("period_from"),
        F.max("ts").alias("period_to"),
        F.min_by("open", "ts").alias("open"),
        F.max_by("close", "ts").alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        js_round(F.avg(or_zero(F.col("volume")))).alias("avg_volume"),
        F.sort_array(F.collect_list(five)).alias("last_5_bars"),
    )
    change = F.col("close") - F.col("open")
    return out.withColumns(
        {
            "range": js_round(F.col("high") - F.col("low"), 2),
            "change": js_round(change, 2),
            # A first price of 0 has no percentage.
            "change_pct": pct_text(F.try_divide(change, F.nullif("open", F.lit(0.0))) * 100),
        }
    )


def export_bars(bars: DataFrame, n: int = 100) -> DataFrame:
    """bar_count and last_bar of the newest n bars of each symbol and resolution."""
    return _newest(bars, n).groupBy(*KEY).agg(F.count(F.lit(1)).alias("bar_count"), F.max_by(F.struct("ts", *PRICES), "ts").alias("last_bar"))


def bar_index(bars: DataFrame) -> DataFrame:
    """bars with bar_index, from 0."""
    return bars.withColumn("bar_index", F.row_number().over(bar_window()) - 1)


def latest_bars(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol and resolution, by partial maxima."""
    return bars.groupBy(*KEY).agg(F.max_by(F.struct("ts", *PRICES), "ts").alias("b")).select(*KEY, "b.*")


def quote_snapshot(bars: DataFrame, symbols: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Last bar of each asked symbol with its metadata; error where there is no price or it is 0."""
    quotes = bars.groupBy("symbol").agg(F.max_by(F.struct("ts", *PRICES), "ts").alias("b")).select("symbol", "b.*")
    out = symbols.select("symbol").join(quotes, "symbol", "left").withColumn("last", F.col("close"))
    out = out.withColumn("error", F.when(or_zero(F.col("last")) == 0, F.lit("Could not retrieve quote")))
    return out if metadata is None else out.join(metadata, "symbol", "left")


def pane_snapshot(panes: DataFrame, bars: DataFrame) -> DataFrame:
    """Last bar of each pane (layout, pane_index, symbol, resolution), or the error 'no bars'; with pane_count."""
    joined = panes.join(latest_bars(bars), list(KEY), "left")
    return joined.withColumns({"error": F.when(F.col("ts").isNull(), F.lit("no bars")), "pane_count": F.count(F.lit(1)).over(Window.partitionBy("layout"))})


def fold_rows(df: DataFrame, order: str, columns: tuple[str, ...], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """Rows that an ordered fold of each symbol and resolution gives: step(state, *columns) to (state, rows).

    A key's rows come in order through one task, which holds its state and a batch of them only.
    schema: of the rows, which follow the key and the order column.
    """
    names = ["symbol", "resolution", order, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for symbol, resolution, at, *values in batch.itertuples(index=False):
                if key != (symbol, resolution):
                    key, state = (symbol, resolution), start()
                state, rows = step(state, *values)
                out += [(symbol, resolution, at, *r) for r in rows]
            yield pd.DataFrame(out, columns=names)

    rows = df.select(*KEY, order, *columns).repartition(*KEY).sortWithinPartitions(*KEY, order)
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*KEY, order))
    return rows.mapInPandas(run, f"{kept}, {schema}")


def renko(bars: DataFrame, brick: float) -> DataFrame:
    """symbol, resolution, ts, brick_no, open, close of the bricks that each symbol's closes fill.

    The first close is the first edge; a close at least one brick beyond the last edge makes
    bricks towards it, and two bricks are needed to turn. Edges are sums of bricks, one after the
    other, so rows go in order through one task; renko_on_grid needs no such task.
    """

    def step(state, close):
        low, high, n = state or (close, close, 0)
        out = []
        while close >= high + brick:
            out.append((n, high, high + brick))
            low, high, n = high, high + brick, n + 1
        while close <= low - brick:
            out.append((n, low, low - brick))
            high, low, n = low, low - brick, n + 1
        return (low, high, n), out

    return fold_rows(bars.where("close is not null and not isnan(close)"), "ts", ("close",), lambda: None, step, "brick_no long, open double, close double")


def candles(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed bars of candle payloads: {"data": [[ms, open, high, low, close, volume], ...]} of strings."""
    parsed = F.from_json(payload, "data array<array<string>>")["data"]
    c = df.select(*[x for x in df.columns if x != payload], F.explode(parsed).alias("c"))
    number = lambda k: F.get("c", k).try_cast("double")
    ts = F.timestamp_millis(F.get("c", 0).try_cast("long")).cast("timestamp_ntz")
    names = [x for x in df.columns if x != payload]
    return c.select(*names, ts.alias("ts"), number(1).alias("open"), number(2).alias("high"), number(3).alias("low"), number(4).alias("close"), or_zero(number(5)).alias("volume"))

