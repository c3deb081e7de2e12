"""Indicators over bars. Trailing ones are windows in blocks of bars; full-history ones use linrec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import or_zero
from .bars import KEY
from .chunks import in_blocks
from .recurrence import linrec, places

LOOKBACK = 30


def _last(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def _whole(w: WindowSpec, n: int, value: Column) -> Column:
    """value once n rows are there, else null."""
    return F.when(F.row_number().over(w) >= n, value)


def ema(bars: DataFrame, n: int, lookback: int = LOOKBACK, out: str | None = None) -> DataFrame:
    """Exponential average of the last lookback closes, from the first of them."""
    return in_blocks(bars, lookback - 1, lambda b, w: ema_over(b, w, n, lookback, out))


def ema_over(bars: DataFrame, w: WindowSpec, n: int, lookback: int = LOOKBACK, out: str | None = None) -> DataFrame:
    """ema over an ordered window."""
    k = 2.0 / (n + 1)
    closes = F.collect_list("close").over(_last(w, lookback))
    folded = F.aggregate(F.slice(closes, 2, lookback), F.get(closes, 0), lambda acc, x: x * F.lit(k) + acc * F.lit(1 - k))
    return bars.withColumn(out or f"ema{n}", folded)


def rsi_simple(bars: DataFrame, n: int = 3, out: str | None = None) -> DataFrame:
    """Relative strength of plain sums of the last n differences; 50 without n of them, 100 without losses."""
    return in_blocks(bars, n, lambda b, w: rsi_over(b, w, n, out))


def rsi_over(bars: DataFrame, w: WindowSpec, n: int = 3, out: str | None = None) -> DataFrame:
    """rsi_simple over an ordered window."""
    with_diff = bars.withColumn("_d", F.col("close") - F.lag("close").over(w))
    gains = F.sum(F.greatest("_d", F.lit(0.0))).over(_last(w, n))
    losses = F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(_last(w, n))
    value = F.when(F.row_number().over(w) <= n, 50.0).when(losses == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gains, losses)))
    return with_diff.withColumn(out or f"rsi{n}", value).drop("_d")


def vwap(bars: DataFrame) -> DataFrame:
    """A row for each symbol: volume-weighted typical price of the rows given; without volume the last close."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum(or_zero(F.col("volume")))
    return bars.groupBy(*KEY).agg(F.when(volume == 0, F.max_by("close", "ts")).otherwise(F.try_divide(F.sum(typical * or_zero(F.col("volume"))), volume)).alias("vwap"))


def rolling_vwap(bars: DataFrame, n: int = LOOKBACK, out: str = "vwap") -> DataFrame:
    """The vwap of the last n bars."""
    return in_blocks(bars, n - 1, lambda b, w: vwap_over(b, _last(w, n), out))


def vwap_over(bars: DataFrame, w: WindowSpec, out: str = "vwap") -> DataFrame:
    """The vwap of a window's bars."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum(or_zero(F.col("volume"))).over(w)
    return bars.withColumn(out, F.when(volume == 0, F.col("close")).otherwise(F.try_divide(F.sum(typical * or_zero(F.col("volume"))).over(w), volume)))


def session_vwap(bars: DataFrame, out: str = "session_vwap") -> DataFrame:
    """The vwap of the day so far."""
    return vwap_over(bars, Window.partitionBy(*KEY, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0), out)


def volume_ma(bars: DataFrame, n: int = 20, out: str = "volume_ma") -> DataFrame:
    return in_blocks(bars, n - 1, lambda b, w: b.withColumn(out, _whole(w, n, F.avg(or_zero(F.col("volume"))).over(_last(w, n)))))


def sma(bars: DataFrame, n: int = 20, out: str | None = None) -> DataFrame:
    """Mean of the last n closes; null before there are n."""
    return in_blocks(bars, n - 1, lambda b, w: b.withColumn(out or f"sma{n}", _whole(w, n, F.avg("close").over(_last(w, n)))))


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """bb_mid, bb_upper, bb_lower: the mean of n closes and width population deviations on either side."""

    def bands(b: DataFrame, w: WindowSpec) -> DataFrame:
        mid, dev = F.avg("close").over(_last(w, n)), F.stddev_pop("close").over(_last(w, n))
        return b.withColumns({"bb_mid": _whole(w, n, mid), "bb_upper": _whole(w, n, mid + width * dev), "bb_lower": _whole(w, n, mid - width * dev)})

    return in_blocks(bars, n - 1, bands)


def pct_change(bars: DataFrame) -> DataFrame:
    """pct_change (percent against the close before; null without one or if it is 0) and momentum: up, down or flat."""
    before = F.col("_before")
    change = F.try_divide((F.col("close") - before) * 100, F.nullif(before, F.lit(0.0)))
    step = F.when(F.col("close") > before, "up").when(F.col("close") < before, "down").otherwise("flat")
    return places(bars, "close").withColumns({"pct_change": change, "momentum": step}).drop("_before", "_n", "_chunk")


def _ema_step(value: Column, n: int, out: str) -> tuple[Column, Column, str]:
    """The first value, then k = 2 / (n + 1)."""
    k, first = 2.0 / (n + 1), F.col("_n") == 1
    return F.when(first, 0.0).otherwise(1 - k), F.when(first, value).otherwise(value * k), out


def _wilder_step(value: str, n: int, out: str, skip: int) -> tuple[Column, Column, str]:
    """A sum of n values' n-th parts, which is their mean, then (y (n - 1) + x) / n; the first skip rows take no part."""
    at = F.col("_n") - skip
    return F.when(at > n, (n - 1) / n).when(at > 0, 1.0), F.col(value) / n, out


def history(bars: DataFrame, emas: dict[str, int] | None = None, rsi: dict[str, int] | None = None, atr: dict[str, int] | None = None, leave_places: bool = False) -> DataFrame:
    """bars with full-history indicators, by name and length, all in one go of linrec.

    emas: from the first close. rsi: Wilder's; null for the first n bars, 100 where the average
    loss is 0. atr: Wilder's average of the true range; null before n bars. leave_places: _n
    and _chunk stay, for macd_of.
    """
    before = F.col("_before")
    diff = F.col("close") - before
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    work = places(bars, "close").withColumns({"_up": F.greatest(diff, F.lit(0.0)), "_down": F.greatest(-diff, F.lit(0.0)), "_tr": true})
    steps = [_ema_step(F.col("close"), n, out) for out, n in (emas or {}).items()]
    for out, n in (rsi or {}).items():
        steps += [_wilder_step("_up", n, f"_gain_{out}", 1), _wilder_step("_down", n, f"_loss_{out}", 1)]
    steps += [_wilder_step("_tr", n, out, 0) for out, n in (atr or {}).items()]
    found = linrec(work, steps, F.col("_chunk"))
    for out, n in (rsi or {}).items():
        gain, loss = F.col(f"_gain_{out}"), F.col(f"_loss_{out}")
        strength = F.when(loss == 0, 100.0).when(loss.isNotNull(), 100 - 100 / (1 + F.try_divide(gain, loss)))
        found = found.withColumn(out, F.when(F.col("_n") > n, strength))
    for out, n in (atr or {}).items():
        found = found.withColumn(out, F.when(F.col("_n") >= n, F.col(out)))
    gone = ["_before", "_up", "_down", "_tr", *(f"_{x}_{out}" for x in ("gain", "loss") for out in rsi or {})]
    return found.drop(*gone, *(() if leave_places else ("_n", "_chunk")))


def ema_full(bars: DataFrame, n: int, out: str | None = None) -> DataFrame:
    return history(bars, emas={out or f"ema{n}": n})


def rsi_wilder(bars: DataFrame, n: int = 14, out: str | None = None) -> DataFrame:
    return history(bars, rsi={out or f"rsi{n}": n})


def atr(bars: DataFrame, n: int = 14, out: str | None = None) -> DataFrame:
    return history(bars, atr={out or f"atr{n}": n})


def macd_of(df: DataFrame, fast: str = "_fast", slow: str = "_slow", signal: int = 9) -> DataFrame:
    """df with macd_line, signal_line, macd_histogram from two averages of history(leave_places=True), which go."""
    line = df.withColumn("macd_line", F.col(fast) - F.col(slow))
    out = linrec(line, [_ema_step(F.col("macd_line"), signal, "signal_line")], F.col("_chunk"))
    return out.withColumn("macd_histogram", F.col("macd_line") - F.col("signal_line")).drop("_n", "_chunk", fast, slow)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return macd_of(history(bars, emas={"_fast": fast, "_slow": slow}, leave_places=True), signal=signal)


def ribbon_of(names: list[str]) -> Column:
    """up if the averages fall strictly in this order, down if they rise, else mixed."""
    up, down = F.lit(True), F.lit(True)
    for x, y in zip(names[:-1], names[1:], strict=True):
        up, down = up & (F.col(x) > F.col(y)), down & (F.col(x) < F.col(y))
    return F.when(up, "up").when(down, "down").otherwise("mixed")


def ema_ribbon(bars: DataFrame, lengths: tuple[int, ...] = (21, 50, 200)) -> DataFrame:
    """ema columns of the lengths, and ribbon."""
    names = [f"ema{n}" for n in lengths]
    return history(bars, emas=dict(zip(names, lengths, strict=True))).withColumn("ribbon", ribbon_of(names))


def heikin_ashi(bars: DataFrame) -> DataFrame:
    """ha_open, ha_high, ha_low, ha_close: each open is the mean of the open and close before it."""
    close = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    numbered = places(bars.withColumn("ha_close", close), "ha_close")
    first = F.col("_n") == 1
    step = (F.when(first, 0.0).otherwise(0.5), F.when(first, (F.col("open") + F.col("close")) / 2).otherwise(F.col("_before") / 2), "ha_open")
    out = linrec(numbered, [step], F.col("_chunk"))
    return out.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")}).drop("_n", "_before", "_chunk")
