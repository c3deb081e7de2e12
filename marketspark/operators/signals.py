"""Signals, positions, sizes and checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEY, fold_rows
from .chunks import in_blocks, running
from .indicators import ema_over, pct_change, rsi_over, rsi_wilder, vwap_over
from .matching import asof_join
from .recurrence import month

NO_SIGNAL = "no signal — conditions not met"


def scalper_signal(bars: DataFrame, lookback: int = 30) -> DataFrame:
    """bars with ema8, rsi3, vwap over the last lookback bars and signal: buy, sell or flat.

    One sort of each block of a symbol's bars serves all of them.
    """
    out = in_blocks(bars, lookback - 1, lambda b, w: vwap_over(rsi_over(ema_over(b, w, 8, lookback), w, 3), w.rowsBetween(-(lookback - 1), 0)))
    bull = (F.col("close") > F.col("vwap")) & (F.col("close") > F.col("ema8"))
    bear = (F.col("close") < F.col("vwap")) & (F.col("close") < F.col("ema8"))
    return out.withColumn("signal", F.when(bull & (F.col("rsi3") < 30), "buy").when(bear & (F.col("rsi3") > 70), "sell").otherwise("flat"))


def momentum_signal(bars: DataFrame, least_pct: float = 0.05) -> DataFrame:
    """bars with rsi14, pct_change, momentum and bias: neutral outside of 30 to 70 or under least_pct."""
    out = pct_change(rsi_wilder(bars, 14))
    quiet = F.col("rsi14").isNull() | (F.col("rsi14") < 30) | (F.col("rsi14") > 70) | F.col("pct_change").isNull() | (F.abs("pct_change") < least_pct)
    return out.withColumn("bias", F.when(quiet, "neutral").when(F.col("pct_change") > 0, "bullish").otherwise("bearish"))


def bias_of(ribbon: Column, close: Column, ema20: Column, rsi: Column) -> Column:
    """bullish, bearish or neutral, neutral first."""
    near = F.abs(F.try_divide(close - ema20, ema20)) < 0.0005
    neutral = (ribbon == "mixed") | rsi.between(45, 55) | near | rsi.isNull() | ema20.isNull() | ribbon.isNull()
    return F.when(neutral, "neutral").when((ribbon == "up") & (close > ema20) & (rsi < 60), "bullish").when((ribbon == "down") & (close < ema20) & (rsi > 40), "bearish").otherwise("neutral")


def position_machine(signals: DataFrame) -> DataFrame:
    """signals with action (buy, sell, skip) and skip_reason, from a start in the quote currency.

    Without limits of balance a position changes where the last signal that wasn't flat
    does, sells before the first buy left out; no state has to be folded.
    """
    acts = F.when(F.col("signal") != "flat", F.col("signal"))
    signals = running(signals, {"_held": ("last", acts)}, KEY, ["ts"], month(), before=True)
    before = F.coalesce("_held", F.lit("sell"))
    out = signals.withColumn("holding_before", F.when(before == "buy", "base").otherwise("quote"))
    turn = ((F.col("signal") == "buy") & (F.col("holding_before") == "quote")) | ((F.col("signal") == "sell") & (F.col("holding_before") == "base"))
    reason = F.when(F.col("signal") == "flat", F.lit(NO_SIGNAL)).otherwise(F.concat(F.lit("signal="), "signal", F.lit(" but holding="), "holding_before", F.lit(" (waiting for right side)")))
    return out.withColumns({"action": F.when(turn, F.col("signal")).otherwise("skip"), "skip_reason": F.when(~turn, reason)}).drop("_held")


def position_fold(signals: DataFrame, quote: float = 100.0, price: str = "close", share: float = 0.9) -> DataFrame:
    """Orders with balances: symbol, resolution, ts, side, size, filled, quote_after, base_after.

    Buys spend share of the quote balance, which must be 1 or more, at a price above 0; sells
    need a base of 1 or more; rows without a price take no part. A balance that is too small for its side never grows again, so what
    is traded is a first part of the turns: each buy that follows a sell and each sell that
    follows a buy. These are found over chunks; only turns, not a symbol's other signals, go in
    order through one task, as sizes are rounded and so depend on every turn before.
    """

    def step(state, signal, p):
        have, base = state
        if signal == "buy" and base == 0 and have >= 1 and p > 0:
            size = round(have * share, 4)
            have, base = have - size, size / p
            return (have, base), [("buy", size, base, have, base)]
        if signal == "sell" and base >= 1:
            size = int(base * 10_000) / 10_000
            have += size * p
            return (have, 0.0), [("sell", size, size, have, 0.0)]
        return state, []

    priced = F.col(price).isNotNull() & ~F.isnan(price)
    some = signals.where(priced & ((F.col("signal") == "sell") | ((F.col("signal") == "buy") & (F.col(price) > 0))))
    seen = running(some, {"_held": ("last", F.col("signal"))}, KEY, ["ts"], month(), before=True)
    turns = seen.where(F.col("signal") != F.coalesce("_held", F.lit("sell"))).drop("_held")
    return fold_rows(turns, "ts", ("signal", price), lambda: (quote, 0.0), step, "side string, size double, filled double, quote_after double, base_after double")


def order_size(df: DataFrame, side: str = "side", quote: str = "quote", base: str = "base") -> DataFrame:
    """df with size, text of four decimals: 90 % of a quote balance of 1 or more, or a base of 1 or more cut down."""
    cut = F.floor(F.col(base) * 10_000) / 10_000
    value = F.when((F.col(side) == "buy") & (F.col(quote) >= 1), F.col(quote) * 0.9).when((F.col(side) == "sell") & (F.col(base) >= 1), cut)
    return df.withColumn("size", F.when(value.isNotNull(), F.format_string("%.4f", value)))


def cap_trade_size(df: DataFrame, portfolio: str = "portfolio", share: float = 0.01, most: float = 3.0, reward_risk: float = 2.0) -> DataFrame:
    """df with trade_size and allowed: whether reward is at least reward_risk times risk."""
    return df.withColumns({"trade_size": F.least(F.col(portfolio) * share, F.lit(most)), "allowed": F.coalesce(F.col("reward") >= reward_risk * F.col("risk"), F.lit(False))})


def safety_check(df: DataFrame) -> DataFrame:
    """df (price, ema21, ema50, ema200, rsi14, macd_line, signal_line) with conditions, verdict and blocked_reasons.

    conditions: map of name to struct(required, actual, result).
    """
    c = F.col
    tests = {
        "price_above_ema200": (c("price") > c("ema200"), "price is not above EMA 200"),
        "ema21_above_ema50": (c("ema21") > c("ema50"), "EMA 21 is not above EMA 50"),
        "price_in_ema21_50_zone": (c("price").between(F.least("ema21", "ema50"), F.greatest("ema21", "ema50")), "price is outside the EMA 21-50 zone"),
        "rsi_35_to_58": (c("rsi14").between(35, 58), "RSI is outside 35 to 58"),
        "macd_above_signal": (c("macd_line") > c("signal_line"), "MACD is not above its signal"),
    }
    held = {k: F.coalesce(t, F.lit(False)) for k, (t, _) in tests.items()}
    entries = [F.struct(F.lit(True).alias("required"), v.alias("actual"), F.when(v, "PASS").otherwise("FAIL").alias("result")) for v in held.values()]
    conditions = F.map_from_arrays(F.array(*map(F.lit, held)), F.array(*entries))
    reasons = F.array_compact(F.array(*(F.when(~held[k], F.lit(why)) for k, (_, why) in tests.items())))
    out = df.withColumns({"conditions": conditions, "blocked_reasons": reasons})
    return out.withColumn("verdict", F.when(F.size("blocked_reasons") > 0, "BLOCKED").otherwise("ALLOWED"))


def time_exit(trades: DataFrame, key: str = "symbol", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Every position closes at the next row: exit_ts, exit_price, null for the last."""
    w = Window.partitionBy(key).orderBy(*order)
    return trades.withColumns({"exit_ts": F.lead("ts").over(w), "exit_price": F.lead("price").over(w)})


def _practised(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[pa.RecordBatch]:
    """Folds sorted rows of each session, symbol and chunk; gives the rows with position and realized_pnl, or what each chunk does.

    Cost and result are kept as a * c + b and d * c + e of the cost c at the chunk's start. With
    rows the start is known, so a and d are 0.
    """
    names = ("_session", "_symbol", "_chunk", "_step", "_closes", "price", "_p0", "_c0", "_r0")
    key, end = None, None
    for batch in batches:
        positions, results, ends = [], [], []
        for *at, step, closes, price, p0, c0, r0 in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if at != key:
                if end:
                    ends.append(end)
                key, position = at, p0
                a, b, d, e = (0.0, c0, 0.0, r0) if rows else (1.0, 0.0, 0.0, 0.0)
            size = abs(position)
            if closes or position * step < 0:
                units = position if closes else -step
                if position:
                    d, e = d - units * a, e + units * (price - b)
                position = 0 if closes else position + step
            elif step:
                a, b, position = a * size / (size + 1), (b * size + price) / (size + 1), position + step
            if rows:
                positions.append(position)
                results.append(e)
            else:
                end = (*at, a, b, d, e)
        if rows:
            kept = batch.select([n for n in batch.schema.names if n not in (*names[:5], *names[6:])])
            yield kept.append_column("position", pa.array(positions, pa.int64())).append_column("realized_pnl", pa.array(results, pa.float64()))
        elif ends:
            yield _ends(ends)
    if end:
        yield _ends([end])


def _ends(ends: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), *(4 * [pa.float64()]))
    return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*ends, strict=True), types, strict=True)], names=["_session", "_symbol", "_chunk", *"abde"])


def _practice_starts(ends: pd.DataFrame) -> pd.DataFrame:
    """_c0 and _r0, cost and result at the start of each chunk of one session and symbol."""
    ends = ends.sort_values("_chunk")
    cost, result, starts = 0.0, 0.0, []
    for a, b, d, e in ends[[*"abde"]].itertuples(index=False):
        starts.append((cost, result))
        cost, result = a * cost + b, result + d * cost + e
    return ends[["_session", "_symbol", "_chunk", "_p0"]].assign(_c0=[c for c, _ in starts], _r0=[r for _, r in starts])


def practice_pnl(actions: DataFrame, bars: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """actions (session, symbol, ts, id, action) priced as of their time, with position and realized_pnl so far.

    Buys and sells are of one unit, close goes to none; the average cost decides what a
    reduction realizes. A session's symbol of up to chunk_rows rows is folded in one go, batch by
    batch. Only longer ones are cut, into chunks of whole days of about chunk_rows rows: what each
    does to position, cost and result is one row, and these tell what the chunks start from.
    """
    priced = asof_join(actions, bars.select("symbol", F.col("ts").alias("bar_ts"), F.col("close").alias("price")), "symbol", "ts", "bar_ts", ["price"])
    columns = priced.columns
    keys = ("_session", "_symbol")
    part = (*keys, "_chunk")
    day = F.date_trunc("day", "ts").alias("_day")

    # Text keys, as joins on them must also find rows without a session or symbol.
    text = [F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).alias(f"_{name}") for name in ("session", "symbol")]
    counted = actions.select(*text, day)
    long = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > chunk_rows)
    days = counted.join(F.broadcast(long.drop("_rows")), [*keys]).groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier.orderBy("_day")), F.lit(0))
    cut = F.broadcast(days.select(*keys, "_day", F.floor(before / chunk_rows).alias("_chunk")))

    unit = F.coalesce(F.when(F.col("action") == "buy", 1).when(F.col("action") == "sell", -1), F.lit(0))
    valid = F.col("price").isNotNull() & ~F.isnan("price")
    steps = priced.select(*columns, *text, day, F.when(valid, unit).otherwise(0).alias("_step"), (valid & (unit == 0)).alias("_closes"))

    def folded(df: DataFrame, rows: bool, schema: str) -> DataFrame:
        known = {"_p0": "long", "_c0": "double", "_r0": "double"}
        whole = df.withColumns({n: F.coalesce(F.col(n) if n in df.columns else F.lit(None), F.lit(0)).cast(t) for n, t in known.items()}).drop("_day")
        return whole.repartition(*part).sortWithinPartitions(*part, "ts", "id").mapInArrow(lambda batches: _practised(batches, rows), schema)

    # A priced close leaves no position, so a position is what was traded since the last one before.
    parts = steps.join(cut, [*keys, "_day"])
    place = F.struct("ts", "id")
    closed = parts.withColumn("_closed", F.max(F.when(F.col("_closes"), place)).over(Window.partitionBy(*part)))
    after = F.col("_closed").isNull() | (place > F.col("_closed"))
    tails = closed.groupBy(*part).agg(F.coalesce(F.sum(F.when(after, F.col("_step"))), F.lit(0)).alias("_tail"), F.max("_closes").alias("_cut"))
    tails = tails.withColumn("_sum", F.coalesce(F.sum("_tail").over(earlier.orderBy("_chunk")), F.lit(0)))
    held = F.coalesce(F.last(F.when(F.col("_cut"), F.col("_sum")), ignorenulls=True).over(earlier.orderBy("_chunk")), F.lit(0))
    positions = tails.select(*part, (F.col("_sum") - held).alias("_p0"))
    ends = folded(parts.join(F.broadcast(positions), [*part]), False, "_session string, _symbol string, _chunk long, a double, b double, d double, e double")
    starts = ends.join(F.broadcast(positions), [*part]).groupBy(*keys).applyInPandas(_practice_starts, "_session string, _symbol string, _chunk long, _p0 long, _c0 double, _r0 double")

    placed = steps.join(cut, [*keys, "_day"], "left").withColumn("_chunk", F.coalesce("_chunk", F.lit(0)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in priced.schema)
    return folded(placed.join(F.broadcast(starts), [*part], "left"), True, f"{kept}, position long, realized_pnl double")


def order_outcome(log: DataFrame, coin: str = "XRP") -> DataFrame:
    """log (code, msg, order_id) with order_placed, order_ref and locked_available."""
    found = F.regexp_extract(F.coalesce("msg", F.lit("")), rf"(?i)([\d.]+){coin} can be used at most", 1)
    placed = F.coalesce(F.col("code") == "00000", F.lit(False))
    return log.withColumns({"order_placed": placed, "order_ref": F.coalesce(F.nullif("order_id", F.lit("")), "msg"), "locked_available": found.try_cast("double")})
