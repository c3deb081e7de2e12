"""Workflows: the morning brief, batch scans, the scalper's backtest, sessions, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import brief_line, number_text
from ..operators.bars import KEY, latest_bars, ohlcv_summary
from ..operators.chunks import running
from ..operators.indicators import ema_full, history, ribbon_of
from ..operators.matching import account_value, htf_align, nearest_level, scan_grid, watchlist_scan
from ..operators.recurrence import month
from ..operators.signals import bias_of, order_size, position_fold, position_machine, scalper_signal
from ..operators.strategy import strategy_metrics
from ..sources.files import watchlist as rules_watchlist

NO_BALANCE = "the balance is too small"


def trend_bias(bars: DataFrame, higher: DataFrame | None = None, higher_seconds: int = 4 * 3600) -> DataFrame:
    """bars with ema20, ribbon of 21, 50 and 200, rsi14 and bias.

    ema20 is that of the last closed bar of higher, bars of a longer time frame, if these are given.
    """
    emas = {"ema21": 21, "ema50": 50, "ema200": 200}
    out = history(bars, emas=emas if higher is not None else emas | {"ema20": 20}, rsi={"rsi14": 14})
    if higher is not None:
        out = htf_align(out, ema_full(higher, 20).select("symbol", "ts", "ema20"), higher_seconds, ["ema20"])
    out = out.withColumn("ribbon", ribbon_of(["ema21", "ema50", "ema200"]))
    return out.withColumn("bias", bias_of(F.col("ribbon"), F.col("close"), F.col("ema20"), F.col("rsi14")))


def morning_brief(watchlist: DataFrame, bars: DataFrame, levels: DataFrame) -> DataFrame:
    """A row for each watched symbol: bias, key level, support, resistance, the brief's line, or an error."""
    wanted = bars.join(watchlist.select("symbol"), "symbol", "left_semi")
    judged = trend_bias(wanted).groupBy("symbol").agg(F.max_by("bias", "ts").alias("bias"), F.max_by("rsi14", "ts").alias("rsi14"))
    scan = watchlist_scan(watchlist, wanted, judged).withColumn("last", F.col("close"))
    out = nearest_level(scan, levels)
    bias = F.coalesce("bias", F.lit("neutral"))
    watch = F.when(bias == "bullish", F.concat(F.lit("break of "), number_text(F.coalesce("resistance", "last")))).when(bias == "bearish", F.concat(F.lit("loss of "), number_text(F.coalesce("support", "last")))).otherwise(F.lit("range"))
    line = F.when(F.col("error").isNull(), brief_line(F.col("symbol"), bias, number_text(F.col("key_level")), watch))
    return out.withColumns({"bias": bias, "line": line})


def brief_totals(brief: DataFrame) -> DataFrame:
    """One row: scanned, failed (symbols with an error), number of symbols of each bias among the rest, and overall, a sentence of them.

    An empty brief gives zeros.
    """
    ok = F.col("error").isNull()
    sides = {bias: F.count_if(ok & (F.col("bias") == bias)).alias(bias) for bias in ("bullish", "bearish", "neutral")}
    counts = brief.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~ok).alias("failed"), *sides.values())
    read = F.when(F.col("bullish") > F.col("bearish"), "bullish").when(F.col("bearish") > F.col("bullish"), "bearish").otherwise("neutral")
    return counts.withColumn("overall", F.format_string("OVERALL: %s (%d bullish, %d bearish, %d neutral)", read, *sides))


def brief_of_rules(spark: SparkSession, rules: dict, bars: DataFrame, levels: DataFrame) -> DataFrame:
    """The morning brief of the rules' watchlist at their default time frame, in the watchlist's order (seq).

    bars hold any resolutions; only those of the time frame are read. A symbol that is listed
    twice is briefed twice.
    """
    watched = rules_watchlist(spark, rules)
    at = bars.where(F.col("resolution") == rules["default_timeframe"])
    brief = morning_brief(watched.select("symbol").distinct(), at, levels)
    return watched.join(brief, "symbol").withColumn("timeframe", F.lit(rules["default_timeframe"]))


def get_session(store: DataFrame, date: str, days_back: int = 1) -> DataFrame:
    """The session of the date, else the latest within days_back before it, with a note; no row if there is none."""
    day = F.to_date(F.lit(date))
    near = store.where(F.to_date("date").between(F.date_sub(day, days_back), day))
    one = near.groupBy().agg(F.max_by(F.struct(*near.columns), "date").alias("s")).where("s is not null").select("s.*")
    return one.withColumn("note", F.when(F.col("date") != date, F.concat(F.lit("no session for "), F.lit(date), F.lit("; this is an earlier one"))))


def day_over_day(sessions: DataFrame) -> DataFrame:
    """sessions (symbol, date, bias) with previous_bias and changed."""
    before = F.lag("bias").over(Window.partitionBy("symbol").orderBy("date"))
    return sessions.withColumns({"previous_bias": before, "changed": F.coalesce(before != F.col("bias"), F.lit(False))})


def batch_scan(symbols: DataFrame, timeframes: list[str], bars: DataFrame, action: str = "ohlcv", trades: DataFrame | None = None) -> DataFrame:
    """Every symbol at every time frame: its summary (ohlcv) or its strategy metrics (strategy), or an error."""
    if action == "ohlcv":
        return scan_grid(symbols, timeframes, ohlcv_summary(bars))
    if action == "strategy":
        return scan_grid(symbols, timeframes, strategy_metrics(trades, KEY))
    grid = scan_grid(symbols, timeframes, symbols.limit(0).select("symbol", F.lit("").alias("resolution")))
    return grid.withColumn("error", F.lit(f"Unknown action: {action}"))


def scalper_backtest(bars: DataFrame) -> DataFrame:
    """The scalper's log: signal, action and skip reason of every bar."""
    return position_machine(scalper_signal(bars))


def backtest_log(bars: DataFrame, quote: float = 100.0) -> DataFrame:
    """The scalper's log with balances, a row for each bar: tick (from 1), indicators, signal, side, size, order_placed, filled, balances after, skip_reason.

    side and size (text) are of orders that the balance before allows; a turn that it doesn't is
    skipped for that reason.
    """
    log = scalper_backtest(bars)
    orders = position_fold(log, quote).select(*KEY, "ts", "side", "filled", "quote_after", "base_after")
    log = log.join(orders, [*KEY, "ts"], "left")
    seen = {"_quote": ("last", F.col("quote_after")), "_base": ("last", F.col("base_after"))}
    log = running(running(log, {"tick": ("sum", F.lit(1).cast("long"))}, KEY, ["ts"], month()), seen, KEY, ["ts"], month(), before=True)
    log = order_size(log.withColumns({"_quote": F.coalesce("_quote", F.lit(quote)), "_base": F.coalesce("_base", F.lit(0.0))}), "side", "_quote", "_base")
    placed = F.col("side").isNotNull()
    return log.select(
        *KEY, "tick", "ts", F.col("close").alias("price"), "ema8", "rsi3", "vwap", "signal", "side", "size",
        placed.alias("order_placed"), F.coalesce("filled", F.lit(0.0)).alias("filled"),
        F.coalesce("quote_after", "_quote").alias("quote_after"), F.coalesce("base_after", "_base").alias("base_after"),
        F.when(~placed, F.coalesce("skip_reason", F.lit(NO_BALANCE))).alias("skip_reason"),
    )


def backtest_totals(log: DataFrame) -> DataFrame:
    """ticks, orders placed and the last price of each symbol's log."""
    return log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("ticks"), F.count_if(F.col("action") != "skip").alias("placed"), F.max_by("close", "ts").alias("last_price"))


def backtest_accounts(bars: DataFrame, quote: float = 100.0) -> DataFrame:
    """A row for each symbol that the scalper traded from this balance: orders, quote_after, base_after, last_price, total_value."""
    orders = position_fold(scalper_signal(bars), quote)
    ends = orders.groupBy("symbol").agg(F.count(F.lit(1)).alias("orders"), F.max_by("quote_after", "ts").alias("quote_after"), F.max_by("base_after", "ts").alias("base_after"))
    prices = latest_bars(bars).select(F.col("symbol").alias("coin"), F.col("close").alias("price"))
    cash = F.struct(F.lit("cash").alias("coin"), F.col("quote_after").alias("qty"))
    held = ends.select(F.col("symbol").alias("account"), F.explode(F.array(cash, F.struct(F.col("symbol").alias("coin"), F.col("base_after").alias("qty")))).alias("h")).select("account", "h.*")
    worth = account_value(held, prices.unionByName(bars.sparkSession.createDataFrame([("cash", 1.0)], "coin string, price double"))).withColumnRenamed("account", "symbol")
    last = prices.select(F.col("coin").alias("symbol"), F.col("price").alias("last_price"))
    return ends.join(worth, "symbol").join(last, "symbol")


def replay_step(bars: DataFrame, start: str | None, steps: int = 0) -> DataFrame:
    """For each symbol the bar that a replay from start is at after steps; error where there is none.

    The first bar from start on is where it begins; without a start, the first of all.
    """
    begin = bars if start is None else bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    at = begin.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("ts")) - 1).where(F.col("_n") == steps).drop("_n")
    keys = bars.select(*KEY).distinct()
    out = keys.join(at, list(KEY), "left")
    return out.withColumn("error", F.when(F.col("ts").isNull(), "no bar at or after the date"))

