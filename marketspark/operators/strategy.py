"""Strategy reports over trades (strategy, side, entry_ts, exit_ts, pnl, trade_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import joined_on, longest_runs, parted, running, runs_in, with_runs
from .recurrence import month

STRATEGY = ("strategy",)
ORDER = ("exit_ts", "trade_id")
CAPITAL = 10_000.0
CHUNK_SECONDS = 30 * 86_400


def _metrics(capital: float) -> list[Column]:
    pnl = F.col("pnl")
    win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    number = lambda c: c.cast("double")
    average = number(F.sum(pnl)) / F.count(F.lit(1))
    deviation = F.stddev_samp(number(pnl))
    return [
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(pnl > 0).alias("wins"),
        F.count_if(pnl < 0).alias("losses"),
        number(F.sum(pnl)).alias("net_profit"),
        (number(F.sum(pnl)) / capital * 100).alias("return_pct"),
        (F.count_if(pnl > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.try_divide(number(F.sum(win)), -number(F.sum(loss))).alias("profit_factor"),
        average.alias("avg_trade"),
        F.try_divide(number(F.sum(win)), F.count(win)).alias("avg_win"),
        F.try_divide(number(F.sum(loss)), F.count(loss)).alias("avg_loss"),
        F.try_divide(F.try_divide(number(F.sum(win)), F.count(win)), F.try_divide(-number(F.sum(loss)), F.count(loss))).alias("reward_risk"),
        number(F.max(win)).alias("largest_win"),
        number(F.min(loss)).alias("largest_loss"),
        F.when((F.count(F.lit(1)) >= 2) & (deviation > 0), average / F.nullif(deviation, F.lit(0.0))).alias("sharpe"),
    ]


def strategy_metrics(trades: DataFrame, keys=STRATEGY, capital: float = CAPITAL) -> DataFrame:
    """A row for each strategy; ratios without a divisor are null. One grouping, summed before the shuffle."""
    return trades.groupBy(*keys).agg(*_metrics(capital))


def long_short_breakdown(trades: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """The metrics of each side and of each strategy as a whole (side 'all')."""
    rolled = trades.rollup("strategy", "side").agg(F.grouping_id().alias("_g"), *_metrics(capital)).where("_g < 3")
    return rolled.withColumn("side", F.when(F.col("_g") == 0, F.col("side")).otherwise("all")).drop("_g")


def equity_curve(trades: DataFrame, keys=STRATEGY, capital: float = CAPITAL) -> DataFrame:
    """trades with equity, peak, drawdown (0 at a peak) and drawdown_pct, in trade order.

    Months are summed up first, by their result and the highest sum inside; each month's trades
    then start from the equity and the peak that the months before have left.
    """
    work, by, back = parted(trades, keys, month("exit_ts"))
    return _curve_in(_sums_in(work, by), by, capital).select(*(back.get(c, c) for c in trades.columns), "equity", "peak", "drawdown", "drawdown_pct")


def _sums_in(work: DataFrame, by: list[str]) -> DataFrame:
    """Trades in parts with _sum (their part's results so far) and _high, the highest of these so far."""
    inside = Window.partitionBy(*by).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("_sum", F.coalesce(F.sum("pnl").over(inside), F.lit(0)))
    return work.withColumn("_high", F.max("_sum").over(inside))


def _curve_in(work: DataFrame, by: list[str], capital: float) -> DataFrame:
    """equity_curve of what _sums_in gives, with _own: whether the peak is of the part itself. One shuffle and one order serve both passes."""
    start = F.lit(capital).cast("decimal(18,2)")
    ends = work.groupBy(*by).agg(F.sum("pnl").alias("_total"), F.max("_high").alias("_top"))
    earlier = Window.partitionBy(*by[:-1]).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_held", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    carried = ends.select(*by, "_held", F.max((F.col("_held") + F.col("_top") + start).cast("double")).over(earlier).alias("_peak"))
    out = work.join(carried, by, "left")
    out = out.withColumn("equity", (F.col("_held") + F.col("_sum") + start).cast("double"))
    high = (F.col("_held") + F.col("_high") + start).cast("double")
    out = out.withColumn("peak", F.greatest(F.lit(float(capital)), "_peak", high)).withColumn("_own", high >= F.col("peak"))
    out = out.withColumn("drawdown", F.col("equity") - F.col("peak")).drop("_held", "_peak")
    return out.withColumn("drawdown_pct", F.col("drawdown") / F.col("peak") * 100)


def drawdown_summary(curve: DataFrame, keys=STRATEGY) -> DataFrame:
    """max_drawdown, max_drawdown_pct (both at most 0) and longest_drawdown, in points under the peak."""
    least = curve.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"), F.min("drawdown_pct").alias("max_drawdown_pct"))
    return joined_on(least, longest_runs(curve, {"longest_drawdown": F.col("drawdown") < 0}, keys, ORDER, month("exit_ts")), keys)


def max_consecutive_losses(trades: DataFrame, keys=STRATEGY) -> DataFrame:
    """The longest run of losses in trade order; trades at 0 break it."""
    return longest_runs(trades, {"max_consecutive_losses": F.col("pnl") < 0}, keys, ORDER, month("exit_ts"))


def time_in_market(trades: DataFrame, keys=STRATEGY) -> DataFrame:
    """Share of the time from first entry to last exit that any trade covers; null for no time."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    spans = trades.select(*keys, seconds("entry_ts").alias("_a"), seconds("exit_ts").alias("_b"))
    seen = running(spans, {"_reached": ("max", F.col("_b"))}, keys, ["_a", "_b"], F.floor(F.col("_a") / CHUNK_SECONDS), before=True)
    new = F.greatest(F.lit(0), F.col("_b") - F.greatest("_a", "_reached"))
    return seen.groupBy(*keys).agg(F.try_divide(F.sum(new), F.max("_b") - F.min("_a")).alias("time_in_market"))


def report_flags(metrics: DataFrame, few: int = 30) -> DataFrame:
    """metrics with flags, an array of names; needs win_rate, profit_factor, max_drawdown_pct, total_trades."""
    pf = F.col("profit_factor")
    flags = (
        F.when((F.col("win_rate") < 0.5) & (pf > 1), F.lit("tighter_entries")),
        F.when(F.col("max_drawdown_pct") < -20, F.lit("position_sizing")),
        F.when(pf < 1.2, F.lit("fundamental")),
        F.when(F.col("total_trades") < few, F.lit("few_trades")),
    )
    return metrics.withColumn("flags", F.array_compact(F.array(*flags)))


def order_stats(log: DataFrame) -> DataFrame:
    """Rows by skip reason (null where not skipped) with placed and total."""
    return log.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("order_placed")).alias("placed"))


def practice_report(trades: DataFrame, keys=("session",)) -> DataFrame:
    """Trades, wins, losses and net result of each practice session."""
    return trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), F.sum("pnl").cast("double").alias("net_pnl"))


def loss_streak_stop(trades: DataFrame, keys=STRATEGY, streak: int = 2) -> DataFrame:
    """trades with blocked: whether streak losses in a row were seen earlier that day."""
    day = Window.partitionBy(*keys, F.to_date("exit_ts")).orderBy("exit_ts", "trade_id")
    lost = F.when(F.col("pnl") < 0, 1).otherwise(0)
    ended = F.sum(lost).over(day.rowsBetween(-(streak - 1), 0)) == streak
    out = trades.withColumn("_s", F.when(ended, 1).otherwise(0))
    return out.withColumn("blocked", F.coalesce(F.max("_s").over(day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1).drop("_s")


def open_positions(trades: DataFrame, keys=STRATEGY, most: int = 2) -> DataFrame:
    """strategy, ts, n_open, breach: after each time at which positions open or close; exits come off at their time."""
    move = lambda c, d: F.struct(F.col(c).alias("ts"), F.lit(d).alias("_d"))
    steps = trades.select(*keys, F.inline(F.array(move("entry_ts", 1), move("exit_ts", -1))))
    # Steps are sorted, not grouped, by their time, as a sort can spill; the last one of a time is told by the next.
    seen = running(steps, {"n_open": ("sum", F.col("_d"))}, keys, ["ts"], month(), peers=True)
    return seen.drop("_d").withColumn("breach", F.col("n_open") > most)


def trade_rate_limit(trades: DataFrame, keys=STRATEGY, most: int = 6, seconds: int = 60) -> DataFrame:
    """trades with recent (entries in the last seconds, this one included) and over_limit."""
    at = trades.withColumn("_t", F.unix_seconds(F.col("entry_ts").cast("timestamp")))
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-(seconds - 1), 0)
    return at.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("over_limit", F.col("recent") > most).drop("_t")


def session_open_block(trades: DataFrame, opens: str = "14:30", minutes: int = 15) -> DataFrame:
    """trades with blocked: entered in the first minutes after the session opens, in UTC."""
    hour, minute = (int(x) for x in opens.split(":"))
    into = F.hour("entry_ts") * 60 + F.minute("entry_ts") - (hour * 60 + minute)
    return trades.withColumn("blocked", (into >= 0) & (into < minutes))


def first_trades(trades: DataFrame, n: int | None = 20, keys=STRATEGY) -> DataFrame:
    """The first n trades (20 at most) of each strategy, in order."""
    w = Window.partitionBy(*keys).orderBy("exit_ts", "trade_id")
    return trades.withColumn("trade_no", F.row_number().over(w)).where(F.col("trade_no") <= min(n or 20, 20))


def rank_scan(results: DataFrame, metric: str, by=("resolution",), top: int | None = None) -> DataFrame:
    """results with rank by metric, the largest first, in each group."""
    ranked = results.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(metric))))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def strategy_report(trades: DataFrame, keys=STRATEGY, capital: float = CAPITAL) -> DataFrame:
    """Metrics, drawdowns, longest losing run, time in market and flags in one row for each strategy.

    Trades are shuffled once by strategy and month, and their spans without results once more; a
    strategy's whole time is a row for each month, its metrics are summed before the shuffle.
    """
    work, by, back = parted(trades, keys, month("exit_ts"))
    least = ("max_drawdown", "max_drawdown_pct")
    runs = ("longest_drawdown", "max_consecutive_losses")
    # A part's highest sums so far, where they are the peak, end drawdowns. So what needs the order is known before the months meet.
    work = with_runs(_sums_in(work, by), by, {"low": F.col("_sum") < F.col("_high"), runs[1]: F.col("pnl") < 0}, ORDER)
    curve = _curve_in(work, by, capital)
    curve = curve.withColumns({
        "_stop_longest_drawdown": F.when(~F.coalesce(F.col("drawdown") < 0, F.lit(False)), F.col("_at")),
        "_run_longest_drawdown": F.when(F.col("_own"), F.col("_run_low")).otherwise(F.col("_at")),
        "max_drawdown": F.col("drawdown"),
        "max_drawdown_pct": F.col("drawdown_pct"),
    })
    found = runs_in(curve, by, runs, least).select(*(back[k] for k in keys), *least, *runs)
    return report_flags(joined_on(joined_on(strategy_metrics(trades, keys, capital), found, keys), time_in_market(trades, keys), keys))
