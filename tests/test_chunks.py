"""Chunked scans, blocks with halos, aligned pieces and the span tree against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.operators import chunks as C
from marketspark.operators import dyadic as Y
from marketspark.operators import matching as M
from marketspark.operators.renko import clamps, renko_on_grid

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, resolution string, ts timestamp_ntz, close double"


def hours():
    return F.date_trunc("hour", "ts")


def bars_of(spark, closes, symbol="A", minutes=7):
    rows = [(symbol, "1", T0 + dt.timedelta(minutes=minutes * k), c) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def bricks(closes, brick):
    """Brick by brick, in whole bricks from the first close."""
    low = high = 0
    out = []
    for c in closes:
        x = (c - closes[0]) / brick
        while x >= high + 1:
            out.append((high, high + 1))
            low, high = high, high + 1
        while x <= low - 1:
            out.append((low, low - 1))
            low, high = low - 1, low
    return [(closes[0] + a * brick, closes[0] + b * brick) for a, b in out]


def test_clamps_compose():
    rng = np.random.default_rng(1)
    low = rng.integers(-9, 9, 50)
    high = low + rng.integers(0, 4, 50)
    a, b = clamps(low, high)
    for start in (-20, -1, 0, 3, 20):
        at = start
        for k in range(50):
            at = max(low[k], min(high[k], at))
            assert max(a[k], min(b[k], start)) == at


@pytest.mark.parametrize("seed, step", [(1, 3), (2, 1), (3, 12)])
def test_renko_over_chunks(spark, seed, step):
    rng = random.Random(seed)
    closes = [16.0]
    for _ in range(300):
        closes.append(closes[-1] + rng.randrange(-step, step + 1) / 2)
    closes += [16.25, float("nan"), None, 200.0, -200.0]
    df = bars_of(spark, closes).unionByName(bars_of(spark, [1.0, 1.5, 1.9], "flat")).repartition(3)
    plain = [c for c in closes if c is not None and c == c]
    for chunk in (hours(), None):
        got = renko_on_grid(df, 2.0, chunk).orderBy("brick_no").collect()
        assert [r["brick_no"] for r in got] == list(range(len(got)))
        assert [(r["open"], r["close"]) for r in got] == bricks(plain, 2.0)


def test_running_values_over_chunks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(900)), k, rng.choice([None, 1, -2, 5, 0])) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v long").repartition(3)
    for before in (False, True):
        w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        v = F.col("v")
        want = df.withColumns({"s": F.sum(v).over(w), "m": F.max(v).over(w), "l": F.last(v, ignorenulls=True).over(w)})
        got = C.running(df, {"s": ("sum", v), "m": ("max", v), "l": ("last", v)}, ["k"], ["ts", "id"], hours(), before)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blocks_hold_the_rows_before(spark):
    rng = random.Random(6)
    df = bars_of(spark, [rng.random() for _ in range(200)]).unionByName(bars_of(spark, [1.0, 2.0], "B")).repartition(3)

    def trailing(d, w):
        last = w.rowsBetween(-6, 0)
        return d.withColumns({"total": F.sum("close").over(last), "n": F.count(F.lit(1)).over(last), "before": F.lag("close").over(w)})

    want = trailing(df, Window.partitionBy("symbol", "resolution").orderBy("ts"))
    for block_rows in (7, 10, 50_000):
        got = C.in_blocks(df, 6, trailing, block_rows)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        C.in_blocks(df, 6, trailing, 6)


def test_pieces_cover_a_range_once(spark):
    rng = random.Random(7)
    ranges = [(0, 0), (-1, 0), (3, 2), (0, 15), (1, 15), (0, 10**9), (-(10**9), 10**9 + 1), (None, 1)] + [(a, a + rng.randrange(200)) for a in (rng.randrange(-300, 300) for _ in range(60))]
    df = spark.createDataFrame(ranges, "a long, b long")
    for bits, levels in ((1, 62), (4, 4), (4, 62)):
        for r in df.withColumn("p", Y.pieces(F.col("a"), F.col("b"), bits, levels)).collect():
            if r["a"] is None:
                assert r["p"] is None
                continue
            covered = sorted((p["piece"] << (bits * p["level"]), (p["piece"] + 1) << (bits * p["level"])) for p in r["p"]) if levels == 62 or r["b"] - r["a"] < 10**6 else None
            if covered is not None:
                assert covered == [] if r["a"] > r["b"] else (covered[0][0], covered[-1][1]) == (r["a"], r["b"] + 1)
                assert all(x[1] == y[0] for x, y in zip(covered[:-1], covered[1:], strict=True))
            if bits == 1:
                assert len(r["p"]) <= 60


def test_wide_bars_and_zones(spark):
    rng = random.Random(8)
    ends = [(rng.choice("AB"), float(a), a + rng.choice([0.0, 0.5, 7.0, 1e9])) for a in (rng.uniform(-50, 50) for _ in range(80))]
    odd = [("A", 5.0, 4.0), ("A", None, 4.0), ("A", float("nan"), 4.0), ("A", 1.0, float("inf")), ("A", 3.0, 3.0), ("A", 3.0, 3.0)]
    bars = spark.createDataFrame(ends[:50] + odd, "symbol string, low double, high double")
    zones = spark.createDataFrame(ends[30:] + odd, "symbol string, zone_low double, zone_high double")
    fine = [e for e in odd if e[1] == 3.0]
    want = sorted((s, a, b, c, d) for s, a, b in ends[:50] + fine for t, c, d in ends[30:] + fine if s == t and a <= d and b >= c)
    got = M.zone_touch(bars, zones)
    assert sorted((r["symbol"], r["low"], r["high"], r["zone_low"], r["zone_high"]) for r in got.collect()) == want


def test_alerts_by_the_span_tree(spark):
    """Paths that touch, leave and cross the price, over years of spans."""
    rng = random.Random(9)
    series, close = [], 50
    for k in range(900):
        close = min(60, max(40, close + rng.choice([-1, 0, 0, 1])))
        series.append((T0 + dt.timedelta(days=3 * k, hours=rng.randrange(24)), float(close)))
    series.append((series[-1][0] + dt.timedelta(days=2000), 75.0))
    bars = spark.createDataFrame([("A", "D", ts, c) for ts, c in series], BAR).repartition(3)
    alerts = []
    for k in range(150):
        created = T0 + dt.timedelta(days=rng.randrange(-40, 2800), hours=rng.randrange(24))
        ends = rng.choice([None, created, created + dt.timedelta(days=40), created + dt.timedelta(days=1500), created - dt.timedelta(days=1)])
        alerts.append((k, "A", rng.choice([38.0, 40.0, 41.0, 45.5, 50.0, 59.0, 60.0, 74.0, 75.0]), created, ends, rng.choice(["crossing", "greater_than", "less_than"]), k % 9 != 0))
    out = M.eval_alerts(bars, spark.createDataFrame(alerts, "alert_id long, symbol string, price double, created timestamp_ntz, expiration timestamp_ntz, condition string, active boolean"))
    want = {}
    for k, _, p, created, ends, kind, active in alerts:
        if active:
            want[k], before = None, None
            for ts, c in series:
                crossed = before is not None and (before < p <= c or before > p >= c)
                if created <= ts and (ends is None or ts <= ends) and {"crossing": crossed, "greater_than": c > p, "less_than": c < p}[kind]:
                    want[k] = ts
                    break
                before = c
    assert len({v for v in want.values()}) > 20
    assert {r["alert_id"]: r["fired_ts"] for r in out.collect()} == want


def test_runs_and_equity_over_months(spark):
    from decimal import Decimal

    from marketspark.operators import strategy as S

    rng = random.Random(10)
    rows = []
    for name in ("a", None, "lost"):
        for k in range(150):
            out = T0 + dt.timedelta(days=rng.randrange(400))
            rows.append((name, "long", out - dt.timedelta(days=rng.randrange(60)), out, Decimal(-5 if name == "lost" else rng.choice([-700, -300, 0, 200, 800])), f"{k:04d}"))
    trades = spark.createDataFrame(rows, "strategy string, side string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, pnl decimal(18,2), trade_id string").repartition(3)
    want = {}
    for name in ("a", None, "lost"):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (r[3], r[5]))
        equity = peak = 1000.0
        under = losing = longest = most = 0
        least, least_pct, reached, covered = 0.0, 0.0, None, 0
        for r in own:
            equity += float(r[4])
            peak = max(peak, equity)
            under = under + 1 if equity < peak else 0
            losing = losing + 1 if r[4] < 0 else 0
            longest, most = max(longest, under), max(most, losing)
            least, least_pct = min(least, equity - peak), min(least_pct, (equity - peak) / peak * 100)
        for r in sorted(own, key=lambda r: r[2]):
            begin = r[2] if reached is None else max(r[2], reached)
            covered += max(0.0, (r[3] - begin).total_seconds())
            reached = r[3] if reached is None else max(reached, r[3])
        time = (max(r[3] for r in own) - min(r[2] for r in own)).total_seconds()
        want[name] = (least, least_pct, longest, most, covered / time)
    got = {r["strategy"]: r for r in S.strategy_report(trades, capital=1000.0).collect()}
    assert set(got) == set(want) and want["lost"][3] == 150
    for name, values in want.items():
        r = got[name]
        assert (r["longest_drawdown"], r["max_consecutive_losses"]) == values[2:4]
        assert (r["max_drawdown"], r["max_drawdown_pct"], r["time_in_market"]) == pytest.approx((*values[:2], values[4]))
    assert S.strategy_report(trades.limit(0)).count() == 0


def test_no_window_over_a_whole_symbol(spark):
    """Windows that hold bars are by block or chunk; those by symbol alone hold a row for each chunk."""
    import re

    from marketspark.operators import signals as G

    bars = bars_of(spark, [1.0, 2.0, 3.0]).withColumns({c: F.col("close") for c in ("open", "high", "low", "volume")})
    plan = G.position_machine(G.scalper_signal(bars))._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[(.*)\], \[(.*?)\], \[(.*?)\]", plan)
    assert len(windows) > 5
    for values, by, order in windows:
        assert "_block" in by or "_chunk" in by or "_chunk" in order, (values, by)


def test_correlations_by_tiles(spark):
    rng = random.Random(11)
    rows = [(s, "60", T0 + dt.timedelta(hours=h), rng.uniform(50, 60)) for s in "abcdefghij" for h in range(120) if rng.random() < 0.7]
    rows += [("flat", "60", T0 + dt.timedelta(hours=h), 5.0) for h in range(60)] + [("few", "60", T0 + dt.timedelta(hours=h), 5.0 + h) for h in range(3)]
    returns = {}
    for s, _, ts, close in sorted(rows, key=lambda r: (r[0], r[2])):
        series = returns.setdefault(s, [[], None])
        if series[1] is not None:
            series[0].append((ts, (close - series[1]) / series[1]))
        series[1] = close
    want = {}
    for a in returns:
        for b in returns:
            x, y = dict(returns[a][0]), dict(returns[b][0])
            both = sorted(set(x) & set(y))
            if a < b and len(both) >= 3:
                c = None if "flat" in (a, b) else np.corrcoef([x[t] for t in both], [y[t] for t in both])[0, 1]
                want[a, b] = (len(both), c)
    df = spark.createDataFrame(rows, BAR).repartition(3)
    got = {(r["symbol_a"], r["symbol_b"]): (r["n"], r["corr"]) for r in M.pair_correlation(df, tile=3, chunk="day").collect()}
    assert set(got) == set(want) and len(want) > 45
    for pair, (n, c) in want.items():
        assert got[pair][0] == n and got[pair][1] == (None if c is None else pytest.approx(c, abs=1e-9))
    with pytest.raises(ValueError):
        M.pair_correlation(df, most_symbols=11)


def shuffled(spark, df):
    """Columns of each shuffle of a plan, reused ones once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        todo, found = [df.select("*")._jdf.queryExecution().executedPlan()], []
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append(node.output().mkString(","))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_report_shuffles_its_trades_once(spark):
    from marketspark.operators import strategy as S

    trades = spark.range(50).selectExpr("concat('s', id % 3) strategy", "'long' side", "timestamp_ntz'2024-01-01' + make_dt_interval(id) entry_ts", "timestamp_ntz'2024-01-05' + make_dt_interval(id) exit_ts", "cast(id % 5 - 2 as decimal(18,2)) pnl", "cast(id as string) trade_id")
    assert sum("trade_id" in columns for columns in shuffled(spark, S.strategy_report(trades))) == 1
    assert sum("trade_id" in columns for columns in shuffled(spark, S.equity_curve(trades).select("strategy", "trade_id", "exit_ts", "equity"))) == 1


def test_open_positions_over_months(spark):
    """Times that several trades share, null strategies and times, and no hash table of a strategy's times."""
    from marketspark.operators import strategy as S

    rng = random.Random(12)
    rows = []
    for name in ("a", None, "0", ""):
        for _ in range(120):
            begin = T0 + dt.timedelta(days=rng.randrange(150), hours=12 * rng.randrange(2))
            rows.append((name, begin, begin + dt.timedelta(days=rng.randrange(40))))
    rows += [("a", None, T0), (None, T0, None), ("a", T0 - dt.timedelta(days=30), T0 - dt.timedelta(days=30))]
    want = []
    for name in ("a", None, "0", ""):
        steps = {}
        for n, begin, end in rows:
            if n == name:
                steps[begin] = steps.get(begin, 0) + 1
                steps[end] = steps.get(end, 0) - 1
        count = 0
        for ts in sorted(steps, key=lambda t: (t is not None, t)):
            count += steps[ts]
            want.append((name, ts, count, count > 2))
    out = S.open_positions(spark.createDataFrame(rows, "strategy string, entry_ts timestamp_ntz, exit_ts timestamp_ntz").repartition(3))
    assert out.columns == ["strategy", "ts", "n_open", "breach"] and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    aggregates = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert aggregates and all("_chunk" in line.split("], [")[0] and "ts#" not in line.split("], [")[0] for line in aggregates), aggregates
