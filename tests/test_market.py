"""Market-data operators on small inputs worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketspark.functions import scalars as S
from marketspark.operators import bars as B
from marketspark.operators import depth as D
from marketspark.operators import drawings as R
from marketspark.operators import indicators as I  # noqa: E741
from marketspark.operators import lint as L
from marketspark.operators import matching as M
from marketspark.operators import signals as G
from marketspark.operators import strategy as Y
from marketspark.operators import studies as V
from marketspark.operators.recurrence import linrec, places
from marketspark.plans import workflows as P
from marketspark.sources import files

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def bars_of(spark, closes, symbol="A", volume=10.0, step=1):
    rows = [(symbol, "1", at(k * step), c, c + 1, c - 1, c, volume) for k, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, resolution string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_summary_of_three_bars(spark):
    rows = [("A", "1", at(0), 10.0, 11.0, 9.5, 10.5, 100.0), ("A", "1", at(1), 10.5, 10.8, 10.1, 10.2, 50.0), ("A", "1", at(2), 10.2, 10.4, 9.0, 9.25, None)]
    df = spark.createDataFrame(rows, "symbol string, resolution string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    r = B.ohlcv_summary(files.clean_bars(df)).first()
    assert (r["bar_count"], r["open"], r["close"], r["high"], r["low"], r["range"], r["change"], r["change_pct"], r["avg_volume"]) == (3, 10.0, 9.25, 11.0, 9.0, 2.0, -0.75, "-7.5%", 50.0)
    assert [b["close"] for b in r["last_5_bars"]] == [10.5, 10.2, 9.25]


def test_rounding_follows_javascript(spark):
    x = spark.createDataFrame([(-2.5, 1.005)], "a double, b double")
    assert x.select(S.js_round(F.col("a")), S.js_round(F.col("b"), 2)).first()[:] == (-2.0, 1.0)


def test_unknown_resolution_is_an_error(spark):
    with pytest.raises(ValueError):
        B.bucket("ts", "x")
    with pytest.raises(Exception, match="unknown resolution"):
        spark.createDataFrame([("x",)], "c string").select(S.resolution_seconds(F.col("c"))).collect()


def test_ema_rsi_vwap(spark):
    assert column(I.ema(bars_of(spark, [10, 11, 12]), 3), "ema3") == [10, 10.5, 11.25]
    for closes, want in (([1, 2, 3], 50), ([1, 2, 3, 4], 100), ([5, 5, 5, 5], 100), ([4, 5, 4, 5], 200 / 3), ([4, 3, 2, 1], 0)):
        assert column(I.rsi_simple(bars_of(spark, closes)), "rsi3")[-1] == pytest.approx(want)
    two = spark.createDataFrame([("A", "1", at(0), 2.0, 3.0, 1.0, 2.0, 10.0), ("A", "1", at(1), 5.0, 6.0, 3.0, 6.0, 30.0)], bars_of(spark, [1]).schema)
    assert I.vwap(two).first()["vwap"] == 4.25
    assert I.vwap(bars_of(spark, [3, 7], volume=0.0)).first()["vwap"] == 7.0


def test_signal_truth_table(spark):
    df = spark.createDataFrame([("A", "1", at(k), s) for k, s in enumerate("sell buy buy flat sell sell buy".split())], "symbol string, resolution string, ts timestamp_ntz, signal string")
    out = G.position_machine(df)
    assert column(out, "action") == ["skip", "buy", "skip", "skip", "sell", "skip", "buy"]
    assert column(out, "skip_reason")[3] == G.NO_SIGNAL


def test_recurrence_in_chunks_is_the_recurrence(spark):
    closes = [float((k * 37) % 101) for k in range(400)]
    bars = bars_of(spark, closes, step=60 * 24)
    whole = column(I.history(bars, emas={"e": 10}), "e")
    value, want = closes[0], []
    for c in closes:
        value = value if not want else c * 2 / 11 + value * (1 - 2 / 11)
        want.append(value)
    assert whole == pytest.approx(want, rel=1e-9)
    numbered = places(bars, "close")
    assert [r[:] for r in numbered.orderBy("ts").select("_n", "_before").collect()] == [(k + 1, closes[k - 1] if k else None) for k in range(400)]
    one = linrec(numbered, [(F.when(F.col("_n") == 1, 0.0).otherwise(0.5), F.col("close"), "y")], chunk=F.lit(0))
    many = linrec(numbered, [(F.when(F.col("_n") == 1, 0.0).otherwise(0.5), F.col("close"), "y")], chunk=F.floor(F.col("_n") / 7))
    assert column(one, "y") == pytest.approx(column(many, "y"), rel=1e-9)


def test_resample_keeps_volume_and_extremes(spark):
    bars = bars_of(spark, range(1, 200))
    for code in ("15", "60", "D", "W", "M"):
        out = B.resample(bars, code).agg(F.sum("volume"), F.max("high"), F.min("low")).first()
        assert out[:] == (1990.0, 200.0, 0.0)
    ok = B.resample(bars, "15").where("high < greatest(open, close) or low > least(open, close)")
    assert ok.count() == 0


def test_safety_check_example(spark):
    df = spark.createDataFrame([(68334.79, 68314.99, 67981.18, 69116.13, 51.95, 385.87, 421.52)], "price double, ema21 double, ema50 double, ema200 double, rsi14 double, macd_line double, signal_line double")
    r = G.safety_check(df).first()
    assert r["verdict"] == "BLOCKED" and len(r["blocked_reasons"]) == 3
    assert {k: v["result"] for k, v in r["conditions"].items()} == {"price_above_ema200": "FAIL", "ema21_above_ema50": "PASS", "price_in_ema21_50_zone": "FAIL", "rsi_35_to_58": "PASS", "macd_above_signal": "FAIL"}


def test_drawings(spark):
    lines = spark.createDataFrame([("s", 100.004, 100.004), ("s", 100.001, 100.001), ("s", 105.0, 105.0), ("s", 101.0, 99.0)], "study string, y1 double, y2 double")
    assert R.horizontal_levels(lines).first()[:] == ("s", [105.0, 100.0], 4)
    boxes = spark.createDataFrame([("s", 10.0, 12.0), ("s", 12.0, 10.0), ("s", 5.0, 6.0)], "study string, y1 double, y2 double")
    zones = R.price_zones(boxes).first()
    assert ([tuple(z) for z in zones["zones"]], zones["total_boxes"]) == ([(12.0, 10.0), (6.0, 5.0)], 3)
    cells = spark.createDataFrame([("s", 0, 0, 0, "a", 1), ("s", 0, 0, 1, "", 2), ("s", 0, 0, 2, "b", 3), ("s", None, 1, 0, "", 4)], "study string, tid int, row int, col int, text string, seq int")
    assert [r["line"] for r in R.table_rows(cells).collect()] == ["a | b"]


def test_depth(spark):
    rows = [("A", 0, "bid", "99.5", "10"), ("A", 1, "buy", "99.0", None), ("A", 2, "ask", "$100.25", "x"), ("A", 3, "sell", "101", "3"), ("A", 4, "sell", "none", "3")]
    levels = D.classify_depth(spark.createDataFrame(rows, "symbol string, row_index int, class_text string, price_text string, size_text string"))
    assert D.depth_summary(levels).first()[:] == ("A", 99.5, 100.25, 2, 2, 0.75)
    book = D.depth_book(levels).first()
    assert [b["price"] for b in book["bids"]] == [99.5, 99.0] and [a["price"] for a in book["asks"]] == [100.25, 101.0]


def test_inputs(spark):
    df = spark.createDataFrame([([("text", "x" * 201), ("other", "y" * 201), ("long", "z" * 501), ("length", "14")],)], "inputs array<struct<id:string,value:string>>")
    assert [i["id"] for i in df.select(V.trim_inputs(F.col("inputs"))).first()[0]] == ["other", "length"]
    r = V.override_inputs(df, {"length": "50", "nope": "1"}).first()
    assert r["updated"] == ["length"] and r["inputs"][3]["value"] == "50"
    with pytest.raises(ValueError):
        V.override_inputs(df, {})


LINT = [
    ('//@version=6\nindicator("x")\na = array.from(1, 2, 3)\nplot(array.get(a, 1))', []),
    ("//@version=6\na = array.from(1, 2, 3)\nx = array.get(a, 5)", [("error", 3, 5)]),
    ("//@version=6\na = array.from(1, 2)\nx = array.get(a, -1)", [("error", 3, 5)]),
    ("//@version=6\na = array.new_float(3)\narray.set(a, 10, 1.0)", [("error", 3, 1)]),
    ("//@version=6\na = array.new<int>(n)\nx = array.get(a, 99)", []),
    ("//@version=6\na = array.new<int>(0)\nx = a.first()", [("warning", 3, 5)]),
    ("//@version=6\na = array.from()\nx = 1 + a.last()", [("warning", 3, 9)]),
    ("//@version=6\na = array.from(1)\nx = a.first() + a.last()", []),
    ('//@version=6\nindicator("x")\nstrategy.entry("L", strategy.long)\nstrategy.close("L")', [("error", 3, 1)]),
    ('//@version=6\nstrategy("x")\nstrategy.entry("L", strategy.long)', []),
    ("//@version=3\nplot(close)", [("info", 1, 1)]),
    ("//@version=5\nplot(close)", []),
    ("a = array.from(1, 2)\nx = array.get(a, 2) + array.get(a, 7)", [("error", 2, 5), ("error", 2, 23)]),
]


def test_lint_cases(spark):
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(LINT)], "script_id int, source string")
    found = {}
    for r in L.script_lint(df).collect():
        found.setdefault(r["script_id"], []).append((r["severity"], r["line"], r["column"]))
    assert [sorted(found.get(k, [])) for k in range(len(LINT))] == [sorted(want) for _, want in LINT]


def test_strategy_report_on_a_few_trades(spark):
    pnl = ["100", "-50", "-25", "0", "-75", "60"]
    rows = [("s", "long", at(60 * 24 * k), at(60 * 24 * k + 60), p, f"{k}") for k, p in enumerate(pnl)]
    t = spark.createDataFrame(rows, "strategy string, side string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, p string, trade_id string").withColumn("pnl", F.col("p").cast("decimal(18,2)"))
    r = Y.strategy_report(t).first()
    assert (r["total_trades"], r["wins"], r["losses"], r["net_profit"], r["max_consecutive_losses"], r["max_drawdown"], r["longest_drawdown"]) == (6, 2, 3, 10.0, 2, -150.0, 5)
    assert r["profit_factor"] == pytest.approx(160 / 150) and r["flags"] == ["tighter_entries", "fundamental", "few_trades"]
    assert Y.strategy_metrics(t.where("pnl > 0")).first()["profit_factor"] is None


def test_asof_and_sessions(spark):
    left = spark.createDataFrame([("A", at(5), 1), ("A", at(0), 2), ("B", at(9), 3)], "symbol string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("A", at(1), 1.5), ("A", at(5), 2.5)], "symbol string, t timestamp_ntz, v double")
    assert {r["id"]: r["v"] for r in M.asof_join(left, right, "symbol", "ts", "t", ["v"]).collect()} == {1: 2.5, 2: None, 3: None}
    store = spark.createDataFrame([("2024-01-09", "a"), ("2024-01-11", "b")], "date string, brief string")
    assert [r["brief"] for r in P.get_session(store, "2024-01-10").collect()] == ["a"]
    assert P.get_session(store, "2024-01-08").count() == 0


def test_rules_and_logs(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"watchlist": ["A", "B"]}))
    rules = files.load_rules(spark, [f"file://{tmp_path}/none.json", f"file://{tmp_path}/rules.json"])
    assert rules["default_timeframe"] == "240" and files.watchlist(spark, rules).count() == 2
    (tmp_path / "empty.json").write_text('{"watchlist": []}')
    with pytest.raises(ValueError, match="empty.json"):
        files.load_rules(spark, [f"file://{tmp_path}/empty.json"])
    log = spark.createDataFrame([("2024-01-01T00:00:00Z", 1)], "timestamp string, tick int")
    for _ in range(2):
        files.append_log(log, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2
    (tmp_path / "log.json").write_text(json.dumps([{"tick": 1, "side": "buy", "price": 1.5}, {"symbol": "A", "verdict": "BLOCKED", "blocked_reasons": ["x"]}]))
    assert files.read_trade_log(spark, f"file://{tmp_path}/log.json").where("verdict = 'BLOCKED' or side = 'buy'").count() == 2
    new = spark.createDataFrame([("2024-01-02", "now", "b")], "date string, saved_at string, brief string")
    for brief in ("b", "c"):
        files.save_session(new.withColumn("brief", F.lit(brief)), f"file://{tmp_path}/sessions")
    assert [r["brief"] for r in spark.read.parquet(f"file://{tmp_path}/sessions").collect()] == ["c"]


def test_renko_bricks(spark):
    out = B.renko(bars_of(spark, [10, 11, 13, 12, 9.5, 8.9, 12]), 1.0).orderBy("brick_no").collect()
    assert [(r["open"], r["close"]) for r in out] == [(10, 11), (11, 12), (12, 13), (12, 11), (11, 10), (10, 9), (10, 11), (11, 12)]


def test_position_fold_keeps_balances(spark):
    rows = [("A", "1", at(k), s, p) for k, (s, p) in enumerate([("sell", 5.0), ("buy", 2.0), ("buy", 9.0), ("flat", 1.0), ("sell", 4.0)])]
    out = G.position_fold(spark.createDataFrame(rows, "symbol string, resolution string, ts timestamp_ntz, signal string, close double")).orderBy("ts").collect()
    assert [(r["side"], r["size"], r["filled"], r["quote_after"], r["base_after"]) for r in out] == [("buy", 90.0, 45.0, 10.0, 45.0), ("sell", 45.0, 45.0, 190.0, 0.0)]


def test_practice_pnl_nets_at_average_cost(spark):
    bars = bars_of(spark, [10, 12, 13, 9, 20, 8])
    actions = spark.createDataFrame([("s", "A", at(k), k, a) for k, a in enumerate(["buy", "buy", "sell", "close", "sell", "close"])], "session string, symbol string, ts timestamp_ntz, id int, action string")
    out = G.practice_pnl(actions, bars).orderBy("id").collect()
    assert [(r["position"], r["realized_pnl"]) for r in out] == [(1, 0.0), (2, 0.0), (1, 2.0), (0, 0.0), (-1, 0.0), (0, 12.0)]


def test_lint_of_tabs_and_long_literals(spark):
    rows = [(1, '//@version=6\n\tstrategy("x")\r\nstrategy.entry("a")'), (2, "//@version=6\na = array.new_float(2)\nb = array.get(a, 99999999999999999999)\nc = array.get(a, " + "9" * 50 + ")")]
    found = [(r["script_id"], r["line"], r["severity"]) for r in L.script_lint(spark.createDataFrame(rows, "script_id long, source string")).collect()]
    assert sorted(found) == [(2, 3, "error"), (2, 4, "error")]


def test_rounding_of_odd_numbers(spark):
    from marketspark.functions.scalars import js_round

    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (-2.5,), (1.005,), (None,)], "x double")
    got = [r[0] for r in df.select(js_round(F.col("x"), 0)).collect()]
    assert got[0] != got[0] and got[1:] == [float("inf"), 1e300, -2.0, 1.0, None]


def test_one_number_orders_times_and_ties(spark):
    rows = [(at(k % 3), t) for k in range(3) for t in (-(2**63), -5, 0, 9_000_000_000_000_000_000, 2**63 - 1)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long")
    assert [r[:] for r in df.orderBy(B.in_order()).collect()] == sorted(rows)


def test_asof_over_chunks(spark):
    right = [("A", at(0), 1.0), ("A", at(60 * 24 * 9), 2.0), ("B", at(5), None)]
    left = [("A", at(60 * 24 * d), d) for d in (-1, 0, 3, 8, 9, 40)] + [("B", at(9), 0), ("C", at(9), 0)]
    r = spark.createDataFrame(right, "symbol string, at timestamp_ntz, v double")
    got = M.asof_join(spark.createDataFrame(left, "symbol string, ts timestamp_ntz, d int"), r, "symbol", "ts", "at", ["v"])
    assert sorted((x["symbol"], x["d"], x["v"]) for x in got.collect()) == [("A", -1, None), ("A", 0, 1.0), ("A", 3, 1.0), ("A", 8, 1.0), ("A", 9, 2.0), ("A", 40, 2.0), ("B", 0, None), ("C", 0, None)]


def test_zones_over_steps(spark):
    rows = [("A", low, low + wide) for low in range(-30, 30, 3) for wide in (0, 4, 25)]
    zones = spark.createDataFrame([(s, float(a), float(b)) for s, a, b in rows], "symbol string, zone_low double, zone_high double")
    bars = spark.createDataFrame([(s, float(a), float(b)) for s, a, b in rows[::2]], "symbol string, low double, high double")
    want = sorted((x, y, a, b) for _, x, y in rows[::2] for _, a, b in rows if x <= b and y >= a)
    assert sorted((r["low"], r["high"], r["zone_low"], r["zone_high"]) for r in M.zone_touch(bars, zones).collect()) == want


def test_bad_dates_raise_if_strict(spark):
    df = spark.createDataFrame([("1700000000",), (None,), ("2024-01-02",)], "t string")
    assert {r["e"] for r in df.select(S.to_epoch(F.col("t"), strict=True).alias("e")).collect()} == {1700000000, None, 1704153600}
    with pytest.raises(Exception, match="not a date: soon"):
        spark.createDataFrame([("soon",)], "t string").select(S.to_epoch(F.col("t"), strict=True)).collect()
