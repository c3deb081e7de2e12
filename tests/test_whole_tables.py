"""Market queries that judge every event, against brute force."""

import datetime as dt
import random

from marketspark import queries
from marketspark.operators import matching as M
from marketspark.operators import signals as G

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def events(spark, folder, n=600):
    rng = random.Random(3)
    # Ids that the sampled queries pass over altogether: none is 5 modulo 100 or 7 modulo 500.
    ids = [k for k in range(10 * n) if k % 100 not in (5, 7)][:n]
    rows = [(k, T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 12)), rng.randrange(4), rng.choice("AAAB"), rng.random() * 10, "{}") for k in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return rows


def hourly(rows):
    found = {}
    for k, ts, _, symbol, value, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        found.setdefault(symbol, {})[ts.replace(minute=0)] = value
    return {s: sorted(b.items()) for s, b in found.items()}


def fired(kind, price, created, expiration, bars):
    before = None
    for ts, close in bars:
        if created <= ts and (expiration is None or ts <= expiration):
            crossed = before is not None and (before < price <= close or before > price >= close)
            if {"crossing": crossed, "greater_than": close > price, "less_than": close < price}[kind]:
                return ts
        before = close
    return None


def test_every_tick_is_an_alert_and_an_anchor(spark, tmp_path):
    rows = events(spark, tmp_path)
    bars = hourly(rows)
    kinds = ("crossing", "greater_than", "less_than")
    want = {r[0]: (kinds[r[0] % 3], fired(kinds[r[0] % 3], r[4], r[1], r[1] + dt.timedelta(days=3), bars[r[3]])) for r in rows}
    got = queries.queries()["jn10_eval_alerts_all"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r["alert_id"]: (r["condition"], r["fired_ts"]) for r in got} == want
    near = sorted((r[3], r[1], ts, close) for r in rows for ts, close in bars[r[3]] if abs(int((ts - T0).total_seconds()) - int((r[1] - T0).total_seconds())) <= 90_000)
    assert sorted(map(tuple, queries.queries()["flt8_around_date_all"](spark, str(tmp_path)).collect())) == near


def test_alerts_meet_bars_by_span_and_may_never_expire(spark):
    rng = random.Random(4)
    bars = [("A", "60", T0 + k * HOUR, rng.random()) for k in range(24 * 20)]
    series = [(ts, close) for _, _, ts, close in bars]
    alerts = []
    for k in range(120):
        created = T0 + dt.timedelta(minutes=rng.randrange(-3000, 60 * 24 * 22))
        alerts.append((k, "A", rng.choice([0.01, 0.5, 0.995]), created, rng.choice([None, created + 30 * HOUR, created - HOUR, created + 9000 * HOUR]), rng.choice(["crossing", "greater_than", "less_than"]), k % 7 != 0))
    out = M.eval_alerts(
        spark.createDataFrame(bars, "symbol string, resolution string, ts timestamp_ntz, close double"),
        spark.createDataFrame(alerts, "alert_id long, symbol string, price double, created timestamp_ntz, expiration timestamp_ntz, condition string, active boolean"),
    )
    assert {r["alert_id"]: r["fired_ts"] for r in out.collect()} == {a[0]: fired(a[5], a[2], a[3], a[4], series) for a in alerts if a[6]}
    assert "_span" in out._jdf.queryExecution().optimizedPlan().toString()


def practised(actions):
    """(position, realized) after each (action, price), by a plain fold."""
    position, cost, realized, out = 0, 0.0, 0.0, []
    for action, price in actions:
        step = {"buy": 1, "sell": -1}.get(action, -position)
        if price is not None and price == price:
            if position * step >= 0:
                cost = (cost * abs(position) + price * abs(step)) / max(1, abs(position) + abs(step))
            else:
                realized += (1 if position > 0 else -1) * min(abs(step), abs(position)) * (price - cost)
            position += step
        out.append((position, realized))
    return out


def test_practice_takes_every_event_and_splits_long_sessions(spark, tmp_path):
    rows = events(spark, tmp_path, 200)
    got = queries.queries()["sig9_practice_pnl"](spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows)

    rng = random.Random(6)
    bars, actions = [], []
    for s in "AB":
        bars += [(s, T0 + k * HOUR, rng.choice([None, float("nan"), 10 * rng.random(), 10 * rng.random(), 10 * rng.random()])) for k in range(100)]
    for n, (session, symbol) in enumerate([("s", "A"), ("s", "B"), (None, "A"), ("long", "B")]):
        # The long session never closes.
        kinds = ["buy", "sell"] if session == "long" else ["buy", "buy", "sell", "close", None]
        actions += [(session, symbol, T0 - HOUR + dt.timedelta(minutes=20 * k), 1000 * n + k, rng.choice(kinds)) for k in range(300)]
    out = G.practice_pnl(
        spark.createDataFrame(actions, "session string, symbol string, ts timestamp_ntz, id int, action string"),
        spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, close double"),
        chunk_rows=37,
    )
    assert out.columns == ["session", "symbol", "ts", "id", "action", "price", "position", "realized_pnl"]
    got = {}
    for r in out.orderBy("id").collect():
        got.setdefault((r["session"], r["symbol"]), []).append(r)
    assert len(got) == 4
    for found in got.values():
        want = practised([(r["action"], r["price"]) for r in found])
        assert [r["position"] for r in found] == [p for p, _ in want]
        assert max(abs(r["realized_pnl"] - x) for r, (_, x) in zip(found, want, strict=True)) < 1e-6


def test_practice_reads_its_rows_few_times_and_cuts_only_long_sessions(spark):
    """The plan reads actions and bars a fixed, small number of times, and rows outside of long sessions are folded once."""
    rng = random.Random(7)
    bars = spark.createDataFrame([(s, T0 + k * HOUR, 10 * rng.random()) for s in "AB" for k in range(24 * 9)], "symbol string, ts timestamp_ntz, close double")
    rows = [("long", "A", T0 + dt.timedelta(minutes=30 * k), k, rng.choice(["buy", "buy", "sell"] if k < 250 else ["buy", "sell", "sell", "close"])) for k in range(430)]
    rows += [(f"s{n}", "B", T0 + dt.timedelta(hours=5 * k), 1000 * (n + 1) + k, rng.choice(["buy", "sell", "close"])) for n in range(3) for k in range(40)]
    out = G.practice_pnl(spark.createDataFrame(rows, "session string, symbol string, ts timestamp_ntz, id long, action string").repartition(3), bars, chunk_rows=100)
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() < 40
    got = {}
    for r in out.orderBy("id").collect():
        got.setdefault(r["session"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for found in got.values():
        want = practised([(r["action"], r["price"]) for r in found])
        assert [r["position"] for r in found] == [p for p, _ in want]
        assert max(abs(r["realized_pnl"] - x) for r, (_, x) in zip(found, want, strict=True)) < 1e-6
