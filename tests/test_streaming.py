"""Streams give what their batch twins give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketspark.operators.bars import build_bars
from marketspark.streaming import feeds as X

T0 = dt.datetime(2024, 1, 1)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    done = q.awaitTermination(120)
    q.stop()
    assert done
    return stream.sparkSession.table(name)


def ticks(spark, tmp_path):
    rows = [(f"S{k % 3}", T0 + dt.timedelta(seconds=41 * k), float(k * 7 % 13), 1.0, k) for k in range(400)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, id long")
    path = f"file://{tmp_path}/ticks"
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_changes_only(spark, tmp_path):
    df, stream = ticks(spark, tmp_path)
    level = F.when(F.col("id") % 11 != 0, F.floor(F.col("price") / 4))
    got = run(X.changes_only(stream.withColumn("level", level), ["symbol"], ["level"], "id"), "changes")
    want = X.changes_only_batch(df.withColumn("level", level), ["symbol"], ["level"], ["id"])
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def test_payload_sequence(spark):
    df = spark.createDataFrame([("f", k, p) for k, p in enumerate(["a", "a", None, "b", "b", "a"])], "feed string, seq int, payload string")
    assert [r["payload"] for r in X.changes_only_batch(df, ["feed"], ["payload"], ["seq"]).orderBy("seq").collect()] == ["a", "b", "a"]


def test_streaming_bars(spark, tmp_path):
    df, stream = ticks(spark, tmp_path)
    got = run(X.streaming_bars(stream, 30, "0 seconds"), "stream_bars", "append")
    want = build_bars(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "30")
    whole = {(r["symbol"], str(r["ts"])): r["close"] for r in want.collect()}
    found = {(r["symbol"], str(r["ts"])): r["close"] for r in got.collect()}
    # The last window stays open behind the watermark.
    assert found and all(whole[k] == v for k, v in found.items())


def test_stream_signals(spark, tmp_path):
    df, _ = ticks(spark, tmp_path)
    bars = build_bars(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "5")
    want = {(r["symbol"], str(r["ts"])): (r["signal"], r["holding"]) for r in X.stream_signals_batch(bars).collect()}
    path = f"file://{tmp_path}/bars"
    timed = bars.withColumn("ts", F.col("ts").cast("timestamp"))
    timed.coalesce(1).write.parquet(path)
    got = run(X.stream_signals(spark.readStream.schema(timed.schema).parquet(path)), "signals")
    assert {(r["symbol"], str(r["ts"])): (r["signal"], r["holding"]) for r in got.collect()} == want


def test_late_ticks_are_left_out(spark, tmp_path):
    path = f"{tmp_path}/late"
    schema = "symbol string, ts timestamp, price double, size double, id long"
    first = [("S", T0 + dt.timedelta(minutes=m), float(m), 1.0, m) for m in (0, 3, 40)]
    late = [("S", T0 + dt.timedelta(minutes=m), 99.0, 1.0, m) for m in (4, 41, 75)]
    for rows in (first, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        run_once(X.streaming_bars(spark.readStream.schema(schema).parquet(path), 30, "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r["ts"]: (r["high"], r["volume"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {T0: (3.0, 2.0), T0 + dt.timedelta(minutes=30): (99.0, 2.0)}


def run_once(stream, path, checkpoint):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_panes_and_forming_bars_emit_any_change(spark):
    bars = spark.createDataFrame([("A", "60", T0, 1.0, 2.0, 1.0, 1.5, 3.0), ("A", "60", T0 + dt.timedelta(hours=1), 1.0, 2.0, 1.0, 1.5, 3.00001), ("A", "60", T0 + dt.timedelta(hours=2), 1.0, 2.0, 1.0, 1.5, 3.00001)], "symbol string, resolution string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    panes = spark.createDataFrame([("L", 0, "A", "60")], "layout string, pane_index int, symbol string, resolution string")
    assert [r["ts"] for r in X.stream_panes_batch(panes, bars).orderBy("ts").collect()] == [T0, T0 + dt.timedelta(hours=1)]
    day = X.stream_bars_batch(X.forming_bars(bars, "D"), "part_ts").orderBy("part_ts").collect()
    assert [r["new_bar"] for r in day] == [True, False, False] and day[-1]["volume"] == 9.00002


def test_json_lines(spark, tmp_path):
    from marketspark.sources import files

    df, stream = ticks(spark, tmp_path)
    out = f"{tmp_path}/lines"
    writer = files.write_jsonl_stream(stream.where("id % 2 = 0").select("symbol", "id"), "quote", out, f"{tmp_path}/lines-state")
    assert writer.trigger(availableNow=True).start().awaitTermination(60)
    got = spark.read.schema("symbol string, id long, _ts long, _stream string").json(out)
    assert sorted((r["symbol"], r["id"]) for r in got.collect()) == sorted((r["symbol"], r["id"]) for r in df.where("id % 2 = 0").collect())
    assert got.where("_stream = 'quote' and _ts > 1700000000000").count() == 200


def drawings(kind):
    """Snapshots of two studies, whose drawings change at some of them."""
    rows = []
    for n in range(12):
        at = T0 + dt.timedelta(minutes=n)
        for study in ("Zones", "Pivots", ""):
            k = n // (2 if study == "Zones" else 3)
            for j in range(4):
                text = f"t{k % 3 if j == 1 else j}" if j != 2 else None
                rows.append({"lines": (study, at, float(j + k % 2), float(j + k % 2) if j else 0.0), "labels": (study, at, 4 - j, text), "tables": (study, at, None if j % 2 else 2, j // 2, 1 - j % 2, text, f"{j}.{k % 2}")}[kind])
    schema = {"lines": "y1 double, y2 double", "labels": "seq long, text string", "tables": "tid long, row long, col long, text string, seq string"}[kind]
    return rows, f"study string, snapshot timestamp, {schema}"


@pytest.mark.parametrize("kind", ["lines", "labels", "tables"])
def test_drawings_on_change(spark, tmp_path, kind):
    rows, schema = drawings(kind)
    df = spark.createDataFrame(rows, schema)
    want = sorted((r["study"], str(r["snapshot"]), tuple(r["payload"])) for r in X.drawing_payloads_batch(df, kind, "o").collect())
    assert {s for s, *_ in want} == {"Zones", "Pivots"} and 5 < len(want) < 24
    half = T0 + dt.timedelta(minutes=6)
    path = f"file://{tmp_path}/{kind}"
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for part in (df.where(F.col("snapshot") < half), df.where(F.col("snapshot") >= half)):  # two runs on one state
            part.coalesce(1).write.mode("append").parquet(path)
            run_once(X.drawing_changes(spark.readStream.schema(df.schema).parquet(path), kind, "o"), f"{tmp_path}/out-{kind}", f"{tmp_path}/state-{kind}")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    got = spark.read.parquet(f"{tmp_path}/out-{kind}").collect()
    assert sorted((r["study"], str(r["snapshot"]), tuple(r["payload"])) for r in got) == want
