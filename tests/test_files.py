"""Stores, logs, rules and removals: what is read, what survives, and odd rows."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from marketspark.operators import drawings as R
from marketspark.plans import workflows as P
from marketspark.sources import files

SCHEMA = "saved_at string, brief string, extra long, date string"


def test_sessions_of_other_dates_are_neither_read_nor_written(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = [(f"2024-01-{day:02d}", "old", f"b{day}", day) for day in range(1, 21)]
    spark.createDataFrame(rows, "date string, saved_at string, brief string, extra long").write.partitionBy("date").parquet(path)
    broken = f"{tmp_path}/store/date=2024-01-15"
    for f in glob.glob(f"{broken}/*.parquet"):
        open(f, "wb").write(b"not parquet")  # a reader of this date would fail
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/store/*/*.parquet")}
    new = spark.createDataFrame([("2024-01-05", "new", "n5"), ("2024-01-07", "new", "n7"), ("2024-02-01", "new", "n32")], "date string, saved_at string, brief string")
    files.save_session(new.where("date < '2024-01-10'"), path, SCHEMA)
    files.save_session(new.where("date > '2024-01-10'"), path, SCHEMA)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/store/*/*.parquet")}
    changed = {f.split("date=")[1][:10] for f in before.keys() ^ after.keys()} | {f.split("date=")[1][:10] for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed == {"2024-01-05", "2024-01-07", "2024-02-01"}
    got = {r["date"]: (r["saved_at"], r["brief"], r["extra"]) for r in files.stored_sessions(spark, path, SCHEMA).where("date <> '2024-01-15'").collect()}
    assert len(got) == 20 and got["2024-01-05"] == ("new", "n5", 5) and got["2024-01-06"] == ("old", "b6", 6) and got["2024-02-01"] == ("new", "n32", None)
    assert not glob.glob(f"{tmp_path}/store.merge-*")


def test_sessions_without_rows_or_dates(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    new = spark.createDataFrame([(None, "s", "b")], "date string, saved_at string, brief string")
    files.save_session(new.limit(0), path)
    assert not os.path.exists(f"{tmp_path}/store")
    with pytest.raises(ValueError, match="without a date"):
        files.save_session(new, path)


def test_the_first_rules_that_exist_win(spark, tmp_path):
    for name, rules in (("a", {"watchlist": ["X", "X", "Y"], "default_timeframe": "D"}), ("b", {"watchlist": ["Z"]})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "rules.json").write_text(json.dumps(rules))
    rules = files.load_rules(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/a", f"file://{tmp_path}/b/rules.json"])
    assert rules["default_timeframe"] == "D" and rules["path"].endswith("/a")
    bar = "symbol string, resolution string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    bars = spark.sql("SELECT 'X' AS symbol, r AS resolution, timestamp_ntz'2024-01-01' AS ts, 1D AS open, 2D AS high, 1D AS low, 1.5D AS close, 1D AS volume FROM VALUES ('D'), ('60') AS t(r)")
    brief = P.brief_of_rules(spark, rules, bars, spark.createDataFrame([("X", 2.0)], "symbol string, level double"))
    got = sorted((r["seq"], r["symbol"], r["error"], r["timeframe"]) for r in brief.collect())
    assert got == [(0, "X", None, "D"), (1, "X", None, "D"), (2, "Y", "no bars", "D")]
    totals = P.brief_totals(brief).first()
    assert (totals["scanned"], totals["failed"], totals["neutral"], totals["overall"]) == (3, 1, 2, "OVERALL: neutral (0 bullish, 0 bearish, 2 neutral)")
    assert P.brief_totals(brief.limit(0)).first()["scanned"] == 0
    with pytest.raises(FileNotFoundError):
        files.load_rules(spark, [f"file://{tmp_path}/none"])
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(ValueError, match="c.json"):
        files.load_rules(spark, [f"file://{tmp_path}/c.json"])
    assert files.clean_bars(spark.createDataFrame([], bar)).count() == 0


def test_removals(spark):
    rows = [("s", "a"), ("s", "b"), ("s", "b"), ("s", None), ("t", "a"), ("u", "z")]
    drawings = spark.createDataFrame(rows, "study string, id string").withColumn("y1", F.lit(1.0))
    removals = spark.createDataFrame([("s", "b"), ("s", "b"), ("s", "nope"), ("t", "a"), ("v", "a"), ("s", None)], "study string, id string").withColumn("y1", F.lit(2.0))
    assert sorted((r["study"], r["id"] or "", r["y1"]) for r in R.remaining_drawings(drawings, removals).collect()) == [("s", "", 1.0), ("s", "a", 1.0), ("u", "z", 1.0)]
    got = {r["study"]: (r["asked"], r["removed"], r["not_found"], r["remaining_count"]) for r in R.removal_outcomes(drawings, removals).collect()}
    assert got == {"s": (2, 1, 1, 2), "t": (1, 1, 0, 0), "v": (1, 0, 1, 0)}
    assert R.remaining_drawings(drawings, removals.limit(0)).count() == 6 and R.removal_outcomes(drawings.limit(0), removals).where("removed > 0").count() == 0
