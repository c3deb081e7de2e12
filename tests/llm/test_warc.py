"""WARC archives: exact round trips, split points everywhere, edge cases."""

import base64
import gzip
import hashlib
import random

from marketspark.llm import warc


def expected(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            key = (h or "").encode()
            first[key] = min(first.get(key, p), p)
    out = []
    for p, _, h in rows:
        payload = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = payload in first and p != first[payload]
        out.append((p, len(payload), digest, "revisit" if revisit else "response", first[payload] if revisit else None))
    return out


def rows_of(seed, n=150):
    rng = random.Random(seed)
    bodies = ["", None, "<p>é</p>", "\r\n\r\n", "x" * 300_000, "\x1f\x8b\x08 WARC/1.1 \x00"] + ["".join(rng.choice("abé\n<>\x1f\x00") for _ in range(rng.randrange(3000))) for _ in range(40)]
    return [(k, rng.choice([None, f"http://a.b/{k}\r\nEvil: 1", "http://x"]), rng.choice(bodies)) for k in range(n)]


def test_round_trip(spark):
    rows = rows_of(1) + [(None, "u", "only null"), (None, "u", "<p>é</p>"), (3, "u", "again"), (3, "u", "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.archive_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def test_every_record_is_read_once_wherever_files_are_split(spark, tmp_path):
    rows = rows_of(2, 60)
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    files = sorted(tmp_path.glob("w/part-*"))
    for f in files:
        assert gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID: <urn:page:") >= 1
    whole = sorted(map(str, warc.read_warc(spark, path).drop("file").collect()))
    assert len(whole) == len(rows)
    for split in (97, 1000, 5000):
        assert sorted(map(str, warc.read_warc(spark, path, split_bytes=split).drop("file").collect())) == whole


def test_min_bytes_and_long_records(spark, tmp_path):
    big = "y" * (17 << 20)
    rows = [(1, "a", "short"), (2, "a", "short"), (3, "b", big), (4, "b", big)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), min_bytes=6).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == [
        (1, "response", None, 5),
        (2, "response", None, 5),
        (3, "response", None, 17 << 20),
        (4, "revisit", 3, 17 << 20),
    ]


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
