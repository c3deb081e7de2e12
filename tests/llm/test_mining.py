"""Hard negatives against brute force, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.llm import mining

SMALL = {"clusters": 4, "sample": 40, "first_rows": 20, "growth": 2, "block_rows": 16, "chunk_rows": 3}


def brute(rows, step, positives=5, negatives=5, percent=80, scale=256.0):
    """Every anchor against every row, in whole numbers."""
    ok = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, anchors = [], {}
    for i, lab, v in sorted(ok, key=lambda r: (r[0], r[1])):
        if i % step == 0:
            anchors.setdefault(i, (lab, v))
    for a, (lab, q) in anchors.items():
        scored = sorted((-min(max(sum(x * y for x, y in zip(q, v, strict=True)), -(2**63)), 2**63 - 1), i, own) for i, own, v in ok if i != a and len(v) == len(q))
        for p, positive, _ in [s for s in scored if s[2] == lab][:positives]:
            fit = [(i, -s) for s, i, own in scored if own != lab and percent * -p <= 100 * -s and s >= p][:negatives]
            out += [(a, positive, r + 1, i, -p, s) for r, (i, s) in enumerate(fit)]
    return sorted(out)


def asked(step):
    return F.pmod(F.col("vec_id"), F.lit(step)) == 0


@pytest.mark.parametrize("options", [{}, SMALL])
def test_same_as_brute_force(spark, options):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    rows = [(k, int(rng.integers(0, 4)), (centres[k % 5] * rng.choice([0.2, 1, 3]) + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(700)]
    rows += [(k, k % 3, rows[3][2]) for k in range(700, 800)]  # a group of equal vectors
    want = brute(rows, 20)
    assert len(want) > 300
    got = mining.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3), asked(20), **options)
    assert sorted(map(tuple, got.collect())) == want


def test_walks_stop_before_the_lists_end(spark, monkeypatch):
    """Where directions differ, later bands are not handed out."""
    seen = []
    handed = mining._handed_out
    monkeypatch.setattr(mining, "_handed_out", lambda lists, band, alive: seen.append((band, len(lists.blocks[0]), int(alive.sum()))) or handed(lists, band, alive))
    rng = np.random.default_rng(3)
    centres = np.eye(6) * 4
    rows = [(k, k % 2, (centres[k % 6] + 0.05 * rng.normal(size=6)).tolist()) for k in range(900)]
    got = mining.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), asked(50), clusters=6, first_rows=64, growth=2, block_rows=32)
    assert sorted(map(tuple, got.collect())) == brute(rows, 50)
    assert max(band for band, _, _ in seen) + 1 < seen[0][1]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, None, [1.0, 2.0]), (2, 1, None), (3, 1, [None, 1.0]), (4, 2, [nan, 1.0]), (5, 2, [inf, 0.0]), (None, 2, [1.0, 2.0])]
    rows += [(6, 1, [1.0, 1.5]), (7, 2, [0.9, 1.6]), (8, 2, []), (10, 2, []), (9, 3, []), (11, 1, [-1.0, -2.0]), (12, 2, [-1.0, -1.0]), (13, 1, [5.0]), (14, 2, [5.0]), (16, 1, [4.0]), (18, 2, [0.0, 0.0])]
    rows += [(20, 1, [1e200, 1e200]), (21, 1, [1e200, 1.0]), (22, 2, [1e190, -1e200]), (23, 2, [1e200, -7.0]), (24, 1, [3e6, 2e6]), (25, 2, [1e6, 1e12])]
    rows += [(26, 2, [1.0, 1.7])] * 3 + [(28, 1, [0.5, 0.5]), (28, 2, [0.5, 0.75])]  # repeated rows, an anchor of two rows
    df = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<double>, row string").repartition(2)
    want = brute(rows, 2)
    assert {r[0] for r in want} >= {0, 8, 16}
    for options in ({}, SMALL | {"sample": 3}):  # a small sample leaves lengths without a fitted list
        assert sorted(map(tuple, mining.hard_negatives(df, asked(2), **options).collect())) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert mining.hard_negatives(df, asked(2)).count() == 0
