"""Exact top-k search against brute force, and its edge cases."""

import numpy as np
from pyspark.sql import functions as F

from marketspark.llm import topk


def brute(rows, step, k, scale=1024.0):
    ok = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for d in {len(v) for _, v in ok}:
        same = [(i, v) for i, v in ok if len(v) == d]
        for q, qv in {i: v for i, v in same if i % step == 0}.items():
            scored = sorted((-min(max(sum(a * b for a, b in zip(qv, v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in same if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def asked(step):
    return F.pmod(F.col("vec_id"), F.lit(step)) == 0


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] * rng.choice([0.2, 1, 3]) + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(900)]
    rows += [(k, rows[3][1]) for k in range(900, 1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(df, asked(20), 10, pivots=5, sample=200, block_rows=64, chunk_rows=20, rounds=(1, 3))
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 10)


def test_odd_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [-1.0, 0.001]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, 0.0]), (9, [200_000.0, -100_000.0]), (10, [3.0]), (11, [300_000.0, 1.0]), (12, [1e12, -2.0]), (13, [-1e12, 3e5]), (14, [1e30, 1.0]), (15, []), (16, [])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, pivot int")
    got = topk.top_k(df, asked(2), 10, pivots=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 10)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, asked(2)).count() == 0


def test_large_components_among_many(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=6) * rng.choice([1, 3e5, 1e9, 1e12])).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, asked(10), 5, pivots=6, sample=100, block_rows=40, chunk_rows=10, rounds=(1, 3))
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)
