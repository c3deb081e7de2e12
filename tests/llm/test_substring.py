"""Substring dedup against brute force, and its edge cases."""

import hashlib
import random

import numpy as np
import pytest

from marketspark.llm import substring


def brute(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    passages = [[rng.choice(vocabulary) for _ in range(length)] for length in (20, 34, 35, 36, 60, 90)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 10, 34, 35, 36, 100, 300]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if rng.random() < 0.1:
            words += ["x"] * rng.choice([30, 35, 36, 80])
        text = rng.choice([" ", "\n", " \t "]).join(words)
        rows += [(k, text)] * 1
        if rng.random() < 0.1:
            rows.append((k + 10_000, text))
    return rows


@pytest.mark.parametrize("size, gram, group_rows, seed", [(35, None, 5000, 1), (35, None, 2, 2), (35, None, 50, 6), (5, 2, 2, 3), (8, 8, 3, 4)])
def test_same_as_counting_all_windows(spark, size, gram, group_rows, seed):
    rows = made(200, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.removal_digests(df, size, gram=gram, group_rows=group_rows)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, size))


@pytest.mark.parametrize("group_rows", [5000, 3])
def test_common_runs_dealt_over_tasks(spark, group_rows):
    shared = " ".join(f"s{k}" for k in range(50))
    rows = made(60, 5) + [(1_000 + k, f"{shared} own{k % 30}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.removal_digests(df, 35, group_rows=group_rows, hot_rows=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 35))


def test_nulls_empty_long_and_repeated_rows(spark):
    long = " ".join(f"é{k}" for k in range(40_000))
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, "a " + shared + " b"), (None, "c " + shared), (7, "q " * 35), (7, "q " * 35), (8, "z " * 36), (9, "u")]
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, _a long, _spans string")
    got = sorted(map(str, map(tuple, substring.removal_digests(df, 35).collect())))
    assert got == sorted(map(str, brute(rows, 35)))
    cut = substring.repeats_removed(df, 35)
    assert cut.columns == df.columns
    texts = sorted((str(r["doc_id"]), r["text"]) for r in cut.collect() if r["doc_id"] not in (1, 4))
    assert texts == sorted([("2", ""), ("3", " \n "), ("5", "a  b"), ("None", "c "), ("7", " "), ("7", " "), ("8", " "), ("9", "u")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.removal_digests(df).count() == 0


def test_crowded_prefix_is_made_longer(spark):
    """Stretches that share a run but differ around it, so that no two are equal."""
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(40)]
    rows = []
    for k in range(150):
        cut = rng.randrange(0, 12)
        words = [f"a{k}x{j}" for j in range(20)] + shared[cut : cut + rng.randrange(14, 40)] + [f"b{k}x{j}" for j in range(20)]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group_rows in (2, 50):
        got = substring.removal_digests(df, 20, gram=6, group_rows=group_rows, hot_rows=10)
        assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 20))


def test_suffix_tree_of_a_text():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 200)
    order, common = substring.suffix_tree(words, np.arange(200), 64)
    suffixes = [tuple(words[k:]) for k in order.tolist()]
    assert suffixes == sorted(suffixes)
    for x, y, n in zip(suffixes[:-1], suffixes[1:], common.tolist(), strict=True):
        assert x[:n] == y[:n] and (x[n : n + 1] != y[n : n + 1])
