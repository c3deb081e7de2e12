"""The n-gram Jaccard join against brute force, and its edge cases."""

import random

import pytest

from marketspark.llm import jaccard


def brute(rows, size, percent):
    """component_id of each row, by comparing all pairs."""

    def shingles(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not words:
            return set()
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((d for d in groups[find(i)] if d is not None), default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def made(n, seed):
    """Texts of families whose members differ by a few words, on both sides of the thresholds."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 8, 40, 120, 200]))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = common
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "  "]).join(words)
            rows.append((len(rows) + 5, text.upper() if rng.random() < 0.1 else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, percent, seed", [(3, 90, 1), (5, 80, 2), (3, 50, 3)])
def test_same_groups_as_all_pairs(spark, size, percent, seed):
    rows = made(250, seed)
    got = jaccard.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute(rows, size, percent))


def test_nulls_empty_long_repeated_rows_and_clashing_names(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (6, long), (7, long + " end"), (None, None), (8, "É b"), (9, "é b")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, uid long, tok string")
    got = sorted(map(str, jaccard.link_groups(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect()))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, 4), (6, 29998, 6), (7, 29999, 6), (None, 0, None), (8, 1, 8), (9, 1, 9)]
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in want)
    kept = jaccard.near_duplicates_removed(df, 3, 90)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "9", "None"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_groups(df).count() == 0
    assert jaccard.near_duplicates_removed(df).count() == 0
