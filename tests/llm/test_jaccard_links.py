"""Links of the n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from marketspark.llm import jaccard

from .test_jaccard import brute as groups_of
from .test_jaccard import made


def links_of(rows, size, percent):
    """For each row, the other sets that its set is similar to."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)]))
    found = {s: sum(100 * len(s & o) >= percent * len(s | o) for o in set(sets) if o != s) for s in set(sets)}
    return sorted((r[0], found[s]) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("size, percent, seed, blocks", [(3, 90, 1, {}), (3, 50, 3, {"pair_rows": 2, "block_rows": 4}), (5, 80, 2, {"pair_rows": 1, "block_tokens": 900}), (3, 90, 4, {"pair_rows": 10**9})])
def test_links_are_those_of_all_pairs(spark, size, percent, seed, blocks):
    rows = made(250, seed)
    want = links_of(rows, size, percent)
    assert max(n for _, n in want) > 4
    got = jaccard.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent, **blocks)
    assert sorted(map(tuple, got.select("doc_id", "links").collect())) == want
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(groups_of(rows, size, percent))


def test_three_similar_texts_have_two_links_each(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*words, f"end{k}"])) for k in range(3)]
    assert [r["links"] for r in jaccard.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()] == [2, 2, 2]


def test_repeated_rows_count_once(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join([*words, "x"])), (2, " ".join([*words, "y"]))] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({}, {"pair_rows": 1}):
        got = jaccard.link_groups(df, 3, 90, **options).select("doc_id", "component_id", "links")
        assert sorted(map(tuple, got.collect())) == sorted([(1, 1, 1), (2, 1, 1)] * 200)
    assert [tuple(r) for r in jaccard.near_duplicates_removed(df, 3, 90).collect()] == [rows[0]]


def test_similar_sets_by_matrices():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9, rng.integers(1, 20))) for _ in range(80)]
    want = np.array([[100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b)) for b in sets] for a in sets])
    np.fill_diagonal(want, False)
    assert want.any() and (jaccard.similar(sets, [sets], 0, 60) == want).all()
    assert (jaccard.similar(sets, [sets], 30, 60) == want[:30, 30:]).all()


@pytest.mark.parametrize("size, percent, n, words, ending", [(5, 80, 100, (40, 60), 10), (3, 90, 150, (90, 130), 11)])
def test_texts_with_and_without_a_common_ending(spark, size, percent, n, words, ending):
    """One text of each pair is in a crowded bucket, that of the ending, and the other in none."""
    rng = random.Random(ending)
    common = [f"end{k}" for k in range(ending)]
    rows = []
    for k in range(n):
        own = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(*words))]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own + common))]
    want = links_of(rows, size, percent)
    assert sum(links for _, links in want) > n
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.link_groups(df, size, percent)
    assert sorted(map(tuple, got.select("doc_id", "links").collect())) == want
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(groups_of(rows, size, percent))


def test_sets_are_dealt_only_where_they_can_have_links(spark, monkeypatch):
    """Half of each text is the beginning of a common one: texts go to the blocks of like size, not to all that share it."""
    rng = random.Random(8)
    common = [f"start{k}" for k in range(700)]
    rows = []
    for k in range(150):
        own = [f"w{rng.randrange(50_000)}" for _ in range(int(8 * 1.03**k))]
        own = common[: len(own)] + own
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own, "end"]))]
    want = links_of(rows, 3, 90)
    assert sum(links for _, links in want) > len(rows) // 2
    dealt = spark.sparkContext.accumulator(0)
    links_in = jaccard._links_in

    def counting(percent):
        run = links_in(percent)

        def counted(pdf):
            dealt.add(len(pdf))
            return run(pdf)

        return counted

    monkeypatch.setattr(jaccard, "_links_in", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.link_groups(df, 3, 90, block_rows=20)
    assert sorted(map(tuple, got.select("doc_id", "links").collect())) == want
    assert 0 < dealt.value <= 4 * len(rows)


@pytest.mark.parametrize("size, percent, seed", [(3, 90, 1), (3, 50, 3)])
def test_links_in_several_rounds(spark, monkeypatch, size, percent, seed):
    monkeypatch.setattr(jaccard, "DEALT", 0)
    rounds = []
    stage = jaccard.Scratch.stage
    monkeypatch.setattr(jaccard.Scratch, "stage", lambda self, df, name: (rounds.append(name), stage(self, df, name))[1])
    rows = made(250, seed)
    got = jaccard.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent, pair_rows=4, block_rows=10, block_tokens=500)
    assert sorted(map(tuple, got.select("doc_id", "links").collect())) == links_of(rows, size, percent)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(groups_of(rows, size, percent))
    assert sum(name.startswith("jaccard-inside") for name in rounds) > 1
