"""Mixing: targets, quotas, and what every document gives."""

import numpy as np

from marketspark.llm import mixing as M


def shared_out(sizes, weights, most=3.0):
    """Targets by the words of the rule: share, stop what is above its cap, share the excess again until none is above."""
    stopped, out = set(), [0.0] * len(sizes)
    while True:
        left = sum(sizes) - sum(most * sizes[k] for k in stopped)
        weight = sum(w for k, w in enumerate(weights) if k not in stopped)
        out = [most * n if k in stopped else left * weights[k] / weight for k, n in enumerate(sizes)]
        above = {k for k, n in enumerate(sizes) if k not in stopped and out[k] > most * n}
        if not above:
            return out
        stopped |= above


def test_targets_against_sharing_again_and_again():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(0, 10 ** rng.integers(1, 6), rng.integers(1, 12)).tolist()
        got = M.targets(sizes, M.cyclic_weights(sizes))
        assert np.allclose(got, shared_out(sizes, M.cyclic_weights(sizes)), rtol=1e-9)


def test_large_draws_follow_the_distribution():
    rng = np.random.default_rng(2)
    good, bad, take = 600_000_000, 900_000_000, 5000
    got = np.array([M.hypergeometric(rng, good, bad, take) for _ in range(3000)])
    sd = np.sqrt(take * 0.4 * 0.6)
    assert abs(got.mean() - 2000) < 4 * sd / np.sqrt(3000) and 0.9 < got.std() / sd < 1.1
    small = np.array([M.hypergeometric(rng, 3, 2_000_000_000, 1_000_000_000) for _ in range(2000)])
    assert set(small) <= {0, 1, 2, 3} and abs(small.mean() - 1.5) < 0.2
    assert M.hypergeometric(rng, 10**12, 0, 5) == 5 and M.hypergeometric(rng, 0, 10**12, 5) == 0


def test_targets_are_stopped_and_shared_again():
    assert M.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert M.targets([10, 1000, 90], [1, 1, 1]) == [30.0, 800.0, 270.0]
    assert M.targets([0, 5], [1, 1]) == [0.0, 5.0]
    assert M.targets([], []) == []


def test_quotas_are_exact():
    quotas = [1000, 0, 37, 5]
    table = M.split_quotas(quotas, 7, seed=3)
    assert table.sum(0).tolist() == quotas and (table >= 0).all()
    assert np.ptp(table.sum(1)) <= 1 + len(quotas)
    assert (M.split_quotas(quotas, 7, seed=3) == table).all()
    big = M.split_quotas([3_000_000_000, 2_000_000_000], 4)
    assert big.sum(0).tolist() == [3_000_000_000, 2_000_000_000] and (big >= 0).all()


def rows_of():
    rows = [(k, f"s{k % 5}" if k % 11 else None, "w " * (k % 40)) for k in range(500)]
    return rows + [(1000, "s1", None), (1001, "s9", ""), (None, "s2", "a b c"), (7, "s2", "w " * 7), (7, "s2", "w " * 7), (1002, "tiny", "x"), (1003, "s3", "long " * 9000)]


def test_taken_words_meet_the_targets(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows_of()], "doc_id long, source string, text string, size int")
    documents, draws = M.mix(df, block_words=8, shards=6)
    got = documents.collect()
    assert len(got) == len(rows_of())
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    names = sorted(by, key=lambda n: (n is None, n or ""))
    want = shared_out([by[n][0]["source_size"] for n in names], M.cyclic_weights(names))
    assert np.allclose([by[n][0]["target"] for n in names], want, rtol=1e-9)
    # Whole passes give every document its words; of the last pass all blocks but one are whole or not there.
    for rows in by.values():
        passes = round(rows[0]["target"]) // max(1, rows[0]["source_size"])
        rest = [(r["size"], r["taken"] - passes * r["size"]) for r in rows]
        assert all(0 <= x <= n for n, x in rest)
        assert sum(x % 8 != 0 and (n - x) % 8 != 0 and x % 8 != n % 8 for n, x in rest) <= 1
    shards = draws.groupBy("shard").count().collect()
    assert len(shards) == 6 and max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1 + len(names)
    places = draws.groupBy("shard").agg({"place": "max", "*": "count"}).collect()
    assert all(r["max(place)"] == r["count(1)"] - 1 for r in places)
    again, _ = M.mix(df.repartition(5), block_words=8, shards=6)
    assert sorted(map(str, again.drop("row_id").collect())) == sorted(map(str, documents.drop("row_id").collect()))


def test_mixed_documents_hold_the_words_taken(spark):
    df = spark.createDataFrame([(d, s, t, len(t or ""), 1, 2, 3) for d, s, t in rows_of()], "doc_id long, source string, text string, n_chars long, row_id int, epoch int, _spans int")
    out = M.mixed_documents(df, block_words=8)
    assert out.columns == df.columns
    documents, _ = M.mix(df, block_words=8)
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in documents.collect())
    assert out.where("n_chars <> length(text)").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    documents, draws = M.mix(df)
    assert documents.count() == 0 and draws.count() == 0
