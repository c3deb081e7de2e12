"""Quality rules: measures by plain Python, policies and ablations."""

import random
import re


from marketspark.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def made():
    rng = random.Random(5)
    rows = [None, "", " \n\t", "a\x85b c", "é # é", "x", "x x x x", "same\nsame\r\nsame\n\n\nsame", "word " * 60, "#" * 200]
    return rows + ["".join(rng.choice(["a ", "b ", "c\n", "d| ", "é ", "\n"]) for _ in range(rng.randrange(120))) for _ in range(200)]


def test_measures(spark):
    rows = list(enumerate(made()))
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_words int")
    got = Q.ledger(df).select("doc_id", *Q.MEASURES).collect()
    assert sorted(map(tuple, got)) == [(k, *brute(t)) for k, t in rows]


def test_policies_and_ablations(spark):
    df = spark.createDataFrame(list(enumerate(made())), "doc_id long, text string")
    entries = Q.ledger(df).cache()
    kept = {r["doc_id"] for r in Q.apply_policy(entries, "v1").where("kept").collect()}
    bits = {r["doc_id"]: r["fail_bits"] for r in entries.collect()}
    mask = Q.mask_of(Q.POLICIES["v1"])
    assert kept == {k for k, b in bits.items() if not b & mask}
    for r in Q.ablations(entries, "v1").collect():
        bit = Q.mask_of([r["rule"]])
        assert r["failed"] == sum(bool(b & bit) for b in bits.values())
        assert r["only_by"] == sum(b & mask == bit for b in bits.values())
        assert r["kept_without"] == sum(not b & mask & ~bit for b in bits.values())


def test_filter_keeps_columns_and_short_clean_texts(spark):
    df = spark.createDataFrame([(1, "a short clean text", "x"), (2, "#" * 50 + " a b", "x"), (3, None, "x")], "doc_id long, text string, fail_bits string")
    out = Q.quality_filter(df, "corpus")
    assert out.columns == df.columns and [r["text"] for r in out.collect()] == ["a short clean text"]
    assert Q.quality_filter(df.limit(0)).count() == 0
