"""Length alone rejects nothing in the policies that follow the first."""

from marketspark.llm import quality as Q


def test_long_clean_texts_stay_and_junk_goes(spark):
    lines = [f"line {k} says w{k * 7} and x{k * 11}" for k in range(5000)]
    for k in range(5):
        lines.insert(1000 * k, "* * *")
    junk = "\n".join(f"w{k} x{k * 3} y{k * 7} z{k * 5}" if k % 2 else "buy it now" for k in range(40))
    short = "one two\nthree four\none two"  # a repeated line is a third, but only one
    rows = [(1, "\n".join(lines)), (2, junk), (3, short), (4, "\n".join(f"w{k} x{k}" for k in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in Q.quality_filter(df, "corpus").collect()) == [1, 3, 4]
    kept = Q.apply_policy(Q.ledger(df), "v2", Q.LATER_POLICIES).where("kept").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4]  # the short text has few words
    assert {r["doc_id"]: r["n_lines"] for r in Q.ledger(df).collect()} == {1: 5005, 2: 40, 3: 3, 4: 60_000}
