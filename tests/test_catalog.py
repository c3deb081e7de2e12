"""Look-up of symbols and names against plain Python."""

from marketspark.operators import catalog as C


def test_search_finds_what_contains_finds(spark):
    words = ["AAPL", "aa", "", "Äpfel", "BANANA", "an"]
    rows = [(w, None if k % 3 == 0 else words[-k], "", "X", "stock", k) for k, w in enumerate(words)]
    asked = ["a", "an", "ANA", "anan", "äp", "", "zzz", "%", "aapl"]
    catalog = spark.createDataFrame(rows, "symbol string, description string, exchange string, prefix string, type string, seq int")
    found = C.search_symbols(catalog, spark.createDataFrame([(q,) for q in asked], "query string"), limit=100)
    got = {(r["query"], r["symbol"], r["description"]) for r in found.collect()}
    want = {(q, s, d or "") for q in asked for s, d, *_ in rows if q.lower() in s.lower() or q.lower() in (d or "").lower()}
    assert got == want and found.count() == len(want)


def test_resolve_prefers_the_exact_name_and_keeps_unknown_ones(spark):
    names = spark.createDataFrame([("1", "My layout", None, 1), ("2", "layout", "", 2), ("3", None, "Other", 3)], "id string, name string, title string, seq int")
    targets = spark.createDataFrame([("LAYOUT",), ("my",), ("oth",), ("none",)], "target string")
    assert {(r["target"], r["id"]) for r in C.resolve_name(names, targets).collect()} == {("LAYOUT", "2"), ("my", "1"), ("oth", "3"), ("none", None)}
