"""Filters on doc_id skip row groups and files of the token store, by what the scan reads."""

from marketspark.llm import token_store


def rows_read(df):
    """The rows that df has, and those that its scan gave."""
    found = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return found, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_ids_prune_row_groups(spark, tmp_path):
    n = 60_000
    docs = spark.range(n).selectExpr("id * 2 AS doc_id", "concat('w', id % 7) AS text")
    path = f"file://{tmp_path}/tokens"
    token_store.write_tokens(docs, path, files=1)
    tokens = token_store.read_tokens(spark, path).select("doc_id", "ids")
    found, read = rows_read(tokens.where("doc_id between 50000 and 50010"))
    assert [r["doc_id"] for r in found] == [50000, 50002, 50004, 50006, 50008, 50010]
    assert 0 < read <= 10_000  # one row group of six
    found, read = rows_read(tokens.where("doc_id = 50001"))
    assert found == [] and read == 0  # inside a row group's range: its Bloom filter tells
    assert rows_read(tokens.where("doc_id > 1000000"))[1] == 0
    assert rows_read(tokens)[1] == n


def test_id_ranges_are_of_their_own_files(spark, tmp_path):
    docs = spark.range(8000).selectExpr("(id * 7919) % 8000 AS doc_id", "'a b' AS text")
    path = f"file://{tmp_path}/tokens"
    token_store.write_tokens(docs, path, files=4)
    ranges = sorted((r["a"], r["b"]) for r in token_store.read_tokens(spark, path).groupBy("part").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "a").join(token_store.read_tokens(spark, path).groupBy("part").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "b"), "part").collect())
    assert len(ranges) == 4 and all(b < c for (_, b), (c, _) in zip(ranges[:-1], ranges[1:], strict=True))
    found, read = rows_read(token_store.read_tokens(spark, path).select("doc_id").where("doc_id < 100"))
    assert len(found) == 100 and read <= 4000
