"""The pipeline against a brute-force version of its filtering stages, and its shape."""

import random

import corpus_pipeline
from marketspark.llm import quality

from .test_jaccard import brute as groups_of


def made():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for k in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([20, 80, 300])))
        rows.append(text + (" " + passage if k % 17 == 0 else ""))
        if k % 10 == 0:
            rows.append(rows[-1])
        if k % 12 == 0:
            rows.append(rows[-1] + " tail")
    rows += ["# $ % " * 30, "again and again\n" * 20, "", None]
    return [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(rows)]


def test_stages(spark, tmp_path):
    rows = made()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, "")
    assert good.columns == docs.columns
    kept = sorted(r["doc_id"] for r in good.collect())
    assert kept == [r[0] for r in rows if r[1] and "#" not in r[1] and "again" not in r[1]]
    assert set(quality.POLICIES) == {"base", "v1", "corpus"}
    good = spark.createDataFrame([r for r in rows if r[0] in kept], schema)
    unique = stages["near_duplicates"](spark, good, "")
    want = sorted({c for _, _, c in groups_of([(r[0], r[1]) for r in rows if r[0] in kept], 5, 80)})
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == want
    cut = {r["doc_id"]: r["text"] for r in stages["repeated_passages"](spark, unique, "").collect()}
    for r in rows:
        if r[0] in cut:
            assert cut[r[0]].split() == (r[1].split()[:-60] if r[0] in want and r[1].split()[-60:] == rows[0][1].split()[-60:] else r[1].split())


def test_run(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(made(), schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() > 50 and "sequence_id" in out.columns
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
