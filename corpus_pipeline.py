"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's rows as Parquet and hands them, read again,
to the next. Further columns of docs stay, whatever their names, up to the last stage.

Null, empty and wordless texts go in the first stage; later ones, if given them, leave them as
they are, but for the mix, which takes no words from them, and the packing, where they are the
end token alone. Of repeated rows near_duplicates keeps one. An empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketspark.llm import jaccard, mixing, packing, quality, substring
from marketspark.llm.common import drop_results, stage, staged_so_far

CAPACITY = 4096


_staged: list[str] = []  # by stages so far, on the way to their results


def _stage_of(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """step, which first deletes what earlier stages staged: their results are written, so nothing reads it again."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_results(spark, _staged, docs)
        before = staged_so_far()
        out = step(spark, docs, sf_dir)
        _staged[:] = [p for p in staged_so_far() if p in _staged or p not in before]
        return out

    return run


@_stage_of
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy for corpora rejects go."""
    return quality.quality_filter(docs, "corpus")


@_stage_of
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, Jaccard similarity 0.8 or more."""
    return jaccard.near_duplicates_removed(docs, size=5, percent=80)


@_stage_of
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur more than once are cut out."""
    return substring.repeats_removed(docs, size=50)


@_stage_of
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, none at more than three times its size."""
    return mixing.mixed_documents(docs)


@_stage_of
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: sequences of 4096 tokens at most."""
    return packing.pack_documents(docs, CAPACITY, keep_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: Hashing, suffix trees and tokenizers are beyond SQL; tests hold the filtering stages and each operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        _staged.append(staged_so_far()[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
