"""Token ids in ORC files: stripes that tasks read apart, row indexes, Bloom filters on doc_id.

Rows are in ascending doc_id over the files and inside each, so an id range or a single
id prunes files, stripes and row groups. ORC encodes the integers in runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, stage
from .encode import encoder, id_lists, tokenizer_path, with_end


def write_tokens(
    df: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int | None = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    files: int | None = None,
    stripe_mb: int = 64,
) -> None:
    """Writes (doc_id, part, row, ids) of df in ascending doc_id order as ORC.

    part is the file's number and row the place in it. Null and empty texts have the end id
    alone. Rows with a null id come first; repeated ids stay rows of their own, in the order
    of their texts' hashes. Texts, which are smaller than ids, are what is shuffled; they are
    encoded where they are written. files: as many as there are shuffle partitions, unless
    given. An empty df makes a folder without rows. Further columns of df are ignored.
    """
    tokenizer = tokenizer or tokenizer_path()
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, part int, row long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, ids, offsets in encoder(tokenizer).encode(batch.column(1)):
                n = last - first
                lists = id_lists(*with_end(ids, offsets, end_id))
                columns = [batch.column(0).slice(first, n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "row", "ids"])
                row += n

    tie = F.xxhash64("text")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(files or shuffle_partitions(df.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    (
        ordered.mapInArrow(run, schema)
        .write.option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, row, ids) of the files; filters on doc_id reach their indexes and Bloom filters."""
    return spark.read.orc(path)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens, ids_crc32, from what read_tokens returns.

    Counts are summed up inside each file; only a sum for each file comes to the driver.
    """
    keep = ["doc_id", "part", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offsets = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], [*keep, "n_tokens", "ids_crc32"])

    schema = tokens.select(*keep).schema.add("n_tokens", "long").add("ids_crc32", "long")
    rows = stage(tokens.select(*keep, "ids").mapInArrow(run, schema), "token-digests")
    ahead, before = 0, []
    for r in sorted(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], ahead))
        ahead += r["n"]
    starts = tokens.sparkSession.createDataFrame(before, "part int, ahead long")  # a row for each file
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "part")
        .select("doc_id", (F.col("ahead") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def encode_and_read_back(df: DataFrame, **options) -> DataFrame:
    """write_tokens to a new folder of the shared directory, then token_digests of what it holds."""
    path = new_path(df.sparkSession, "tokens")
    write_tokens(df, path, **options)
    return token_digests(read_tokens(df.sparkSession, path))
