"""Mixing sources to target weights.

Sources get targets in words by weight, none above ``most_repeats`` times what it holds.
Each source's documents are cut into blocks; whole passes over a source take every block
once more, and the rest of its target is taken from the front of a random permutation of
its blocks, the last block in part, so every target is met to the word. A tree then splits
the blocks' exact quotas among output shards: at each node the left half of the shards gets
a multivariate hypergeometric draw of what the node has. A shard's quota of a source is a
run of that source's draw order which no other shard has, and rows are shuffled inside
the shard by a keyed hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, new_names, shuffle_partitions, stage

SHARD_QUOTAS = 4_000_000  # 32 MB


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int  # words
    blocks: int
    target: float


def targets(sizes: list[int], weights: list[float], total: float | None = None, most: float = 3.0) -> list[float]:
    """Shares of total (all sizes, if None) by weight, stopped at most times a source's size.

    What a stopped source leaves is shared again among the others by weight until none is
    above. If the caps hold less than total, every source gets its cap.
    """
    total = float(sum(sizes)) if total is None else float(total)
    out = [0.0] * len(sizes)
    rest = sorted((k for k in range(len(sizes)) if weights[k] > 0), key=lambda k: most * sizes[k] / weights[k])
    left, weight = total, float(sum(weights[k] for k in rest))
    for n, k in enumerate(rest):
        # The one that is full first: if it isn't full, none of the others is.
        if most * sizes[k] * weight <= left * weights[k]:
            out[k] = most * sizes[k]
            left -= out[k]
            weight -= weights[k]
        else:
            for j in rest[n:]:
                out[j] = left * weights[j] / weight
            break
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """Exact quotas of each shard (shards x sources): hypergeometric draws down a tree.

    The shards' totals differ by one block at most. The same seed gives the same table.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def fill(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        take = int(have.sum()) * (middle - first) // (last - first)
        left = _draw(np.random.Generator(np.random.Philox(key=[seed, first << 32 | last])), have, take)
        fill(first, middle, left)
        fill(middle, last, have - left)

    fill(0, shards, np.array(quotas, np.int64))
    return out


def _draw(rng: np.random.Generator, have: np.ndarray, take: int) -> np.ndarray:
    """take blocks out of have, without putting any back: each source against those that follow."""
    out, others = np.zeros_like(have), int(have.sum())
    for k, n in enumerate(have.tolist()):
        others -= n
        out[k] = hypergeometric(rng, n, others, take)
        take -= int(out[k])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of take draws out of good + bad are good, for any size.

    numpy's draws end at a billion. Beyond, the distribution is inverted: ratios of neighbouring
    probabilities, multiplied up from the mode as far as they are above 1e-30 of it.
    """
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, take))
    mode = min(max((take + 1) * (good + 1) // (good + bad + 2), low), high)
    share = good / (good + bad)
    reach = int(12 * np.sqrt(min(take, good + bad - take) * share * (1 - share))) + 100
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    more = np.cumprod((good - up) * (take - up) / ((up + 1) * (bad - take + up + 1)))
    less = np.cumprod(down * (bad - take + down) / ((good - down + 1) * (take - down + 1)))
    total = np.cumsum(np.concatenate([less[::-1], [1.0], more]))
    return mode - len(less) + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def word_sizes(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and size: number of words in the text; null and empty: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for b in W.blocks(batch.column(batch.num_columns - 1)):
                size[b.first : b.last] = b.counts()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size)], [*keep, "size"])

    return df.select(*keep, F.col(text)).mapInArrow(W.lean(run), df.select(*keep).schema.add("size", "long"))


def source_plan(sizes: DataFrame, weights, most: float, block_words: int, max_sources: int = 100_000) -> list[Source]:
    """Sources by code point, null last, with their targets. weights: a function of the sorted names."""
    blocks = F.ceil(F.col("size") / block_words)
    found = (
        sizes.groupBy("source").agg(F.sum("size").alias("size"), F.sum(blocks).alias("blocks")).limit(max_sources + 1).collect()
    )
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources: weights are given by source, so their number is bounded")
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    goal = targets([int(r["size"]) for r in found], weights([r["source"] for r in found]), most=most)
    return [Source(r["source"], int(r["size"]), int(r["blocks"]), t) for r, t in zip(found, goal, strict=True)]


def mix(
    df: DataFrame,
    weights=None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    row_id: str | None = None,
    most: float = 3.0,
    block_words: int = 1024,
    shards: int | None = None,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(documents, draws) of the mix of df.

    weights: maps the sorted list of source names to their weights (default: 1, 2, 3, repeating).
    documents has a row for each row of df: row_id (long), doc_id, source, size, source_size,
    target, taken. draws has a row for each block that the mix takes: row_id, doc_id, source,
    block (0 on), epoch, words (taken from the block's start), shard, place (in the shard).

    Null and empty texts have size 0 and are never taken; a null source is a source. Repeated
    rows and repeated ids are rows of their own. An empty df gives empty tables. Draws go by
    doc_id, size and block, so reruns agree whatever the order of the rows; equal rows are
    interchangeable. Only per-source sums come to the driver (max_sources bounds them). Ranks
    are taken inside hash buckets, so many tasks rank a source with a third of all rows.
    Further columns of df are ignored. row_id: a column with distinct numbers, if df has one.
    shards: as many as shuffle partitions if None, but so few that shards times sources is
    at most SHARD_QUOTAS, since the tasks get that table; more raise. Results are staged.
    """
    spark = df.sparkSession
    named = [F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source")]
    given = [F.col(row_id).alias("row_id")] if row_id else []
    sizes = word_sizes(df.select(*named, *given, F.col(text).alias("text")), ["doc_id", "source", *["row_id"] * len(given)])
    if not given:
        sizes = sizes.withColumn("row_id", F.monotonically_increasing_id())
    sizes = stage(sizes, "mix-sizes")
    plan = source_plan(sizes, weights or cyclic_weights, most, block_words)
    parts = shuffle_partitions(spark)
    most_shards = max(1, SHARD_QUOTAS // max(1, len(plan)))
    if shards is not None and shards > most_shards:
        raise ValueError(f"at most {most_shards} shards for {len(plan)} sources: their quotas go to every task")
    shards = shards or min(parts, most_shards)
    total_blocks = max(1, sum(s.blocks for s in plan))
    rows = []
    for s in plan:
        goal = min(round(s.target), int(most * s.size))
        passes, rest = divmod(goal, s.size) if s.size else (0, 0)
        rows.append((s.name, s.size, s.target, passes, rest, s.blocks, max(1, -(-s.blocks * 4 * parts // total_blocks))))
    sources = spark.createDataFrame(rows, "_s string, source_size long, target double, passes long, rest long, n_blocks long, buckets long")
    # As many rows as there are sources, which source_plan has bounded.
    joined = sizes.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    index = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / block_words) - 1).cast("int")))
    blocks = joined.where("size > 0").select(*(c for c in joined.columns if c not in ("source_size", "target")), index.alias("block"))
    blocks = blocks.withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("long"))

    def drawn(scratch: Scratch) -> DataFrame:
        ranked = _ranked(blocks, seed, scratch)
        # Passes over the whole source, then the front of its permutation, the last block in part.
        epochs = F.sequence(F.lit(1), (F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)).cast("int"))
        each = ranked.where("passes > 0 or before < rest").select("*", F.explode(epochs).alias("epoch"))
        last = F.col("epoch") > F.col("passes")
        # Every whole pass goes round the permutation from another point.
        turn = F.pmod(F.xxhash64(F.lit(seed), "source", "epoch"), F.col("n_blocks"))
        place = F.when(last, F.col("rank")).otherwise(F.pmod(F.col("rank") + turn, F.col("n_blocks")))
        return each.select(
            "row_id", "doc_id", "source", "size", "block", "epoch",
            F.when(last, F.least("words", F.col("rest") - F.col("before"))).otherwise(F.col("words")).alias("words"),
            ((F.col("epoch") - 1) * F.col("n_blocks") + place).alias("position"),
        )

    with Scratch(spark) as scratch:
        draws = stage(_dealt(scratch.stage(drawn(scratch), "mix-drawn"), plan, shards, seed), "mix-draws")
    taken = draws.groupBy("row_id").agg(F.sum("words").alias("taken"))
    documents = joined.join(taken, "row_id", "left").select(
        "row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return documents, draws.drop("size")


def _ranked(blocks: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """blocks with rank (place in the source's permutation) and before (words ahead of it)."""
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "block")
    keyed = blocks.withColumn("key", key).withColumn("bucket", F.floor(F.shiftrightunsigned("key", 33) * F.col("buckets") / F.lit(1 << 31)))
    keyed = scratch.stage(keyed, "mix-blocks")
    zero = F.lit(0).cast("long")
    ahead = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(F.col("source").alias("_s"), F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    sums = sums.select("_s", "_b", F.coalesce(F.sum("n").over(ahead), zero).alias("n0"), F.coalesce(F.sum("w").over(ahead), zero).alias("w0"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "block", "row_id")
    local = keyed.withColumns(
        {"r": F.row_number().over(inside) - 1, "c": F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)}
    )
    both = local.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return both.withColumns({"rank": F.col("n0") + F.col("r"), "before": F.col("w0") + F.col("c")}).drop("n0", "w0", "r", "c", "_s", "_b", "key", "bucket", "buckets")


def _dealt(drawn: DataFrame, plan: list[Source], shards: int, seed: int) -> DataFrame:
    """The draws with their shard, and their place in it by a keyed hash."""
    counts = {r["source"]: int(r["n"]) for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = split_quotas([counts.get(s.name, 0) for s in plan], shards, seed)
    spark = drawn.sparkSession
    numbers = spark.createDataFrame([(s.name, k) for k, s in enumerate(plan)], "_s string, _k int")
    shared = spark.sparkContext.broadcast(np.cumsum(table, axis=0))  # SHARD_QUOTAS numbers at most

    @F.pandas_udf("int")
    def shard_of(k, position):
        out = np.zeros(len(k), np.int32)
        for one in np.unique(k):
            here = (k == one).to_numpy()
            out[here] = np.searchsorted(shared.value[:, one], position[here].to_numpy(), side="right")
        import pandas as pd

        return pd.Series(out)

    joined = drawn.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("_s"))).withColumn("shard", shard_of("_k", "position"))
    within = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "block", "epoch"), "doc_id", "size", "block", "epoch", "row_id")
    return joined.withColumn("place", F.row_number().over(within) - 1).drop("_s", "_k", "position")


def cyclic_weights(names: list) -> list[float]:
    """1, 2, 3, repeating."""
    return [1.0 + k % 3 for k in range(len(names))]


def mixed_documents(df: DataFrame, weights=None, text: str = "text", **options) -> DataFrame:
    """The documents that the mix takes, with df's columns, whatever their names.

    A document is a row for each pass that takes it. Where a pass takes all its words, the
    text is unchanged; otherwise it is the words of the drawn blocks, joined by one space,
    and a column n_chars, if there is one, is counted anew. Null and empty texts, and those
    without words, are never taken; a null source is a source; repeated rows are rows of
    their own. An empty df gives no rows.
    """
    rid, at, epoch, parts = new_names(df, "row", "at", "epoch", "parts")
    held = stage(df.withColumn(rid, F.monotonically_increasing_id()), "mix-input")
    _, draws = mix(held, weights, text=text, row_id=rid, **options)
    block_words = options.get("block_words", 1024)
    spans = draws.groupBy(F.col("row_id").alias(at), F.col("epoch").alias(epoch)).agg(F.sort_array(F.collect_list(F.struct("block", "words"))).alias(parts))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        def one(value, blocks):
            words = value.encode().split()
            if sum(b["words"] for b in blocks) == len(words):
                return value
            return b" ".join(w for b in blocks for w in words[b["block"] * block_words :][: b["words"]]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    out = held.join(spans.hint("merge"), F.col(rid) == F.col(at)).withColumn(text, cut(text, parts))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)
