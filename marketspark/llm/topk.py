"""Exact top-k search by inner product: a pivot-distance index.

Vectors are keyed by their nearest pivot and by the ring (annulus) of their distance to it.
A query meets the cells, that is rings of pivots, in the order of what their vectors can
score at most: by the triangle inequality a vector v of a ring is at least as far from the
query q as the ring, and <q, v> = (|q|^2 + |v|^2 - |q - v|^2) / 2. Cells are opened in
rounds of growing size; a query stops where no cell left can reach its k-th score so far,
so results are exact whatever the pivots are. Each vector length has an index of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stage

RINGS = 16  # the last one is open
LONG = np.iinfo(np.int64)


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: float, *more: str) -> DataFrame:
    """vec_id, further columns, dim, v (little-endian doubles floor(scale * x), whole numbers) of the rows that take part.

    Where scale * x is beyond doubles, that is from about 1e305 on, v holds floor(x) instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            offsets = lists.offsets.to_numpy()
            keep, out = [], []
            with np.errstate(all="ignore"):
                scaled = np.floor(flat * scale)
                fine = np.isfinite(flat)
                scaled = np.where(np.isinf(scaled) & fine, np.floor(flat), scaled)  # beyond what doubles can scale
            bad = np.concatenate([[0], np.cumsum(~fine)])
            valid = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(valid & (bad[offsets[1:]] == bad[offsets[:-1]])).tolist():
                keep.append(k)
                out.append(scaled[offsets[k] : offsets[k + 1]].astype("<f8").tobytes())
            kept = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(o) // 8 for o in out], pa.int32()), pa.array(out, pa.binary())], [*names, "dim", "v"])

    names = ["vec_id", *more]
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, [vec_id, *more], strict=True))
    columns = [F.col(c).alias(n) for n, c in zip(names, [vec_id, *more], strict=True)]
    return df.select(*columns, F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, f"{kinds}, dim int, v binary")


def _matrix(column) -> np.ndarray:
    rows = list(column)
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), len(rows[0]) // 8 if rows else 0)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n vectors of the sample, each as far as can be from those before it."""
    chosen = [0]
    with np.errstate(all="ignore"):
        far = ((sample - sample[0]) ** 2).sum(1)
        while len(chosen) < min(n, len(sample)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1))


def _placed(pivots: np.ndarray, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                x = _matrix(part.column(1).to_pylist())
                d = _distances(x, pivots)
                nearest = d.argmin(1)
                near = d[np.arange(len(d)), nearest]
                ring = np.minimum(near / width, RINGS - 1).astype(np.int32)
                with np.errstate(all="ignore"):
                    norm2 = (x**2).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nearest.astype(np.int32)), pa.array(ring), pa.array(near), pa.array(norm2)], ["vec_id", "v", "pivot", "ring", "dist", "norm2"])

    return run


def _bounds(x: np.ndarray, pivots: np.ndarray, cells: pd.DataFrame) -> np.ndarray:
    """What a vector of each cell can score with each query at most, a little rounded up; infinite where doubles overflow."""
    d = _distances(x, pivots)[:, cells["pivot"].to_numpy()]
    with np.errstate(all="ignore"):
        gap = np.maximum(0, np.maximum(d - cells["far"].to_numpy(), cells["near"].to_numpy() - d))
        norm2 = (x**2).sum(1)[:, None]
        most = cells["norm2"].to_numpy()[None, :]
        bound = np.minimum((norm2 + most - gap**2) / 2, np.sqrt(norm2) * np.sqrt(most)) + 1 + 1e-9 * (norm2 + most)
    return np.where(np.isnan(bound), np.inf, bound)


def _opened(pivots: np.ndarray, cells: pd.DataFrame, first: int, last: int):
    """(query_id, v, least, chunk) to the blocks of cells number first to last - 1 that can reach least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, ring, blocks = (cells[c].to_numpy() for c in ("pivot", "ring", "blocks"))
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                ids, v, least, chunk = (c.to_pylist() for c in part.columns)
                bound = _bounds(_matrix(v), pivots, cells)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                row, col = np.nonzero(np.take_along_axis(bound, order, 1) >= np.array([-np.inf if x is None else x for x in least])[:, None])
                cell = order[row, col]
                times = blocks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(pivot[cell]), pa.array(ring[cell]), pa.array(block), part.column(3).take(take), part.column(0).take(take), part.column(1).take(take), part.column(2).take(take)], ["pivot", "ring", "block", "chunk", "query_id", "v", "least"])

    return run


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as long; those beyond long's range are its ends."""
    top_q, top_x = (np.abs(m).max(initial=0.0, axis=1) for m in (q, x))
    dim = max(1, x.shape[1])

    def small(a: float, b: float, limit: int) -> bool:
        return float(a) * float(b) * dim < limit

    if small(top_q.max(initial=0.0), top_x.max(initial=0.0), 2**53):
        return (q @ x.T).astype(np.int64)
    out = np.zeros((len(q), len(x)), np.int64)
    common = 2.0**26 / np.sqrt(dim)  # two such rows have an exact product in doubles
    easy_q, easy_x = top_q < common, top_x < common
    out[np.ix_(easy_q, easy_x)] = (q[easy_q] @ x[easy_x].T).astype(np.int64)
    rows_q, rows_x = ([[int(c) for c in row] for row in m] for m in (q, x))
    for k, j in zip(*np.nonzero(~(easy_q[:, None] & easy_x[None, :])), strict=True):
        out[k, j] = min(max(sum(a * b for a, b in zip(rows_q[k], rows_x[j], strict=True)), LONG.min), LONG.max)
    return out


def _scores(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, near, score = [], [], []
        if len(rows) and len(queries):
            x, ids = _matrix(rows["v"]), rows["vec_id"].to_numpy()
            for first in range(0, len(queries), 256):
                part = queries.iloc[first : first + 256]
                own = part["query_id"].to_numpy()
                least = part["least"].to_numpy(np.int64, na_value=LONG.min)
                s = inner_products(_matrix(part["v"]), x)
                fit = (s >= least[:, None]) & (own[:, None] != ids[None, :])
                for one, hits, scores in zip(own, fit, s, strict=True):
                    hit = np.flatnonzero(hits)
                    if len(hit) > k:
                        hit = hit[np.lexsort((ids[hit], ~scores[hit]))[:k]]  # ~s falls as s grows, and can't overflow
                    asked.append(np.repeat(one, len(hit)))
                    near.append(ids[hit])
                    score.append(scores[hit])
        if not asked:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame({"query_id": np.concatenate(asked), "vec_id": np.concatenate(near), "score": np.concatenate(score)})

    return run


def top_k(
    df: DataFrame,
    queries: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 1024.0,
    pivots: int = 32,
    sample: int = 4096,
    block_rows: int = 2048,
    chunk_rows: int = 4096,
    rounds: tuple[int, ...] = (4, 32),
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows but the query's own.

    queries: a condition on vec_id. Scores are integer inner products of floor(scale * x); ties
    go to the smaller id. A score beyond long's range is long's nearest end, and so ties with
    others there. Rows with a null id, a null vector, null or non-finite components take no
    part. Vectors are compared with those of their own length; empty ones score 0. A query whose id repeats
    is asked once for each length, with the least of its vectors; repeated rows are candidates
    each. No vectors: no rows. Further columns are ignored, whatever their names.

    Pivots come from a sample of at most ``sample`` rows of each length, the least by the id's
    hash; it decides speed only. Cells have at most pivots * 16 statistics rows, which are what
    is broadcast. The distinct lengths come to the driver, which runs one search for each.
    """
    spark = df.sparkSession
    kind = df.schema[vec_id].dataType.simpleString()
    with Scratch(spark) as scratch:
        whole = scratch.stage(integer_vectors(df, vec_id, vector, scale), "topk-vectors")
        best = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
        for r in whole.select("dim").distinct().orderBy("dim").collect():
            own = whole.where(F.col("dim") == r["dim"]).drop("dim")
            best = best.unionByName(_search(own, queries, kind, k, pivots, sample, block_rows, chunk_rows, rounds, scratch))
        return stage(best, "topk-best")


def _search(whole: DataFrame, queries: Column, kind: str, k: int, pivots: int, sample: int, block_rows: int, chunk_rows: int, rounds: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """top_k of vectors of one length."""
    spark = whole.sparkSession
    fit = _matrix([r["v"] for r in whole.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()])
    chosen = choose_pivots(fit, pivots)
    near = _distances(fit, chosen).min(1)
    near = near[np.isfinite(near)]
    width = max(float(np.quantile(near, 0.98)) / (RINGS - 1) if len(near) else 0.0, 1e-9)
    index = scratch.stage(whole.mapInArrow(_placed(chosen, width), f"vec_id {kind}, v binary, pivot int, ring int, dist double, norm2 double"), "topk-index")
    stats = index.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("rows"), F.min("dist").alias("near"), F.max("dist").alias("far"), F.max("norm2").alias("norm2"))
    stats = stats.withColumn("blocks", F.ceil(F.col("rows") / block_rows))
    cells = stats.toPandas().sort_values(["pivot", "ring"], ignore_index=True)
    sizes = spark.createDataFrame(cells[["pivot", "ring", "blocks"]], "pivot int, ring int, blocks long")
    filed = index.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).select("pivot", "ring", "block", "vec_id", "v")

    asked = index.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    chunks = max(1, -(-asked.count() // chunk_rows))
    asked = scratch.stage(asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("long")), "topk-queries")
    key = ["pivot", "ring", "block", "chunk"]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best: DataFrame | None = None
    for first, last in zip((0, *rounds), (*rounds, len(cells)), strict=True):
        if first >= len(cells):
            break
        if best is None:
            due = asked.select("query_id", "v", F.lit(None).cast("long").alias("least"), "chunk")
        else:
            least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            due = asked.join(least, "query_id", "left").select("query_id", "v", "least", "chunk")
        opened = due.mapInArrow(_opened(chosen, cells, first, last), f"pivot int, ring int, block long, chunk long, query_id {kind}, v binary, least long")
        opened = scratch.stage(opened, f"topk-opened-{first}")
        # Only blocks that some query opens move, once for each chunk of queries that does.
        met = filed.join(opened.select(*key).distinct(), ["pivot", "ring", "block"])
        met = met.select(*(F.col(c).alias(f"at_{c}") for c in key), "vec_id", "v")
        found = met.groupBy(*(f"at_{c}" for c in key)).cogroup(opened.groupBy(*key)).applyInPandas(_scores(k), f"query_id {kind}, vec_id {kind}, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = scratch.stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"topk-round-{first}")
        scratch.drop(f"topk-opened-{first}")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
