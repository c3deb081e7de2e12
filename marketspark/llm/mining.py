"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For a candidate v at angle a from a cluster's centre, whose
members lie within angle b of it, no member q scores more than |q| |v| cos(max(0, a - b)): the
angular bound, which orders one list of candidates for the whole cluster. Every member walks
that list until the bound falls below what it still needs, so results are exact whatever the
clusters are.

A list isn't written out. One pass counts the candidates of each level of the bound; levels
make bands, each several times as long as those before it. A round hands the members that are
not yet certified the next band of their list, cut into blocks, and only these candidates move.
Two walks are made: for the best rows of the anchor's own label, and then, their scores known,
for the best rows of other labels below each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, stage
from .topk import LONG, inner_products, integer_vectors

LEVELS = 256  # of the bound, from 0 to the largest norm
SLICE = 512  # candidates that a member meets before it looks at the bound again
SLACK = 1e-6  # of angles, far above what arccos loses

Batches = Iterator[pa.RecordBatch]


def _floats(column, dim: int) -> np.ndarray:
    """Rows of packed whole numbers as doubles; the width of a number follows from a row's length."""
    rows = list(column)
    out = np.zeros((len(rows), dim))
    if dim:
        width = np.array([len(r) // dim for r in rows])
        for size, kind in ((1, np.int8), (2, "<i2"), (4, "<i4"), (8, "<f8")):
            at = np.flatnonzero(width == size)
            if len(at):
                out[at] = np.frombuffer(b"".join([rows[k] for k in at]), kind).reshape(len(at), dim)
    return out


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 1, 2 and 4 byte integers and doubles that holds them."""
    top = np.abs(x).max(initial=0.0)
    return x.astype(np.int8 if top < 2**7 else "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8").tobytes()


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows; infinite only where doubles can't hold them."""
    top = np.abs(x).max(axis=1, initial=0.0)
    with np.errstate(all="ignore"):
        return np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1)) * top


def _units(x: np.ndarray) -> np.ndarray:
    """Directions of the rows; zero rows stay zero."""
    top = np.abs(x).max(axis=1, initial=0.0)
    small = x / np.where(top > 0, top, 1)[:, None]
    length = np.sqrt((small**2).sum(1))
    return small / np.where(length > 0, length, 1)[:, None]


def _lean_rows(batches: Batches) -> Batches:
    for batch in batches:
        v = [_packed(np.frombuffer(r, "<f8")) for r in batch.column(3).to_pylist()]
        norm = np.concatenate([_norms(np.frombuffer(r, "<f8")[None, :]) for r in batch.column(3).to_pylist()] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(v, pa.binary()), pa.array(norm)], ["vec_id", "label", "dim", "v", "norm"])


def fit_centres(units: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Up to n directions for these: far apart at first, then means of those nearest to them."""
    chosen = [0]
    near = units @ units[0]
    while len(chosen) < min(n, len(units)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    centres = units[chosen]
    for _ in range(rounds):
        own = (units @ centres.T).argmax(1)
        sums = np.stack([units[own == k].sum(0) for k in range(len(centres))])
        centres = np.where(np.abs(sums).max(axis=1, initial=0.0)[:, None] > 0, _units(sums), centres)
    return centres


@dataclass
class Lists:
    """The lists of the fitted clusters, numbered through all vector lengths: some KB for each cluster, at any size of the data."""

    centres: dict[int, np.ndarray]  # of each vector length
    first: dict[int, int]  # number of its first list
    angle: np.ndarray  # of each list: the largest between its centre and a member
    top: dict[int, float]  # the largest norm of each length
    band: np.ndarray | None = None  # of each list and level
    rows: np.ndarray | None = None
    blocks: np.ndarray | None = None  # of each list and band
    chunks: np.ndarray | None = None  # of each list's members

    def levels(self, x: np.ndarray, norm: np.ndarray, dim: int) -> np.ndarray:
        """The level of each row's bound in each list of its length."""
        lists = slice(self.first[dim], self.first[dim] + len(self.centres[dim]))
        angle = np.arccos(np.clip(_units(x) @ self.centres[dim].T, -1, 1))
        with np.errstate(all="ignore"):
            bound = np.cos(np.maximum(0, angle - self.angle[None, lists] - SLACK)) * (norm / self.top[dim])[:, None]
        bound = np.where(np.isnan(bound), 1.0, bound) if self.top[dim] > 0 else np.zeros(angle.shape)
        return np.clip(bound * (LEVELS - 1), 0, LEVELS - 1).astype(np.int64)

    def edges(self, dim: int) -> np.ndarray:
        """What a candidate of each level scores with a member of norm 1 at most."""
        return (np.arange(LEVELS) + 1) / (LEVELS - 1) * self.top[dim] * (1 + 1e-9)

    def cut(self, first_rows: int, growth: int, block_rows: int) -> None:
        """Bands of levels, from the highest bound down: each begins within growth times the rows that the one before began in."""
        above = np.cumsum(self.rows[:, ::-1], axis=1)[:, ::-1] - self.rows
        self.band = np.zeros(above.shape, np.int64)
        limit = first_rows
        while (above >= limit).any():
            self.band += above >= limit
            limit *= growth
        held = np.zeros((len(self.rows), int(self.band.max(initial=0)) + 1), np.int64)
        for k in range(held.shape[1]):
            held[:, k] = np.where(self.band == k, self.rows, 0).sum(1)
        self.blocks = -(-held // block_rows)

    def next_edge(self, band: int) -> list[float]:
        """For each list, the edge of the highest level after this band; minus infinity at its end."""
        out = []
        for dim, centres in self.centres.items():
            edges = self.edges(dim)
            for k in range(self.first[dim], self.first[dim] + len(centres)):
                left = np.flatnonzero((self.band[k] > band) & (self.rows[k] > 0))
                out.append(float(edges[left[-1]]) if len(left) else -np.inf)
        return out


def _by_dim(run: Callable[[pa.RecordBatch, int], Iterator[pa.RecordBatch]], dims: set[int], rows: int = 2000) -> Callable[[Batches], Batches]:
    """run on the rows of each of these vector lengths, some at a time; column 0 is dim."""

    def each(batches: Batches) -> Batches:
        for batch in batches:
            dim = batch.column(0).to_numpy()
            for d in sorted(set(dim.tolist()) & dims):
                at = np.flatnonzero(dim == d)
                for low in range(0, len(at), rows):
                    yield from run(batch.take(pa.array(at[low : low + rows])), d)

    return each


def _assigned(lists: Lists):
    """dim, anchor_id, label, v, norm, list, angle: each anchor with its nearest centre."""

    def run(batch: pa.RecordBatch, dim: int) -> Batches:
        cosine = _units(_floats(batch.column(3).to_pylist(), dim)) @ lists.centres[dim].T
        own = cosine.argmax(1)
        angle = np.arccos(np.clip(cosine[np.arange(len(own)), own], -1, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int64) + lists.first[dim]), pa.array(angle)], [*batch.schema.names, "list", "angle"])

    return _by_dim(run, set(lists.centres))


def _counted(lists: Lists):
    """list, level, rows of a task's candidates."""

    def counts(batches: Batches) -> Batches:
        rows = np.zeros((len(lists.angle), LEVELS), np.int64)

        def run(batch: pa.RecordBatch, dim: int) -> Batches:
            level = lists.levels(_floats(batch.column(1).to_pylist(), dim), batch.column(2).to_numpy(), dim)
            for k in range(level.shape[1]):
                rows[lists.first[dim] + k] += np.bincount(level[:, k], minlength=LEVELS)
            return iter(())

        for _ in _by_dim(run, set(lists.centres))(batches):
            pass
        at, level = np.nonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(level), pa.array(rows[at, level])], ["list", "level", "rows"])

    return counts


def _handed_out(lists: Lists, band: int, alive: np.ndarray):
    """list, block, chunk, bound, vec_id, label, v of the candidates in this band of the lists that members still walk."""

    def run(batch: pa.RecordBatch, dim: int) -> Batches:
        row, vec_id, label, v, norm = batch.columns[1:]
        level = lists.levels(_floats(v.to_pylist(), dim), norm.to_numpy(), dim)
        edges = lists.edges(dim)
        for k in range(level.shape[1]):
            own = lists.first[dim] + k
            at = np.flatnonzero(lists.band[own][level[:, k]] == band) if alive[own] else np.zeros(0, np.int64)
            if not len(at):
                continue
            block = row.to_numpy()[at] % lists.blocks[own, band]
            chunks = int(lists.chunks[own])
            take = np.repeat(at, chunks)
            columns = [np.full(len(take), own), np.repeat(block, chunks), np.tile(np.arange(chunks), len(at)), np.repeat(edges[level[at, k]], chunks)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(c.take(pa.array(take)) for c in (vec_id, label, v))], ["list", "block", "chunk", "bound", "vec_id", "label", "v"])

    return _by_dim(run, set(lists.centres))


def _ragged(column, empty: int) -> np.ndarray:
    out = np.full((len(column), max((len(c) for c in column), default=0)), empty, np.int64)
    for k, c in enumerate(column):
        out[k, : len(c)] = c
    return out


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (member, under, id, score) the k best of each member and number of under, in order."""
    member, under, ids, score = found
    order = np.lexsort((ids, ~score, under, member))
    member, under, ids, score = (a[order] for a in (member, under, ids, score))
    begins = np.ones(len(member), bool)
    begins[1:] = (member[1:] != member[:-1]) | (under[1:] != under[:-1])
    start = np.flatnonzero(begins)
    place = np.arange(len(member)) - np.repeat(start, np.diff([*start, len(member)]))
    kept = place < k
    return [a[kept] for a in (member, under, ids, score)]


def _walked(k: int, same: bool):
    """For cogroups: the members' k best of a block, at or below each number of ``under`` and not below ``least``."""

    def run(rows: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(members):
            return pd.DataFrame({"anchor_id": [], "under": [], "vec_id": [], "score": []})
        dim = int(members["dim"].iloc[0])
        rows = rows.sort_values("bound", ascending=False, kind="stable")
        x, bound, ids, labels = _floats(rows["v"], dim), rows["bound"].to_numpy(), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        q, norm, own, label = _floats(members["v"], dim), members["norm"].to_numpy(), members["anchor_id"].to_numpy(), members["label"].to_numpy()
        under, least = _ragged(members["under"], LONG.min), _ragged(members["least"], LONG.max)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), ids[:0], np.zeros(0, np.int64)]
        for low in range(0, len(rows), SLICE):
            with np.errstate(all="ignore"):
                reach = norm * bound[low] * (1 + 1e-9) + 1
            on = np.flatnonzero(((least <= reach[:, None]) | ~np.isfinite(reach)[:, None]).any(axis=1))
            if not len(on):
                break
            part = slice(low, low + SLICE)
            score = inner_products(q[on], x[part])
            fit = ((label[on][:, None] == labels[None, part]) == same) & (own[on][:, None] != ids[None, part])
            for n in range(under.shape[1]):
                member, at = np.nonzero(fit & (score <= under[on, n][:, None]) & (score >= least[on, n][:, None]))
                found = [np.concatenate(pair) for pair in zip(found, (on[member], np.full(len(member), n), ids[part][at], score[member, at]), strict=True)]
            found = _best(found, k)
            member, n, _, score = found
            last = np.flatnonzero(np.bincount(member * under.shape[1] + n, minlength=under.size) == k)
            at = np.searchsorted(member * under.shape[1] + n, last, "right") - 1
            least.reshape(-1)[last] = np.maximum(least.reshape(-1)[last], score[at])
        member, n, near, score = found
        return pd.DataFrame({"anchor_id": own[member], "under": under[member, n], "vec_id": near, "score": score})

    return run


def _walk(index: DataFrame, members: DataFrame, lists: Lists, rest: DataFrame, k: int, same: bool, id_type: str, name: str, scratch: Scratch) -> DataFrame:
    """anchor_id, under, rank, vec_id, score: for each number of ``under`` the k best rows at or below it, and at or above its ``least``.

    members: anchor_id, label, dim, v, norm, list, under and least (arrays). rest: list, blocks,
    chunks of the vector lengths without a fitted list, whose one band is everything.
    """
    spark = index.sparkSession
    fitted = len(lists.angle)
    order = Window.partitionBy("anchor_id", "under").orderBy(F.desc("score"), "vec_id")
    due, best = members, None
    for band in range(1 if lists.blocks is None else max(1, lists.blocks.shape[1])):
        alive = np.zeros(fitted, bool)
        alive[[r["list"] for r in due.where("list >= 0").select("list").distinct().collect()]] = True
        parts = [(k, int(lists.blocks[k, band]), int(lists.chunks[k])) for k in np.flatnonzero(alive).tolist() if lists.blocks[k, band]]
        cut = spark.createDataFrame(parts, "list long, blocks long, chunks long")
        rows = index.select("dim", "row", "vec_id", "label", "v", "norm").mapInArrow(_handed_out(lists, band, alive), f"list long, block long, chunk long, bound double, vec_id {id_type}, label long, v binary")
        if not band:
            others = index.select((-1 - F.col("dim").cast("long")).alias("list"), "row", "vec_id", "label", "v", "norm").where(~F.col("dim").isin(list(lists.centres))).join(rest, "list")
            others = others.select("list", (F.col("row") % F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("norm").alias("bound"), "vec_id", "label", "v")
            rows, cut = rows.unionByName(others), cut.unionByName(rest)
        asked = due.join(cut, "list").withColumn("chunk", bucket_of(F.col("chunks"), "anchor_id")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked = asked.select("list", "block", "chunk", "anchor_id", "label", "dim", "v", "norm", "under", "least")
        key = ["list", "block", "chunk"]
        found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_walked(k, same), f"anchor_id {id_type}, under long, vec_id {id_type}, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = scratch.stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"{name}-best-{band}")
        # Who can still gain from the rest of the list.
        edges = lists.next_edge(band) if fitted else []
        if not any(np.isfinite(edges)):
            break
        ahead = F.broadcast(spark.createDataFrame([(n, e) for n, e in enumerate(edges) if e > -np.inf], "list long, edge double"))
        last = best.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("under", "score"))).alias("last"))
        least = F.transform(F.arrays_zip("under", "least"), lambda x: F.greatest(x["least"], F.try_element_at("last", x["under"])))
        due = due.join(ahead, "list").join(last, "anchor_id", "left").withColumn("least", F.when(F.col("last").isNull(), F.col("least")).otherwise(least)).drop("last")
        reach = F.col("norm") * F.col("edge") * (1 + 1e-9) + 1
        due = due.where(F.exists("least", lambda x: x <= reach) | (F.col("norm") * F.col("edge") == float("inf"))).drop("edge")
        due = scratch.stage(due, f"{name}-due-{band}")
        if not due.limit(1).count():
            break
    return best


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
    clusters: int = 16,
    sample: int = 4096,
    first_rows: int = 4096,
    growth: int = 8,
    block_rows: int = 2048,
    chunk_rows: int = 2048,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors: a condition on vec_id. Scores are integer inner products of floor(scale * x); higher
    ones come first, ties by the smaller id. An anchor's positives are its first rows of the same
    label; a positive's negatives are the anchor's first rows of other labels that score at most
    the positive's score and at least ``least_percent`` percent of it.

    Rows with a null id, label or vector, or with null or non-finite components, take no part.
    Vectors are compared with those of their own length; empty ones score 0 with each other. Of
    an anchor id that repeats, the row of the least label and vector asks; repeated rows are
    candidates each, but never for their own id. Scores beyond long's range are its ends. A
    positive without negatives gives no rows, and so does an empty table. Further columns are
    ignored, whatever their names. Labels are whole numbers.

    Centres are fitted on at most ``sample`` anchors, those of the least hash of their id; they
    decide speed only. At most ``clusters`` of each and all lengths are fitted; anchors of other
    lengths walk one list for each length. Tasks hold a block of candidates and a chunk of anchors.
    """
    id_type = df.schema[vec_id].dataType.simpleString()
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        plain = df.select(F.col(vec_id).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("x")).where("label IS NOT NULL")
        whole = integer_vectors(plain, "id", "x", scale, "label")
        index = whole.mapInArrow(_lean_rows, f"vec_id {id_type}, label long, dim int, v binary, norm double")
        index = scratch.stage(index.withColumn("row", F.monotonically_increasing_id()), "mining-index")
        own = index.where(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "dim", "v", "norm")).alias("own"))
        own = scratch.stage(own.select("own.dim", "anchor_id", "own.label", "own.v", "own.norm"), "mining-anchors")

        # Centres of the commonest lengths of a bounded sample.
        fit = own.orderBy(F.xxhash64("anchor_id"), "anchor_id").limit(sample).select("dim", "v").toPandas()
        lists = Lists({}, {}, np.zeros(0), {})
        for dim, times in fit["dim"].value_counts().sort_index().sort_values(ascending=False, kind="stable").head(clusters).items():
            lists.first[dim] = sum(map(len, lists.centres.values()))
            lists.centres[dim] = fit_centres(_units(_floats(fit["v"][fit["dim"] == dim], dim)), max(1, clusters * int(times) // len(fit)))
        fitted = list(lists.centres)
        placed = own.mapInArrow(_assigned(lists), f"dim int, anchor_id {id_type}, label long, v binary, norm double, list long, angle double")
        others = own.where(~F.col("dim").isin(fitted)).withColumns({"list": -1 - F.col("dim").cast("long"), "angle": F.lit(0.0)})
        own = scratch.stage(placed.unionByName(others), "mining-members")
        known = sum(map(len, lists.centres.values()))
        lists.angle, lists.chunks = np.zeros(known), np.zeros(known, np.int64)
        sizes = own.groupBy("list").agg(F.max("angle").alias("angle"), F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
        for r in sizes.where("list >= 0").collect():
            lists.angle[r["list"]], lists.chunks[r["list"]] = r["angle"], r["chunks"]
        for r in index.where(F.col("dim").isin(fitted)).groupBy("dim").agg(F.max("norm").alias("top")).collect():
            lists.top[r["dim"]] = r["top"]
        if fitted:
            lists.rows = np.zeros((known, LEVELS), np.int64)
            for r in index.select("dim", "v", "norm").mapInArrow(_counted(lists), "list long, level long, rows long").groupBy("list", "level").agg(F.sum("rows").alias("rows")).collect():
                lists.rows[r["list"], r["level"]] = r["rows"]
            lists.cut(first_rows, growth, block_rows)
        rest = index.where(~F.col("dim").isin(fitted)).groupBy((-1 - F.col("dim").cast("long")).alias("list")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        rest = rest.join(sizes.where("list < 0").select("list", "chunks"), "list").select("list", "blocks", "chunks")

        members = own.drop("angle").withColumns({"under": F.array(F.lit(LONG.max)), "least": F.array(F.lit(LONG.min))})
        same = _walk(index, members, lists, rest, positives, True, id_type, "mining-positives", scratch)
        near = same.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        under = near.select("anchor_id", F.col("positive_score").alias("p"), _percent_of(F.col("positive_score"), least_percent).alias("low")).where("low <= p").distinct()
        wanted = under.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("p", "low"))).alias("wanted"))
        members = own.drop("angle").join(wanted, "anchor_id").withColumns({"under": F.col("wanted.p"), "least": F.col("wanted.low")}).drop("wanted")
        members = scratch.stage(members, "mining-asking")
        differ = _walk(index, members, lists, rest, negatives, False, id_type, "mining-negatives", scratch)
        differ = differ.select(F.col("anchor_id").alias("_a"), F.col("under").alias("_p"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = near.join(differ, (F.col("anchor_id") == F.col("_a")) & (F.col("positive_score") == F.col("_p")))
        return stage(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mining-found")


def _percent_of(p: Column, percent: int) -> Column:
    """The least whole number n with 100 * n >= percent * p, without leaving long's range."""
    return F.ceil(p.cast("decimal(20,0)") * F.lit(percent).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
