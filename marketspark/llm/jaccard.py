"""N-gram Jaccard join: prefix filters under several global token orders, then exact counts.

A text's set is its distinct shingles (runs of ``size`` words), as 64-bit hashes; a text of
fewer words has its whole sequence as the one shingle. Sets are told apart, and their shingles
compared, by these hashes. Two sets of similarity t or more share a token among their first
n - ceil(t n) + 1 tokens under any order of all tokens.

* Order A begins with one hash-chosen part of the tokens, rare ones first by their counts
  over all distinct sets; sets meet in the buckets of its prefix tokens.
* Orders B and C go by two other hashes; candidates must share a prefix token in these too.
* What is left is compared exactly.

Equal sets form one class, and one row stands for it. Buckets of at most ``pair_rows`` sets
are joined with themselves; places in the order and 256-bit parity maps bound the difference
from below inside that join. Sets of larger buckets are cut into blocks of sets that share
tokens and are of like size. A block is compared with itself, and with those sets of another
that sizes and places in the order allow to be similar to one of its own in such a bucket.
That happens inside one task for each two blocks, by products of 0-1 matrices: first the
prefixes of B and C, then the whole sets. Only a row for each set and block pair comes out,
with its number of links and the least set it is connected with there, so rows grow by the
number of blocks and not with pairs, whatever lies just under the threshold. Every link shares
a bucket, so none is missed; a pair that the blocks compare isn't counted again among the
joined ones. What is dealt to the tasks at once is bounded by a multiple of the sets' own
tokens; if block pairs hold more, they are compared in rounds.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, bucket_of, component_labels, new_names, parted, stage

BITS = 256
CELLS = 4_000_000
TOKEN_SHARES = 4
DEALT = 2  # times the tokens of the sets in blocks, dealt to tasks in one round


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    for b in W.blocks(column):
        words = b.hashes(lower=True)
        windows = W.window_hashes(words, size)
        for first, last in zip(b.word_offsets[:-1].tolist(), b.word_offsets[1:].tolist(), strict=True):
            if last - first >= size:
                yield np.unique(windows[first : last - size + 1])
            else:
                yield W.window_hashes(words[first:last], last - first) if last > first else words[:0]


def _least(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with a similar one."""
    return -(-percent * n // 100)


def _part(percent: int) -> int:
    """One token in so many is of the part that comes first in order A: a little more than a prefix needs."""
    return max(1, round(100 / (100 - percent + 6)))


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _summary_of(size: int, percent: int):
    part = np.uint64(_part(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, bits, picks, extra = [], [], [], [], []
            for s in shingle_sets(batch.column(2), size):
                with np.errstate(over="ignore"):
                    fp.append((int(W.mix(s).sum(dtype=np.uint64)), int(W.mix(s ^ W.MULTIPLIERS[1]).sum(dtype=np.uint64))))
                parity = np.bincount((s >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
                bits.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                chosen = s % part == 0
                need = len(s) - _least(len(s), percent) + 1 if len(s) else 0
                p = s[chosen]
                n.append(len(s))
                picks.append(_long(p))
                extra.append(_long(s[~chosen][: max(0, need - len(p))]))
            fps = np.array(fp, np.uint64).reshape(-1, 2).view(np.int64)
            maps = np.array(bits, np.int64).reshape(-1, 4)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fps[:, 0]), pa.array(fps[:, 1]), *(pa.array(maps[:, k]) for k in range(4))]
            columns += [pa.array([len(p) for p in picks], pa.int32()), _lists(picks, np.int64), _lists(extra, np.int64)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "fp1", "fp2", "b0", "b1", "b2", "b3", "n_picks", "picks", "extra"])

    return W.lean(run)


def _sets_of(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            orders = []
            for k in (1, 2):
                short = []
                for s in sets:
                    need = len(s) - _least(len(s), percent) + 1
                    h = W.mix(s + W.MULTIPLIERS[k])
                    short.append((np.partition(h, need - 1)[:need] if need < len(h) else h).astype(np.uint32).view(np.int32))
                orders.append(_lists(short, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists([_long(s) for s in sets], np.int64), *orders], ["uid", "n", "tokens", "order_b", "order_c"])

    return W.lean(run)


def _may_link(percent: int, a: str, b: str) -> Column:
    """Whether two prefix rows can belong to similar sets: by sizes, by places in the order, by parity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = n + m - 2 * F.ceil(percent * (n + m) / F.lit(100 + percent))
    apart = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(1, 4)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (F.col(f"{a}.pos") + F.col(f"{b}.pos") <= differ) & (apart <= differ)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar."""
    for end in ("u", "v"):
        orders = sets.select(F.col("uid").alias(end), F.col("order_b").alias(f"{end}_b"), F.col("order_c").alias(f"{end}_c"))
        pairs = pairs.join(orders, end)
    pairs = pairs.where(F.arrays_overlap("u_b", "v_b") & F.arrays_overlap("u_c", "v_c")).select("u", "v")
    for end in ("u", "v"):
        whole = sets.select(F.col("uid").alias(end), F.col("n").alias(f"{end}_n"), F.col("tokens").alias(f"{end}_t"))
        pairs = pairs.join(whole, end)
    both = F.size(F.array_intersect("u_t", "v_t"))
    return pairs.where(100 * both >= percent * (F.col("u_n") + F.col("v_n") - both)).select("u", "v")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Tokens that each set of left shares with each of right (None: of left itself).

    Products of 0-1 matrices over the tokens that occur on both sides, some columns at a
    time; whole numbers below 2**24, so exact.
    """
    own = right is None
    a = np.concatenate([*left, np.zeros(0, left[0].dtype if left else np.int64)])
    b = a if own else np.concatenate([*right, np.zeros(0, a.dtype)])
    if own:
        values, times = np.unique(a, return_counts=True)
        common = values[times > 1]
    else:
        common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(left) if own else len(right)), np.int64)
    if own:
        np.fill_diagonal(out, [len(s) for s in left])
    if not len(common):
        return out

    def placed(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        kept = common[column] == flat
        row, column = row[kept], column[kept]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    rows_a, columns_a = placed(left, a)
    rows_b, columns_b = (rows_a, columns_a) if own else placed(right, b)
    total = np.zeros(out.shape, np.int64)
    wide = max(1, CELLS // max(1, *out.shape))
    for first in range(0, len(common), wide):

        def part(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
            low, high = np.searchsorted(columns, [first, first + wide])
            x = np.zeros((n, min(wide, len(common) - first)), np.float32)
            x[rows[low:high], columns[low:high] - first] = 1
            return x

        x = part(rows_a, columns_a, len(left))
        y = x if own else part(rows_b, columns_b, len(right))
        total += (x @ y.T).astype(np.int64)
    if own:
        np.fill_diagonal(total, out.diagonal())
    return total


def similar(sets: list[np.ndarray], orders: list[list[np.ndarray]], cut: int, percent: int) -> np.ndarray:
    """Which of the first cut sets are similar to which of the others; with cut = 0, all of them to each other.

    Candidates share prefix tokens under each of the orders; they are compared exactly,
    one by one if they are few.
    """
    left, right = (sets[:cut], sets[cut:]) if cut else (sets, None)
    n = np.array([len(s) for s in left])
    m = n if right is None else np.array([len(s) for s in right])
    found = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    for order in orders:
        found &= shared_counts(*((order[:cut], order[cut:]) if cut else (order,))) > 0
    if right is None:
        np.fill_diagonal(found, False)
    u, v = np.nonzero(found)
    if len(u) > 4 * len(sets):
        both = shared_counts(left, right)
    else:
        both = np.zeros(found.shape, np.int64)
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            both[x, y] = len(np.intersect1d(left[x], (left if right is None else right)[y], assume_unique=True))
    return found & (100 * both >= percent * (n[:, None] + m[None, :] - both))


def _least_reached(linked: np.ndarray, ids: np.ndarray, cut: int) -> np.ndarray:
    """The least of ids that links reach from each."""
    ids = ids.copy()
    largest = np.iinfo(np.int64).max
    while True:
        left, right = (ids[:cut], ids[cut:]) if cut else (ids, ids)
        to_left = np.minimum(left, np.where(linked, right[None, :], largest).min(axis=1, initial=largest))
        to_right = np.minimum(right, np.where(linked, to_left[:, None], largest).min(axis=0, initial=largest))
        new = np.concatenate([to_left, to_right]) if cut else np.minimum(to_left, to_right)
        if (new == ids).all():
            return ids
        ids = new


def _links_in(percent: int):
    """A function for applyInPandas: links of the members of each (low, high), between the two blocks or inside the one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (low, high), part in pdf.groupby(["low", "high"], sort=False):
            if low != high:
                part = part.sort_values("block", key=lambda b: b != low, kind="stable")
            cut = 0 if low == high else int((part["block"] == low).sum())
            ids = part["uid"].to_numpy()
            sets, b, c = ([np.asarray(x) for x in part[name]] for name in ("tokens", "order_b", "order_c"))
            linked = similar(sets, [b, c], cut, percent)
            links = np.concatenate([linked.sum(axis=1), linked.sum(axis=0)]) if cut else linked.sum(axis=1)
            root = _least_reached(linked, ids, cut)
            out.append(pd.DataFrame({"uid": ids[links > 0], "links": links[links > 0], "root": root[links > 0]}))
        return pd.concat(out) if out else pd.DataFrame({"uid": [], "links": [], "root": []})

    return run


def _blocks(crowded: DataFrame, scratch: Scratch, percent: int, block_rows: int, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(uid, n, block) of each set of crowded (tok, pos, uid, n), and (uid, n, block, other): the other blocks it is compared with.

    Sets that share tokens come under one label where that is easily seen, and a label's sets
    of like size are cut into blocks of about block_rows sets and block_tokens tokens. Labels
    decide how many block pairs there are, not which sets are compared: that goes by the tokens.
    """
    least = crowded.groupBy("tok").agg(F.min("uid").alias("least"))
    first = scratch.stage(crowded.join(least, "tok").groupBy("uid").agg(F.min("least").alias("near"), F.first("n").alias("n")), "jaccard-near")
    jump = first.select(F.col("uid").alias("near"), F.col("near").alias("label"))
    once = first.join(jump, "near")
    again = first.select(F.col("uid").alias("label"), F.col("near").alias("far"))
    # Similar sets are of one band or of neighbouring ones.
    band = F.floor(F.log("n") / math.log(100 / min(percent, 99))).alias("band")
    labels = scratch.stage(once.join(again, "label").select("uid", "near", "n", F.col("far").alias("label"), band), "jaccard-near-labels")

    def parts() -> Column:
        return F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / block_tokens)).cast("int")

    of_label = labels.groupBy("label", "band").agg(parts().alias("blocks"))
    of_near = labels.groupBy("label", "band", "near").agg(parts().alias("spread"))
    # Sets of one nearest set stay together, as far as they fit one block.
    number = F.pmod(F.xxhash64("near") + bucket_of(F.col("spread"), "uid"), F.col("blocks"))
    blocks = labels.join(of_label, ["label", "band"]).join(of_near, ["label", "band", "near"]).select("uid", "n", F.xxhash64("label", "band", number).alias("block"))
    blocks = scratch.stage(blocks, "jaccard-blocks")
    placed = scratch.stage(crowded.join(blocks.select("uid", "block"), "uid"), "jaccard-placed")
    met = placed.groupBy("tok", "block").agg(F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.min("pos").alias("least_pos"))
    met = scratch.stage(met.withColumnRenamed("block", "other"), "jaccard-met")
    apart = met.groupBy("tok").agg(F.min("other").alias("b0"), F.max("other").alias("b1")).where("b0 <> b1").select("tok")
    # What can be similar to a set has a size near its own, and the tokens before the first common one are of one set only.
    n = F.col("n")
    sizes = (100 * F.col("high_n") >= percent * n) & (100 * n >= percent * F.col("low_n"))
    most = F.least(F.col("high_n"), F.floor(100 * n / percent))
    places = (100 + percent) * (F.col("pos") + F.col("least_pos")) <= (100 - percent) * (n + most)
    reach = placed.join(met.join(apart, "tok"), "tok").where((F.col("block") != F.col("other")) & sizes & places)
    return blocks, scratch.stage(reach.select("uid", "n", "block", "other").distinct(), "jaccard-reach")


def _not_in_blocks(pairs: DataFrame, blocks: DataFrame, reach: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that the blocks don't compare: their sets aren't in one block, nor each dealt to the other's."""
    for end, name in (("u", "bu"), ("v", "bv")):
        pairs = pairs.join(blocks.select(F.col("uid").alias(end), F.col("block").alias(name)), end, "left")
    for end, other, name in (("u", "bv", "to_v"), ("v", "bu", "to_u")):
        dealt = reach.select(F.col("uid").alias(end), F.col("other").alias(other), F.lit(True).alias(name))
        pairs = pairs.join(dealt, [end, other], "left")
    one = F.coalesce(F.col("bu") == F.col("bv"), F.lit(False))
    return pairs.where(~one & (F.col("to_v").isNull() | F.col("to_u").isNull())).select("u", "v")


def _met_in_blocks(sets: DataFrame, blocks: DataFrame, reach: DataFrame, scratch: Scratch, percent: int, block_rows: int, block_tokens: int) -> DataFrame:
    """uid, links, root: what the blocks find of each set, a row for each block or pair of blocks with links."""
    own = blocks.select("uid", "n", "block", F.col("block").alias("low"), F.col("block").alias("high"))
    across = reach.select("uid", "n", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    due = own.unionByName(across)
    sizes = due.groupBy("low", "high").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("amount"), (F.min("block") < F.max("block")).alias("both"))
    sizes = scratch.stage(sizes.where("members > 1 and (both or low = high)"), "jaccard-sizes")
    # Small ones share tasks; others have their own.
    small = (2 * F.col("members") <= block_rows) & (2 * F.col("amount") <= block_tokens)
    amount = sizes.agg(F.sum(F.when(small, F.col("amount"))), F.sum(F.when(small, F.col("members"))), F.sum("amount"), F.sum(F.when(F.col("low") == F.col("high"), F.col("amount")))).first()
    of_small, rows_of_small, of_all, of_own = (x or 0 for x in amount)
    tasks = max(1, -(-of_small // block_tokens), -(-rows_of_small // (4 * block_rows)))
    rounds = max(1, -(-of_all // max(DEALT * of_own, 16 * block_tokens)))
    task = F.when(small, bucket_of(tasks, "low", "high")).otherwise(F.xxhash64("low", "high"))
    dealt = sizes.select("low", "high", small.alias("whole"), task.alias("task"))
    due = due.drop("n").join(dealt, ["low", "high"])
    members = sets.select("uid", "tokens", "order_b", "order_c")
    found = []
    for number in range(rounds):
        now = members.join(due.where(bucket_of(rounds, "whole", "task") == number), "uid")
        out = now.groupBy("whole", "task").applyInPandas(_links_in(percent), "uid long, links long, root long")
        found.append(scratch.stage(out, f"jaccard-inside-{number}"))
    return functools.reduce(DataFrame.unionByName, found)


def link_groups(
    df: DataFrame,
    size: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    count_links: bool = True,
    pair_rows: int = 16,
    block_rows: int = 1000,
    block_tokens: int = 1_000_000,
) -> DataFrame:
    """A row for each row of df: doc_id, text_hash, n_shingles, component_id, links, root, is_first.

    Texts link when 100 * shared >= percent * all of their shingles; component_id is the
    smallest doc_id that links reach. links counts the other sets that the text's set is
    similar to, texts of equal sets as one; it is null without count_links. is_first marks the row of
    the component's smallest doc_id (of several, the one of the smallest text hash; equal rows
    alike). Null and empty texts have no shingles and link with nothing; their root is null.
    Null ids are larger than others. Repeated rows are texts of one set. Further columns of df
    are ignored, whatever their names. An empty df gives no rows. The result is staged.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    id_type = df.schema[doc_id].dataType.simpleString()
    with Scratch(spark) as scratch:
        summary = docs.mapInArrow(
            _summary_of(size, percent),
            f"doc_id {id_type}, text_hash long, n long, fp1 long, fp2 long, b0 long, b1 long, b2 long, b3 long, n_picks int, picks array<long>, extra array<long>",
        )
        rows = scratch.stage(summary.withColumn("uid", F.monotonically_increasing_id()), "jaccard-rows")
        index = scratch.stage(rows.select("uid", "doc_id", "text_hash", "n", "fp1", "fp2"), "jaccard-index")

        # One row stands for each class of equal sets.
        classes = index.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("low"))
        classes = scratch.stage(classes, "jaccard-classes")
        heads = classes.select("uid").hint("merge").join(rows.select("uid", "n", "b0", "b1", "b2", "b3", "n_picks", "picks", "extra"), "uid")
        heads = scratch.stage(heads, "jaccard-heads")

        scratch.drop("jaccard-rows")

        # Order A: counts over all sets put the first part's rare tokens in front; those of one set
        # meet nothing. Tokens are counted a share at a time, so that only a share is on disk.
        tokens = heads.select("uid", F.explode("picks").alias("tok"))
        several = []
        for number in range(TOKEN_SHARES):
            share = tokens.where(F.pmod(F.shiftrightunsigned("tok", 40), F.lit(TOKEN_SHARES)) == number)
            counts = share.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            several.append(scratch.stage(share.join(counts, "tok"), f"jaccard-shared-{number}"))
        found = several[0]
        for more in several[1:]:
            found = found.unionByName(more)
        shared = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("shared"))
        need = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + 1
        own = F.col("n_picks") - F.coalesce(F.size("shared"), F.lit(0))  # tokens of no other set
        front = F.transform(
            F.slice(F.coalesce("shared", F.array().cast("array<struct<c:bigint,tok:bigint>>")), F.lit(1), F.greatest(need - own, F.lit(0)).cast("int")),
            lambda x, k: F.struct(x["tok"].alias("tok"), (own + k).cast("long").alias("pos")),
        )
        back = F.transform("extra", lambda x, k: F.struct(x.alias("tok"), (F.col("n_picks") + k).cast("long").alias("pos")))
        prefix = heads.drop("picks").join(shared, "uid", "left").where(F.col("shared").isNotNull() | (F.size("extra") > 0))
        prefix = prefix.select("uid", "n", "b0", "b1", "b2", "b3", F.explode(F.concat(front, back)).alias("t"))
        prefix = scratch.stage(prefix.select("t.tok", "t.pos", "uid", "n", "b0", "b1", "b2", "b3"), "jaccard-prefix")
        scratch.drop("jaccard-heads", *(f"jaccard-shared-{number}" for number in range(TOKEN_SHARES)))

        # Buckets of two or more.
        buckets = prefix.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        full = scratch.stage(prefix.join(buckets, "tok"), "jaccard-buckets")
        scratch.drop("jaccard-prefix")
        crowded = full.where(F.col("c") > pair_rows).select("tok", "pos", "uid", "n")
        blocks, reach = _blocks(crowded, scratch, percent, block_rows, block_tokens)
        a, b = (full.where(F.col("c") <= pair_rows).drop("c").alias(x) for x in "ab")
        pairs = a.join(b, "tok").where((F.col("a.uid") < F.col("b.uid")) & _may_link(percent, "a", "b")).select(F.col("a.uid").alias("u"), F.col("b.uid").alias("v")).distinct()
        pairs = scratch.stage(_not_in_blocks(pairs, blocks, reach), "jaccard-pairs")
        active = pairs.select(F.col("u").alias("uid")).unionByName(pairs.select(F.col("v").alias("uid"))).unionByName(blocks.select("uid")).distinct()

        # Their texts, by id and hash. Of equal rows, which nothing tells apart before, one stays.
        same = index.groupBy("doc_id", "text_hash").agg(F.min("uid").alias("uid"))
        wanted = scratch.stage(same.join(active, "uid").select("uid", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")), "jaccard-wanted")
        scratch.drop("jaccard-buckets", "jaccard-placed", "jaccard-met", "jaccard-near", "jaccard-near-labels")
        near, _ = parted(docs, F.col("text_hash"), wanted.select("_h"))
        texts = near.join(wanted.hint("merge"), (F.col("text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("uid", "text")
        sets = texts.mapInArrow(_sets_of(size, percent), "uid long, n long, tokens array<long>, order_b array<int>, order_c array<int>")
        sets = scratch.stage(sets.withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
        first = sets.groupBy("uid").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
        others = scratch.stage(sets.select("uid", "row").join(first, "uid").where("row <> first").select("row"), "jaccard-others")
        sets = sets.join(others, "row", "left_anti").drop("row")

        links = scratch.stage(_links(pairs, sets, percent), "jaccard-links")
        inside = _met_in_blocks(sets, blocks, reach, scratch, percent, block_rows, block_tokens)
        scratch.drop("jaccard-sets", "jaccard-pairs")
        edges = links.unionByName(inside.where("uid <> root").select(F.col("root").alias("u"), F.col("uid").alias("v")))
        labels = component_labels(edges, scratch)

        # Every class gets its group's smallest id, every row its class's.
        rooted = classes.join(labels, classes["uid"] == labels["node"], "left").withColumn("root", F.coalesce("root", "uid")).drop("node")
        lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
        rooted = rooted.join(lowest, "root")
        if count_links:
            ends = links.select(F.explode(F.array("u", "v")).alias("uid"), F.lit(1).cast("long").alias("links"))
            counted = ends.unionByName(inside.select("uid", "links")).groupBy("uid").agg(F.sum("links").alias("links"))
            rooted = rooted.join(counted, "uid", "left")
        else:
            rooted = rooted.withColumn("links", F.lit(None))
        rooted = rooted.select(F.col("fp1").alias("_f1"), F.col("fp2").alias("_f2"), F.col("n").alias("_n"), "root", "component_id", F.col("links").cast("long").alias("links"))
        out = index.drop("uid").join(rooted, (F.col("fp1") == F.col("_f1")) & (F.col("fp2") == F.col("_f2")) & (F.col("n") == F.col("_n")), "left")
        out = out.select(
            "doc_id",
            "text_hash",
            F.col("n").alias("n_shingles"),
            F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            (F.coalesce("links", F.lit(0)).cast("long") if count_links else F.col("links")).alias("links"),
            F.col("root"),
            (F.col("root").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("is_first"),
        )
        return stage(out, "jaccard-groups")


def near_duplicates_removed(df: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of linked texts: that of the smallest id. Columns are df's own.

    Null and empty texts, and those without words, stay. Of rows with equal id and text one
    stays. Ties for the smallest id go to the smallest text hash; null ids are larger than
    others. An empty df gives no rows.
    """
    groups = link_groups(df, size, percent, doc_id, text, count_links=False)
    each = groups.groupBy("root", "doc_id", "text_hash").agg(F.max("is_first").alias("is_first"), F.count(F.lit(1)).alias("times"))
    # Of several rows with the group's smallest id, the one of the smallest text hash.
    best = each.where("is_first and root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    stays = F.col("root").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    own, kept_id, kept_hash, keep = new_names(df, "hash", "kept_id", "kept_hash", "keep")
    judged = each.join(best, "root", "left").withColumn(keep, stays)
    # Most rows are alone and once there, and stay where they are: only the others are looked up.
    judged = judged.where(~F.col(keep) | (F.col("times") > 1)).select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash), keep)
    judged = stage(judged, "jaccard-judged")
    near, alone = parted(df.withColumn(own, F.xxhash64(F.col(text))), F.col(own), judged.select(kept_hash))
    near = near.join(judged.hint("merge"), (F.col(own) == F.col(kept_hash)) & F.col(doc_id).eqNullSafe(F.col(kept_id)), "left")
    repeated = near.where(F.col(keep)).dropDuplicates([doc_id, own])
    out = alone.select(*df.columns)
    for more in (near.where(F.col(keep).isNull()), repeated):
        out = out.unionByName(more.select(*df.columns))
    return out
