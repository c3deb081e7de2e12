"""Substring dedup: windows of words that occur more than once, by prefix-partitioned suffix trees.

Every window of ``size`` words owns one anchor: its k-word run of least hash, the leftmost of
several. Equal windows own equal runs at the same place, so a window whose anchor's run occurs
once is itself unique, and only stretches of words around anchors that occur more than once go
on: those of the windows of one anchor.

The suffixes of these stretches are dealt by a prefix that they have in common, the anchor's
run at first. Equal stretches are taken together: all their windows repeat, and one of them
stands for them. A group of at most ``group_rows`` of these is built into a suffix tree in
memory. If a group is larger, its prefix is made longer: a window holds either the next words
before its prefix or those behind it, so each stretch is split into the windows that begin
further left and those that reach further right, half of what is missing to ``size`` words
each time. These parts are shorter, so more of them are equal, and at the length of a window
all of a group are. So groups get small within a logarithm of steps, nothing is a row for
each window, and no group is held whole that doesn't fit.

A tree is its leaves in the order of their suffixes and, between neighbours, the depth of
their lowest common internal node. A leaf under an internal node of ``size`` words or more
begins a repeat of that node's depth, as long as it can be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, new_names, parted, stage

GRAM = 12  # words of an anchor's run
GROUP_ROWS = 5_000  # about 2 MB of words
HOT_ROWS = 10_000  # rows of one key that a task of a join gets, at least
HOT_KEYS = 1_000  # keys with more than this part of all rows are split, so there are fewer of them than this
NOTHING = hashlib.sha256(b"").hexdigest()


def anchors(block: W.Block, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the gram-word runs of a block, and for each window: its first word and its anchor."""
    runs = W.rolling_hashes(block.hashes(), gram)
    wide = size - gram + 1
    if len(runs) < wide:
        return runs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The upper half of the hash, then the place: the least of these is the leftmost least.
    least = (runs >> np.uint64(32) << np.uint64(32)) | np.arange(len(runs), dtype=np.uint64)
    have = 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows inside one text.
    counts = block.counts() - size + 1
    rows = np.flatnonzero(counts > 0)
    n = counts[rows]
    first = np.repeat(block.word_offsets[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return runs, first, anchor[first]


def _index_of(size: int, gram: int):
    """Arrow batches of (doc_id, a, b, text) to n_words, kept_sha256 of all words, and the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, grams, spots, sizes = [], [], [], [], []
            for b in W.blocks(batch.column(3)):
                raw = b.data.tobytes()
                counts = b.counts()
                n.append(counts)
                for x, y in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
                    sha.append(hashlib.sha256(b" ".join(raw[x:y].split())).hexdigest())
                runs, _, anchor = anchors(b, size, gram)
                anchor = np.unique(anchor)
                text = np.searchsorted(b.word_offsets, anchor, "right") - 1
                grams.append(runs[anchor])
                spots.append(anchor - b.word_offsets[text])
                sizes.append(np.bincount(text, minlength=b.last - b.first))
            offsets = pa.array(np.concatenate([[0], *(sizes and [np.cumsum(np.concatenate(sizes))])]).astype(np.int32))
            flat = np.concatenate([*grams, np.zeros(0, np.uint64)]).view(np.int64)
            places = np.concatenate([*spots, np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(sha, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(places))],
                ["doc_id", "a", "b", "n_words", "all_sha256", "grams", "spots"],
            )

    return W.lean(run)


STRETCH = "key long, a long, b long, start long, words int, at int, part string"
NAMES = [c.split()[0] for c in STRETCH.split(", ")]


def _stretches_of(size: int, gram: int):
    """(a, b, text, spots) to the stretches of words around the anchors at these spots.

    A row for each anchor in spots: key (of its run), a, b, start (its first window), words,
    at (its place in the stretch), part (the words, joined by one space).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.blocks(batch.column(2)):
                runs, first, anchor = anchors(b, size, gram)
                rows = np.arange(b.first, b.last)
                text = np.searchsorted(b.word_offsets, anchor, "right") - 1
                wanted = np.zeros(len(b.starts) + 1, bool)
                lists = batch.column(3).slice(b.first, len(rows))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
                # Texts that share a hash by chance may be shorter: such spots are beyond them.
                inside = flat < b.counts()[of]
                wanted[(b.word_offsets[:-1][of] + flat)[inside]] = True
                a, bb = (batch.column(k).to_numpy()[b.first : b.last] for k in (0, 1))
                raw = b.data.tobytes()
                hit = np.flatnonzero(wanted[anchor])
                if not len(hit):
                    continue
                # Windows of one anchor follow one another.
                new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(anchor[hit]) != 0)])
                begin, last = hit[new], hit[np.append(new[1:], True)]
                low, high = b.starts[first[begin]], b.ends[first[last] + size - 1]
                parts = [b" ".join(raw[x:y].split()) for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                columns = [
                    runs[anchor[begin]].view(np.int64), a[text[begin]], bb[text[begin]], first[begin] - b.word_offsets[text[begin]],
                    (first[last] + size - first[begin]).astype(np.int32), (anchor[begin] - first[begin]).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary()).cast(pa.string())], NAMES)

    return W.lean(run)


def _longer_prefixes(size: int, prefix: int, more: int):
    """Stretches to those of their windows that hold ``more`` words behind the prefix, and of the others, which hold as many before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.blocks(batch.column(NAMES.index("part"))):
                a, bb, start, words, at = (batch.column(NAMES.index(c)).to_numpy()[b.first : b.last].astype(np.int64) for c in ("a", "b", "start", "words", "at"))
                runs = W.rolling_hashes(b.hashes(), prefix + more)
                base, raw = b.word_offsets[:-1], b.data.tobytes()
                edge = at - (size - prefix - more)  # windows from here on reach far enough behind
                for low, high, place, side in ((np.maximum(edge, 0), words - size, at, 0), (np.zeros_like(at), np.minimum(edge - 1, words - size), at - more, 1)):
                    k = np.flatnonzero(low <= high)
                    if not len(k):
                        continue
                    first, last = base[k] + low[k], base[k] + high[k] + size - 1
                    parts = [raw[x:y] for x, y in zip(b.starts[first].tolist(), b.ends[last].tolist(), strict=True)]
                    key = W.mix(runs[base[k] + place[k]] + W.MULTIPLIERS[side]).view(np.int64)
                    columns = [key, a[k], bb[k], start[k] + low[k], (last + 1 - first).astype(np.int32), (place[k] - low[k]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary()).cast(pa.string())], NAMES)

    return W.lean(run)


def _trees_of(size: int):
    """Stretches sorted by key to (a, b, low, high): runs of words that repeats cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = batch.column(0)
            if keys[0] == keys[-1]:
                continue  # the group may go on; groups are bounded
            table = pa.Table.from_batches(held).combine_chunks()
            all_keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(all_keys, all_keys[-1]))  # the last group may go on
            if cut:
                yield from _tree(table.slice(0, cut), size)
            held = table.slice(cut).to_batches()
        if held:
            yield from _tree(pa.Table.from_batches(held), size)

    return W.lean(run, 10_000)


def suffix_tree(ranks: np.ndarray, leaves: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in the order of their suffixes, and the depth of the internal node between each two neighbours.

    ranks: numbers of the words, one text after another. Suffixes are told apart by their
    first ``most`` words at least, and depths counted up to there at least.
    """
    n = len(ranks)
    levels, depth = [ranks], 1
    while depth < most:
        later = np.zeros(n, np.int64)
        later[: n - depth] = levels[-1][depth:] + 1
        levels.append(np.unique(levels[-1] * (n + 1) + later, return_inverse=True)[1].astype(np.int64))
        depth *= 2
    order = leaves[np.argsort(levels[-1][leaves], kind="stable")]
    x, y = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(x), np.int64)
    for k in reversed(range(len(levels))):
        same = np.flatnonzero((x < n) & (y < n))
        same = same[levels[k][x[same]] == levels[k][y[same]]]
        for z in (x, y, common):
            z[same] += 1 << k
    return order, common


def _tree(table: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    a, b, start, words = (table.column(c).to_numpy() for c in ("a", "b", "start", "words"))
    for block in W.blocks(table.column("part").combine_chunks(), 1 << 40):
        counts = words.astype(np.int64) - size + 1
        of = np.repeat(np.arange(len(counts)), counts)
        begin = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        leaves = block.word_offsets[:-1][of] + begin
        ranks = np.unique(block.hashes(), return_inverse=True)[1].astype(np.int64)
        order, common = suffix_tree(ranks, leaves, int(words.max()))
        # Depths end with the shorter stretch; a leaf's parent is the deeper of the nodes beside it.
        left = np.full(len(ranks), 0, np.int64)
        left[leaves] = words[of] - begin
        common = np.minimum(common, np.minimum(left[order[:-1]], left[order[1:]]))
        parent = np.zeros(len(ranks), np.int64)
        parent[order[:-1]] = common
        parent[order[1:]] = np.maximum(parent[order[1:]], common)
        depth = parent[leaves]
        hit = np.flatnonzero(depth >= size)
        if not len(hit):
            return
        new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(of[hit]) != 0)])
        low = hit[new]
        high = np.maximum.reduceat(begin[hit] + depth[hit], np.flatnonzero(new))
        yield pa.RecordBatch.from_arrays([pa.array(a[of[low]]), pa.array(b[of[low]]), pa.array(start[of[low]] + begin[low]), pa.array(start[of[low]] + high)], ["a", "b", "low", "high"])


def _joined(rows: DataFrame, found: DataFrame, keys: list[str], total: int, least: int, *spread: str) -> DataFrame:
    """rows joined with found, whose c is each key's number of rows; total: that of all rows.

    Keys of more than least rows are dealt over several tasks by a hash of spread. least is
    raised with total, so fewer than HOT_KEYS keys are that common and get broadcast.
    """
    least = max(least, total // HOT_KEYS)
    salts = F.ceil(F.col("c") / least).cast("int")  # 1 for keys that are not split
    hot = found.where(F.col("c") > least).select(*keys, salts.alias("_salts"))
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    return dealt.join(found.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))), [*keys, "_salt"]).drop("_salt", "c")


TAKEN = f"{STRETCH}, content long, kind int, n int, task int"
MEMBER, INNER, BORDER = 0, 1, 2  # one of several equal stretches; a stretch for all equal to it; the same of a task's first or last run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by key, content and place to TAKEN: each run of equal ones once, and all its members if there are several.

    One row and one batch are held at a time, however long a run is. n: 2 for several. Whether
    a run goes on in another task isn't known here; first and last runs are marked for that.
    """
    task = TaskContext.get().partitionId()
    before, first, open_row, open_n, open_kind = None, True, None, 0, INNER

    def out(rows: pa.Table, kind: int, n: np.ndarray | int) -> pa.RecordBatch:
        more = [np.full(rows.num_rows, kind, np.int32), np.broadcast_to(np.minimum(n, 2), rows.num_rows).astype(np.int32), np.full(rows.num_rows, task, np.int32)]
        part = rows.column("part") if kind != MEMBER else pa.nulls(rows.num_rows, pa.string())
        columns = [*(part if c == "part" else rows.column(c) for c in [*NAMES, "content"]), *map(pa.array, more)]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in TAKEN.split(", ")]).combine_chunks()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        place = np.stack([table.column(c).to_numpy() for c in ("key", "content", "a", "b", "start")])
        if not place.shape[1]:
            continue
        last = place[:, -1]
        prior = place[:, :1] - 1 if before is None else before[:, None]
        differs = place != np.concatenate([prior, place[:, :-1]], axis=1)
        once = differs.any(axis=0)  # the same place twice is one
        new = differs[:2].any(axis=0)[once]
        table, before = table.filter(pa.array(once)), last
        if not len(new):
            continue
        begin = np.flatnonzero(new)
        goes_on = int(begin[0]) if len(begin) else len(new)
        if goes_on:
            if open_n == 1:
                yield from out(open_row, MEMBER, 2).to_batches()
            yield from out(table.slice(0, goes_on), MEMBER, 2).to_batches()
            open_n += goes_on
        if not len(begin):
            continue
        if open_row is not None:
            yield from out(open_row, open_kind, open_n).to_batches()
        sizes = np.diff(np.append(begin, len(new)))
        inner = np.arange(int(first), len(begin) - 1)
        if first and len(begin) > 1:
            yield from out(table.slice(0, 1), BORDER, int(sizes[0])).to_batches()
        if len(inner):
            yield from out(table.take(pa.array(begin[inner])), INNER, sizes[inner]).to_batches()
        several = np.repeat(sizes > 1, sizes)
        if several.any():
            yield from out(table.slice(int(begin[0])).filter(pa.array(several)), MEMBER, 2).to_batches()
        open_row, open_n, open_kind = table.slice(int(begin[-1]), 1), int(sizes[-1]), BORDER if first and len(begin) == 1 else INNER
        first = False
    if open_row is not None:
        yield from out(open_row, BORDER, open_n).to_batches()


def _taken_together(rows: DataFrame, name: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(one stretch for all that are equal to it, (a, b, low, high) of all stretches that have an equal one).

    Rows are dealt by ranges of key, content and place, so stretches equal to very many others
    are dealt over many tasks. Of each task two runs at most may go on in another one.
    """
    placed = rows.withColumn("content", F.xxhash64("part")).repartitionByRange("key", "content", "a", "b", "start")
    taken = scratch.stage(placed.sortWithinPartitions("key", "content", "a", "b", "start").mapInArrow(W.lean(_runs), TAKEN), name)
    w = Window.partitionBy("key", "content")
    border = taken.where(F.col("kind") == BORDER).withColumns({"_nth": F.row_number().over(w.orderBy("task", "a", "b", "start")), "_of": F.count(F.lit(1)).over(w)})
    one = taken.where(F.col("kind") == INNER).select(*NAMES).unionByName(border.where("_nth = 1").select(*NAMES))
    again = taken.where(F.col("kind") == MEMBER).select("a", "b", "start", "words").unionByName(border.where("n = 1 and _of > 1").select("a", "b", "start", "words"))
    return one, again.select("a", "b", F.col("start").alias("low"), (F.col("start") + F.col("words")).alias("high"))


def _covered(stretches: DataFrame, size: int, gram: int, group_rows: int, scratch: Scratch) -> DataFrame:
    """(a, b, low, high): the words that repeated windows of the stretches cover."""
    found, small, rows, prefix, level = [], [], stretches, gram, 0
    while True:
        # Stretches with an equal one repeat as a whole; one of them stands for all.
        one, again = _taken_together(rows, f"substring-level-{level}", scratch)
        found.append(again)
        crowded = one.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group_rows)
        crowded = scratch.stage(crowded.select("key"), "substring-crowded")
        if prefix == size or not crowded.limit(1).count():
            small.append(one)  # at the length of a window a key's stretches are all equal
            break
        small.append(one.join(crowded, "key", "left_anti"))
        more = -(-(size - prefix) // 2)
        rows = scratch.stage(one.join(crowded, "key", "left_semi").mapInArrow(_longer_prefixes(size, prefix, more), STRETCH), f"substring-rows-{level}")
        prefix, level = prefix + more, level + 1
    trees = small[0]
    for more_rows in small[1:]:
        trees = trees.unionByName(more_rows)
    out = trees.repartition("key").sortWithinPartitions("key").mapInArrow(_trees_of(size), "a long, b long, low long, high long")
    for more_rows in found:
        out = out.unionByName(more_rows)
    return out


def repeated_spans(
    df: DataFrame, size: int = 35, doc_id: str = "doc_id", text: str = "text", gram: int | None = None, group_rows: int = GROUP_ROWS, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). Texts with equal hashes a and b are equal.

    rows: doc_id, a, b, n_words, all_sha256 of each row of df. spans: for each text that holds
    words covered by repeated windows: a, b, copies (rows with the text), spans (array of low,
    high: word numbers, high excluded, in order, overlaps possible; of copies, the whole text).
    Null and empty texts have no words and no spans; an empty df gives no rows. Both results
    are staged.
    """
    gram = gram or min(GRAM, size)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(7), F.col(text)).alias("b"), F.col(text).alias("text"))
    id_type = df.schema[doc_id].dataType.simpleString()
    with Scratch(df.sparkSession) as scratch:
        indexed = scratch.stage(
            docs.mapInArrow(_index_of(size, gram), f"doc_id {id_type}, a long, b long, n_words long, all_sha256 string, grams array<long>, spots array<int>"),
            "substring-index",
        )
        rows = stage(indexed.drop("grams", "spots"), "substring-rows")
        classes = rows.where(F.col("n_words") >= size).groupBy("a", "b").agg(F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"))
        classes = scratch.stage(classes, "substring-classes")

        # Runs at two places or more; copies of a text have theirs at one place.
        each = indexed.select("doc_id", "a", "b", F.explode(F.arrays_zip("grams", "spots")).alias("z")).select("doc_id", "a", "b", F.col("z.grams").alias("gram"), F.col("z.spots").alias("spot"))
        place = F.xxhash64("a", "b", "spot")
        often = each.select("gram", place.alias("o")).groupBy("gram").agg(F.min("o").alias("o0"), F.max("o").alias("o1"), F.count(F.lit(1)).alias("c"))
        often = scratch.stage(often.where("o0 <> o1").select("gram", "c"), "substring-runs")
        places = indexed.agg(F.sum(F.size("grams"))).first()[0] or 0
        met = _joined(each.select("gram", "a", "spot", "doc_id"), often, ["gram"], places, hot_rows, "doc_id", "spot")
        spots = met.groupBy("a").agg(F.collect_set("spot").alias("spots"))
        wanted = classes.join(spots, "a").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "low_id", "spots")
        wanted = scratch.stage(wanted, "substring-wanted")
        near, _ = parted(docs, F.col("a"), wanted.select("_a"))
        texts = near.join(wanted.hint("merge"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("low_id")))
        stretches = texts.select("a", "b", "text", "spots").mapInArrow(_stretches_of(size, gram), STRETCH)
        stretches = scratch.stage(stretches, "substring-stretches")
        scratch.drop("substring-index", "substring-runs")

        covered = _covered(stretches, size, gram, group_rows, scratch)
        found = covered.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("found"))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_words").alias("high")))
        spans = classes.join(found, ["a", "b"], "left").select("a", "b", "copies", F.when(F.col("copies") > 1, whole).otherwise(F.col("found")).alias("spans"))
        return rows, stage(spans.where("spans is not null"), "substring-spans")


def _kept(words: list, spans) -> list:
    """The words that no span covers."""
    out, at = [], 0
    for s in spans:
        if s["low"] > at:
            out += words[at : s["low"]]
        at = max(at, s["high"])
    return out + words[at:]


def removal_digests(df: DataFrame, size: int = 35, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of df.

    A word is removed if a window of ``size`` words covers it whose words also start anywhere
    else, in the same text or another row's. kept_sha256 is that of the kept words, joined by
    one space. Null and empty texts have no words. Repeated rows are copies of each other.
    Further columns of df are ignored. An empty df gives no rows.
    """
    rows, spans = repeated_spans(df, size, doc_id, text, **options)
    docs = df.select(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(7), F.col(text)).alias("b"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    part = spans.where("copies = 1").withColumnsRenamed({"a": "_a", "b": "_b"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for value, cover in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = value.split()
                kept = _kept(words, cover)
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["a", "b", "n_removed", "sha"])

    near, _ = parted(docs.select("a", "b", "text"), F.col("a"), part.select("_a"))
    held = near.join(part.hint("merge"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("a", "b", "text", "spans")
    cut = held.mapInArrow(W.lean(run), "a long, b long, n_removed long, sha string")
    gone = spans.where("copies > 1").select("a", "b", F.lit(-1).cast("long").alias("n_removed"), F.lit(NOTHING).alias("sha"))
    joined = rows.join(cut.unionByName(gone), ["a", "b"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("sha", "all_sha256").alias("kept_sha256"),
    )


def repeats_removed(df: DataFrame, size: int = 35, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with the repeated words cut out of its texts; rows and columns stay, whatever their names.

    What is kept of a cut text keeps its own white space; a column n_chars, if there is one,
    is counted anew in cut texts. Null and empty texts stay as they are; repeated rows are
    copies of each other, so all their words go if they have ``size`` or more. An empty df
    gives no rows.
    """
    _, spans = repeated_spans(df, size, doc_id, text, **options)
    a, b, ha, hb, cover, changed_text = new_names(df, "a", "b", "ha", "hb", "spans", "cut")
    spans = spans.select(F.col("a").alias(a), F.col("b").alias(b), F.col("spans").alias(cover))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, covers: pd.Series) -> pd.Series:
        def one(value, cover):
            if value is None or cover is None:
                return value
            block = next(W.blocks(pa.array([value], pa.string()), 1 << 40))
            raw, out, at = block.data.tobytes(), [], 0
            for s in cover:
                low = int(block.starts[s["low"]])
                if low > at:
                    out.append(raw[at:low])
                at = max(at, int(block.ends[s["high"] - 1]))
            return b"".join([*out, raw[at:]]).decode()

        return pd.Series([one(t, c) for t, c in zip(texts, covers, strict=True)], dtype=object)

    hashed = df.withColumns({ha: F.xxhash64(F.col(text)), hb: F.xxhash64(F.lit(7), F.col(text))})
    near, alone = parted(hashed, F.col(ha), spans.select(a))
    joined = near.join(spans.hint("merge"), (F.col(ha) == F.col(a)) & (F.col(hb) == F.col(b)), "left")
    changed = F.col(cover).isNotNull()
    out = joined.withColumn(changed_text, F.when(changed, cut(text, cover)).otherwise(F.col(text)))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(changed_text).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    out = out.select(*(F.col(changed_text).alias(text) if c == text else F.col(c) for c in df.columns))
    return alone.select(*df.columns).unionByName(out)
