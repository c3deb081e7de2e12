"""Spelling variants: words one edit apart, found in FM-indexes by a search scheme of two halves.

If two words differ by one inserted, deleted or replaced code point, one half of the first
stands unchanged at that end of the second. So each word is searched twice: its left half
exactly, then to the right with one error; its right half exactly, then to the left with one
error. The first search runs on an FM-index that extends to the right, the second on one that
extends to the left; both are suffix-rank intervals over words between delimiters.

The vocabulary is dealt out by what a search needs to see: words for the first search by their
first code points, for the second by their last ones. Such groups are packed into indexes of
bounded size; a group that is larger is dealt by one more code point, and those words whose half
is no longer than that go with the words that are near enough in length. Pairs found by the
first search are left out of the second, so counts add up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, stage

LEAST = 5  # code points of a word
END, BETWEEN, FIRST = 0, 1, 2  # codes: the text's end, the delimiter, the first letter
#: ASCII letters, lower-cased, and U+00C0 to U+00FF in UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
CHUNK = 1 << 20  # bytes of a text that are searched at once
HELD = 300_000  # different words that a task counts before it hands them on
QUERIES = 4096  # words that are searched at once


def runs_of(data: bytes) -> Counter:
    """The runs of letters of a lower-cased text, with their numbers; a run at a chunk's end waits for the next chunk."""
    out: Counter = Counter()
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data) and data[end - 1] == 0xC3 and end - 1 > at:  # half a letter
            end -= 1
        found = RUN.findall(data, at, end)
        if end < len(data) and found:
            start = data.rindex(found[-1], at, end)
            if start + len(found[-1]) == end:  # it may go on
                found.pop()
                if start > at:
                    end = start
                else:  # as long as the chunk
                    found.append(RUN.match(data, start)[0])
                    end = start + len(found[-1])
        out.update(found)
        at = end
    return out


def observed(doc_id, run: bytes, modulus: int) -> str:
    """The word that a run of a document counts for: in one of modulus cases one code point is deleted, by checksum."""
    h = zlib.crc32(b"%s:%s" % (str("" if doc_id is None else doc_id).encode(), run))
    word = run.decode()
    if modulus and h % modulus == 0:
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    return word


def _counted(modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_buffer()
                data = b"" if text is None else text.to_pybytes().lower()  # bytes: A-Z alone
                for word, n in runs_of(data).items():
                    # A run of the least length may come out shorter, never longer.
                    if len(word) >= LEAST:
                        total[observed(doc_id, word, modulus)] += n
                if len(total) > HELD:
                    yield handed()
        yield handed()

    return run


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 3, modulus: int = 97) -> DataFrame:
    """word, n: words of at least 5 code points that occur ``least`` times or more.

    Words are the maximal runs of ASCII letters and U+00C0 to U+00FF of whole texts, A-Z
    lower-cased. In one of ``modulus`` cases, by a checksum of document and run, one code point
    of the run is deleted first (0: never). Null and empty texts have no words; a null id counts
    as an empty one. Repeated rows count each.
    """
    found = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(_counted(modulus), "word string, n long")
    return found.where(F.length("word") >= LEAST).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """FM-index over words between delimiters, extended to the left."""

    def __init__(self, words: list[np.ndarray]):
        """words: code arrays, different and in order."""
        lengths = np.array([len(w) for w in words])
        text = np.full(int(lengths.sum()) + len(words) + 2, BETWEEN, np.int64)
        starts = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(words) else np.zeros(0, np.int64)
        inside = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum())) if len(words) else starts
        text[inside] = np.concatenate([*words, np.zeros(0, np.int64)])
        text[-1] = END
        self.n, self.sigma = len(text), int(text.max(initial=BETWEEN)) + 1
        rank = text.copy()
        step = 1
        while True:  # suffixes in order, by prefixes of twice the length each time
            behind = np.zeros(self.n, np.int64)
            behind[: self.n - step] = rank[step:] + 1
            order = np.argsort(rank * (self.n + self.sigma + 1) + behind, kind="stable")
            key = (rank * (self.n + self.sigma + 1) + behind)[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(self.n, np.int64)
            rank[order] = new
            if new[-1] == self.n - 1 or step >= self.n:
                break
            step *= 2
        self.before = text[order - 1]  # the code in front of each suffix
        place = np.argsort(self.before, kind="stable")
        self.keys = self.before[place] * (self.n + 1) + place
        self.words = np.searchsorted(self.keys, [BETWEEN * (self.n + 1), (BETWEEN + 1) * (self.n + 1)])

    def extended(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes with code in front of what the given ones begin with."""
        base = code * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def any_letter(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the interval, code, low, high) of every letter in front of it."""
        wide = high - low > self.sigma
        at = np.flatnonzero(wide)
        k, code = np.repeat(at, self.sigma - FIRST), np.tile(np.arange(FIRST, self.sigma), len(at))
        # Of narrow intervals the rows are looked at, each letter once.
        narrow = np.flatnonzero(~wide)
        size = (high - low)[narrow]
        own = np.repeat(narrow, size)
        row = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[own]
        seen = np.unique(own * self.sigma + self.before[row])
        seen = seen[seen % self.sigma >= FIRST]
        k, code = np.concatenate([k, seen // self.sigma]), np.concatenate([code, seen % self.sigma])
        new_low, new_high = self.extended(code, low[k], high[k])
        some = new_high > new_low
        return k[some], code[some], new_low[some], new_high[some]

    def near(self, codes: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of words one edit away: the last ``exact`` codes unchanged, one error before them.

        codes: a row for each query, its first ``lengths`` entries count.
        """
        query = np.arange(len(lengths))
        left = lengths.copy()  # codes still to match
        low, high = np.full(len(query), self.words[0]), np.full(len(query), self.words[1])
        e_query, e_left, e_low, e_high = (np.zeros(0, np.int64) for _ in range(4))
        out_query, out_word = [], []
        while len(query) or len(e_query):
            # One error at this place, where the exact half is behind.
            can = np.flatnonzero(left <= (lengths - exact)[query])
            if len(can):
                q, j, a, b = query[can], left[can], low[can], high[can]
                k, code, x, y = self.any_letter(a, b)
                same = np.zeros(len(k), bool)
                some = j[k] > 0
                same[some] = codes[q[k][some], j[k][some] - 1] == code[some]
                change, drop = some & ~same, j > 0
                e_query = np.concatenate([e_query, q[k], q[k][change], q[drop]])
                e_left = np.concatenate([e_left, j[k], j[k][change] - 1, j[drop] - 1])
                e_low, e_high = np.concatenate([e_low, x, x[change], a[drop]]), np.concatenate([e_high, y, y[change], b[drop]])
            # Those with the whole query matched must meet the delimiter.
            done = e_left == 0
            x, y = self.extended(np.full(int(done.sum()), BETWEEN), e_low[done], e_high[done])
            some = y > x
            out_query.append(e_query[done][some])
            out_word.append(x[some] - self.words[0] - 1)
            e_query, e_left, e_low, e_high = (v[~done] for v in (e_query, e_left, e_low, e_high))
            e_query, e_left, e_low, e_high = self._step(codes, e_query, e_left, e_low, e_high)
            more = left > 0
            query, left, low, high = self._step(codes, query[more], left[more], low[more], high[more])
        pairs = np.unique(np.stack([np.concatenate(out_query), np.concatenate(out_word)], 1), axis=0) if out_query else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]

    def _step(self, codes, query, left, low, high):
        """The states whose next code is matched."""
        if not len(query):
            return query, left, low, high
        x, y = self.extended(codes[query, left - 1], low, high)
        some = y > x
        return query[some], left[some] - 1, x[some], y[some]


def near_words(words: list[str], targets: list[str], forward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, target) numbers of pairs one edit apart: with forward by left halves, else by right halves of pairs that left halves don't find."""
    letters = {c: FIRST + k for k, c in enumerate(sorted({c for w in targets for c in w}))}
    unknown = FIRST + len(letters)  # no target has it
    turned = [w[::-1] for w in targets] if forward else targets
    order = np.array(sorted(range(len(turned)), key=turned.__getitem__), np.int64)
    index = Index([np.array([letters[c] for c in turned[k]], np.int64) for k in order.tolist()])
    for first in range(0, len(words), QUERIES):
        part = words[first : first + QUERIES]
        lengths = np.array([len(w) for w in part])
        codes = np.zeros((len(part), int(lengths.max(initial=0))), np.int64)
        for k, w in enumerate(part):
            codes[k, : len(w)] = [letters.get(c, unknown) for c in (reversed(w) if forward else w)]
        half = lengths // 2
        query, found = index.near(codes, lengths, half if forward else lengths - half)
        target = order[found]
        if not forward:
            new = np.array([not targets[t].startswith(part[q][: len(part[q]) // 2]) for q, t in zip(query.tolist(), target.tolist(), strict=True)], bool)
            query, target = query[new], target[new]
        yield query + first, target


def _best_near(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, form_n, form: of each asked word its near words here, and the best of them."""
    out = {"word": [], "n_near": [], "form_n": [], "form": []}
    if len(asked) and len(held):
        words, targets, n = asked["word"].tolist(), held["target"].tolist(), held["n"].to_numpy()
        for query, target in near_words(words, targets, bool(asked["forward"].iloc[0])):
            by_word = np.argsort(np.array(targets, object)[target], kind="stable") if len(target) else target
            query, target = query[by_word], target[by_word]
            order = np.lexsort((-n[target], query))  # stable: ties stay by word
            query, target = query[order], target[order]
            one, at, times = np.unique(query, return_index=True, return_counts=True)
            out["word"] += [words[k] for k in one.tolist()]
            out["n_near"] += times.tolist()
            out["form_n"] += n[target[at]].tolist()
            out["form"] += [targets[k] for k in target[at].tolist()]
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in out.items()})


def _ends(forward: bool, size: Column | int) -> Column:
    """The size code points that groups go by: the first or the last ones."""
    return F.substring("word", 1, size) if forward else F.right("word", F.lit(size))


def _dealt(words: DataFrame, forward: bool, index_words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(task, forward, word) of searches, (at, target, n) of the words that they may find.

    Every search meets all words that share its half. Groups of more than index_words words are
    dealt by one more code point. Words whose half is as long as the group's key stay with those
    that are at most one code point longer or shorter; should these be more still, they are cut
    into several indexes and the searches run in each.
    """
    asked, held = None, None
    half = F.floor(F.length("word") / 2) if forward else F.length("word") - F.floor(F.length("word") / 2)
    words = words.select("word", "n", half.alias("half"))
    size = LEAST // 2 if forward else LEAST - LEAST // 2
    side = "right" if forward else "left"
    while True:
        groups = words.select("*", _ends(forward, size).alias("key"))
        counts = scratch.stage(groups.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), f"spelling-{side}-{size}")
        total = counts.agg(F.sum(F.when(F.col("rows") <= index_words, F.col("rows"))), F.count(F.when(F.col("rows") > index_words, 1))).first()
        bins = max(1, -(-2 * (total[0] or 0) // index_words))
        sized = groups.join(counts, "key")
        small = sized.where(F.col("rows") <= index_words).withColumn("task", F.xxhash64(F.lit(side), F.lit(size), bucket_of(bins, "key")))
        parts = [(small.where(F.col("half") >= size), small)]
        large = sized.where(F.col("rows") > index_words)
        if total[1]:
            # The shortest halves can't be dealt by more code points.
            short = large.where((F.col("half") >= size - 1) & (F.col("half") <= size + 1)).drop("rows")
            cuts = short.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / index_words).alias("cuts"))
            short = short.join(cuts, "key")
            task = F.xxhash64(F.lit(side), F.lit(size), F.lit("short"), "key", F.col("cut"))
            ask = short.where(F.col("half") == size).withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
            hold = short.withColumn("cut", bucket_of(F.col("cuts"), "word"))
            parts.append((ask.withColumn("task", task), hold.withColumn("task", task)))
        for a, h in parts:
            a, h = a.select("task", F.lit(forward).alias("forward"), "word"), h.select(F.col("task").alias("at"), F.col("word").alias("target"), "n")
            asked, held = (a, h) if asked is None else (asked.unionByName(a), held.unionByName(h))
        if not total[1]:
            return asked, held
        words = scratch.stage(large.select("word", "n", "half"), f"spelling-{side}-large-{size}").where(F.col("half") >= size)
        size += 1


def variant_groups(words: DataFrame, index_words: int = 16384) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), which are different and not null.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's
    form is its near word of largest n (ties: smallest in code-point order) if that n is at least
    twice the word's; its root is where forms lead to, itself without a form. As n doubles with
    each form there are no rings. No words: no rows. Words of fewer than 5 code points raise.
    """
    spark = words.sparkSession
    with Scratch(spark) as scratch:
        words = scratch.stage(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
        if words.where(F.length("word") < LEAST).limit(1).count():
            raise ValueError(f"words of fewer than {LEAST} code points")
        found = None
        for forward in (True, False):
            asked, held = _dealt(words, forward, index_words, scratch)
            part = asked.groupBy("task").cogroup(held.groupBy("at")).applyInPandas(_best_near, "word string, n_near long, form_n long, form string")
            found = part if found is None else found.unionByName(part)
        # The largest n, then the smallest word.
        best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best"))
        best = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))
        fits = F.col("form_n") >= 2 * F.col("n")
        best = scratch.stage(best.withColumns({"form_n": F.when(fits, F.col("form_n")), "form": F.when(fits, F.col("form"))}), "spelling-forms")

        # Each round follows twice as many forms as the one before.
        roots = scratch.stage(best.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots-0")
        number = 0
        while True:
            number += 1
            after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            new = scratch.stage(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"spelling-roots-{number}")
            scratch.drop(f"spelling-roots-{number - 1}")
            roots = new.select("word", "root")
            if not new.where("moved").limit(1).count():
                break
        out = best.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return stage(out, "spelling-groups")
