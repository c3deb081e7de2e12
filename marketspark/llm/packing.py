"""Best-fit packing with certified bin counts.

Documents are tokenized, longer ones cut at the capacity, and the pieces dealt by hash into
groups of bounded size. Each group is packed by best fit decreasing; dual feasible functions
give a lower bound on the bins that its pieces need, and a group that meets it is done. Groups
with a gap release the pieces of their emptiest bins; these are dealt anew among all such
groups and packed again, until no gap is left or a round brings nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bucket_of, new_names, stage
from .encode import encoder, id_lists, tokenizer_path, with_end

GROUP_PIECES = 20_000


def tokenized_pieces(df: DataFrame, capacity: int = 4096, end_id: int | None = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids (array of int) of each piece.

    Null and empty texts have the end id alone. Without an end id, texts without ids have no
    piece. Repeated rows are documents of their own.
    """
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, ids, offsets in encoder(tokenizer).encode(batch.column(1)):
                ids, offsets = with_end(ids, offsets, end_id)
                pieces = -(-np.diff(offsets) // capacity)
                row = np.repeat(np.arange(last - first), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                begin = offsets[row] + start
                length = np.minimum(capacity, offsets[row + 1] - begin)
                plain = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(plain[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(first, last - first).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:  # pieces cover the ids in order
                    columns.append(id_lists(ids, np.append(begin, len(ids))))
                yield pa.RecordBatch.from_arrays(columns, [*names, *["ids"] * keep_ids])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(W.lean(run), schema)


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Bins that pieces need at least, count[n] of them of length n: the best of three kinds of dual feasible functions."""
    count = np.asarray(count, np.int64)
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # With a threshold t: pieces over capacity - t count as whole bins, those under t not at all.
    number = np.concatenate([[0], np.cumsum(count)])
    amount = np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - t + 1]
    middle = amount[capacity - t + 1] - amount[t]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    # Lengths rounded down to k-ths, where k + 1 times the length isn't a multiple of the capacity.
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, bins numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by what is left in them
    present = 0  # bit r: there is a bin with r left
    bins = 0
    for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = present >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                present ^= 1 << left
        else:
            b, left = bins, capacity
            bins += 1
        out[k] = b
        left -= n
        if left:
            open_bins[left].append(b)
            present |= 1 << left
    return out


def _pack_group(capacity: int, release: float):
    """A function for applyInPandas: packs a group, and releases the emptiest bins if it has a gap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, lengths).astype(np.int64)
        gap = len(used) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        free = np.zeros(len(used), bool)
        if gap:
            # Bins with most space left, so many that one bin's worth is sure to be among them.
            order = np.argsort(used, kind="stable")
            space = np.cumsum(capacity - used[order])
            enough = int(np.searchsorted(space, (gap + 1) * capacity)) + 1
            free[order[: max(enough, int(len(used) * release))]] = True
        offset = np.zeros(len(pdf), np.int64)
        order = np.argsort(bins, kind="stable")
        ahead = np.cumsum(lengths[order]) - lengths[order]
        begins = np.concatenate([[True], np.diff(bins[order]) > 0])
        offset[order] = ahead - np.repeat(ahead[begins], np.diff(np.append(np.flatnonzero(begins), len(order))))
        return pdf.assign(bin=bins, offset=offset, open=free[bins], gap=gap)

    return run


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES, release: float = 0.02) -> DataFrame:
    """pieces with sequence_id (long), offset (long, gapless from 0 in its sequence) and gap (long).

    pieces needs a column length, from 1 to capacity; others are kept, apart from those named
    sequence_id, offset or gap, which are replaced. gap: sequences beyond the lower bound of the
    group that the piece was last packed in; 0 certifies that group. Groups have about
    group_pieces pieces at most, whatever keys repeat, since they are dealt by row. Rounds go
    on until no group has a gap, one group holds all that is left, or a round gains nothing.
    No pieces: no rows.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "gap")]
    uid, at = new_names(pieces, "uid", "at")
    held = stage(pieces.select(*kept).withColumn(uid, F.monotonically_increasing_id()), "pieces")
    todo = held.select(F.col(uid).alias("uid"), F.col("length").cast("long").alias("length"))
    placed = _placed(todo, capacity, group_pieces, release).withColumnRenamed("uid", at)
    return held.join(placed, F.col(uid) == F.col(at)).select(*kept, "sequence_id", "offset", "gap")


def _placed(todo: DataFrame, capacity: int, group_pieces: int, release: float) -> DataFrame:
    """uid, sequence_id, offset, gap of each of todo's uid and length."""
    schema = "uid long, length long, grp long, bin long, offset long, open boolean, gap long"
    columns = ["uid", "sequence_id", "offset", "gap"]
    placed = todo.sparkSession.createDataFrame([], "uid long, sequence_id long, offset long, gap long")
    number, before, fewest = 0, None, 0
    while n := todo.count():
        groups = max(1, -(-n // group_pieces))
        grouped = todo.withColumn("grp", bucket_of(groups, F.lit(number), "uid").cast("long"))
        packed = stage(grouped.groupBy("grp").applyInPandas(_pack_group(capacity, release), schema), "packed")
        sequence = F.lit(number << 52) + F.col("grp") * (1 << 24) + F.col("bin")
        numbered = packed.withColumn("sequence_id", sequence.cast("long"))
        if before is not None and packed.select("grp", "bin").distinct().count() >= fewest:
            break  # nothing gained: what the round started from stays
        placed = placed.unionByName(numbered.where("not open").select(*columns))
        released = numbered.where("open")
        before, fewest = released.select(*columns), released.select("sequence_id").distinct().count()
        if groups == 1 or number == 2047:
            break
        todo, number = released.select("uid", "length"), number + 1
    return placed if before is None else placed.unionByName(before)


def pack_documents(df: DataFrame, capacity: int = 4096, keep_ids: bool = True, **options) -> DataFrame:
    """tokenized_pieces of df, packed: a row for each piece with its sequence_id, offset and gap.

    Null and empty texts have the end id alone; only texts of more than capacity ids are cut.
    Repeated rows are documents of their own. An empty df gives no rows. Further columns of df
    are ignored, whatever their names.
    """
    tokens = {k: options.pop(k) for k in ("end_id", "tokenizer", "doc_id", "text") if k in options}
    return pack(tokenized_pieces(df, capacity, keep_ids=keep_ids, **tokens), capacity, **options)


def certificate(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """(sequences, lower bound of all pieces): the counts of each length, capacity numbers at most, are all that is gathered."""
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return packed.select("sequence_id").distinct().count(), lower_bound(count, capacity)
