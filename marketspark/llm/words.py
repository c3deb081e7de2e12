"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of bytes other than the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``); in UTF-8 no other character holds these bytes, so nothing
needs decoding. Nulls count as empty texts. Work is cut into blocks of about a
megabyte (one longer text makes its own block), so memory doesn't follow the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Odd multipliers of the hashes below: fixed values.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)
LONG_WORD = 64  # bytes; the hash of longer words is taken one by one


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches], rows: int = 1000) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, on batches of at most so many rows; what a task has freed goes back to the system at its end.

    Workers outlive their tasks, and several are alive in an executor: what their allocators
    keep would add up.
    """

    def slices(batches: Batches) -> Batches:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                yield batch.slice(first, rows)

    def wrapped(batches: Batches) -> Batches:
        yield from run(slices(batches))
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values in which every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * MULTIPLIERS[3]
        x ^= x >> np.uint64(29)
        x *= MULTIPLIERS[4]
        return x ^ (x >> np.uint64(32))


@dataclass
class Block:
    """The texts of rows first to last - 1 of a batch."""

    first: int
    last: int
    data: np.ndarray  # their bytes, uint8
    offsets: np.ndarray  # of the texts in data, one more than there are texts
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    word_offsets: np.ndarray  # of the texts in starts

    def counts(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the words; with lower, of the words with A-Z lower-cased."""
        data = LOWER[self.data] if lower else self.data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        windows = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        lengths = self.ends - self.starts
        out = lengths.astype(np.uint64) * MULTIPLIERS[0]
        at = 0
        rows = np.arange(len(lengths))
        while len(rows := rows[lengths[rows] > at]) and at < LONG_WORD:
            left = lengths[rows] - at
            chunk = windows[self.starts[rows] + at]
            short = left < 8
            chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            with np.errstate(over="ignore"):
                out[rows] = mix(out[rows] ^ (chunk * MULTIPLIERS[1]))
            at += 8
        for k in rows[lengths[rows] > LONG_WORD] if len(rows) else ():
            word = data[self.starts[k] : self.ends[k]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = 1 << 20, between: np.ndarray = WHITE) -> Iterator[Block]:
    """The column's texts in blocks of at most limit bytes, or of one text. between: bytes that part words."""
    data, offsets = utf8_parts(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        part = data[offsets[first] : offsets[last]]
        yield _block(first, last, part, offsets[first : last + 1] - offsets[first], between)
        first = last


def _block(first: int, last: int, data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> Block:
    word = ~between[data]
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    full = np.flatnonzero(np.diff(offsets))
    edge = offsets[:-1][full]
    begins[edge] = word[edge]
    edge = offsets[1:][full] - 1
    closes[edge] = word[edge]
    starts = np.flatnonzero(begins)
    return Block(first, last, data, offsets, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of size consecutive word hashes; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * MULTIPLIERS[2] + words[k : k + n]) if k % 4 == 3 else out * MULTIPLIERS[2] + words[k : k + n]
    return mix(out)


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """As window_hashes, for longer windows: differences of one running sum, so the cost doesn't follow size."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = MULTIPLIERS[2]
        powers = np.cumprod(np.full(len(words), base, np.uint64))
        inverse = np.cumprod(np.full(n, pow(int(base), -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * powers, dtype=np.uint64)])
        return mix((sums[size:] - sums[:n]) * inverse)

