"""Encoding texts with a given tokenizer, each distinct piece once.

Where a tokenizer file folds white space, lower-cases and then keeps the matches of
WORD_PATTERN, a text's ids are those of its white-space separated words one after another,
and a word's are those of its runs of letters, single digits and runs of other signs.
These pieces are found with numpy in words of ASCII and the letters of U+00C0 to U+00FF,
looked up by a 64-bit hash, and only new ones reach the tokenizer's model. Words with
other characters, apostrophes or < (special tokens) are encoded whole by the tokenizer. Other tokenizer files encode whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from . import words as W

#: Fixed value: the split pattern for which pieces are known.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
KEPT_PIECES = 1_500_000  # of one worker, about 60 MB; then the table starts anew
#: Kinds of bytes: 0 white, 1 letter, 2 digit, 3 other sign, 4 makes its word odd.
KIND = np.full(256, 3, np.uint8)
KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
KIND[[*range(ord("0"), ord("9") + 1)]] = 2
KIND[W.WHITE] = 0
KIND[[*range(0x21), 0x7F, *range(0x80, 256), ord("'"), ord("<")]] = 4
KIND[W.WHITE] = 0
#: The characters that stand for bytes in a byte-level model: printable ones for themselves,
#: the others, in order, for those from U+0100 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in PRINTED} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in PRINTED)}


def kinds(data: np.ndarray) -> np.ndarray:
    """KIND of each byte, with the two bytes of U+00C0 to U+00FF as letters, but for the two signs among them."""
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    return kind


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def has_word_pieces(path: str) -> bool:
    """Whether the file is of the kind that pieces are known for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = (spec.get("normalizer") or {}).get("normalizers") or []
    split, *more = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": "\\s+"}, " ")
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": WORD_PATTERN}, "Removed", True)
        and [(m["type"], m.get("add_prefix_space"), m.get("use_regex")) for m in more] == [("ByteLevel", False, False)]
        and all(t["content"].startswith("<") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
        and not any(c.isspace() for t in spec.get("added_tokens") or [] for c in t["content"])
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
    )


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = has_word_pieces(path)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of the known pieces
        self.slots = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows: first row, row after the last, all their ids, offsets of the rows in these."""
        for b in W.blocks(column, limit):
            if self.pieces:
                ids, offsets = self._encode_block(b)
            else:
                raw = b.data.tobytes()
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(b.offsets[:-1], b.offsets[1:], strict=True)]
                lists = [np.array(f.ids, np.uint32) for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                ids = np.concatenate([*lists, np.zeros(0, np.uint32)])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            yield b.first, b.last, ids, offsets

    def _encode_block(self, b: W.Block) -> tuple[np.ndarray, np.ndarray]:
        kind = kinds(b.data)
        odd_before = np.concatenate([[0], np.cumsum(kind == 4)])
        odd = odd_before[b.ends] > odd_before[b.starts]
        # Pieces begin with their word, where the kind changes, and at every digit.
        begins = np.zeros(len(b.data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inside = np.zeros(len(b.data) + 1, np.int8)
        inside[b.starts[~odd]] = 1
        inside[b.ends[~odd]] -= 1
        begins &= np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        begins[b.starts] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(b.last - b.first + 1, np.int64)
        # A piece ends where the next begins, or with its word.
        first = np.zeros(len(b.data), np.int32)
        first[b.starts] = 1
        word = np.cumsum(first, dtype=np.int32)[starts] - 1
        ends = np.minimum(np.append(starts[1:], len(b.data)), b.ends[word])
        unit = W.Block(b.first, b.last, b.data, b.offsets, starts, ends, np.searchsorted(starts, b.offsets))
        whole = odd[word]
        keys = unit.hashes(lower=True)
        if whole.any():
            few = np.flatnonzero(whole)
            exact = W.Block(b.first, b.last, b.data, b.offsets, starts[few], ends[few], b.offsets).hashes()
            keys[few] = W.mix(exact + W.MULTIPLIERS[1])
        codes, distinct = pd.factorize(keys)
        slots = self._slots(distinct, codes, unit, whole)[codes]
        sizes = self.sizes[slots]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.first[slots] - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[at], total[unit.word_offsets]

    def _slots(self, distinct: np.ndarray, codes: np.ndarray, unit: W.Block, whole: np.ndarray) -> np.ndarray:
        """Where the distinct keys' ids are; unknown ones are encoded first."""
        if len(self.keys) > KEPT_PIECES:
            self._reset()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        near = at < len(self.keys)
        known[near] = self.keys[at[near]] == distinct[near]
        slots = np.empty(len(distinct), np.int64)
        slots[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return slots
        rows = np.zeros(len(distinct), np.int64)
        rows[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the first of each
        lists = self._ids(unit, rows[new], whole[rows[new]])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        slots[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))])
        order = np.argsort(distinct[new])
        self.keys = np.insert(self.keys, at[new][order], distinct[new][order])
        self.slots = np.insert(self.slots, at[new][order], slots[new][order])
        return slots

    def _ids(self, unit: W.Block, rows: np.ndarray, whole: np.ndarray) -> list[list[int]]:
        """Ids of the pieces in these rows: by the model alone, or by the tokenizer where whole."""
        raw, tokenize = unit.data.tobytes(), self.tokenizer.model.tokenize
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(unit.starts[rows].tolist(), unit.ends[rows].tolist(), strict=True)]
        lists: list[list[int]] = [[]] * len(texts)
        odd = np.flatnonzero(whole).tolist()
        for k in np.flatnonzero(~whole).tolist():
            text = texts[k].lower()
            if not text.isascii():
                text = "".join(map(BYTE_CHARS.__getitem__, text.encode()))
            lists[k] = [t.id for t in tokenize(text)]
        for k, found in zip(odd, self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False), strict=True):
            lists[k] = found.ids
        return lists


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; tasks of one worker share what it knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each row."""
    if end_id is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An array of lists of int32."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
