"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingles verify.

Texts and templates are words of ASCII letters, digits and other characters beyond ASCII,
A-Z lower-cased; punctuation parts words. Templates are classed by the number of their
five-word shingles, m, rounded up to a power of two; a class looks at windows of four times
that half, that is 2m to 4m shingles, every half window, so each occurrence lies whole in one.
A window that holds 80 % of a template has at least 0.8 m of at most 4.2 m shingles with it
in common; each of BANDS bands of one MinHash meets with that probability, and the chance
that all miss is below 2e-6. What meets is counted exactly: a match has at least 80 % of the
template's distinct shingles in one window.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SHINGLE = 5
BANDS = 64
BETWEEN = np.zeros(256, bool)
BETWEEN[[c for c in range(128) if not chr(c).isalnum()]] = True

#: Statements and notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "BSD-2-Clause-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
def _gnu(program: str, name: str, version: str) -> str:
    return f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_LEADS = ("licensed under the", "released under the", "distributed under the", "available under the", "under the terms of the")

#: License to phrasings, each with the words that tell it from its siblings: all of them must be in the window.
LICENSES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    **{n: ((TEMPLATES[n], ()),) for n in ("Apache-2.0-notice", "MIT-notice", "MPL-2.0-notice")},
    "Apache-2.0": tuple((f"{lead} Apache License, Version 2.0", ("version 2 0",)) for lead in _LEADS),
    "MIT": tuple((f"{lead} MIT License", ("mit license",)) for lead in _LEADS),
    "ISC": tuple((f"{lead} ISC License", ("isc license",)) for lead in _LEADS),
    "ISC-notice": (("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ()),),
    "CC-BY-NC-4.0": ((TEMPLATES["CC-BY-NC-4.0"], ("nc 4 0",)), ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",))),
    "CC-BY-4.0": ((TEMPLATES["CC-BY-4.0"], ("attribution 4 0",)), ("Licensed under CC BY 4.0", ("by 4 0",))),
    # The opening is the same in both licenses of this family; the clauses tell which.
    "BSD-notice": ((_BSD, ()),),
    "BSD-2-Clause-notice": ((f"{_BSD}: {_BSD_2} THIS SOFTWARE IS PROVIDED", ("the distribution this software is",)),),
    "BSD-3-Clause-notice": ((_BSD_3, ("nor the names of",)),),
    **{
        f"{short}-{version}": tuple((f"{lead} GNU {name}{comma} {version[0] if version.endswith('.0') else version}", (f"gnu {name}".lower(), f"{comma.strip(', ')} {version[0] if version.endswith('.0') else version}".replace(".", " "))) for lead in _LEADS for comma in (", version", " v"))
        for short, name, version in (("GPL", _GPL, "2.0"), ("GPL", _GPL, "3.0"), ("LGPL", _LGPL, "2.1"), ("LGPL", _LGPL, "3.0"), ("AGPL", _AGPL, "3.0"))
    },
    **{
        f"{short}-{version}-notice": tuple((_gnu(program, name, number), (f"{'gnu ' * (name == _GPL)}{name} as".lower(), f"version {number.replace('.', ' ')} of")) for program in ("program", "library"))
        for short, name, version, number in (("GPL", _GPL, "2.0", "2"), ("GPL", _GPL, "3.0", "3"), ("LGPL", _LGPL, "2.1", "2.1"), ("LGPL", _LGPL, "3.0", "3"), ("AGPL", _AGPL, "3.0", "3"))
    },
}
RESULT = "license string, shared long, template_size long, start long"


def shingles(text: str) -> np.ndarray:
    """The distinct shingle hashes of a template, sorted; a shorter one has its whole sequence."""
    (block,) = W.blocks(pa.array([text], pa.string()), 1 << 40, BETWEEN)
    words = block.hashes(lower=True)
    if not len(words):
        raise ValueError("a template needs a word")
    return np.unique(W.window_hashes(words, min(SHINGLE, len(words))))


class Index:
    """Templates by class, with what each band holds of them."""

    def __init__(self, templates: dict[str, str], percent: int, telling: dict[str, tuple[str, ...]] | None = None):
        self.percent = percent
        self.names = sorted(templates)
        self.sets = [shingles(templates[n]) for n in self.names]
        self.telling = [_telling(templates[n], (telling or {}).get(n, ())) for n in self.names]
        short = [n for n in self.names if len(_words(templates[n])) < SHINGLE]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.classes: dict[int, list[int]] = defaultdict(list)  # half a window to templates
        for k, s in enumerate(self.sets):
            self.classes[1 << math.ceil(math.log2(len(s)))].append(k)
        rng = np.random.Generator(np.random.Philox(key=5))
        self.factors = rng.integers(0, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.adds = rng.integers(0, 1 << 63, BANDS, np.uint64)
        with np.errstate(over="ignore"):
            self.least = np.array([[(s * f + a).min() for s in self.sets] for f, a in zip(self.factors, self.adds, strict=True)])
        self.maps = {}
        for half, ks in self.classes.items():
            for band in range(BANDS):
                bits = np.zeros(1 << 16, bool)
                bits[(self.least[band, ks] >> np.uint64(48)).astype(np.int64)] = True
                self.maps[half, band] = bits

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int, int]]:
        """(half, number of the window, template) that meet in a band. Windows start every half shingles."""
        found: set[tuple[int, int, int]] = set()
        top = max(self.classes, default=0)
        for band in range(BANDS):
            with np.errstate(over="ignore"):
                level = hashes * self.factors[band] + self.adds[band]
            half = 1
            while half <= top:
                if half in self.classes and len(level):
                    window = np.minimum(level, np.append(level[1:], level[-1:]))
                    hit = np.flatnonzero(self.maps[half, band][(window >> np.uint64(48)).astype(np.int64)])
                    for w in hit.tolist():
                        found.update((half, w, k) for k in self.classes[half] if self.least[band, k] == window[w])
                if len(level) % 2:
                    level = np.append(level, level[-1:])
                level = np.minimum(level[::2], level[1::2])
                half *= 2
        return found

    def matches(self, hashes: np.ndarray, candidates) -> dict[int, tuple[int, int]]:
        """template: (shared shingles, first shingle) of the best window, the first of several, if it has enough."""
        best: dict[int, tuple[int, int]] = {}
        for half, w, k in candidates:
            window = np.unique(hashes[w * half : (w + 2) * half])
            shared = len(np.intersect1d(window, self.sets[k], assume_unique=True))
            if 100 * shared >= self.percent * len(self.sets[k]) and all(np.isin(t, window).any() for t in self.telling[k]):
                best[k] = max(best.get(k, (0, 0)), (shared, -w * half))
        return {k: (n, -at) for k, (n, at) in best.items()}


def _telling(text: str, phrases: tuple[str, ...]) -> list[np.ndarray]:
    """For each phrase the shingles of the template that hold it: a window needs one of each."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    out = []
    for phrase in phrases:
        runs = [" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)]
        held = [r for r in runs if f" {phrase} " in f" {r} "]
        if not held:
            raise ValueError(f"no shingle of {text!r} holds {phrase!r}")
        out.append(np.concatenate([shingles(r) for r in held]))
    return out


def scan_licenses(df: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As scan, for LICENSES: a row for each license that a text holds, of its best phrasing.

    A phrasing counts only in windows that hold its telling words whole.
    """
    named = {f"{name}\n{k:03d}": phrasing for name, phrasings in LICENSES.items() for k, (phrasing, _) in enumerate(phrasings)}
    telling = {f"{name}\n{k:03d}": words for name, phrasings in LICENSES.items() for k, (_, words) in enumerate(phrasings)}
    return scan(df, named, percent, doc_id, text, telling=telling)


def _words(text: str) -> list:
    (block,) = W.blocks(pa.array([text], pa.string()), 1 << 40, BETWEEN)
    return block.starts.tolist()


def scan(df: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, doc_id: str = "doc_id", text: str = "text", most_templates: int = 10_000, telling: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, license, shared, template_size, start: a row for each template that a text holds.

    shared: distinct shingles of the template in the best window; start: number of that
    window's first word. Null, empty and short texts hold nothing. Repeated rows each give
    their rows; further columns are ignored. Templates go to every task, so their number is
    bounded; more raise a ValueError. telling: phrases that a template's window must hold.
    Templates whose names differ only after a line feed are phrasings of one license, and
    the one of the largest share is reported. No shuffle.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > most_templates:
        raise ValueError(f"more than {most_templates} templates")
    shared = df.sparkSession.sparkContext.broadcast((dict(templates), percent, telling))
    Index(templates, percent, telling)  # a bad template fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            rows, out = [], []
            for b in W.blocks(batch.column(1), between=BETWEEN):
                windows = W.window_hashes(b.hashes(lower=True), SHINGLE)
                # All texts at once; a window that reaches into the next text is counted anew below.
                for row, hits in _by_text(index, windows, b):
                    first, last = b.word_offsets[row], b.word_offsets[row + 1] - SHINGLE + 1
                    best: dict[str, tuple[int, int, int]] = {}
                    for k, (n, at) in sorted(index.matches(windows[first:last], hits).items()):
                        name, size = index.names[k].split("\n")[0], len(index.sets[k])
                        if name not in best or n * best[name][1] > best[name][0] * size:
                            best[name] = (n, size, at)
                    for name, found in best.items():
                        rows.append(b.first + row)
                        out.append((name, *found))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "shared", "template_size", "start"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {RESULT}")


def _by_text(index: Index, windows: np.ndarray, b: W.Block):
    """For texts with candidates: their row in the block and the candidates, by windows of the text itself."""
    meets = defaultdict(set)
    for half, w, k in index.candidates(windows):
        low, high = w * half, (w + 2) * half
        # Texts that the block's window touches, and in each the windows that overlap it.
        for row in range(max(0, np.searchsorted(b.word_offsets, low, "right") - 1), min(b.last - b.first, int(np.searchsorted(b.word_offsets, high)))):
            first, last = int(b.word_offsets[row]), int(b.word_offsets[row + 1]) - SHINGLE + 1
            if last > first and low < last and high > first:
                begin, end = max(low, first) - first, min(high, last) - first
                for own in range(max(0, begin // half - 1), (end - 1) // half + 1):
                    meets[row].add((half, own, k))
    return sorted(meets.items())
