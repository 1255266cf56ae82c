"""License scan: which license templates the texts hold.

Words are runs of letters and digits in lower case; a shingle is ``SHINGLE``
neighbouring words. A template of ``n`` words is in a text if some window of ``n`` words
holds at least ``threshold`` of the template's shingles.

A template of ``m`` shingles belongs to the windows of ``W`` shingles, the power of two from ``4/3 m`` on. These begin at every ``W / 4``-th
shingle, so that each stretch of ``m`` lies whole in one. Windows and templates have
``BANDS`` MinHash bands of one row; a template is retrieved for the windows that agree with it in
any band. A window that holds a template at the threshold shares more than a fourth
of the union of both sets, and misses all bands with a
probability of at most ``(1 - 0.28)^48 < 2e-7``. The windows retrieved are
verified by exact containment. A window of length ``2 W`` has the smaller of the minima of two of length ``W``, so
that the windows of all lengths cost little more than the longest.

One narrow pass over whole texts; the templates have a documented size limit and go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed import IS_LETTER
from .textnum import BYTE_VALUE, LOWER, U, mix64, pieces, shingles, span_hash, spans, texts_of

SHINGLE = 3
BANDS = 48
THRESHOLD = 0.8
#: The templates together must not have more bytes than this.
MAX_TEMPLATE_BYTES = 16_000_000
IS_WORD = IS_LETTER.copy()
IS_WORD[48:58] = True
_A = (mix64(np.arange(1, BANDS + 1, dtype=U) * U(0x9FB21C651E98DF25)) >> U(32)).astype(np.uint32) | np.uint32(1)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_NOTICE = ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
_BSD_NAMES = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. '
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Notices, and licenses that are published for reuse, in full (``-text``).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": _ISC,
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Rights-reserved": "All rights reserved.",
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause-text": _BSD + _BSD_NAMES + _BSD_END,
    "ISC-text": _ISC + _ISC_END,
}
TEMPLATES["MIT-text"] = TEMPLATES["MIT-grant"] + _NOTICE + _AS_IS


def short(h: np.ndarray) -> np.ndarray:
    """32 of the 64 bits of hashes, for MinHash."""
    return (h >> U(32)).astype(np.uint32)


def word_shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in order, their bounds, and the start and end bytes of all words, with bounds in the last row."""
    starts, ends = spans(IS_WORD[buf], offsets)
    h = span_hash(BYTE_VALUE[LOWER[buf]], starts, ends)
    bounds = np.searchsorted(starts, offsets).astype(np.int64)
    return *shingles(h, bounds, SHINGLE), starts, bounds


class Templates:
    """The templates by size class, with their MinHash bands."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
            raise ValueError(f"the templates have more than {MAX_TEMPLATE_BYTES} bytes")
        column = pa.array([templates[n] for n in self.names], pa.string())
        h, bounds, _, word_bounds = word_shingles(*texts_of(column))
        self.words = np.diff(word_bounds)
        self.sets = [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(len(self.names))]
        #: By the logarithm of the windows' length: the templates.
        self.classes: dict[int, list[int]] = {}
        for i, n in enumerate(self.words.tolist()):
            if n:
                m = max(1, n - SHINGLE + 1)
                self.classes.setdefault(max(1, (-(-4 * m // 3) - 1).bit_length()), []).append(i)
        #: By class and band: sorted minima and their templates, and a filter by the minima's high bits.
        self.bands = {c: [self._band(own, a) for a in _A] for c, own in self.classes.items()}

    def _band(self, own: list[int], a: np.uint32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = np.array([(short(self.sets[i]) * a).min() for i in own], dtype=np.uint32)
        order = np.argsort(least)
        known = np.zeros(1 << 16, dtype=bool)
        known[least >> np.uint32(16)] = True
        return least[order], np.array(own)[order], known

    def verify(self, h: np.ndarray, t: int) -> tuple[float, int]:
        """The greatest share of template ``t``'s shingles in a window of as many words, and the first such window, of shingles ``h``."""
        own = self.sets[t]
        length = max(1, int(self.words[t]) - SHINGLE + 1)
        at = np.searchsorted(own, h)
        known = own[np.minimum(at, len(own) - 1)] == h
        pos = np.flatnonzero(known)
        best, where = 0, 0
        seen: dict[int, int] = {}
        left = 0
        for r in range(len(pos)):  # distinct shingles in a sliding window
            k = int(at[pos[r]])
            seen[k] = seen.get(k, 0) + 1
            while pos[r] - pos[left] >= length:
                j = int(at[pos[left]])
                seen[j] -= 1
                if not seen[j]:
                    del seen[j]
                left += 1
            if len(seen) > best:
                best, where = len(seen), int(pos[left])
        return best / len(own), where

    def scan(self, h: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, int, float, int]]:
        """``text, template, containment, first shingle`` of each template that a text holds, at its best place."""
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for c, start, t in self._retrieve(h):
            end = min(start + (1 << c), len(h))
            first, last = (int(x) for x in np.searchsorted(bounds, [start, end - 1], side="right") - 1)
            for i in range(first, last + 1):  # a window may reach into the next texts
                a, b = max(start, int(bounds[i])), min(end, int(bounds[i + 1]))
                if a >= b:
                    continue
                share, at = self.verify(h[a:b], t)
                old = found.get((i, t))
                new = (share, a + at - int(bounds[i]))
                if share >= threshold and (old is None or (-new[0], new[1]) < (-old[0], old[1])):
                    found[(i, t)] = new
        return [(i, t, share, at) for (i, t), (share, at) in sorted(found.items())]

    def _retrieve(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """Class, first shingle and template of each window that agrees with a template in a band."""
        pairs: set[tuple[int, int, int]] = set()
        if not len(h) or not self.classes:
            return []
        top = max(self.classes)
        low = short(h)
        x = np.full(len(h) + (1 << top), 0xFFFFFFFF, dtype=np.uint32)
        for j, a in enumerate(_A):
            np.multiply(low, a, out=x[: len(h)])
            w = x
            for c in range(1, top + 1):
                w = np.minimum(w[: -(1 << (c - 1))], w[1 << (c - 1) :])
                if c in self.classes:
                    step = max(1, (1 << c) // 4)
                    least, own, known = self.bands[c][j]
                    some = w[: len(h) : step]
                    for k in np.flatnonzero(known[some >> np.uint32(16)]).tolist():
                        lo, hi = np.searchsorted(least, some[k], "left"), np.searchsorted(least, some[k], "right")
                        pairs |= {(c, k * step, int(t)) for t in own[lo:hi]}
        return sorted(pairs)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_licenses, licenses, matches``.

    ``matches`` has for each template found its name, containment and first word
    (from 0) at the best place (of equal ones the first); ``licenses`` their names, sorted and joined by
    commas. Null and empty texts hold none; a text shorter than a template is matched
    as one window. Rows that repeat have equal results; an empty table gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_licenses long, licenses string, matches array<struct<name: string, containment: double, first_word: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(templates)
        for batch in batches:
            buf, offsets = texts_of(batch.column(1))
            for a, b in pieces(offsets, 1 << 19):
                h, bounds, _, _ = word_shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows: list[list[dict]] = [[] for _ in range(b - a)]
                for i, t, share, at in index.scan(h, bounds, threshold):
                    rows[i].append({"name": index.names[t], "containment": share, "first_word": at})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(m["name"] for m in r) for r in rows], pa.string()), pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())])))],
                    ["id", "n_licenses", "licenses", "matches"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
