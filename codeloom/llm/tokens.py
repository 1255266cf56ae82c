"""Token ids of many texts, with each distinct pre-token encoded once.

The byte-level BPE splits a text into pre-tokens before it merges, so a text's
ids are those of its pre-tokens in order. The splits are found with array
operations over code points, and only pre-tokens not met before go to the
tokenizer. Character classes are asked from the tokenizer's own splitter. As in
the tokenizer at its defaults, literals of added tokens such as ``<|endoftext|>``
are cut out first and have their own ids.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .textnum import U, mix64, span_hash

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
MAX_CACHED = 300_000


def _byte_chars() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself if it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


class BatchEncoder:
    """Ids of whole batches by the byte-level BPE in ``vocabulary``, a file of the tokenizers library."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.split = ByteLevel(add_prefix_space=False)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        #: Tokens that take white space beside them or look at what is beside them are left to the tokenizer.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.literals = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self._classify(np.arange(128))
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=U)
        self.where = np.zeros(0, dtype=np.int64)  # of a known hash: its entry
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _classify(self, points: np.ndarray) -> None:
        for p in points.tolist():
            c = chr(p)
            alone = [len(self.split.pre_tokenize_str(x + c)) == 1 for x in ("a", "1", "!")]
            self.kind[p] = LETTER if alone[0] else NUMBER if alone[1] else OTHER if alone[2] else SPACE

    def pretokens(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in ``points``, the code points of texts with these offsets (no text is empty)."""
        n = len(points)
        kind = self.kind[points]
        if (kind == UNKNOWN).any():
            self._classify(np.unique(points[kind == UNKNOWN]))
            kind = self.kind[points]
        text_start = np.zeros(n, dtype=bool)
        text_start[offsets[:-1]] = True
        text_end = np.zeros(n, dtype=bool)
        text_end[offsets[1:] - 1] = True
        run = text_start.copy()
        run[1:] |= kind[1:] != kind[:-1]
        run_end = np.ones(n, dtype=bool)
        run_end[:-1] = run[1:]
        space = kind == SPACE
        # the last of a run of white space before something else stands alone, or, if it is a plain space, begins the next pre-token
        last = space & run_end & ~text_end
        start = run | last
        prefix = np.flatnonzero(last & (points == 32)) + 1
        start[prefix] = False
        # contractions: an apostrophe that is a whole run and no prefix's, with the letters after it
        quote = np.flatnonzero((points == 39) & run & run_end & ~text_end & start)
        if len(quote):
            a = quote + 1
            b = np.minimum(quote + 2, n - 1)
            inner = (b > a) & ~text_start[b]
            x, y = points[a], np.where(inner, points[b], 0)
            one = np.isin(x, [ord(c) for c in "stmd"])
            two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
            for q in quote[one].tolist():
                start[q + 1] = False
                if q + 2 < n:
                    start[q + 2] = True if kind[q + 2] == LETTER and not text_start[q + 2] else start[q + 2]
            for q in quote[two & ~one].tolist():
                start[q + 1] = False
                if q + 3 < n:
                    start[q + 3] = True if kind[q + 3] == LETTER and not text_start[q + 3] else start[q + 3]
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the bounds of each text's ids."""
        held = [i for i, t in enumerate(texts) if self.literals.search(t)] if self.literals else []
        if not held:
            return self._encode(texts)
        # each text as parts between the literals; those of the literals are empty
        parts: list[str] = []
        own: dict[int, list[int]] = {}  # ids in the place of a part
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        among = set(held)
        for i, t in enumerate(texts):
            if i not in among:
                parts.append(t)
            elif not self.plain:
                own[len(parts)] = self.tokenizer.encode(t, add_special_tokens=False).ids
                parts.append("")
            else:
                at = 0
                for m in self.literals.finditer(t):
                    parts.append(t[at : m.start()])
                    own[len(parts)] = [self.added[m[0]]]
                    parts.append("")
                    at = m.end()
                parts.append(t[at:])
            ends[i + 1] = len(parts)
        ids, bounds = self._encode(parts)
        counts = np.diff(bounds)
        for k, x in own.items():
            counts[k] = len(x)
        out_bounds = np.concatenate(([0], np.cumsum(counts)))
        places = np.array(list(own), dtype=np.int64)
        return np.insert(ids, np.repeat(bounds[places], counts[places]), np.array([i for x in own.values() for i in x], dtype=np.uint32)), out_bounds[ends]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts taken as they are."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        out_bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        full = np.flatnonzero(lengths)
        if not len(full):
            return np.zeros(0, dtype=np.uint32), out_bounds
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate(([0], np.cumsum(lengths[full])))
        starts = self.pretokens(points, offsets)
        ends = np.append(starts[1:], len(points))
        h = span_hash(mix64(points.astype(U) + U(0x5851F42D4C957F2D)) | U(1), starts, ends)
        distinct, first, index = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            if len(self.known) + int(new.sum()) > MAX_CACHED:
                self._clear()
                new[:] = True
            f = first[new]
            merge = self.tokenizer.model.tokenize
            ids = [[t.id for t in merge(joined[a:b].encode().decode("latin-1").translate(BYTE_CHARS))] for a, b in zip(starts[f].tolist(), ends[f].tolist())]
            entry = len(self.starts) - 1 + np.arange(len(ids))
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids]))
            self.ids = np.append(self.ids, np.array([i for x in ids for i in x], dtype=np.uint32))
            put = np.searchsorted(self.known, distinct[new])
            self.known, self.where = np.insert(self.known, put, distinct[new]), np.insert(self.where, put, entry)
            at = np.searchsorted(self.known, distinct)
        entry = self.where[at][index]
        count = np.diff(self.starts)[entry]
        token_bounds = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat(self.starts[entry] - token_bounds[:-1], count) + np.arange(token_bounds[-1])
        out_bounds[1:][full] = token_bounds[np.searchsorted(starts, offsets[1:])]
        np.maximum.accumulate(out_bounds, out=out_bounds)
        return self.ids[source], out_bounds


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(vocabulary: str) -> BatchEncoder:
    """The encoder of this worker process, whose cache outlives a task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = BatchEncoder(vocabulary)
    return _ENCODERS[vocabulary]
