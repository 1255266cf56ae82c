"""Chunks of source files from a tree of units, independent of the language.

A unit is a stretch of bytes: glue (comments, decorators, bare strings) belongs to what
follows it, containers (classes, functions) are chunks of their own, and
other statements group until they fill a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, field

LIMIT = 800
LEAST = 400
LONG_HEADER = 480


@dataclass
class Unit:
    """A stretch of a file; ``body`` has the units inside, from ``body_start`` on."""

    start: int
    end: int
    glue: bool = False
    container: bool = False
    body: list[Unit] | None = None
    body_start: int = 0
    tags: list[str] = field(default_factory=list)


@dataclass
class Capture:
    """A named piece of syntax: category ``role`` or ``type``, and its value."""

    start: int
    end: int
    category: str
    value: str


@dataclass
class Chunk:
    """A chunk's bytes, the chunk that it is a child of (by number, or none), and its tags."""

    start: int
    end: int
    parent: int | None = None
    tags: list[str] = field(default_factory=list)


def hard_split(data: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """Bounds of pieces of at most ``LIMIT`` bytes, cut behind a newline that lies far enough in."""
    out = []
    while start < end:
        stop = end
        if end - start > LIMIT:
            newline = data.rfind(b"\n", start, start + LIMIT)
            stop = newline + 1 if newline - start > LEAST else start + LIMIT
        out.append((start, stop))
        start = stop
    return out


class Chunker:
    """Chunks of one file, in order of their start."""

    def __init__(self, data: bytes):
        self.data = data
        self.chunks: list[Chunk] = []

    def run(self, units: list[Unit]) -> list[Chunk]:
        self._scope(units, 0, len(self.data), None)
        order = sorted(range(len(self.chunks)), key=lambda i: (self.chunks[i].start, self.chunks[i].end))
        at = {old: new for new, old in enumerate(order)}
        for c in self.chunks:
            c.parent = None if c.parent is None else at[c.parent]
        return [self.chunks[i] for i in order]

    def _add(self, start: int, end: int, parent: int | None, tags: list[str]) -> int | None:
        """The first chunk made of a stretch; none if it is blank. Long stretches are split, and the first piece is the parent of the others."""
        first = None
        for a, b in hard_split(self.data, start, end) if end - start > LIMIT else [(start, end)]:
            if self.data[a:b].strip():
                self.chunks.append(Chunk(a, b, parent if first is None else first, list(dict.fromkeys(tags))))
                first = len(self.chunks) - 1 if first is None else first
        return first

    def _scope(self, units: list[Unit], start: int, end: int, parent: int | None, adopt: bool = False) -> None:
        """Chunks of the units between two bytes; with ``adopt`` the first one made becomes the parent of the rest."""
        group = start  # what isn't in a chunk yet begins here
        filled = False  # whether that has more than glue
        last = start  # where the last unit ended: what lies between belongs to the next one

        def made(i: int | None) -> None:
            nonlocal parent, adopt
            if adopt and i is not None:
                parent, adopt = i, False

        for n, u in enumerate(units):
            if u.glue:
                if filled:
                    made(self._add(group, last, parent, []))
                    group, filled = last, False
            elif u.container:
                if filled:
                    made(self._add(group, last, parent, []))
                    group, filled = last, False
                made(self._container(u, group, parent))
                group = u.end
            else:
                filled = True
                if u.end - group > LIMIT and end - u.end > LEAST:
                    made(self._add(group, u.end, parent, u.tags))
                    group, filled = u.end, False
            last = u.end
        made(self._add(group, end, parent, []))

    def _container(self, u: Unit, start: int, parent: int | None) -> int | None:
        if u.end - start <= LIMIT:
            return self._add(start, u.end, parent, u.tags)
        if not u.body:
            return self._add(start, u.end, parent, u.tags)
        before = len(self.chunks)
        if u.body_start - start > LONG_HEADER:
            head = self._add(start, u.body_start, parent, u.tags)
            self._scope(u.body, u.body_start, u.end, head if head is not None else parent)
        else:
            self._scope(u.body, start, u.end, parent, adopt=True)
            if len(self.chunks) > before:
                self.chunks[before].tags = list(dict.fromkeys(u.tags + self.chunks[before].tags))
        return before if len(self.chunks) > before else None
