"""The engine as tools for an agent: text in, text out, and errors as text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

from ..functions.columns import primary_label
from .engine import Engine, render


def _said(tool: Callable[..., str]) -> Callable[..., str]:
    @wraps(tool)
    def run(*args: object, **kwargs: object) -> str:
        try:
            return tool(*args, **kwargs)
        except Exception as e:  # noqa: BLE001 - the agent reads what was wrong
            return f"Error: {e}"

    return run


class Tools:
    """Search, reading, inspection and listing over the active snapshot of one repository."""

    def __init__(self, engine: Engine, url: str, branch: str = "main"):
        self.engine, self.url, self.branch = engine, url, branch

    @property
    def snapshot(self) -> str:
        found = self.engine.resolve(self.url, self.branch)
        if found is None:
            raise ValueError(f"{self.url} has no active snapshot")
        return found

    @_said
    def search_codebase(self, query: str, filters: dict | None = None, limit: int = 5) -> str:
        """The best hits, rendered; if the filters leave none, those without filters, which is said."""
        at = self.snapshot
        hits = self.engine.retrieve(query, snapshot=at, limit=limit, filters=filters).collect()
        note = ""
        if not hits and filters:
            hits = self.engine.retrieve(query, snapshot=at, limit=limit).collect()
            note = f"Nothing fits the filters {filters}; without them:\n"
        return note + "\n".join(render(h.asDict()) for h in hits) if hits else "Nothing found."

    @_said
    def read_file(self, path: str, start_line: int | None = None, end_line: int | None = None) -> str:
        found = self.engine.read_file(self.snapshot, path, start_line, end_line)
        return f"File: {path}\n{found['content']}" if found["content"] else "The file is empty."

    @_said
    def inspect_node(self, node_id: str) -> str:
        """Who refers to a node (the first five), its parent and its next neighbour."""
        at = self.snapshot
        refs = self.engine.impact(at, node_id).orderBy("file", "line").collect()
        out = [f"Called by ({len(refs)}):", *(f"  - {r.file} L{r.line} ({r.relation})" for r in refs[:5])] if refs else ["Called by: none"]
        about = self.engine.metadata(at, node_id)
        for k in ("parent", "next"):
            if about[k]:
                place = self.engine.nodes(at).filter(F.col("node_id") == about[k]["id"]).select("file_path", primary_label(F.col("matches")).alias("label")).first()
                out.append(f"{k.title()}: {place.label} in {place.file_path}")
        return "\n".join(out)

    @_said
    def list_repo_structure(self, children: int = 5) -> str:
        """Two levels of the tree, of each directory the first ``children`` entries."""
        tree = self.engine.manifest(self.snapshot)
        top = tree.filter("parent = ''").orderBy("place").collect()
        below = tree.join(F.broadcast(tree.filter("parent = ''").select(F.col("path").alias("parent"))), "parent", "left_semi").filter(F.col("place") <= children + 1)
        inside: dict[str, list] = {}
        for r in below.orderBy("parent", "place").collect():
            inside.setdefault(r.parent, []).append(r)
        mark = lambda r: r.name + "/" * (r.type == "directory")
        out = []
        for r in top:
            out.append(mark(r))
            own = inside.get(r.path, [])
            out += [f"  {mark(x)}" for x in own[:children]] + ["  …"] * (len(own) > children)
        return "\n".join(out)
