"""What can be plugged into the engine: embedding services, metadata of a folder, relations from code, stores."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..functions.columns import clean_text
from ..operators.vectors import seeded
from ..sources.repositories import repository_info

#: Components of known models; of others ``DEFAULT_DIMENSIONS``.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
DEFAULT_DIMENSIONS = 1536


@runtime_checkable
class EmbeddingProvider(Protocol):
    """Vectors of texts; it is sent to the tasks, which call it with a batch each."""

    model: str
    dimensions: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class MetadataProvider(Protocol):
    """``url, name, commit, branch`` of a folder."""

    def metadata(self, path: str) -> dict[str, str]: ...


@runtime_checkable
class RelationExtractor(Protocol):
    """Relations between byte ranges (see ``graph.resolve_edges``) of files ``path, size, content, error``."""

    def extract(self, files: DataFrame) -> DataFrame: ...


@runtime_checkable
class GraphStorage(Protocol):
    """What the engine needs of a store."""

    def lock(self, repository: str, seconds: float = ...) -> bool: ...
    def unlock(self, repository: str) -> None: ...
    def register(self, repository: str, url: str, branch: str, name: str) -> None: ...
    def repositories(self) -> DataFrame: ...
    def snapshots(self) -> DataFrame: ...
    def completed(self, repository: str, commit: str) -> str | None: ...
    def activate(self, repository: str, snapshot: str, commit: str | None, stats: dict) -> None: ...
    def active(self, repository: str) -> str | None: ...
    def prune(self, repository: str, snapshot: str) -> None: ...
    def write(self, name: str, df: DataFrame) -> None: ...
    def read(self, name: str, snapshot: str | None = None) -> DataFrame: ...
    def contents(self, hashes: list[str] | None = None) -> DataFrame: ...


class GitMetadata:
    """Metadata of a Git checkout; a folder without Git has its path for a url and ``unknown`` for the rest."""

    def metadata(self, path: str) -> dict[str, str]:
        return repository_info(path)


class SeededProvider:
    """A stand-in for a service: vectors that only depend on the text, for tests and dry runs."""

    def __init__(self, model: str = "seeded", dimensions: int | None = None):
        self.model = model
        self.dimensions = dimensions or DIMENSIONS.get(model, DEFAULT_DIMENSIONS)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [seeded(clean_text(t), self.dimensions) for t in texts]


class LocalModelProvider:
    """A model in the workers' memory: ``load`` makes the function from texts to vectors, once for each process."""

    _loaded: dict[str, Callable[[list[str]], list[list[float]]]] = {}

    def __init__(self, model: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimensions: int):
        self.model, self.load, self.dimensions = model, load, dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self.model not in self._loaded:
            self._loaded[self.model] = self.load()
        out = [list(map(float, v)) for v in self._loaded[self.model]([clean_text(t) for t in texts])]
        if any(len(v) != self.dimensions for v in out):
            raise ValueError(f"{self.model} gave vectors of another length than {self.dimensions}")
        return out
