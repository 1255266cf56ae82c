"""A data source over a checked-out tree of files.

Spark's own file sources hide names that begin with ``_`` or ``.``, such as
``__init__.py``; this one doesn't. The driver lists the upper folders only; each task walks those of its own and reads their files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.columns import LANGUAGES, MAX_FILE_BYTES, PRUNED_DIRS

SCHEMA = "path string, size long, content binary, error string"


def walk(root: str, below: str = "") -> Iterator[str]:
    """Paths, relative to ``root``, of the files below a folder of it with a known extension, in order; pruned directories aren't entered."""
    for folder, dirs, names in os.walk(os.path.join(root, below)):
        dirs[:] = sorted(d for d in dirs if d not in PRUNED_DIRS)
        for name in sorted(names):
            if known(name):
                yield os.path.relpath(os.path.join(folder, name), root)


def known(name: str) -> bool:
    return "." in name and name.rpartition(".")[2] in LANGUAGES


def plan(root: str, least: int) -> tuple[list[str], list[str]]:
    """Folders, at least ``least`` if the tree has as many, whose whole subtrees make up the tree together with some files above them."""
    folders, files = [""], []
    while folders and len(folders) < least:
        inner: list[str] = []
        for f in folders:
            with os.scandir(os.path.join(root, f)) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    path = os.path.join(f, e.name)
                    if e.is_dir(follow_symlinks=False):
                        inner += [path] if e.name not in PRUNED_DIRS else []
                    elif known(e.name):
                        files.append(path)
        folders = inner
    return folders, files


def guarded_read(path: str) -> tuple[int, bytes | None, str | None]:
    """Size, bytes and error of a file: those too large or binary, and those that can't be read, have no bytes."""
    try:
        size = os.path.getsize(path)
        if size > MAX_FILE_BYTES:
            return size, None, f"File too large ({size / 1048576:.2f} MB)"
        with open(path, "rb") as f:
            data = f.read()
    except OSError as e:
        return 0, None, f"Read Error: {e}"
    return (size, None, "Binary file detected") if b"\0" in data[:1024] else (size, data, None)


class _Part(InputPartition):
    def __init__(self, folder: str | None, paths: list[str]):
        self.folder, self.paths = folder, paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, per_task: int, folders: int):
        self.root, self.per_task, self.folders = root, per_task, folders

    def partitions(self) -> list[InputPartition]:
        folders, paths = plan(self.root, self.folders)
        return [_Part(f, []) for f in folders] + [_Part(None, paths[a : a + self.per_task]) for a in range(0, len(paths), self.per_task)] or [_Part(None, [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths if partition.folder is None else walk(self.root, partition.folder):
            yield (path, *guarded_read(os.path.join(self.root, path)))


class CodeTree(DataSource):
    """``spark.read.format("codetree").option("root", folder)``; options ``filesPerTask`` (50, of files above the tasks' folders) and ``folders`` (256, at least so many tasks if the tree has as many)."""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["root"], int(self.options.get("filesPerTask", 50)), int(self.options.get("folders", 256)))


def read_tree(spark: SparkSession, root: str, files_per_task: int = 50) -> DataFrame:
    """``path, size, content, error`` of the files below ``root``, a folder that the executors share."""
    spark.dataSource.register(CodeTree)
    return spark.read.format("codetree").option("root", root).option("filesPerTask", files_per_task).load()
