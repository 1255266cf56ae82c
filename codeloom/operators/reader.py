"""Files and directories, rebuilt from chunks and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``path, content, first_line`` of each file: its chunks in order; empty if it has none."""
    parts = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "content"))).alias("p"), F.min("start_line").alias("first_line"))
    text = F.array_join(F.transform("p", lambda x: x["content"]), "")
    return files.join(parts, "file_id", "left").select("path", F.coalesce(text, F.lit("")).alias("content"), F.coalesce("first_line", F.lit(1)).alias("first_line"))


def read_range(nodes: DataFrame, files: DataFrame, start_line: int | None, end_line: int | None) -> DataFrame:
    """``path, content`` of a range of lines (from 1, inclusive); only chunks that overlap it are read."""
    a, b = start_line or 0, end_line or 999_999
    near = nodes.filter((F.col("end_line") >= a) & (F.col("start_line") <= b))
    whole = read_files(near, files)
    lines = F.split("content", "(?<=\n)")
    skip = F.greatest(F.lit(a) - F.col("first_line"), F.lit(0)) if start_line else F.lit(0)
    count = F.greatest(F.lit(b) - F.col("first_line") + 1, F.lit(0)) - skip
    return whole.select("path", F.array_join(F.slice(lines, skip + 1, F.greatest(F.least(count, F.size(lines)), F.lit(0))), "").alias("content"))


def entries(paths: DataFrame, path: str = "path") -> DataFrame:
    """The flattened tree of all paths: ``dir, name, type, path``; the root's ``dir`` is empty."""
    parts = F.split(F.col(path), "/")
    rows = paths.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    up_to = lambda i: F.array_join(F.slice("p", F.lit(1), i), "/")
    return rows.select(
        up_to(F.col("i") - 1).alias("dir"), F.element_at("p", F.col("i")).alias("name"), F.when(F.col("i") == F.size("p"), "file").otherwise("dir").alias("type"), up_to(F.col("i")).alias("path"),
    ).distinct()


def list_directory(paths: DataFrame, directory: str, path: str = "path") -> DataFrame:
    """``name, type, path`` of a directory's children, directories first; nothing if it doesn't exist. A file's path raises ``NotADirectoryError``."""
    directory = directory.strip("/")
    if directory and not paths.filter(F.col(path) == directory).isEmpty():
        raise NotADirectoryError(directory)
    prefix = directory + "/" if directory else ""
    below = F.substring(F.col(path), len(prefix) + 1, 1 << 30)
    name = F.substring_index(below, "/", 1)
    rows = paths.filter(F.col(path).startswith(prefix)).select(name.alias("name"), F.when(name == below, "file").otherwise("dir").alias("type")).distinct()
    return rows.withColumn("path", F.concat(F.lit(prefix), "name")).orderBy(F.col("type") != "dir", "name")


def file_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path, name, type, parent, place``: the tree of all paths, each directory's children numbered from 1, directories first."""
    rows = entries(paths, path).withColumn("type", F.when(F.col("type") == "dir", "directory").otherwise("file"))
    order = Window.partitionBy("dir").orderBy(F.col("type") != "directory", "name")
    return rows.select("path", "name", "type", F.col("dir").alias("parent"), F.row_number().over(order).alias("place"))


def overlay(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``path, content, chunks``: each file with the places of its chunks in order (``node_id, start_line, end_line, start, end``)."""
    places = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "start_line", "end_line", "node_id"))).alias("chunks"))
    return read_files(nodes, files).join(files.select("path", "file_id"), "path").join(places, "file_id", "left").select("path", "content", "chunks")


def find_directories(paths: DataFrame, part: str, limit: int, path: str = "path") -> DataFrame:
    """The first ``limit`` directories, by path, whose name holds ``part`` in any case."""
    named = entries(paths, path).filter((F.col("type") == "dir") & F.contains(F.lower("name"), F.lit(part.lower())))
    return named.select("path").orderBy("path").limit(limit)


def changed(old: DataFrame, new: DataFrame, key: str = "path", content: str = "file_hash") -> DataFrame:
    """``<key>, change`` between two snapshots: added, removed or modified."""
    o, n = old.select(key, F.col(content).alias("o")), new.select(key, F.col(content).alias("n"))
    change: Column = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).filter("change is not null")
