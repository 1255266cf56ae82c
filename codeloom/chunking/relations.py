"""Relations found in Python files: what they import, and calls of functions and classes of the same tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .python_ast import Lines, name_of

FOUND = "path string, kind string, symbol string, start long, end long"


def found_in(path: str, data: bytes) -> list[tuple[str, str, str, int, int]]:
    """``path, kind, symbol, start, end`` of definitions, calls and imports; nothing of a file that doesn't parse."""
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = Lines(data)
    out = []
    for node in ast.walk(tree):
        if not hasattr(node, "lineno"):
            continue
        a, b = lines.at(node.lineno, node.col_offset), lines.at(node.end_lineno, node.end_col_offset)
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            out.append((path, "class" if isinstance(node, ast.ClassDef) else "function", node.name, *name_of(node, data, lines)))
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.append((path, "call", name, a, b))
        elif isinstance(node, ast.Import):
            out += [(path, "import", x.name, a, b) for x in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((path, "import", "." * node.level + (node.module or ""), a, b))
    return out


class PythonRelations:
    """Calls by name to the definition of that name in the same file, or else to the only one in the tree; imports of modules as external relations."""

    def extract(self, files: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [r for path, data in zip(pdf.path, pdf.content) if path.endswith(".py") and data is not None for r in found_in(path, bytes(data))]
                yield pd.DataFrame(rows, columns=["path", "kind", "symbol", "start", "end"]).astype({"start": "int64", "end": "int64"})

        found = files.select("path", "content").mapInPandas(run, FOUND).withColumn("ref", F.sha2(F.concat_ws("|", "path", "kind", "symbol", "start", "end"), 256))
        defined = found.filter("kind in ('class', 'function')")
        own = defined.groupBy("path", "symbol").agg(F.min(F.struct("start", "end", "kind")).alias("own"))
        only = defined.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "start", "end", "kind")).alias("only")).filter("n = 1").drop("n")
        calls = found.filter("kind = 'call'").drop("kind").join(own, ["path", "symbol"], "left").join(only, "symbol", "left").filter("own is not null or only is not null")
        pick = lambda c: F.coalesce(F.col(f"own.{c}"), F.col(f"only.{c}"))
        source = [F.col("ref"), F.col("path").alias("source_path"), F.col("start").alias("source_start"), F.col("end").alias("source_end")]
        called = calls.select(
            *source, F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("only.path")).alias("target_path"), pick("start").alias("target_start"), pick("end").alias("target_end"),
            F.when(pick("kind") == "class", "instantiates").otherwise("calls").alias("relation_type"), "symbol", F.lit(False).alias("external"),
        )
        none = F.lit(None).cast("long")
        imported = found.filter("kind = 'import'").select(*source, F.col("symbol").alias("target_path"), none.alias("target_start"), none.alias("target_end"), F.lit("imports").alias("relation_type"), "symbol", F.lit(True).alias("external"))
        return called.unionByName(imported)
