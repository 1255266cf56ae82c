"""Hard split of texts into windows, and what follows from the chunks' order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import newlines

WINDOW = 800
LEAST = 400
#: Sums before a chunk are taken over so many chunks, and over whole groups of them.
GROUP = 256


def _windows(window: int, least: int) -> str:
    """One window as a regular expression: it ends behind its last newline if that lies more than ``least`` in, else when it is full; what is left at the end is the last one."""
    line = f".{{{least + 1},{window - 1}}}\\n|" if least + 1 < window else ""
    return f"(?s)(?=.{{{window + 1}}})(?:{line}.{{{window}}})|.{{1,{window}}}"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, although ``use`` has it in several places or for each element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it. In groups, so that the time is all but linear."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, n: s + n)
    group = F.transform(sizes, lambda _, i: F.when(i % GROUP == 0, total(F.slice(sizes, i + 1, GROUP))))
    groups = _once(F.filter(group, lambda n: n.isNotNull()), lambda each: F.transform(each, lambda _, j: total(F.slice(each, F.lit(1), j))))
    return _once(groups, lambda before: F.transform(sizes, lambda _, i: F.get(before, F.floor(i / GROUP).cast("int")) + total(F.slice(sizes, i - i % GROUP + 1, i % GROUP))))


def hard_split(docs: DataFrame, keep: list[str], text: str, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``<keep>, seq, start, end, start_line, end_line, content`` of each chunk that isn't blank; offsets in characters, from 0, lines from 1.

    Built-in functions only, so that no text goes through Python. A text is never split between tasks. A null text has no chunk.
    """
    parts = F.regexp_extract_all(F.col(text).cast("string"), F.lit(_windows(window, least)), F.lit(0))

    def placed(parts: Column) -> Column:
        start = _once(F.transform(parts, lambda p: F.length(p)), _sums_before)
        line = _once(F.transform(parts, newlines), _sums_before)
        return F.arrays_zip(parts.alias("content"), start.alias("start"), line.alias("line"))

    rows = docs.select(*keep, F.posexplode(_once(parts, placed)).alias("__n", "__part"))
    part = lambda name: F.col("__part")[name]
    found = rows.filter(part("content").rlike(r"[^ \t\n\r\f\x0B]"))
    line = (part("line") + 1).cast("int")
    return found.select(
        *keep, (F.col("__n") + 1).alias("seq"), part("start").alias("start"), (part("start") + F.length(part("content"))).alias("end"),
        line.alias("start_line"), (line + newlines(part("content"))).alias("end_line"), part("content").alias("content"),
    )


def first_in_file(node: str, file: str, order: str) -> Column:
    """The first node of a file, which its later fragments are children of."""
    return F.first(node).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def coverage_audit(nodes: DataFrame, file: str, start: str, end: str) -> DataFrame:
    """Each chunk that doesn't begin where the one before it ends: ``gap`` or ``overlap`` and its size."""
    before = F.lag(end, 1, 0).over(Window.partitionBy(file).orderBy(start))
    return nodes.withColumn("delta", F.col(start) - before).filter("delta <> 0").withColumn("kind", F.when(F.col("delta") > 0, "gap").otherwise("overlap"))
