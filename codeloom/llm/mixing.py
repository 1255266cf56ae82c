"""Mixing sources to target weights.

Each row gets a hash-random key (MD5 of its id), and its point (key, id, size) says where
it comes in its source. Rows fall, in key order, into ``16^CELL_DIGITS`` ranges per
source; prefix sums run over the ranges' totals, and over the points of the one range
that holds a source's cut, in which rows with one point are a single line with a count.
A target of ``e`` whole epochs and a rest takes every row ``e`` times and the rows
before the cut once more. Of the rows behind the cut the one whose size best
fills what is still missing is taken too, if it brings the source nearer its target,
so that what is taken differs from a target by half of the row at the cut at most.

Rows with the point of a cut or of a fill are numbered in two steps (within a task, and by the tasks' counts),
so that exactly as many of them are taken as are due, also if one point holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

CELL_DIGITS = 3
MAX_EPOCHS = 3
#: The plan of up to so many sources (some 200 bytes each) is broadcast, and joined beyond it.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: dict[str | None, int] | None = None) -> DataFrame:
    """``s, source_size, target`` of each source (``s, source_size``).

    Without ``weights``, sources in code point order, null last, weigh 1, 2, 3,
    1, 2, 3 and so on. They share the sum of all sizes; a target stops at
    ``MAX_EPOCHS`` times its source's size and the excess is shared again by
    weight. That ends where one level ``x`` gives each source the lesser of
    ``x * weight`` and its limit: sources in order of limit / weight stop at their limits
    until the level that is left for the rest is below the next one's.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    by_name = Window.orderBy(F.asc_nulls_last("s"))
    o = sizes.withColumn("i", F.row_number().over(by_name))
    if weights is None:
        o = o.withColumn("w", (F.col("i") - 1) % 3 + 1)
    else:
        given = sizes.sparkSession.createDataFrame(list(weights.items()), "ws string, w int")
        o = o.join(given, F.col("s").eqNullSafe(F.col("ws"))).drop("ws")
    o = o.withColumn("limit", exact("source_size") * MAX_EPOCHS).withColumn("w", exact("w")).withColumn("at", F.col("limit").cast("double") / F.col("w").cast("double"))
    before = Window.orderBy("at", "i").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("decimal(38,0)")
    o = o.withColumn("left", sum_of("source_size", every) - sum_of("limit", before)).withColumn("left_w", sum_of("w", every) - sum_of("w", before))
    stops = F.col("limit").cast("double") * F.col("left_w").cast("double") > F.col("left").cast("double") * F.col("w").cast("double")
    first = o.filter(stops).agg(F.min(F.struct("at", "i", (F.col("left").cast("double") / F.col("left_w").cast("double")).alias("level"))).alias("stop"))
    limited = F.col("stop").isNull() | (F.col("at") < F.col("stop.at"))
    return o.join(F.broadcast(first)).select("s", "source_size", F.when(limited, F.col("limit").cast("double")).otherwise(F.col("w").cast("double") * F.col("stop.level")).alias("target"))  # ``first`` is one row


def _keyed(id_col: str, text_col: str, source_col: str, size_expr: str | None) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.expr(size_expr) if size_expr else F.regexp_count(text, F.lit(WORD))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return [F.col(id_col).alias("id"), size.cast("long").alias("size"), F.col(source_col).cast("string").alias("s"), F.md5(ident).alias("key")]


def _point() -> Column:
    return F.struct("key", "id", "size")


def _with(rows: DataFrame, table: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """``rows`` with the line of their source in ``table``, whose source is ``name``."""
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(table) if few else table, F.col("s").eqNullSafe(F.col(name)), how)


def _decide(rows: DataFrame, weights: dict[str | None, int] | None) -> DataFrame:
    """The plan, a line for each source: ``src, source_size, target, epochs, cut, cut_copies, fill``.

    Rows before the point ``cut`` (all, if it is null) are taken once more than the epochs, ``cut_copies`` of those at
    it, and one of those at the point ``fill``.
    """
    cells = written(rows.groupBy("s", F.substring("key", 1, CELL_DIGITS).alias("cell")).agg(F.sum("size").alias("n")), "cells")
    targets = source_targets(cells.groupBy("s").agg(F.sum("n").alias("source_size")), weights)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(0).cast("long")
    plan = written(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("s", "src"), "targets")

    # the range that holds each source's cut: the first whose running sum passes the rest
    run = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    passed = _with(cells.withColumn("upto", F.sum("n").over(run)), plan.select("src", "rest"), "src").filter(F.col("upto") > F.col("rest"))
    at = passed.groupBy("src", "rest").agg(F.min(F.struct("cell", (F.col("upto") - F.col("n")).alias("before"))).alias("c"))
    at = written(at.select("src", "rest", "c.cell", "c.before"), "cut_cells")

    # the point in it: what begins before the rest and ends behind it
    inside = _with(rows, at, "src").filter(F.substring("key", 1, CELL_DIGITS) == F.col("cell"))
    lines = inside.groupBy("src", "rest", "before", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("src").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.withColumn("end", F.col("before") + F.sum(F.col("n") * F.col("size")).over(upto)).filter(F.col("end") > F.col("rest"))
    cut = ends.groupBy("src").agg(F.min(F.struct(_point().alias("cut"), (F.col("end") - F.col("n") * F.col("size")).alias("start"), "rest")).alias("c"))
    copies = F.floor((F.col("c.rest") - F.col("c.start")) / F.col("c.cut.size")).cast("long")
    cut = cut.select("src", F.col("c.cut").alias("cut"), copies.alias("cut_copies"), (F.col("c.rest") - F.col("c.start") - copies * F.col("c.cut.size")).alias("gap"))
    cut = written(cut, "cuts")

    # of the rows left, the one that fills best what is missing
    gaps = cut.filter("gap > 0.5").select(F.col("src").alias("gap_src"), F.col("cut").alias("after"), "gap")
    left = _with(rows.filter("size > 0"), gaps, "gap_src").filter((F.col("size") < 2 * F.col("gap")) & (_point() >= F.col("after")))
    fill = left.groupBy("gap_src").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("d"), "key", "id", "size")).alias("b"))
    fill = fill.select("gap_src", F.struct("b.key", "b.id", "b.size").alias("fill"))
    found = cut.join(fill, F.col("src").eqNullSafe(F.col("gap_src")), "left").select(F.col("src").alias("cut_src"), "cut", "cut_copies", "fill")
    out = plan.join(found, F.col("src").eqNullSafe(F.col("cut_src")), "left")
    return written(out.select("src", "source_size", "target", "epochs", "cut", "cut_copies", "fill"), "plan")


def _times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``s, key, id, size``) with their source's line and ``times``, how often the mix takes them."""
    known = _with(rows, plan, "src")
    # keys decide on all rows but a few, so that sizes needn't be known of the others
    at_cut, at_fill = (F.coalesce((F.col("key") == F.col(f"{c}.key")) & (_point() == F.col(c)), F.lit(False)) for c in ("cut", "fill"))
    before_cut = (F.col("key") < F.col("cut.key")) | ((F.col("key") == F.col("cut.key")) & (_point() < F.col("cut")))
    clear = known.filter(~at_cut & ~at_fill).withColumn("times", F.col("epochs") + F.when(F.col("cut").isNull() | before_cut, 1).otherwise(0))
    due = F.when(at_cut, F.col("cut_copies")).otherwise(0) + F.when(at_fill, 1).otherwise(0)
    # rows with one point are alike: they are numbered within each task's part, and behind the parts before it
    edge = written(known.filter(at_cut | at_fill).withColumn("due", due).withColumn("g", F.struct("src", at_cut.alias("c"))).withColumn("part", F.spark_partition_id()), "edge")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = edge.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c")).select(F.col("g").alias("pg"), F.col("part").alias("pp"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("g", "part").orderBy("size")) - 1
    edge = edge.withColumn("nth", nth).join(parts, F.col("g").eqNullSafe(F.col("pg")) & (F.col("part") == F.col("pp")))
    edge = edge.withColumn("times", F.col("epochs") + F.when(F.col("base") + F.col("nth") < F.col("due"), 1).otherwise(0))
    return clear.unionByName(edge.select(clear.columns)).withColumn("times", F.col("times").cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, int] | None = None, size_expr: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``<id>, size, source, source_size, target, taken, times``.

    ``size`` counts the words of the whole text (null: 0), ``times`` says how
    often the mix takes the row and ``taken`` is their product. Null sources are
    one source. Rows of size 0 are taken once for each whole epoch and with the
    rows before the cut. Rows that repeat id and size have one point: each counts, and as many of
    them are taken as fit. Null ids have one key. An empty table gives an empty result;
    if all sizes are 0, all targets are 0 and nothing is taken. There may be any number of sources.
    """
    rows = written(docs.select(*_keyed(id_col, text_col, source_col, size_expr)), "mix")
    return _times(rows, _decide(rows, weights)).select(
        F.col("id").alias(id_col), "size", F.col("s").alias("source"), "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times",
    )


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, int] | None = None, size_expr: str | None = None) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with all their columns.

    The decision on a row follows from its source's plan, so that texts aren't shuffled, but for
    those of rows with the point of a cut or of a fill.
    """
    plan = _decide(written(docs.select(*_keyed(id_col, text_col, source_col, size_expr)), "mix"), weights)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keyed(id_col, text_col, source_col, size_expr))
    return _times(keyed, plan).withColumn("n", F.col("times").cast("int")).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
