"""Navigation of the code graph: tables of nodes and edges, and joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema

#: Offsets of a file are joined by stretches of this length.
BUCKET = 4096


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node_id").alias(f"{name}_id"), F.col("file_path").alias("file"), F.col("start_line").alias("line"))


def incoming(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = schema.INCOMING, limit: int | None = 50) -> DataFrame:
    """Who refers to each target: ``target_id, source_id, file, line, relation, symbol``, the first ``limit`` of each by file and line."""
    found = edges.filter(F.col("relation_type").isin(*types)).join(_side(nodes, "source"), "source_id").select("target_id", "source_id", "file", "line", F.col("relation_type").alias("relation"), "symbol")
    return first_of(found, "target_id", ["file", "line", "source_id", "relation", "symbol"], limit)


def outgoing(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = schema.OUTGOING, limit: int | None = 50) -> DataFrame:
    """What each source refers to: ``source_id, target_id, file, line, relation, symbol``, the first ``limit`` of each."""
    found = edges.filter(F.col("relation_type").isin(*types)).join(_side(nodes, "target"), "target_id").select("source_id", "target_id", "file", "line", F.col("relation_type").alias("relation"), "symbol")
    return first_of(found, "source_id", ["file", "line", "target_id", "relation", "symbol"], limit)


def first_of(rows: DataFrame, group: str, order: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each group in a total order."""
    if limit is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= limit).drop("__n")


def parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, parent_id, file, line``: the first parent of each node that has any."""
    up = edges.filter(F.col("relation_type") == schema.PARENT).select(F.col("source_id").alias("node_id"), F.col("target_id").alias("parent_id"))
    found = up.join(_side(nodes, "parent"), "parent_id").select("node_id", "parent_id", "file", "line")
    return first_of(found, "node_id", ["parent_id"], 1)


def children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, child_id, file, line`` of all children."""
    down = edges.filter(F.col("relation_type") == schema.PARENT).select(F.col("target_id").alias("node_id"), F.col("source_id").alias("child_id"))
    return down.join(_side(nodes, "child"), "child_id").select("node_id", "child_id", "file", "line")


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing relations of the nodes that have a parent; a node without one has no answer."""
    return outgoing(edges, nodes).join(parents(edges, nodes).select(F.col("node_id").alias("source_id")), "source_id", "left_semi")


def context(edges: DataFrame, nodes: DataFrame, limit: int = 15) -> DataFrame:
    """Up to ``limit`` called or referenced nodes of each node, with their symbol or ``unknown``."""
    found = outgoing(edges, nodes, schema.CONTEXT, None).withColumn("symbol", F.coalesce("symbol", F.lit("unknown")))
    return first_of(found, "source_id", ["file", "line", "target_id", "symbol"], limit)


def neighbours(nodes: DataFrame, direction: str, of: DataFrame | None = None) -> DataFrame:
    """``node_id, neighbour_id`` of the next or previous chunk in each node's file, as of its lines.

    The next one is the first that begins at or behind the node's last line, the previous one the last that
    ends at or before its first line; ties by start, then id. ``of`` restricts the nodes asked for (by ``node_id``).
    """
    if direction not in ("next", "prev"):
        raise ValueError(f"direction must be 'next' or 'prev', not {direction!r}")
    line, limit = ("start_line", "end_line") if direction == "next" else ("end_line", "start_line")
    turn = F.desc if direction == "next" else F.asc
    order = [turn("line"), turn("start"), turn("id")]
    chunk = nodes.select("file_id", F.col(line).alias("line"), "start", F.col("node_id").alias("id"))
    asked = nodes if of is None else nodes.join(of.select("node_id"), "node_id", "left_semi")
    if of is not None:
        chunk = chunk.join(asked.select("file_id").distinct(), "file_id", "left_semi")
    # the candidate behind each one, for a chunk whose nearest candidate is itself
    chunk = chunk.withColumn("found", F.struct("id", F.lag("id").over(Window.partitionBy("file_id").orderBy(*order)).alias("other"))).withColumn("ask", F.lit(0))
    ask = asked.select("file_id", F.col(limit).alias("line"), "start", F.col("node_id").alias("id"), F.lit(None).cast(chunk.schema["found"].dataType).alias("found"), F.lit(1).alias("ask"))
    # one sort of each file: going towards the chunk asked for, the last candidate passed is the nearest
    passed = Window.partitionBy("file_id").orderBy(turn("line"), "ask", turn("start"), turn("id")).rowsBetween(Window.unboundedPreceding, 0)
    near = chunk.unionByName(ask).withColumn("near", F.last("found", ignorenulls=True).over(passed)).filter("ask = 1")
    found = F.when(F.col("near.id") == F.col("id"), F.col("near.other")).otherwise(F.col("near.id"))
    return near.select(F.col("id").alias("node_id"), found.alias("neighbour_id")).filter("neighbour_id is not null")


def around(edges: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The nodes that neighbours, parents and relations of a bounded number of nodes (``of``, by ``node_id``) can lead to: those of their files, and the targets of ``edges``, which are theirs."""
    own = nodes.join(F.broadcast(of.select("node_id")), "node_id", "left_semi")
    same = F.col("file_id").isin([r.file_id for r in own.select("file_id").distinct().collect()])  # as many as ``of`` has at most
    targets = edges.select(F.col("target_id").alias("node_id")).distinct()
    return nodes.filter(same).unionByName(nodes.filter(~same).join(F.broadcast(targets), "node_id", "left_semi"))


def enclosing(refs: DataFrame, nodes: DataFrame, tolerance: int = 1) -> DataFrame:
    """``ref, node_id``: the smallest node of the file that encloses each reference (``ref, path, start, end``), give or take ``tolerance``."""
    bucket = lambda x: F.floor(x / F.lit(BUCKET)).cast("long")
    n = nodes.select(F.col("file_path").alias("path"), "node_id", F.col("start").alias("a"), F.col("end").alias("b"))
    # a node lies in each stretch of its file that it touches, a reference in that of its start
    n = n.withColumn("bucket", F.explode(F.sequence(bucket(F.col("a") - tolerance), bucket(F.col("b") + tolerance))))
    hit = refs.withColumn("bucket", bucket(F.col("start"))).join(n, ["path", "bucket"]).filter((F.col("a") <= F.col("start") + tolerance) & (F.col("b") >= F.col("end") - tolerance))
    smallest = Window.partitionBy("ref").orderBy(F.col("b") - F.col("a"), "a", "node_id")
    return hit.withColumn("n", F.row_number().over(smallest)).filter("n = 1").select("ref", "node_id")


def resolve_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from relations between byte ranges: ``source_id, target_id, relation_type, symbol``.

    Relations have ``ref, source_path, source_start, source_end, target_path, target_start, target_end,
    relation_type, symbol, external``. An external target keeps its path as the id of a phantom node;
    relations without a source or target, and those of a node to itself, are dropped.
    """
    side = lambda s: relations.select("ref", F.col(f"{s}_path").alias("path"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end")).filter("path is not null and start is not null")
    source = enclosing(side("source"), nodes).withColumnRenamed("node_id", "source_id")
    target = enclosing(side("target").join(relations.filter("not external").select("ref"), "ref", "left_semi"), nodes).withColumnRenamed("node_id", "target_node")
    found = relations.join(source, "ref").join(target, "ref", "left")
    target_id = F.when(F.col("external"), F.col("target_path")).otherwise(F.col("target_node"))
    return found.withColumn("target_id", target_id).filter("target_id is not null and source_id <> target_id").select("source_id", "target_id", "relation_type", "symbol")


def external_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id`` of the phantom nodes: targets outside the snapshot, such as libraries, once each."""
    return edges.select(F.col("target_id").alias("node_id")).distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def with_external(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, file_path, start_line`` of all nodes and of phantom nodes, whose path is their id and whose line is null, so that navigation shows them."""
    own = nodes.select("node_id", "file_path", F.col("start_line").cast("int").alias("start_line"))
    return own.unionByName(external_nodes(edges, nodes).select("node_id", F.col("node_id").alias("file_path"), F.lit(None).cast("int").alias("start_line")))


def impact_graph(edges: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """``center_id, source, target, relation``: the first ``limit`` references to each node, as edges of its subgraph."""
    found = incoming(edges, nodes, limit=limit)
    return found.select(F.col("target_id").alias("center_id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation").distinct()


def pipeline_graph(edges: DataFrame, nodes: DataFrame, roots: DataFrame, max_depth: int = 2, fan_out: int = 10) -> DataFrame:
    """``center_id, source, target, relation``: the call tree below each root, with what occurs in it more than once a single time."""
    step = outgoing(edges, nodes, limit=fan_out).select(F.col("source_id").alias("at"), F.col("target_id").alias("target"), "relation").distinct()
    level = roots.select(F.col("node_id").alias("center_id"), F.col("node_id").alias("at"))
    out = None
    for _ in range(max_depth):
        made = level.join(step, "at").select("center_id", F.col("at").alias("source"), "target", "relation").distinct()
        out = made if out is None else out.unionByName(made)
        level = made.select("center_id", F.col("target").alias("at")).distinct()
    return out.distinct()


def neighbour_graph(edges: DataFrame, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``center_id, source, target, relation``: each node with the next and the previous chunk of its file and its first parent."""
    parts = [
        neighbours(nodes, "next", of).select(F.col("node_id").alias("center_id"), F.col("node_id").alias("source"), F.col("neighbour_id").alias("target"), F.lit("next").alias("relation")),
        neighbours(nodes, "prev", of).select(F.col("node_id").alias("center_id"), F.col("neighbour_id").alias("source"), F.col("node_id").alias("target"), F.lit("next").alias("relation")),
        parent_graph(edges if of is None else edges.join(of.select(F.col("node_id").alias("source_id")), "source_id", "left_semi"), nodes),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def parent_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``center_id, source, target, relation``: each node with its first parent."""
    return parents(edges, nodes).select(F.col("node_id").alias("center_id"), F.col("node_id").alias("source"), F.col("parent_id").alias("target"), F.lit(schema.PARENT).alias("relation"))


def subgraph_nodes(links: DataFrame, kind: str) -> DataFrame:
    """``center_id, node_id, type`` of the subgraphs with these edges; the center is ``center``, all others are ``kind``."""
    ends = links.select("center_id", F.explode(F.array("center_id", "source", "target")).alias("node_id")).distinct()
    return ends.withColumn("type", F.when(F.col("node_id") == F.col("center_id"), "center").otherwise(kind))


def ego(edges: DataFrame, nodes: DataFrame, center: Column) -> DataFrame:
    """``node_id, via`` around the nodes that fulfil ``center`` (over ``node_id``): itself, outgoing, incoming, parents and children, once for each way."""
    at = nodes.filter(center).select("node_id")
    s = edges.join(at.select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    t = edges.join(at.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    up = F.col("relation_type") == schema.PARENT
    parts = at.withColumn("via", F.lit("center"))
    for rows, col, via in ((s.filter(~up), "target_id", "outgoing"), (t.filter(~up), "source_id", "incoming"), (s.filter(up), "target_id", "parent"), (t.filter(up), "source_id", "child")):
        parts = parts.unionByName(rows.select(F.col(col).alias("node_id"), F.lit(via).alias("via")))
    return parts.distinct().join(nodes.select("node_id"), "node_id", "left_semi")


def call_tree(edges: DataFrame, nodes: DataFrame, roots: DataFrame, max_depth: int = 2, fan_out: int = 10) -> DataFrame:
    """``root_id, depth, path`` of all calls below ``roots`` (column ``node_id``), the first ``fan_out`` callees of each node; cycles end at ``max_depth``.

    One join for each level; ``path`` joins the nodes' ids by ``>``.
    """
    step = outgoing(edges, nodes, limit=fan_out).select(F.col("source_id").alias("at"), F.col("target_id").alias("next")).distinct()
    level = roots.select(F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), F.col("node_id").alias("path"), F.col("node_id").alias("at"))
    out = level
    for _ in range(max_depth):
        level = level.join(step, "at").select("root_id", (F.col("depth") + 1).alias("depth"), F.concat_ws(">", "path", "next").alias("path"), F.col("next").alias("at"))
        out = out.unionByName(level)
    return out.drop("at")
