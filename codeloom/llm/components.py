"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_scratch, join_counted, written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a long, b long``); a component is its smallest node.

    Each round links the larger neighbours of a node, then the smaller ones, to
    the smallest (Kiveris et al. 2014, "Connected Components in MapReduce and
    Beyond"); it ends when the edges are stars. Rounds grow with the logarithm of
    the longest path. A node that is the centre of many edges is only ever
    aggregated, never collected, and its edges aren't moved to be joined with its minimum.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    sign = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("sign")
    before = now.agg(F.count(F.lit(1)).alias("n"), sign).first()
    for _ in range(MAX_ROUNDS):
        if before.n == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).filter("n > 0"), "least")
        large = written(join_counted(both.filter("b > a"), least, ["a"], before.n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        least2 = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_counted(large, least2, ["a"], before.n).select("a", F.explode(F.array(F.struct("b"), F.struct(F.col("a").alias("b")))).alias("x"), "m").select(F.col("x.b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        after = written(small, "edges")
        for x in (now, least, large, least2):
            drop_scratch(x)
        now = after
        found = now.agg(F.count(F.lit(1)).alias("n"), sign).first()
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("components did not settle")
    return written(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components") if before.n else spark.createDataFrame([], "node long, component long")
