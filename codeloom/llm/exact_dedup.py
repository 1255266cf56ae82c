"""Exact dedup through an extendible-hash index in the shared folder.

Every text has a 64-bit key. A directory of ``2^g`` slots maps the first ``g``
bits of a key to a bucket; it starts with one bucket, and a bucket with more
distinct keys than its capacity splits on its next bit, doubling the directory
whenever the bucket was as deep as the directory. Buckets are grouped, in key
order, into one range of about equal bytes for each owner task. An owner
compares the bytes of the texts with equal keys, so that different texts with
one key chain up as separate entries, and writes its entries to its files.

Data flow: one narrow pass writes digests (id, key, length, SHA-256); from
their counts the driver lays out the directory (at most ``2^MAX_DEPTH`` slots, as
buckets hold more keys where there are more than ``2^MAX_DEPTH`` buckets could of ``CAPACITY``); one pass sends each
text once to its owner. Copies of hot keys, those with more than a part of a task's share of rows, are first collapsed
within the tasks that read them and under a salt, so that no task sees all copies of a hot text. A row
finds its entry through the directory: its slot gives the bucket, the bucket's entries with its key are compared by SHA-256.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hot_limit, join_counted, partitions, scratch_path, written

MAX_DEPTH = 20
CAPACITY = 1 << 16
SALTS = 64


def build_directory(counts: dict[int, tuple[int, int]], depth: int, capacity: int, owners: int) -> list[tuple[int, int, int, int]]:
    """Slots ``(prefix, bucket, local_depth, owner)`` of a directory over ``depth`` key bits.

    ``counts`` has the number of distinct keys and of bytes by ``depth``-bit
    prefix. A bucket that is still too full at ``depth`` stays so, as a chain of
    pages. Without any key there is one bucket.
    """
    keys = [0] * (1 << depth)
    size = [0] * (1 << depth)
    for prefix, (n, b) in counts.items():
        keys[prefix], size[prefix] = n, b
    sums = [0]
    for n in keys:
        sums.append(sums[-1] + n)
    global_depth = 0
    buckets = []  # (first slot, local depth)
    todo = [(0, 0)]
    while todo:
        first, local = todo.pop()
        span = 1 << (depth - local)
        if local < depth and sums[first + span] - sums[first] > capacity:
            global_depth = max(global_depth, local + 1)  # the directory doubles
            todo += [(first + span // 2, local + 1), (first, local + 1)]
        else:
            buckets.append((first, local))
    total = sum(size) or 1
    out, seen = [], 0
    for bucket, (first, local) in enumerate(sorted(buckets)):
        span = 1 << (depth - local)
        inside = sum(size[first : first + span])
        own = min(owners - 1, int((seen + inside / 2) * owners / total))
        seen += inside
        step = 1 << (depth - global_depth)
        out += [(slot // step, bucket, local, own) for slot in range(first, first + span, step)]
    return out


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The digests of all rows and the index over them, both as written tables.

    Digests: ``id, key, n_bytes, sha`` and the ``bucket`` of the key's slot. Index: ``owner, bucket, key, chain,
    n_bytes, sha, keep_id, group_size`` and, with ``carry``, ``row``, the whole
    row that stays. See ``exact_dedup`` for nulls, ties and empty tables.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    digests = written(base.select("id", F.xxhash64("t").alias("key"), F.octet_length("t").cast("long").alias("n_bytes"), F.unhex(F.sha2("t", 256)).alias("sha")), "digests")

    keys = written(digests.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("b")), "keys")
    total = digests.count()
    owners = partitions(spark)
    if capacity is None:
        capacity = max(min(CAPACITY, max(1, total // (8 * owners))), -(-total // (1 << (MAX_DEPTH - 3))))
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total) / capacity)) + 3))
    seen = keys.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).collect()  # at most 2^MAX_DEPTH rows
    slots = build_directory({r.prefix: (r.n, r.b) for r in seen}, depth, capacity, owners)
    global_depth = (len(slots) - 1).bit_length()
    directory = written(spark.createDataFrame(slots, T.StructType([T.StructField(c, T.IntegerType()) for c in ("prefix", "bucket", "local_depth", "owner")])).coalesce(1), "directory")
    slot = F.broadcast(directory.select("prefix", "bucket", "owner"))
    hot = written(keys.filter(F.col("n") > hot_limit(spark, total)).select("key"), "hot")

    def entry(grouped: GroupedData) -> DataFrame:
        last = [F.max_by("row", F.struct("keep_id")).alias("row")] if carry else []
        return grouped.agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), *last)

    cold = base.withColumn("key", F.xxhash64("t")).withColumn("n", F.lit(1).cast("long")).withColumnRenamed("id", "keep_id")
    if not hot.isEmpty():
        few = F.broadcast(hot)  # their number is bounded by that of the owners
        salted = entry(cold.join(few, "key", "left_semi").groupBy("key", "t", (F.spark_partition_id() % SALTS).alias("salt"))).drop("salt")
        cold = cold.join(few, "key", "left_anti").unionByName(salted)
    placed = cold.join(slot, _prefix(F.col("key"), global_depth) == F.col("prefix")).drop("prefix")
    owned = placed.repartitionById(owners, F.col("owner"))
    entries = entry(owned.groupBy("owner", "bucket", "key", "t"))
    chained = entries.select(
        "owner", "bucket", "key", F.octet_length("t").cast("long").alias("n_bytes"), F.unhex(F.sha2("t", 256)).alias("sha"),
        "keep_id", F.col("n").alias("group_size"), *(["row"] if carry else []),
    )
    if not carry:
        chained = chained.withColumn("chain", F.row_number().over(Window.partitionBy("owner", "bucket", "key").orderBy("n_bytes", "sha", "keep_id")))
    found = digests.join(slot, _prefix(F.col("key"), global_depth) == F.col("prefix")).drop("prefix", "owner")
    return found, written(chained, "index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``<id>, keep_id, group_size, kept, text_sha256, bucket, chain``.

    Of rows with equal texts the one with the largest id stays. A null text
    counts as the empty text, and empty texts are equal. A null id never stays
    unless all of the group are null (then ``keep_id`` is null). Rows that repeat
    both id and text are all marked ``kept`` together; ``exact_dedup_rows`` keeps
    one of them. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    digests, index = build_index(docs, id_col, text_col, capacity=capacity)
    found = index.select("bucket", "key", "sha", "keep_id", "group_size", "chain", F.col("group_size").alias("n"))
    out = join_counted(digests, found, ["bucket", "key", "sha"], digests.count())
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.col("bucket").cast("long").alias("bucket"), F.col("chain").cast("long").alias("chain"),
    )


def exact_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each set of equal texts the row with the largest id.

    Exactly one row stays for each text, also if rows repeat as a whole.
    """
    _, index = build_index(docs, id_col, text_col, carry=True, capacity=capacity)
    return index.select("row.*")
