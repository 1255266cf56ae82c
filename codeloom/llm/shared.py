"""Scratch tables in the folder that all executors share.

Lineage is cut by writing a Parquet table there and reading it again, so that
the loss of an executor never loses a result that a later step needs.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    The setting is read from the session. Only in local mode (tests, one machine) a temporary
    folder is made and set where it is unset; on a cluster, whose executors wouldn't share it, that
    raises ``ValueError``. The folder is deleted when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="codeloom-")
            spark.sparkContext.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/codeloom-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[app] = root
    return _ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    conf = spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":")[-1] in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which a driver with little to do
    may not run for a long time.
    """
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if its rows are more than this part of what a task gets on average.
HOT_SHARE = 16


def hot_limit(spark: SparkSession, total: int) -> int:
    """The number of rows above which a key is hot. There are at most ``HOT_SHARE`` hot keys for each shuffle partition."""
    return max(total // (HOT_SHARE * partitions(spark)), 1000)


#: Copies of a wide line of a hot key, one for each salt.
SALTS = 64


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, n: str = "n", wide: bool = False) -> DataFrame:
    """The inner join of ``rows`` (``total`` in all) with ``table``, a written table of a line for each key whose number of rows is ``n``.

    Lines of hot keys are broadcast, of which the number of partitions bounds the number, so
    that their rows stay where they are; ``wide`` lines, such as texts, are copied under ``SALTS`` salts instead, and the rows of
    a key are spread over these. The others are joined by a shuffle. ``n`` is dropped.
    """
    limit = hot_limit(rows.sparkSession, total)
    hot = table.filter(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(table.drop(n).hint("shuffle_hash"), keys)
    few = F.broadcast(hot.select(*keys))
    cold = rows.join(few, keys, "left_anti").join(table.filter(F.col(n) <= limit).drop(n).hint("shuffle_hash"), keys)
    if not wide:
        return cold.unionByName(rows.join(F.broadcast(hot.drop(n)), keys))
    copies = hot.drop(n).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.join(few, keys, "left_semi").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return cold.unionByName(spread.join(copies, [*keys, "__salt"]).drop("__salt"))
