"""Tables that are derived once per application and read again, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, str] = {}


def _folder(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir``; in local mode a temporary one is set where that is unset, on a cluster that raises ``ValueError``. It goes with the application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/codeloom-tables-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def kept_path(spark: SparkSession, source: str, name: str, build: Callable[[str], None]) -> str:
    """The path of what ``build`` made of the files at ``source``: at first use, and again when those change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, source, changed, name)
    if key not in _KEPT:
        to = f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        build(to)
        _KEPT[key] = to
    return _KEPT[key]


def kept(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from the files at ``source``, written as ``kept_path`` says, in zstd."""
    return spark.read.parquet(kept_path(spark, source, name, lambda to: build().write.option("compression", "zstd").parquet(to)))
