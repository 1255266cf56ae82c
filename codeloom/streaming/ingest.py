"""Continuous ingest: files that land in a folder are parsed and added to the graph, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..chunking.files import parse_files, tables
from ..plans.store import Store

LANDED = "path string, size long, content binary, error string"


def ingest(spark: SparkSession, landing: str, root: str, checkpoint: str, snapshot: str) -> StreamingQuery:
    """A query over Parquet files (``LANDED``) in ``landing``; each batch is written under an id of its own, ``<snapshot>-<batch>``.

    A batch that runs again after a failure first removes what it wrote, so that
    each file is in the graph once. Its files are parsed once, into a staging table. When it is written, the batch becomes the active snapshot of the
    repository ``snapshot``.
    """
    store = Store(spark, root)

    def add(batch: DataFrame, number: int) -> None:
        name = f"{snapshot}-{number}"
        store.log(snapshot, name, name, "indexing")
        store.drop(name)
        staged = f"{store.root}/staging/{name}"
        parse_files(batch).write.mode("overwrite").parquet(staged)
        made = tables(spark.read.parquet(staged), name)
        store.add_contents(made.pop("contents"))
        for table, df in made.items():
            store.write(table, df)
        store._fs.delete(store._path(f"staging/{name}"), True)
        store.activate(snapshot, name, name, {"batch": number})

    stream = spark.readStream.schema(LANDED).parquet(landing)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
