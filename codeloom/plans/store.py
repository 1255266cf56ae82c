"""The graph's tables as Parquet below one folder, with snapshots as partitions.

Data is written first and never changed; a snapshot becomes visible when its
repository's pointer file is replaced, in one step. All files are reached through Hadoop's file
system, so the folder can lie on any storage that the cluster shares.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..operators.fts import SEGMENT, bucket_of

TABLES = {"files": schema.FILES, "nodes": schema.NODES, "edges": schema.EDGES, "embeddings": schema.EMBEDDINGS, "posting_lists": schema.POSTING_LISTS}
#: A lock that is older was left by a process that is gone.
LOCK_SECONDS = 6 * 3600
VERSION = 2


def content_bucket(chunk_hash: F.Column) -> F.Column:
    """The partition of a content: the first digit of its hash."""
    return F.substring(chunk_hash, 1, 1)


class Store:
    """Tables, repositories, pointers, locks and the lifecycle log below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # small files

    def _create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet; whether it was so."""
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError:
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _replace(self, name: str, text: str) -> None:
        """Put a file in the place of another in one step: readers see the old one or the new one."""
        fresh = f"{name}.{uuid.uuid4().hex}.tmp"
        self._create(fresh, text)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        where = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        where.rename(self._fs.makeQualified(self._path(fresh)), self._fs.makeQualified(self._path(name)), options)

    def _text(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if n.endswith(".json"))

    def migrate(self) -> int:
        """Bring an older store to ``VERSION``; its version before. A store that is newer raises ``ValueError``.

        Version 1 had contents in one folder, no postings and one log of all repositories: these are derived anew when
        snapshots are indexed again, so that only the contents move. Postings that a store of version 2 has as a row for each word of a node become lists.
        """
        found = int(self._text("version") or (1 if self._fs.exists(self._path("tables")) else VERSION))
        if found > VERSION:
            raise ValueError(f"the store has version {found}, this is {VERSION}")
        if found == 1 and self._fs.exists(self._path("tables/contents")):
            old, new = self._path("tables/contents"), self._path("tables/contents.v1")
            self._fs.rename(old, new)
            self.add_contents(self.spark.read.parquet(f"{self.root}/tables/contents.v1").select("chunk_hash", "content"))
            self._fs.delete(new, True)
        if self._fs.exists(self._path("tables/postings")):
            self._to_lists()
        self._replace("version", str(VERSION))
        return found

    def _to_lists(self) -> None:
        """Put postings with a row for each word of a node into segments of about half of ``SEGMENT`` nodes."""
        old, new, made = (self._path(f"tables/{x}") for x in ("postings", "posting_lists", "posting_lists.tmp"))
        if not self._fs.exists(new):  # else they were put in place before an interruption
            self._fs.delete(made, True)
            rows = self._read("postings", schema.POSTINGS)
            parts = max(1, -(-rows.select("snapshot_id", "node_id").distinct().count() * 2 // SEGMENT))
            rows = rows.withColumn("segment", F.xxhash64("snapshot_id", F.pmod(F.xxhash64("node_id"), F.lit(parts))))
            ids = rows.groupBy("snapshot_id", "segment").agg(F.sort_array(F.collect_set("node_id")).alias("ids"))
            at = rows.join(ids.select("snapshot_id", "segment", F.posexplode("ids").alias("at", "node_id")), ["snapshot_id", "segment", "node_id"])
            each = F.sort_array(F.collect_list(F.struct("at", F.col("tf").cast("int").alias("tf"))))
            lists = at.groupBy("snapshot_id", "segment", "term", "weight_class").agg(each.alias("each")).select("snapshot_id", "segment", "term", "weight_class", F.col("each.at").alias("at"), F.col("each.tf").alias("tf"))
            lists = lists.unionByName(ids.select("snapshot_id", "segment", F.lit("").alias("term"), F.lit("").alias("weight_class"), "ids"), allowMissingColumns=True)
            self.write("posting_lists", lists, "posting_lists.tmp")
            self._fs.rename(made, new)
        self._fs.delete(old, True)

    # locks

    def lock(self, repository: str, seconds: float = LOCK_SECONDS) -> bool:
        """Take a repository's lock, which only one caller gets; another sets its dirty flag instead. A lock that is older than ``seconds`` is taken over."""
        name, mine = f"locks/{repository}", json.dumps({"owner": self.spark.sparkContext.applicationId, "at": time.time()})
        if self._create(name, mine):
            return True
        held = self._text(name)
        if held is not None and time.time() - (json.loads(held)["at"] if held else 0) > seconds:
            stale = f"{name}.{uuid.uuid4().hex}.stale"
            if self._fs.rename(self._path(name), self._path(stale)):  # one caller only
                self._fs.delete(self._path(stale), False)
                if self._create(name, mine):
                    return True
        self._create(f"dirty/{repository}", "")
        return False

    def unlock(self, repository: str) -> None:
        self._fs.delete(self._path(f"locks/{repository}"), False)

    def take_dirty(self, repository: str) -> bool:
        """Whether the dirty flag was set; it is cleared."""
        return bool(self._fs.delete(self._path(f"dirty/{repository}"), False))

    # repositories and snapshots

    def register(self, repository: str, url: str, branch: str, name: str) -> None:
        """Insert a repository, or refresh the name of one that is there and keep when it was made."""
        known = self._text(f"repositories/{repository}.json")
        now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        made = json.loads(known)["created_at"] if known else now
        self._replace(f"repositories/{repository}.json", json.dumps({"id": repository, "url": url, "branch": branch, "name": name, "created_at": made, "updated_at": now}))

    def repositories(self) -> DataFrame:
        """All repositories, by url and branch."""
        if not self._names("repositories"):
            return self.spark.createDataFrame([], schema.REPOSITORIES)
        return self.spark.read.schema(schema.REPOSITORIES).option("pathGlobFilter", "*.json").json(f"{self.root}/repositories").orderBy("url", "branch")

    def log(self, repository: str, snapshot: str, commit: str | None, status: str, **more: object) -> None:
        """Append an event to the repository's lifecycle log; events are in order of time."""
        seq = time.time_ns()
        self._create(f"log/{repository}/{seq:020d}-{uuid.uuid4().hex[:8]}.json", json.dumps({"seq": seq, "repository": repository, "snapshot": snapshot, "commit": commit, "status": status, "at": seq / 1e9, **more}))

    def events(self, repository: str) -> list[dict]:
        """The log of one repository, in order."""
        return [json.loads(self._text(f"log/{repository}/{n}")) for n in self._names(f"log/{repository}")]

    def snapshots(self) -> DataFrame:
        """All snapshots with their last status, when they were begun and completed, and the statistics of their completion."""
        if not self._fs.exists(self._path("log")):
            return self.spark.createDataFrame([], schema.SNAPSHOTS)
        rows = self.spark.read.schema(schema.EVENTS).option("recursiveFileLookup", "true").json(f"{self.root}/log")
        at = lambda s, f: f(F.when(F.col("status") == s, F.timestamp_seconds("at")))
        done = rows.groupBy(F.col("snapshot").alias("id")).agg(
            F.max_by("repository", "seq").alias("repository_id"), F.max_by("commit", "seq").alias("commit_hash"), F.max_by("status", "seq").alias("status"),
            at("indexing", F.min).alias("created_at"), at("completed", F.max).alias("completed_at"), F.max_by("stats", F.when(F.col("status") == "completed", F.col("seq"))).alias("stats"),
        )
        return done.orderBy("created_at", "id")

    def completed(self, repository: str, commit: str) -> str | None:
        """The newest completed snapshot of a commit that wasn't pruned since."""
        last: dict[str, dict] = {}
        for e in self.events(repository):
            last[e["snapshot"]] = e
        done = [e for e in last.values() if (e["commit"], e["status"]) == (commit, "completed")]
        return max(done, key=lambda e: e["seq"])["snapshot"] if done else None

    def activate(self, repository: str, snapshot: str, commit: str | None, stats: dict) -> None:
        """Log a snapshot as completed and swap the repository's pointer, last."""
        self.log(repository, snapshot, commit, "completed", stats=json.dumps(stats))
        self._replace(f"pointers/{repository}", snapshot)

    def active(self, repository: str) -> str | None:
        return self._text(f"pointers/{repository}")

    def prune(self, repository: str, snapshot: str) -> None:
        """Log a snapshot as pruned, so that it is never returned again, and drop its partitions; shared contents stay (see ``operators.writes.unreferenced``)."""
        commits = [e["commit"] for e in self.events(repository) if e["snapshot"] == snapshot]
        self.log(repository, snapshot, commits[-1] if commits else None, "pruned")
        self.drop(snapshot)

    def drop(self, snapshot: str) -> None:
        """Drop a snapshot's partitions."""
        for name in TABLES:
            self._fs.delete(self._path(f"tables/{name}/snapshot_id={snapshot}"), True)

    # tables

    def write(self, name: str, df: DataFrame, folder: str | None = None) -> None:
        """Append rows (to ``folder`` in place of the table's own); those with a ``snapshot_id`` or ``bucket`` go to its partition."""
        by = [c for c in ("snapshot_id", "bucket") if c in df.columns]
        if name == "posting_lists":  # written where they are made, each file in order of terms
            by = ["snapshot_id", "bucket"]
            df = df.withColumn("bucket", bucket_of(F.col("term"))).sortWithinPartitions(*by, "term")
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/tables/{folder or name}")

    def add_contents(self, contents: DataFrame) -> None:
        """Append the contents whose hash isn't stored yet, each once.

        They are shuffled and sorted a single time, by the first two digits of their hash; of stored ones only the hashes are read.
        """
        rows = contents.select("chunk_hash", "content", F.lit(False).alias("known"))
        known = self.contents().select("chunk_hash", F.lit(None).cast("string").alias("content"), F.lit(True).alias("known"))
        digits = F.substring("chunk_hash", 1, 2).alias("digits")
        rows = rows.unionByName(known).select("*", content_bucket(F.col("chunk_hash")).alias("bucket"), digits).repartition("digits")
        once = rows.groupBy("bucket", "digits", "chunk_hash").agg(F.first("content", ignorenulls=True).alias("content"), F.max("known").alias("known"))
        self.write("contents", once.filter(~F.col("known")).select("chunk_hash", "content", "bucket"))

    def contents(self, hashes: list[str] | None = None) -> DataFrame:
        """All contents, or those of a bounded list of hashes, whose partitions alone are read."""
        df = self._read("contents", schema.CONTENTS)
        if hashes is not None:
            df = df.filter(F.col("bucket").isin(*sorted({h[:1] for h in hashes})) & F.col("chunk_hash").isin(*hashes)) if hashes else df.limit(0)
        return df.drop("bucket")

    def read(self, name: str, snapshot: str | None = None) -> DataFrame:
        """A table, or its rows of one snapshot (only its partition is read)."""
        kind = TABLES[name] if "snapshot_id" in TABLES[name].fieldNames() else StructType([*TABLES[name].fields]).add("snapshot_id", "string")
        df = self._read(name, kind)
        return df if snapshot is None else df.filter(F.col("snapshot_id") == snapshot)

    def _read(self, name: str, kind: StructType) -> DataFrame:
        if not self._fs.exists(self._path(f"tables/{name}")):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.root}/tables/{name}")
