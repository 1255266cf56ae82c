"""Snapshot lifecycle from a log of events: status, locks, reuse and active pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(log: DataFrame, key: str, status: str = "status", sequence: str = "seq") -> DataFrame:
    """The last status of each key: ``<key>, status, seq``."""
    return log.groupBy(key).agg(F.max_by(status, sequence).alias("status"), F.max(sequence).alias("seq"))


def last_of(log: DataFrame, key: str, sequence: str = "seq") -> DataFrame:
    """The last event of each key, such as ``pruned`` of a snapshot that was completed before."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("__r")).select(key, "__r.*")


def locked(log: DataFrame, repository: str, status: str = "status", sequence: str = "seq") -> DataFrame:
    """Repositories whose last status is ``indexing``: a new index request only sets their dirty flag."""
    return state(log, repository, status, sequence).filter("status = 'indexing'").select(repository)


def active(log: DataFrame, repository: str, snapshot: str, status: str = "status", sequence: str = "seq") -> DataFrame:
    """``<repository>, <snapshot>`` last completed, which readers see."""
    done = log.filter(F.col(status) == "completed")
    return done.groupBy(repository).agg(F.max_by(snapshot, sequence).alias(snapshot))


def reusable(log: DataFrame, repository: str, commit: str, snapshot: str, status: str = "status", sequence: str = "seq") -> DataFrame:
    """The newest completed snapshot of each commit, which an index request without force returns."""
    done = log.filter(F.col(status) == "completed")
    return done.groupBy(repository, commit).agg(F.max_by(snapshot, sequence).alias(snapshot))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, n`` for each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
