"""Spans around the engine's steps: names of Spark's jobs, and hooks that get each span's duration."""

from __future__ import annotations

import contextlib
import logging
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

LOG = logging.getLogger(__name__)
#: Called with a span's name, its seconds, its attributes and the error that ended it, or None.
HOOKS: list[Callable[[str, float, dict, BaseException | None], None]] = []


@contextlib.contextmanager
def span(spark: SparkSession, name: str, **about: object) -> Iterator[None]:
    """Name the jobs that run inside, and tell all hooks when they are done. A hook that fails is logged."""
    began, error = time.monotonic(), None
    spark.sparkContext.setJobDescription(" ".join([name, *map(str, about.values())]))
    try:
        yield
    except BaseException as e:
        error = e
        raise
    finally:
        spark.sparkContext.setJobDescription(None)
        for hook in HOOKS:
            try:
                hook(name, time.monotonic() - began, dict(about), error)
            except Exception:
                LOG.exception("a telemetry hook failed")
