"""Draining, prefetching and measuring: what is left of execution control where Spark schedules."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from rowtide.streaming.runner import shared_dir


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: iterations neither grow its plan nor compute it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drain(df: DataFrame, daemon: bool = False) -> threading.Thread | None:
    """Compute all rows and keep none; with ``daemon`` in a thread of its own, which is returned."""
    sink = lambda: df.write.format("noop").mode("overwrite").save()
    if not daemon:
        sink()
        return None
    thread = threading.Thread(target=sink, daemon=True)
    thread.start()
    return thread


def prefetched(df: DataFrame) -> Iterator[Row]:
    """Rows on the driver, a partition at a time, the next one computed meanwhile; order and errors are kept."""
    return df.toLocalIterator(prefetchPartitions=True)


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and metrics (the number of rows at least) that an action on it leaves in the observation."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *metrics), watch


@contextlib.contextmanager
def timer(report: Callable[[int], None] = lambda ns: print(f"{ns / 1e9:.3f} s")) -> Iterator[None]:
    """Call report with the nanoseconds that a block took, also if it fails."""
    began = time.perf_counter_ns()
    try:
        yield
    finally:
        report(time.perf_counter_ns() - began)


def sampled(df: DataFrame, share: float, seed: int) -> DataFrame:
    """A sample that is the same whenever rows and their partitions are."""
    return df.sample(fraction=share, seed=seed)
