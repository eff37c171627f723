"""Event-time operators: extensions beyond ordered sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, keys: Sequence[str], *aggs) -> DataFrame:
    """Aggregates by key and fixed windows of time; the start of the window in ``start``."""
    return df.groupBy(*keys, F.window(ts, width).alias("__w")).agg(*aggs).withColumn("start", F.col("__w.start")).drop("__w")


def sliding(df: DataFrame, ts: str, width: str, step: str, keys: Sequence[str], *aggs) -> DataFrame:
    """As tumbling, with windows of a width that begin every step."""
    return df.groupBy(*keys, F.window(ts, width, step).alias("__w")).agg(*aggs).withColumn("start", F.col("__w.start")).drop("__w")


def sessions(df: DataFrame, ts: str, gap_seconds: float, keys: Sequence[str], *aggs) -> DataFrame:
    """Aggregates by key and session: a pause of gap or more ends one. Sessions count from 0."""
    from rowtide.operators.caching import reuse_generations

    return reuse_generations(df, ts, gap_seconds, keys).groupBy(*keys, F.col("generation").alias("session")).agg(*aggs)


def asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with columns of the last right row of the same key at or before its time; one sort of both together."""
    item = lambda df, ts, side, own: df.select(*keys, F.col(ts).alias("__ts"), F.lit(side).alias("__side"), *own)
    a = left.select("*", F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"))
    b = item(right, right_ts, 0, [F.struct(*columns).alias("__r")])
    both = a.unionByName(b, allowMissingColumns=True)
    last = F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__r", last).where("__side = 1")
    return found.select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in columns])
