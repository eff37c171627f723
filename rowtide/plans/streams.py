"""Queries of the streaming operators: each runs a stream over all files there are and gives the same rows as its
batch form."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from rowtide.plans.caches import batch_timeout, cache_ttl
from rowtide.plans.registry import ORACLES, query
from rowtide.plans.sequences import _SIGNED_SQL, signed
from rowtide.streaming import runner, state

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _events(spark, sf_dir):
    return runner.source(spark, f"{sf_dir}/events.parquet")


@query("select event_type, count(*) as n from events group by event_type")
def s_running_counts(spark, sf_dir):
    return runner.run_to_end(_events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query(f"select event_id, cast(max(s) over (partition by event_type order by event_id rows unbounded preceding) as bigint) as top from (select event_id, event_type, sum({_SIGNED_SQL}) over (partition by event_type order by event_id rows unbounded preceding) as s from events)")
def s_actor_top(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "event_type", signed().alias("v"))
    with _rocks(spark):
        return runner.run_to_end(state.with_state(rows, ["event_type"], state.RunningTop("event_id", ["event_id"], "top"), "event_id long, top long"))


@query(ORACLES[cache_ttl.__name__])
def s_ttl(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    with _rocks(spark):
        return runner.run_to_end(state.with_state(rows, ["user_id"], state.TimeToLive("t", ["event_id"], "hit", 12 * 3600 * 1e6), "event_id long, hit boolean"))


@query(ORACLES[batch_timeout.__name__])
def s_batches(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    with _rocks(spark):
        return runner.run_to_end(state.with_state(rows, ["user_id"], state.Batches("t", ["event_id"], "batch", 3, 12 * 3600 * 1e6), "event_id long, batch long"))


@query("select distinct event_type, user_id from events")
def s_dedupe(spark, sf_dir):
    return runner.run_to_end(_events(spark, sf_dir).select("event_type", "user_id").dropDuplicates(["event_type", "user_id"]))


@query("select epoch_us(time_bucket(interval '1 day', ts)) as start, event_type, count(*) as n from events group by all")
def s_tumbling(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", "1 hour")
    counts = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return runner.run_to_end(counts.select(F.unix_micros("window.start").alias("start"), "event_type", "n"), "complete")
