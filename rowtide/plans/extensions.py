"""Queries of event-time operators and sets of groupings: extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import events as ops
from rowtide.plans.registry import query, table


def _us():
    return F.unix_micros(F.col("start").cast("timestamp")).alias("start")


def _events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events", "event_id", "ts", *columns)


@query("select event_type, epoch_us(time_bucket(interval '1 day', ts)) as start, count(*) as n from events group by all")
def x_tumbling(spark, sf_dir):
    return ops.tumbling(_events(spark, sf_dir, "event_type"), "ts", "1 day", ["event_type"], F.count("*").alias("n")).select("event_type", _us(), "n")


@query("select event_type, epoch_us(time_bucket(interval '6 hours', ts)) - s * 21600000000 as start, count(*) as n from events, range(0, 4) r(s) group by all")
def x_sliding(spark, sf_dir):
    return ops.sliding(_events(spark, sf_dir, "event_type"), "ts", "1 day", "6 hours", ["event_type"], F.count("*").alias("n")).select("event_type", _us(), "n")


@query("select user_id, session, count(*) as n from (select user_id, cast(sum(case when gap >= 86400000000 then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as bigint) as session from (select user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as gap from events)) group by all")
def x_session(spark, sf_dir):
    return ops.sessions(_events(spark, sf_dir, "user_id"), "ts", 86400, ["user_id"], F.count("*").alias("n"))


@query("select a.event_id, coalesce(b.event_id, -1) as purchase_id from (select * from events where event_type <> 'purchase') a asof left join (select * from events where event_type = 'purchase') b on a.user_id = b.user_id and a.ts >= b.ts")
def x_asof(spark, sf_dir):
    events = _events(spark, sf_dir, "user_id", "event_type")
    left = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"))
    return ops.asof(left, right, "ts", "at", ["user_id"], ["purchase_id"]).select("event_id", F.coalesce("purchase_id", F.lit(-1)).alias("purchase_id"))


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def x_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def x_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
