"""Queries of sequence, grouping and running operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import grouping, running, sequence
from rowtide.plans.registry import query, table



def cents():
    return F.rint(F.col("value") * 100).cast("long")


def signed():
    return F.when(F.col("event_type").isin("click", "view"), -cents()).otherwise(cents())


_SIGNED_SQL = "case when event_type in ('click', 'view') then -1 else 1 end * cast(round_even(value * 100, 0) as bigint)"


@query("select event_id, win from (select event_id, array_to_string(list(event_type) over w, ',') as win, count(*) over w as c from events window w as (order by event_id rows between current row and 3 following)) where c = 4")
def seq_windowed(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type")
    return sequence.windowed(events, 4, "event_id", "event_type").select("event_id", F.array_join("values", ",").alias("win"))


@query("select user_id, event_id, total from (select user_id, event_id, cast(sum(cast(round_even(value * 100, 0) as bigint)) over w as bigint) as total, count(*) over w as c from events window w as (partition by user_id order by event_id rows between current row and 2 following)) where c = 3")
def seq_windowed_by_key(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "user_id", "value").withColumn("cents", cents())
    found = sequence.windowed(events, 3, "event_id", "cents", partition_by=["user_id"])
    return found.select("user_id", "event_id", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("select vec_id, i, embedding[i + 1]::double as first_value, embedding[i + 60]::double as last_value from (select vec_id, embedding, unnest(range(0, 5)) as i from embeddings)")
def seq_windowed_array(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(sequence.array_windows("embedding", 60)).alias("i", "w"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.element_at("w", 1).cast("double").alias("first_value"), F.element_at("w", 60).cast("double").alias("last_value"))


@query("select chunk, array_to_string(list(event_type order by event_id), ',') as items from (select event_id, event_type, (row_number() over (order by event_id) - 1) // 7 as chunk from events) group by chunk")
def seq_chunked(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type")
    return sequence.chunked(events, 7, "event_id", "event_type", dense=True).select("chunk", F.array_join("values", ",").alias("items"))


@query("select chunk, count(*) as n, min(c_custkey) as first_key from (select c_custkey, (row_number() over (order by c_acctbal, c_custkey) - 1) // 100 as chunk from customer) group by chunk")
def seq_chunked_unkeyed(spark, sf_dir):
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return sequence.ichunked(rows, 100, ["c_acctbal", "c_custkey"], "c_custkey").groupBy("chunk").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("select (row_number() over (order by o_orderkey) - 1) // 10 as chunk, (row_number() over (order by o_orderkey) - 1) % 10 as pos, o_orderkey from orders")
def seq_ichunked(spark, sf_dir):
    return sequence.ichunked(table(spark, sf_dir, "orders", "o_orderkey"), 10, "o_orderkey", "o_orderkey")


@query("select vec_id, i as chunk, cast(least(10, 64 - i * 10) as bigint) as n, embedding[i * 10 + 1]::double as first_value from (select vec_id, embedding, unnest(range(0, 7)) as i from embeddings)")
def seq_chunked_array(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(sequence.array_chunks("embedding", 10)).alias("chunk", "w"))
    return rows.select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.size("w").cast("long").alias("n"), F.element_at("w", 1).cast("double").alias("first_value"))


@query("""select round, source, value from (
    select row_number() over (order by c_custkey) - 1 as round, 0::bigint as source, c_name as value from customer
    union all select row_number() over (order by s_suppkey) - 1, 1, s_name from supplier
    union all select row_number() over (order by p_partkey) - 1, 2, p_name from part) order by round, source""")
def seq_roundrobin(spark, sf_dir):
    frames = [table(spark, sf_dir, t, k, v) for t, k, v in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))]
    found = sequence.roundrobin(frames, ["c_custkey", "s_suppkey", "p_partkey"], ["c_name", "s_name", "p_name"])
    return found.select("round", F.col("source").cast("long").alias("source"), "value").orderBy("round", "source")


@query("select ord, o_orderkey, event_id from (select row_number() over (order by o_orderkey) - 1 as ord, o_orderkey from orders) join (select row_number() over (order by event_id) - 1 as ord, event_id from events) using (ord)")
def seq_zip(spark, sf_dir):
    return sequence.zip_rows([table(spark, sf_dir, "orders", "o_orderkey"), table(spark, sf_dir, "events", "event_id")], ["o_orderkey", "event_id"])


@query("select ord, a, b from (select row_number() over (order by c_custkey) - 1 as ord, c_name as a from customer) join (select row_number() over (order by c_acctbal, c_custkey) - 1 as ord, c_custkey as b from customer) using (ord)")
def seq_zip_strict(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    names, keys = rows.select("c_custkey", F.col("c_name").alias("a")), rows.select("c_acctbal", F.col("c_custkey").alias("b"))
    return sequence.zip_rows([names, keys], ["c_custkey", ["c_acctbal", "b"]], strict=True).select("ord", "a", "b")


@query("select doc_id, n_chars from documents order by doc_id limit 25")
def seq_limit(spark, sf_dir):
    return sequence.take(table(spark, sf_dir, "documents", "doc_id", "n_chars"), 25, "doc_id")


@query("select 7::bigint as value from range(12)")
def seq_repeat(spark, sf_dir):
    return sequence.repeat(spark, 7, 12).select(F.col("value").cast("long").alias("value"))


@query("select p_name, ch, count(*) as n from (select p_name, unnest(string_split(p_name, '')) as ch from part) group by all")
def seq_chars(spark, sf_dir):
    return sequence.characters(table(spark, sf_dir, "part", "p_name"), "p_name").groupBy("p_name", "ch").agg(F.count("*").alias("n"))


@query("select user_id, array_to_string(list(event_type order by event_id), ',') as items, min(event_id) as first from events group by user_id order by first")
def group_values(spark, sf_dir):
    found = grouping.group_values(table(spark, sf_dir, "events", "user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")
    return found.select("user_id", F.array_join("values", ",").alias("items"), "first").orderBy("first")


@query("select count(*) as n from lineitem")
def count_rows(spark, sf_dir):
    return grouping.count_rows(table(spark, sf_dir, "lineitem", "l_orderkey"))


@query("""select event_id, coalesce(k, '') as k, case when k is not null then count(*) over (partition by user_id, epoch, k order by event_id rows unbounded preceding) else 0 end as n from (
    select event_id, user_id, k, sum(case when k is null then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as epoch from (
    select event_id, user_id, nullif(event_type, 'purchase') as k from events))""")
def running_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", "user_id", F.expr("nullif(event_type, 'purchase')").alias("k"))
    return running.running_counts(events, "k", "event_id", ["user_id"]).select("event_id", F.coalesce("k", F.lit("")).alias("k"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"select event_id, cast(sum({_SIGNED_SQL}) over (order by event_id rows unbounded preceding) as bigint) as total from events")
def cumsum(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value").select("event_id", signed().alias("v"))
    return running.cumsum(events, "v", "event_id", to="total").select("event_id", "total")


@query(f"select event_id, cast(max(s) over (order by event_id rows unbounded preceding) as bigint) as top from (select event_id, sum({_SIGNED_SQL}) over (order by event_id rows unbounded preceding) as s from events)")
def max_cumsum(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value").select("event_id", signed().alias("v"))
    return running.maximum_cumsum(events, "v", "event_id", to="top").select("event_id", "top")


@query("select event_id, cast(max(s) over (partition by event_type order by event_id rows unbounded preceding) as bigint) as top from (select event_id, event_type, sum(case when event_id % 2 = 0 then -1 else 1 end * cast(round_even(value * 100, 0) as bigint)) over (partition by event_type order by event_id rows unbounded preceding) as s from events)")
def max_cumsum_by_key(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, -cents()).otherwise(cents()).alias("v"))
    return running.maximum_cumsum(events, "v", "event_id", ["event_type"], to="top").select("event_id", "top")


@query("""with edges as (select event_type, epoch_us(ts) as t, 1 as d from events union all select event_type, epoch_us(ts) + cast(round_even(value * 100, 0) as bigint) * 1000000, -1 from events),
    steps as (select event_type, t, sum(d) as d from edges group by all),
    run as (select event_type, sum(d) over (partition by event_type order by t rows unbounded preceding) as o from steps)
    select event_type, cast(max(o) as bigint) as max_concurrency from run group by event_type""")
def max_concurrency(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_type", "ts", "value").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return running.max_concurrency(events, F.col("t"), F.col("t") + cents() * 1_000_000, ["event_type"])


@query("""with t as (select l_partkey, cast(sum(cast(round_even(l_extendedprice * (1 - l_discount) * 100, 0) as bigint)) as bigint) as total from lineitem group by l_partkey),
    r as (select l_partkey, total, sum(total) over (order by total, l_partkey rows unbounded preceding) as running, sum(total) over () as everything from t)
    select l_partkey, total from t where total >= (select min(total) from r where running::double >= everything::double * 0.05::double)""")
def pareto_cut(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice", "l_discount")
    return grouping.pareto_cut(lines, "l_partkey", F.rint(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long"))


@query("select p_partkey, case when k = 0 then p_name else p_name || ':' || k end as mangled from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) - 1 as k from part)")
def mangle_names(spark, sf_dir):
    return running.mangle(table(spark, sf_dir, "part", "p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "mangled")


@query("select event_id, id from events join (select user_id, row_number() over (order by f) - 1 as id from (select user_id, min(event_id) as f from events group by user_id)) using (user_id)")
def dense_ids(spark, sf_dir):
    return running.dense_ids(table(spark, sf_dir, "events", "event_id", "user_id"), "user_id", "event_id").select("event_id", "id")


@query("select user_id, round(list_reduce(list(value order by event_id), lambda a, x: a * 0.8::double + x * 0.2::double), 6) as ema from events group by user_id")
def ema(spark, sf_dir):
    found = running.ema(table(spark, sf_dir, "events", "user_id", "event_id", "value"), "value", "event_id", ["user_id"])
    return found.select("user_id", F.round("ema", 6).alias("ema"))


@query("select o_orderpriority, count(*) as calls, cast(sum(c) as bigint) as busy, cast(sum(c % 1000) as bigint) as idle, round(avg(c), 4) as mean_busy from (select o_orderpriority, cast(round_even(o_totalprice * 100, 0) as bigint) as c from orders) group by o_orderpriority")
def call_profile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice").withColumn("busy", F.rint(F.col("o_totalprice") * 100).cast("long")).withColumn("idle", F.col("busy") % 1000)
    return grouping.profile(orders, "o_orderpriority", "busy", "idle").withColumn("mean_busy", F.round("mean_busy", 4))


@query("select l_returnflag, cast(sum(l_linenumber) as bigint) as lines, cast(sum(l_quantity) as bigint) as quantity from lineitem group by rollup (l_returnflag)")
def total_row(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber", "l_quantity").select("l_returnflag", F.col("l_linenumber").cast("long").alias("lines"), F.col("l_quantity").cast("long").alias("quantity"))
    return grouping.with_total(lines, "l_returnflag", "lines", "quantity")
