"""Queries of caching, batching, mapping and scope operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.operators import batching, caching, mapping, multicast, scope, tree
from rowtide.plans.registry import query, table


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, (l_partkey * l_partkey + 11) % 97 as score from lineitem")
def compute_once(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    score = F.pandas_udf(lambda k: (k * k + 11) % 97, "long")
    found = caching.compute_once(lines, "l_partkey", lambda keys: keys.withColumn("score", score("l_partkey")))
    return found.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "score")


@query("select l_partkey, count(*) as n, cast(sum(case when l_partkey < 500 then -1 else (l_partkey * 7) % 13 end) as bigint) as total from lineitem group by l_partkey")
def compute_once_known(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_partkey")
    known = table(spark, sf_dir, "part", "p_partkey").where("p_partkey < 500").select(F.col("p_partkey").alias("l_partkey"), F.lit(-1).cast("long").alias("score"))
    found = caching.compute_once(lines, "l_partkey", lambda keys: keys.withColumn("score", (F.col("l_partkey") * 7) % 13), known)
    return found.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("""with f as (select user_id, min(event_id) as f from events group by user_id), r as (select user_id, f, row_number() over (order by f) as r from f)
    select event_id, coalesce(r <= 20 and event_id > f, false) as hit from events left join r using (user_id)""")
def cache_first_come(spark, sf_dir):
    return caching.first_come_hits(table(spark, sf_dir, "events", "event_id", "user_id"), "user_id", "event_id", 20).select("event_id", "hit")


_STACK = """with p as (select event_id, event_type, user_id, lag(event_id) over (partition by event_type, user_id order by event_id) as prev from events)
    select event_id, coalesce((select count(distinct b.user_id) from p b where b.event_type = p.event_type and b.event_id > p.prev and b.event_id < p.event_id) < 20 and prev is not null, false) as hit from p"""


@query(_STACK)
def cache_lru(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    return caching.lru_hits(events, "user_id", "event_id", 20, partition_by=["event_type"]).select("event_id", "hit")


def _trace(start: str, after: str, columns: str = "") -> str:
    """SQL for a cache of each event type as a recursion over its accesses: ``start`` is the list held after the
    first one, ``after`` that held after access e, given the list ``held`` before it."""
    return f"""with recursive e as (select event_id, event_type, user_id as k, {columns or "0"} as x, row_number() over (partition by event_type order by event_id) as r from events),
    b as (select event_id, event_type, r, false as hit, {start} as held from e where r = 1
    union all select e.event_id, e.event_type, e.r, {after} from b join e on e.event_type = b.event_type and e.r = b.r + 1) select event_id, hit from b"""


def _timed(full: str) -> str:
    """The recursion step of a cache of twenty keys whose items expire six hours after their last use."""
    alive = "list_filter(held, lambda h: h.at + 21600000000 > e.x)"
    at = f"list_position(list_transform({alive}, lambda h: h.k), e.k)"
    item = "[{'k': e.k, 'at': e.x}]"
    return f"{at} is not null, case when {at} is not null then list_filter({alive}, lambda h: h.k <> e.k) when len({alive}) >= 20 then {full.format(alive)} else {alive} end || {item}"


@query(_trace("[k]", "list_contains(held, e.k), case when list_contains(held, e.k) then list_filter(held, lambda h: h <> e.k) when len(held) >= 20 then held[1:len(held) - 1] else held end || [e.k]"))
def cache_mru(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    return caching.mru_hits(events, "user_id", "event_id", 20, partition_by=["event_type"]).select("event_id", "hit")


@query("select event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 43200000000, false) as hit from events")
def cache_ttl(spark, sf_dir):
    return caching.ttl_hits(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), "user_id", "ts", 12 * 3600).select("event_id", "hit")


@query(_trace("[{'k': k, 'at': x}]", _timed("({0})[2:]"), "epoch_us(ts)"))
def cache_ttl_lru(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "ts")
    return caching.replay(events, "user_id", "event_id", ["event_type"], ts="ts", count=20, policy="lru", ttl=6 * 3600.0).select("event_id", "hit")


@query(_trace("[{'k': k, 'at': x}]", _timed("({0})[1:len({0}) - 1]"), "epoch_us(ts)"))
def cache_ttl_mru(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "ts")
    return caching.replay(events, "user_id", "event_id", ["event_type"], ts="ts", count=20, policy="mru", ttl=6 * 3600.0).select("event_id", "hit")


_SIZES = "coalesce(list_sum(list_transform(held[i + 1:], lambda h: h.s)), 0) + e.x <= 500000"


@query(_trace("case when x <= 500000 then [{'k': k, 's': x}] else [] end", f"""list_contains(list_transform(held, lambda h: h.k), e.k), case when list_contains(list_transform(held, lambda h: h.k), e.k) then list_filter(held, lambda h: h.k <> e.k) || list_filter(held, lambda h: h.k = e.k)
    when e.x > 500000 then held else held[list_filter(range(0, len(held) + 1), lambda i: {_SIZES})[1] + 1:] || [{{'k': e.k, 's': e.x}}] end""", "cast(round_even(value * 100, 0) as bigint)"))
def cache_bytes(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "value").withColumn("cents", F.rint(F.col("value") * 100).cast("long"))
    return caching.replay(events, "user_id", "event_id", ["event_type"], size="cents", nbytes=500_000, policy="lru").select("event_id", "hit")


@query(f"select event_type, count(*) filter (hit) as hits, count(*) filter (not hit) as misses, count(*) as accesses from ({_STACK}) join events using (event_id) group by event_type")
def cache_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    return caching.hit_stats(caching.lru_hits(events, "user_id", "event_id", 20, partition_by=["event_type"]), "event_type")


@query("select event_id, cast(sum(case when gap >= 43200000000 then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as bigint) as generation from (select event_id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as gap from events)")
def reuse_generations(spark, sf_dir):
    return caching.reuse_generations(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), "ts", 12 * 3600, ["user_id"]).select("event_id", "generation")


@query("select event_id, (row_number() over (partition by user_id order by event_id) - 1) // 3 as batch from events")
def batch_count(spark, sf_dir):
    return batching.batches_by_count(table(spark, sf_dir, "events", "event_id", "user_id"), 3, "event_id", ["user_id"]).select("event_id", "batch")


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts) as r from events),
    b as (select event_id, user_id, r, 0::bigint as batch, 1 as held, t + 43200000000 as deadline from e where r = 1
    union all select e.event_id, e.user_id, e.r, case when held >= 3 or e.t >= deadline then batch + 1 else batch end, case when held >= 3 or e.t >= deadline then 1 else held + 1 end, case when held >= 3 or e.t >= deadline then e.t + 43200000000 else deadline end
    from b join e on e.user_id = b.user_id and e.r = b.r + 1) select event_id, batch from b""")
def batch_timeout(spark, sf_dir):
    return batching.batches_by_timeout(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), 3, 12 * 3600, "ts", ["user_id"]).select("event_id", "batch")


@query("""with recursive e as (select event_id, user_id, value as v, row_number() over (partition by user_id order by event_id) as r from events),
    b as (select event_id, user_id, r, 0::bigint as batch, v as held from e where r = 1
    union all select e.event_id, e.user_id, e.r, case when held + e.v >= 500 then batch + 1 else batch end, case when held + e.v >= 500 then e.v else held + e.v end
    from b join e on e.user_id = b.user_id and e.r = b.r + 1) select event_id, batch from b""")
def batch_weight(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    return batching.batches_by_cut(events, batching.usable_by_weight(500.0), "value", F.col("event_id").asc_nulls_last(), ["user_id"]).select("event_id", "batch")


@query("select reader, event_id from events join (values ('a', 0), ('b', 500), ('c', 9990)) r(reader, pos) on event_id >= pos")
def multicast_replay(spark, sf_dir):
    readers = spark.createDataFrame([("a", 0), ("b", 500), ("c", 9990)], "reader string, pos long")
    return multicast.replay_from(table(spark, sf_dir, "events", "event_id"), readers, "event_id").select("reader", "event_id")


@query("select reader, greatest(0, m + 1 - pos)::bigint as behind, greatest(pos, m + 1)::bigint as \"end\" from (values ('a', 0), ('b', 500), ('c', 200000)) r(reader, pos), (select max(event_id) as m from events)")
def multicast_lag(spark, sf_dir):
    readers = spark.createDataFrame([("a", 0), ("b", 500), ("c", 200_000)], "reader string, pos long")
    return multicast.lag_of(table(spark, sf_dir, "events", "event_id"), readers, "event_id")


@query("select o_orderkey, cast(round_even(o_totalprice * 3 / 7, 0) as bigint) as share from orders order by o_orderkey")
def map_rows_ordered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return mapping.map_rows(orders, lambda p: pd.DataFrame({"o_orderkey": p["o_orderkey"], "share": (p["o_totalprice"] * 3 / 7).round().astype("int64")}), "o_orderkey long, share long", order_by="o_orderkey")


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, cast(round_even(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100, 0) as bigint) as cents from lineitem")
def map_rows_multi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    cents = mapping.map_column(lambda p, d, t: (p * (1 - d) * (1 + t) * 100).round().astype("int64"), "l_extendedprice", "l_discount", "l_tax", returns="long")
    return lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), cents.alias("cents"))


@query("select c_custkey, c_custkey * 2 + c_nationkey as y from customer")
def map_async(spark, sf_dir):
    async def double(row):
        return row[0] * 2 + row[1]

    found = mapping.map_async(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), double, "y", T.LongType())
    return found.select("c_custkey", "y")


@query("select event_id, 'k=' || (cast(json_extract(props, '$.k') as bigint) + 1) as props from events")
def map_values(spark, sf_dir):
    from rowtide.functions.scalars import repr_map

    parsed = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", repr_map(mapping.map_values(parsed, lambda v: v + 1)).alias("props"))


_RESULT = "select event_id, case when event_id % 7 = 0 then 'divisible' end as error, event_id * 3 as value from events"


def _results(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id")
    return events.select("event_id", mapping.as_result(F.col("event_id") * 3, F.when(F.col("event_id") % 7 == 0, "divisible")).alias("r"))


@query(f"select event_id, value from ({_RESULT}) where error is null")
def split_results(spark, sf_dir):
    return mapping.split_results(_results(spark, sf_dir), "event_id", "r")[0]


@query(f"select error, count(*) as n from ({_RESULT}) where error is not null group by error")
def split_errors(spark, sf_dir):
    return mapping.split_results(_results(spark, sf_dir), "event_id", "r")[1]


@query("select n_name, case when n_nationkey % 3 = 0 then 'n' || n_nationkey else r_name end as label from nation join region on n_regionkey = r_regionkey")
def scope_merge(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    outer = F.when(F.col("n_nationkey") % 3 == 0, F.create_map(F.lit("label"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    inner = F.create_map(F.lit("label"), F.col("r_name"), F.lit("other"), F.lit("x"))
    both = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return both.select("n_name", scope.merge_maps(outer, inner)["label"].alias("label"))


@query("select key, val from (select c_mktsegment as key, c_custkey as val, row_number() over (partition by c_mktsegment order by c_custkey) as r from customer) where r = 1")
def scope_resolve(spark, sf_dir):
    settings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("level"), F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("val"))
    return scope.resolve(settings)


_TREE = """with recursive n as (select p_partkey as id, p_partkey // 2 as parent, p_size from part),
    a as (select id, id as anc, 0 as d from n union all select a.id, n.parent, d + 1 from a join n on n.id = a.anc where n.parent <> n.id)"""


@query(_TREE + " select anc as p_partkey, max(depth)::bigint as depth, count(*) as n_nodes, cast(sum(p_size) as bigint) as p_size from a join n on a.id = n.id join (select id as k, max(d) as depth from a group by id) on k = anc group by anc")
def tree_totals(spark, sf_dir):
    nodes = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("parent", F.expr("p_partkey div 2")).withColumn("p_size", F.col("p_size").cast("long"))
    return tree.subtree_totals(nodes, "p_partkey", "parent", "p_size").withColumn("depth", F.col("depth").cast("long"))


@query(_TREE + " select id as p_partkey, array_to_string(list(anc order by d desc), '/') as path from a group by id")
def tree_paths(spark, sf_dir):
    nodes = table(spark, sf_dir, "part", "p_partkey").withColumn("parent", F.expr("p_partkey div 2"))
    return tree.paths(nodes, "p_partkey", "parent")


@query("select l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) as mean from lineitem group by l_returnflag")
def udaf_fold(spark, sf_dir):
    import numpy as np

    found = mapping.fold_groups(
        table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", lambda x: [np.log(x).sum(), len(x)],
        lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: float(np.exp(s[0] / s[1])), "double", to="mean",
    )
    return found.withColumn("mean", F.round("mean", 4))


@query("select o_orderkey, k::bigint as k, o_orderkey * k as v from orders, range(o_orderkey % 4) r(k)")
def udtf_expand(spark, sf_dir):
    def multiples(key):
        for k in range(key % 4):
            yield k, key * k

    return mapping.expand(table(spark, sf_dir, "orders", "o_orderkey"), multiples, "o_orderkey", returns="k bigint, v bigint")


@query(_TREE + " select p_partkey, d::bigint as depth, repeat('-', d) || ' ' || p_partkey as line, substr(p_name, 1, 8) as label from part join (select id as p_partkey, max(d) as d from a group by id) using (p_partkey)")
def tree_outline(spark, sf_dir):
    nodes = table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("parent", F.expr("p_partkey div 2"))
    return tree.outline(nodes, "p_partkey", "parent", "p_name", 8).select("p_partkey", F.col("depth").cast("long").alias("depth"), "line", "label")


@query("""select l_orderkey, cast(sum(3 * q) * 1024 as bigint) as rss, cast(sum(2 * q) * 1024 as bigint) as pss, cast(sum(q) * 1024 as bigint) as uss, cast(sum(2 * q) * 1024 as bigint) as shared, cast(sum(q) * 1024 as bigint) as pshared
    from (select l_orderkey, cast(l_quantity as bigint) as q from lineitem) group by l_orderkey""")
def memory_totals(spark, sf_dir):
    size = F.col("l_quantity").cast("long")
    names = (("Rss", 3), ("Pss", 2), ("Private_Dirty", 1), ("Shared_Clean", 2), ("Swap", 5))
    texts = F.array(F.lit("00400000-00452000 r-xp"), *[F.format_string(f"{name}: %8d kB", size * k) for name, k in names])
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").select("l_orderkey", F.explode(texts).alias("text"))
    return tree.memory_totals(lines, "l_orderkey", "text")
