import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.operators import batching, caching, folding, mapping, multicast, running, scope, tree

T0 = datetime(2024, 1, 1)


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_compute_once(rows, spark):
    tokens = [random.Random(1).choice([*range(20), None]) for _ in range(60)]
    requests = rows([(i, t) for i, t in enumerate(tokens)], "ord long, token long")
    seen = spark.sparkContext.accumulator(0)

    def compute(keys):
        def run(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf[["token"]].assign(y=pdf["token"].fillna(-1) * 2)

        return keys.mapInPandas(run, "token long, y double")

    found = caching.compute_once(requests, "token", compute)
    assert column(found, "y", "ord") == [-2.0 if t is None else t * 2.0 for t in tokens]
    assert seen.value == len(set(tokens))
    known = rows([(3, 100.0), (None, 7.0)], "token long, y double")
    found = caching.compute_once(requests, "token", compute, known)
    assert column(found, "y", "ord") == [7.0 if t is None else 100.0 if t == 3 else t * 2.0 for t in tokens]


def test_compute_once_last_request_stands(rows):
    requests = rows([(0, "k", 1), (1, "k", 2)], "ord long, key string, v long")
    found = caching.compute_once(requests, "key", lambda r: r.withColumn("y", F.col("v") * 10), order_by="ord")
    assert column(found, "y", "ord") == [20, 20]


def test_wrong_length_fails(rows):
    df = rows([(1,), (2,)], "x long").coalesce(1)
    with pytest.raises(Exception, match="length"):
        df.select(mapping.map_column(lambda x: x[:1], "x", returns="long")).collect()


def model(trace, count, policy):
    held, hits = [], []
    for k in trace:
        hits.append(k in held)
        if k in held:
            held.remove(k)
            held.append(k)
        elif len(held) < count or policy:
            if len(held) >= count:
                held.pop(0 if policy == "lru" else -1)
            held.append(k)
    return hits


@pytest.mark.parametrize("policy", [None, "lru", "mru"])
def test_replay(rows, policy):
    trace = [random.Random(2).randrange(12) for _ in range(1)] + [random.Random(i).randrange(12) for i in range(300)]
    df = rows([(i, k) for i, k in enumerate(trace)], "ord long, k long")
    assert column(caching.replay(df, "k", "ord", count=5, policy=policy), "hit", "ord") == model(trace, 5, policy)
    if policy is None:
        assert column(caching.first_come_hits(df, "k", "ord", 5), "hit", "ord") == model(trace, 5, None)


def test_cache_bounds():
    cache = caching.CacheModel(nbytes=10, policy="lru")
    assert [cache.access(k, size=s) for k, s in (("a", 4), ("b", 4), ("c", 11), ("a", 4), ("d", 4), ("b", 4), ("a", 4))] == [False, False, False, True, False, False, False]
    with pytest.raises(ValueError):
        caching.CacheModel(count=3, nbytes=0)
    with pytest.raises(ValueError):
        caching.CacheModel(count=3, policy="fifo")
    cache = caching.CacheModel(ttl=2)
    assert [cache.access("a", t) for t in (0, 1.9, 3.8, 5.8)] == [False, True, True, False]


def test_ttl_and_generations(rows):
    times = [T0, T0 + timedelta(seconds=10) - timedelta(microseconds=1), T0 + timedelta(seconds=20) - timedelta(microseconds=1)]
    df = rows([("k", t) for t in times], "k string, ts timestamp")
    assert column(caching.ttl_hits(df, "k", "ts", 10), "hit", "ts") == [False, True, False]
    assert column(caching.reuse_generations(df, "ts", 10, ["k"]), "generation", "ts") == [0, 0, 1]
    half = rows([("k", T0), ("k", T0 + timedelta(seconds=5))], "k string, ts timestamp")
    assert column(caching.reuse_generations(half, "ts", 10, ["k"]), "generation", "ts") == [0, 0]


def test_batches(rows):
    df = rows([(i, float(i), 0) for i in range(8)], "ord long, v double, p long")
    assert column(batching.batches_by_count(df, 3, "ord", ["p"]), "batch", "ord") == [0, 0, 0, 1, 1, 1, 2, 2]
    assert column(batching.batches_by_cut(df, batching.usable_by_weight(7), "v", "ord", ["p"]), "batch", "ord") == [0, 0, 0, 0, 1, 2, 3, 4]
    times = rows([(0, T0 + timedelta(seconds=s)) for s in (0, 1, 9, 10, 11, 12, 30)], "p long, ts timestamp")
    assert column(batching.batches_by_timeout(times, 3, 10, "ts", ["p"]), "batch", "ts") == [0, 0, 0, 1, 1, 1, 2]
    assert column(batching.batches_by_timeout(times, 0, 10, "ts", ["p"]), "batch", "ts") == [0, 0, 0, 1, 1, 1, 2]


def test_maps(rows):
    df = rows([(i, i) for i in range(10)], "ord long, x long")
    double = lambda p: pd.DataFrame({"ord": p["ord"], "y": p["x"] * 2})
    assert [r["y"] for r in mapping.map_rows(df, double, "ord long, y long", order_by="ord").collect()] == [2 * i for i in range(10)]
    assert sorted(r["y"] for r in mapping.map_rows(df, double, "ord long, y long").collect()) == [2 * i for i in range(10)]

    async def triple(row):
        return row[1] * 3

    assert column(mapping.map_async(df, triple, "y", T.LongType(), limit=2), "y", "ord") == [3 * i for i in range(10)]

    async def fail(row):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        mapping.map_async(df, fail, "y", T.LongType()).collect()


def test_split_results(rows):
    df = rows([(i,) for i in range(4)], "k long").select("k", mapping.as_result(F.col("k"), F.when(F.col("k") > 1, "big")).alias("r"))
    ok, errors = mapping.split_results(df, "k", "r")
    assert sorted(map(tuple, ok.collect())) == [(0, 0), (1, 1)] and [tuple(r) for r in errors.collect()] == [("big", 2)]


def test_multicast(rows, spark):
    log = rows([(0, 0), (1, 1)], "ord long, v long")
    readers = spark.createDataFrame([("a", 0), ("b", 0), ("late", 1)], "reader string, pos long")
    seen = multicast.replay_from(log, readers, "ord").groupBy("reader").agg(F.sort_array(F.collect_list("v")).alias("v"))
    assert {r["reader"]: r["v"] for r in seen.collect()} == {"a": [0, 1], "b": [0, 1], "late": [1]}
    assert sorted(map(tuple, multicast.lag_of(log, readers, "ord").collect())) == [("a", 2, 2), ("b", 2, 2), ("late", 1, 2)]


def test_scope(rows, spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("outer"), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)).alias("inner"))
    assert df.select(scope.merge_maps("outer", "inner")).first()[0] == {"a": 1, "b": 3}
    settings = rows([(0, "a", 1), (1, "a", 2), (1, "b", 3)], "level int, key string, val long")
    assert sorted(map(tuple, scope.resolve(settings).collect())) == [("a", 1), ("b", 3)]
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with scope.scoped(spark, spark__sql__shuffle__partitions="5"):
        with scope.scoped(spark, spark__sql__shuffle__partitions="6"):
            assert spark.conf.get(name) == "5"
    assert spark.conf.get(name) == before


def test_tree(rows):
    df = rows([(1, 1, 10), (2, 1, 5), (3, 1, 1), (4, 2, 2), (5, 4, 3)], "id long, parent long, v long")
    totals = {r["id"]: (r["depth"], r["n_nodes"], r["v"]) for r in tree.subtree_totals(df, "id", "parent", "v").collect()}
    assert totals == {1: (0, 5, 21), 2: (1, 3, 10), 3: (1, 1, 1), 4: (2, 2, 5), 5: (3, 1, 3)}
    assert {r["id"]: r["path"] for r in tree.paths(df, "id", "parent").collect()}[5] == "1/2/4/5"


def test_deep_tree(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(1000)], "id long, parent long, v long")
    totals = {r["id"]: (r["depth"], r["n_nodes"], r["v"]) for r in tree.subtree_totals(chain, "id", "parent", "v").collect()}
    assert totals == {i: (i, 1000 - i, 1000 - i) for i in range(1000)}


def test_cycle(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 4)], "id long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        tree.ancestors(nodes, "id", "parent")


@pytest.fixture
def tiny_batches(spark):
    """Arrow batches of three rows, so that keys and waiting rows cross them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def test_fold_over_batches(rows, tiny_batches):
    r = random.Random(7)
    data = [(i, r.choice(["a", "b", None, "d"]), float(r.randrange(1, 9))) for i in range(97)]
    df = rows(data, "ord long, p string, v double")
    got = {x["ord"]: x["batch"] for x in batching.batches_by_cut(df, batching.usable_by_weight(20.0), "v", "ord", ["p"]).collect()}
    want = {}
    for p in {x[1] for x in data}:
        number, held = 0, []
        for i, _, v in (x for x in data if x[1] == p):
            held.append(v)
            if sum(held) >= 20 and len(held) > 1:
                number, held = number + 1, [v]
            want[i] = number
    assert got == want
    counted = folding.fold_rows(df, ["p"], "ord", list, lambda seen, part: [seen.append(v) or len(seen) for v in part["v"]], "n", T.LongType())
    want = {i: sum(x[1] == p and x[0] <= i for x in data) for i, p, _ in data}
    assert {x["ord"]: x["n"] for x in counted.collect()} == want
    assert folding.fold_rows(df.limit(0), ["p"], "ord", list, lambda seen, part: [0] * len(part), "n", T.LongType()).count() == 0
    clash = df.withColumn("__position", F.col("ord") + 1)
    assert all(x["__position"] == x["ord"] + 1 for x in folding.fold_rows(clash, ["p"], "ord", list, lambda seen, part: [0] * len(part), "n", T.LongType()).collect())


def test_ema_and_mangle_nulls(rows):
    r = random.Random(3)
    data = [(i, i % 3, r.uniform(-5, 5)) for i in range(200)]
    got = {x["p"]: x["ema"] for x in running.ema(rows(data, "ord long, p long, v double"), "v", "ord", ["p"]).collect()}
    for p in range(3):
        want = None
        for _, _, v in (x for x in data if x[1] == p):
            want = v if want is None else 0.8 * want + 0.2 * v
        assert abs(got[p] - want) < 1e-12
    assert running.ema(rows([(0, 0, 1.0), (1, 0, None)], "ord long, p long, v double"), "v", "ord", ["p"]).first()["ema"] is None
    names = rows([(0, None), (1, "x"), (2, None), (3, "x")], "ord long, n string")
    assert column(running.mangle(names, "n", "ord"), "mangled", "ord") == [None, "x", None, "x:1"]


def test_fold_groups(rows, tiny_batches):
    data = [(i % 5 or None, float(i)) for i in range(100)]
    found = mapping.fold_groups(rows(data, "k long, v double"), "k", "v", lambda x: [x.max(), x.min()], lambda a, b: [max(a[0], b[0]), min(a[1], b[1])], lambda s: s[0] - s[1], "double", most_keys=2)
    assert {x["k"]: x["result"] for x in found.collect()} == {k: 95.0 for k in (None, 1, 2, 3, 4)}


def test_expand(rows):
    found = mapping.expand(rows([(0, None), (1, 2), (2, 3)], "id long, n long"), lambda n: ((k,) for k in range(n or 0)), "n", returns="k bigint")
    assert sorted(map(tuple, found.collect())) == [(1, 2, 0), (1, 2, 1), (2, 3, 0), (2, 3, 1), (2, 3, 2)]


def test_outline_and_memory(rows):
    nodes = rows([(1, 0, "init x"), (2, 1, "a"), (5, 1, "b"), (7, 2, "c"), (3, 1, None)], "pid long, ppid long, cmd string")
    found = tree.outline(nodes.withColumn("ppid", F.when(F.col("ppid") > 0, F.col("ppid"))), "pid", "ppid", "cmd", 4)
    assert [(x["line"], x["label"]) for x in found.orderBy("path").collect()] == [(" 1", "init"), ("- 5", "b"), ("- 3", None), ("- 2", "a"), ("-- 7", "c")]
    lines = rows([(1, t) for t in ("Rss:   12 kB", "Pss: 8 kB", "Private_Clean: 1 kB", "Private_Dirty: 2 kB", "Shared_Dirty: 9 kB", "Rss: x kB", "7f00 rw-p", None)], "pid long, text string")
    assert tuple(tree.memory_totals(lines, "pid", "text").first()) == (1, 12288, 8192, 3072, 9216, 5120)
