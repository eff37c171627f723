"""Compute-once evaluation of keyed functions, and replays of cache policies over a trace of accesses."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.operators.folding import fold_rows
from rowtide.operators.sequence import _names


def compute_once(requests: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, order_by: str | None = None) -> DataFrame:
    """requests with the columns that ``compute`` adds to their keys; each distinct key is computed once.

    compute maps a DataFrame of distinct requests to one with the same key column and its results. ``known``
    holds results from before, in the same columns; its keys are not computed. With order_by the request of a
    key that comes last in that order stands for it. A null is a key.
    """
    if order_by is None:
        distinct = requests.select(key).distinct()
    else:
        columns = [c for c in requests.columns if c != key]
        distinct = requests.groupBy(key).agg(F.max_by(F.struct(*columns), order_by).alias("__r")).select(key, "__r.*")
    if known is not None:
        have = known.select(F.col(key).alias("__known"))
        distinct = distinct.join(have, F.col(key).eqNullSafe(F.col("__known")), "left_anti")
    results = compute(distinct)
    results = results.select(key, *[c for c in results.columns if c not in requests.columns])
    if known is not None:
        results = results.unionByName(known.select(*results.columns))
    results = results.withColumnRenamed(key, "__key")
    return requests.join(results, requests[key].eqNullSafe(results["__key"]), "left").drop("__key")


def first_come_hits(trace: DataFrame, key: str, order_by: str | Sequence[str], count: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """trace with ``hit``: a cache that takes the first ``count`` distinct keys and never evicts. Keys are ranked
    by first access, so the ranking runs over distinct keys only."""
    order = _names(order_by)
    keys = trace.groupBy(*partition_by, key).agg(F.min(F.struct(*order)).alias("__first"))
    if partition_by:
        taken = keys.withColumn("__rank", F.row_number().over(Window.partitionBy(*partition_by).orderBy("__first"))).where(F.col("__rank") <= count)
    else:
        taken = keys.orderBy("__first").limit(count)  # a top-k: each task sends its first ones only
    taken = taken.select(*[F.col(c).alias(f"__{c}") for c in (*partition_by, key)], "__first")
    same = None
    for c in (*partition_by, key):
        test = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = test if same is None else same & test
    out = trace.join(taken, same, "left").withColumn("hit", F.coalesce(F.struct(*order) > F.col("__first"), F.lit(False)))
    return out.select(*trace.columns, "hit")


def ttl_hits(trace: DataFrame, key: str, ts: str, ttl_seconds: float, partition_by: Sequence[str] = ()) -> DataFrame:
    """trace with ``hit``: less than ttl since the key's last access; an access at exactly ttl is a miss."""
    gap = _gap(ts, [*partition_by, key])
    return trace.withColumn("hit", F.coalesce(gap < ttl_seconds * 1_000_000, F.lit(False)))


def _gap(ts: str, keys: Sequence[str]):
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return micros - F.lag(micros).over(Window.partitionBy(*keys).orderBy(ts))


def reuse_generations(calls: DataFrame, ts: str, delay_seconds: float, partition_by: Sequence[str]) -> DataFrame:
    """calls with ``generation``: how often a resource that is dropped ``delay`` after its last use was rebuilt."""
    rebuilt = (F.coalesce(_gap(ts, partition_by), F.lit(0)) >= delay_seconds * 1_000_000).cast("int")
    frame = Window.partitionBy(*partition_by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("__new", rebuilt).withColumn("generation", F.sum("__new").over(frame)).drop("__new")


class CacheModel:
    """A cache of one policy: ``access`` tells whether a key is held, and takes it in if not.

    policy None never evicts, "lru" evicts the key used longest ago, "mru" the one used last. ``count`` bounds
    the number of keys, ``nbytes`` the sum of sizes (a larger item is refused), ``ttl`` the time since the last
    use; an item at exactly ttl has expired.
    """

    def __init__(self, count: float | None = None, nbytes: float | None = None, policy: str | None = None, ttl: float | None = None):
        if policy not in (None, "lru", "mru"):
            raise ValueError(f"unknown policy {policy!r}")
        if (count == 0) != (nbytes == 0) and None not in (count, nbytes):
            raise ValueError("a bound of zero needs the other to be zero")
        self.count, self.nbytes, self.policy, self.ttl = count, nbytes, policy, ttl
        self.held: OrderedDict = OrderedDict()
        self.size = 0.0

    def access(self, key, now: float = 0.0, size: float = 0.0) -> bool:
        if self.ttl is not None:
            for old in [k for k, (_, at) in self.held.items() if at + self.ttl <= now]:
                self.size -= self.held.pop(old)[0]
        if key in self.held:
            self.held[key] = (self.held[key][0], now)
            self.held.move_to_end(key)
            return True
        if self._room(size):
            self.held[key] = (size, now)
            self.size += size
        return False

    def _room(self, size: float) -> bool:
        full = lambda: self.count is not None and len(self.held) >= self.count or self.nbytes is not None and self.size + size > self.nbytes
        if self.nbytes is not None and size > self.nbytes or self.count is not None and self.count < 1:
            return False
        while full():
            if self.policy is None:
                return False
            self.size -= self.held.popitem(last=self.policy == "mru")[1][0]
        return True


def replay(trace: DataFrame, key: str, order_by: str, partition_by: Sequence[str] = (), ts: str | None = None, size: str | None = None, ttl: float | None = None, **bounds) -> DataFrame:
    """trace with ``hit`` under a CacheModel per partition; ttl is in seconds of ``ts``. A cache is one sequence of
    decisions, so each partition's trace is one task's work, which holds the cache and a batch of rows; without
    partition_by that is the whole trace."""
    helpers = {} if ts is None else {"__now": F.unix_micros(F.col(ts).cast("timestamp"))}
    bounds["ttl"] = None if ttl is None else ttl * 1_000_000

    def step(cache: CacheModel, rows: pd.DataFrame) -> list:
        now = rows["__now"].tolist() if ts is not None else [0] * len(rows)
        sizes = rows[size].tolist() if size is not None else [0] * len(rows)
        return [cache.access(*x) for x in zip(rows[key].tolist(), now, sizes)]

    return fold_rows(trace, partition_by, order_by, lambda: CacheModel(**bounds), step, "hit", T.BooleanType(), helpers=helpers)


def lru_hits(trace: DataFrame, key: str, order_by: str, count: int, **options) -> DataFrame:
    return replay(trace, key, order_by, count=count, policy="lru", **options)


def mru_hits(trace: DataFrame, key: str, order_by: str, count: int, **options) -> DataFrame:
    return replay(trace, key, order_by, count=count, policy="mru", **options)


def hit_stats(hits: DataFrame, *keys: str) -> DataFrame:
    """hits, misses and their sum."""
    return hits.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count("*").alias("accesses"))
