"""Running aggregates, names and numbers by appearance, and concurrency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.operators.sequence import _names, range_part


def _frame(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def cumsum(df: DataFrame, value: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), to: str = "cumsum", parts: int | None = None) -> DataFrame:
    """df with the running sum of a value.

    Without partition_by, sums run within ranges of the order and start at the total of the ranges before;
    one total for each range comes to the driver.
    """
    order = _names(order_by)
    if partition_by:
        return df.withColumn(to, F.sum(value).over(_frame(partition_by, order)))
    part, n = range_part(df, order, parts)
    rows = df.withColumn("__part", part)
    totals = dict(rows.groupBy("__part").agg(F.sum(value)).collect())
    starts, total = [], 0
    for i in range(n):
        starts.append(total)
        total += totals.get(i) or 0
    start = F.element_at(F.array(*map(F.lit, starts)), F.col("__part") + 1)
    return rows.withColumn(to, F.sum(value).over(_frame(["__part"], order)) + start).drop("__part")


def maximum_cumsum(df: DataFrame, value: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), to: str = "max_cumsum", parts: int | None = None) -> DataFrame:
    """df with the running maximum of the running sum; the first is the first value.

    Without partition_by, a range has a pair (sum, maximum prefix); pairs combine as (s1 + s2, max(m1, s1 + m2)).
    """
    order = _names(order_by)
    if partition_by:
        summed = df.withColumn("__sum", F.sum(value).over(_frame(partition_by, order)))
        return summed.withColumn(to, F.max("__sum").over(_frame(partition_by, order))).drop("__sum")
    part, n = range_part(df, order, parts)
    rows = df.withColumn("__part", part).withColumn("__sum", F.sum(value).over(_frame(["__part"], order)))
    pairs = {r[0]: (r[1], r[2]) for r in rows.groupBy("__part").agg(F.sum(value), F.max("__sum")).collect()}
    starts, tops, total, top = [], [], 0, None
    for i in range(n):
        starts.append(total), tops.append(top)
        if i in pairs and pairs[i][1] is not None:
            top = total + pairs[i][1] if top is None else max(top, total + pairs[i][1])
            total += pairs[i][0]
    kind = rows.schema["__sum"].dataType
    at = F.col("__part") + 1
    start = F.element_at(F.array(*[F.lit(s).cast(kind) for s in starts]), at)
    before = F.element_at(F.array(*[F.lit(t).cast(kind) for t in tops]), at)
    own = F.max("__sum").over(_frame(["__part"], order)) + start
    return rows.withColumn(to, F.greatest(own, before)).drop("__part", "__sum")


def running_counts(df: DataFrame, key: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), to: str = "n") -> DataFrame:
    """df with how often a row's key has come since the last null key of its partition; null for a null key."""
    order = _names(order_by)
    rows = cumsum(df.withColumn("__null", F.col(key).isNull().cast("long")), "__null", order, partition_by, "__epoch").drop("__null")
    n = F.count("*").over(_frame([*partition_by, "__epoch", key], order))
    return rows.withColumn(to, F.when(F.col(key).isNotNull(), n)).drop("__epoch")


def max_concurrency(df: DataFrame, start: str | Column, end: str | Column, partition_by: Sequence[str], to: str = "max_concurrency") -> DataFrame:
    """The most intervals [start, end) open at once in each partition, by a sweep over starts and ends."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    edges = df.select(*partition_by, F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*partition_by, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    open_ = steps.withColumn("open", F.sum("d").over(_frame(partition_by, ["t"])))
    return open_.groupBy(*partition_by).agg(F.max("open").alias(to))


def mangle(df: DataFrame, name: str, order_by: str | Sequence[str], to: str = "mangled") -> DataFrame:
    """df with names made unique: the k-th repeat of ``x`` is ``x:k``, the first stays bare, null stays null."""
    order = _names(order_by)
    apart = F.when(F.col(name).isNull(), F.xxhash64(*order))  # nulls need no numbers, so they are dealt out
    k = F.row_number().over(Window.partitionBy(name, apart).orderBy(*order)) - 1
    return df.withColumn(to, F.when(F.col(name).isNull(), F.lit(None)).when(k == 0, F.col(name)).otherwise(F.concat(name, F.lit(":"), k.cast("string"))))


def dense_ids(df: DataFrame, key: str, order_by: str, to: str = "id") -> DataFrame:
    """df with the number of its key by first appearance, from 0. The ranking runs over distinct keys only."""
    from rowtide.operators.sequence import ordinal

    first = df.groupBy(key).agg(F.min(order_by).alias("__first"))
    ids = ordinal(first, "__first", to).select(F.col(key).alias("__key"), to)
    return df.join(ids, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def ema(df: DataFrame, value: str, order_by: str, partition_by: Sequence[str], keep: float = 0.8, to: str = "ema") -> DataFrame:
    """A row for each partition with the exponential average of its values: keep * old + (1 - keep) * new, seeded by the first.
    Null if a value is null.

    The fold is a sum of weights by distance from the end, so no history is held, only numbered and added up.
    """
    x, back = F.col(value).cast("double"), F.col("__back")
    rows = df.withColumn("__back", F.row_number().over(Window.partitionBy(*partition_by).orderBy(F.col(order_by).desc())) - 1)
    total = F.sum(x * F.pow(F.lit(float(keep)), back)) * (1 - keep) + F.max_by(x, back) * F.pow(F.lit(float(keep)), F.count("*"))
    return rows.groupBy(*partition_by).agg(F.when(F.count(x) == F.count("*"), total).alias(to))
