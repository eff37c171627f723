"""Grouping, counting and the share cut of a report."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def group_values(df: DataFrame, key: str, value: str, order_by: str) -> DataFrame:
    """key, values (in order) and first (the least order of the group): order by first for first-seen order.

    Equal keys merge wherever they are. Null keys are a group and null values stay. A group's values must fit
    in a row, as they do in any list.
    """
    item = F.struct(F.col(order_by).alias("o"), F.col(value).alias("v"))
    lists = df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("__items"), F.min(order_by).alias("first"))
    return lists.select(key, F.transform("__items", lambda x: x["v"]).alias("values"), "first")


def count_rows(df: DataFrame, to: str = "n") -> DataFrame:
    """The number of rows, whatever they hold."""
    return df.agg(F.count("*").alias(to))


def pareto_cut(df: DataFrame, key: str, weight: str | Column, share: float = 0.05, least: int = 5) -> DataFrame:
    """Keys whose total weight is at least the weight at which totals, added up from the smallest, reach a share
    of all; all keys if there are ``least`` or fewer.

    The running total over ranges of the totals has one number for each range on the driver; so has the cut.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    totals = df.groupBy(key).agg(F.sum(weight).alias("total"))
    n, everything = totals.agg(F.count("*"), F.sum("total")).first()
    if n <= least:
        return totals
    from rowtide.operators.running import cumsum

    running = cumsum(totals, "total", ["total", key], to="running")
    cut = running.where(F.col("running") >= F.lit(everything) * F.lit(share)).agg(F.min("total")).first()[0]
    return totals.where(F.col("total") >= cut)


def profile(df: DataFrame, key: str, busy: str, idle: str) -> DataFrame:
    """Calls, total busy and idle time and mean busy time of each key."""
    return df.groupBy(key).agg(F.count("*").alias("calls"), F.sum(busy).alias("busy"), F.sum(idle).alias("idle"), F.avg(busy).alias("mean_busy"))


def with_total(df: DataFrame, key: str, *sums: str) -> DataFrame:
    """Sums by key and a last row, with a null key, for all: grouping sets (key) and ()."""
    return df.rollup(key).agg(*[F.sum(c).alias(c) for c in sums])


