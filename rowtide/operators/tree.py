"""Totals and paths over trees given as (id, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.operators.execution import settled


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, ancestor and distance, itself at 0 included; by pointer doubling, a join for each doubling of the
    depth, whatever it is. A root has a null parent or itself as parent. A cycle is an error."""
    up = nodes.select(F.col(node).alias("node"), F.when(F.col(parent) != F.col(node), F.col(parent)).alias("up"))
    most, length = nodes.count(), 1
    steps = [settled(up.where("up is not null"), "step")]
    while not steps[-1].isEmpty():
        if length > most:
            raise ValueError("the nodes have a cycle")
        x, y = steps[-1].alias("x"), steps[-1].alias("y")
        steps.append(settled(x.join(y, F.col("x.up") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.up").alias("up")), "step"))
        length *= 2
    pairs = settled(up.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")), "pairs")
    for k, step in enumerate(steps[:-1]):
        more = pairs.join(step.withColumnRenamed("node", "at"), F.col("ancestor") == F.col("at")).select("node", F.col("up").alias("ancestor"), (F.col("distance") + 2**k).alias("distance"))
        pairs = settled(pairs.union(more), "pairs")
    return pairs


def subtree_totals(nodes: DataFrame, node: str, parent: str, *sums: str) -> DataFrame:
    """For each node, its depth and the sums over itself and all below it."""
    pairs = ancestors(nodes, node, parent)
    level = pairs.groupBy("node").agg(F.max("distance").alias("depth"))
    below = pairs.join(nodes.withColumnRenamed(node, "__node"), F.col("node") == F.col("__node")).groupBy("ancestor").agg(F.count("*").alias("n_nodes"), *[F.sum(c).alias(c) for c in sums])
    return below.join(level, F.col("ancestor") == F.col("node")).select(F.col("ancestor").alias(node), "depth", "n_nodes", *sums)


def paths(nodes: DataFrame, node: str, parent: str, separator: str = "/") -> DataFrame:
    """node and the ids from its root to itself joined by a separator."""
    pairs = ancestors(nodes, node, parent)
    items = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("ancestor").cast("string").alias("a"))))
    return pairs.groupBy("node").agg(F.array_join(F.transform(items, lambda x: x["a"]), separator).alias("path")).withColumnRenamed("node", node)


def outline(nodes: DataFrame, node: str, parent: str, label: str, width: int = 80) -> DataFrame:
    """node, depth, ``line`` (a dash for each level, then the node), its label cut to a width, and ``path`` (an array):
    ordered by path, nodes come depth first, the last of several children before the others."""
    pairs = ancestors(nodes, node, parent)
    way = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), (-F.col("ancestor")).alias("a")))), lambda x: x["a"])
    lines = pairs.groupBy(F.col("node").alias("__node")).agg(F.max("distance").alias("depth"), way.alias("path"))
    line = F.concat(F.repeat(F.lit("-"), F.col("depth")), F.lit(" "), F.col(node).cast("string"))
    labels = nodes.select(node, F.substring(label, 1, width).alias("label"))
    return labels.join(lines, F.col(node) == F.col("__node")).select(node, "depth", line.alias("line"), "label", "path")


def memory_totals(lines: DataFrame, key: str, text: str) -> DataFrame:
    """rss, pss, uss, shared and pshared, in bytes, of each process from the lines ``Name: 12 kB`` of its memory maps:
    uss is what is private, pshared the rest of pss. Other lines count for nothing."""
    field = F.regexp_extract(text, r"^([A-Za-z_]+):\s*[0-9]+ kB\s*$", 1)
    size = F.regexp_extract(text, r"^[A-Za-z_]+:\s*([0-9]+) kB\s*$", 1).try_cast("long") * 1024
    total = lambda *names: F.coalesce(F.sum(F.when(field.isin(*names), size)), F.lit(0))
    sums = lines.groupBy(key).agg(total("Rss").alias("rss"), total("Pss").alias("pss"), total("Private_Clean", "Private_Dirty").alias("uss"), total("Shared_Clean", "Shared_Dirty").alias("shared"))
    return sums.withColumn("pshared", F.col("pss") - F.col("uss"))
