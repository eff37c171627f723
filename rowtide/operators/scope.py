"""Scoped settings: the outermost scope that names a key decides."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_maps(outer: Column | str, inner: Column | str) -> Column:
    """The outer map, and the entries of the inner one whose keys it lacks."""
    outer, inner = (F.col(c) if isinstance(c, str) else c for c in (outer, inner))
    return F.map_concat(outer, F.map_filter(inner, lambda k, _: ~F.map_contains_key(outer, k)))


def resolve(settings: DataFrame, level: str = "level", key: str = "key", value: str = "val") -> DataFrame:
    """key and value of the least level (outermost scope) that has the key."""
    return settings.groupBy(key).agg(F.min_by(value, level).alias(value))


@contextlib.contextmanager
def scoped(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for a block, by names with ``__`` for dots; a scope outside that set one keeps its say."""
    outer = getattr(spark, "_rowtide_scope", set())
    own = {k.replace("__", "."): v for k, v in settings.items() if k.replace("__", ".") not in outer}
    before = {k: spark.conf.get(k, None) for k in own}
    spark._rowtide_scope = outer | set(own)
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        spark._rowtide_scope = outer
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
