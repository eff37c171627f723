"""Operators on ordered sequences of rows and on array columns.

A DataFrame has no order, so every row operator takes ``order_by``, columns whose values together are unique.
Global positions come from ``ordinal``, which never gathers a sequence in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def range_part(df: DataFrame, order_by: str | Sequence[str], parts: int | None = None) -> tuple[Column, int]:
    """A column that numbers ranges of the first ordering column, null first, and how many there are.

    The bounds are approximate quantiles (of the first seven bytes, for strings), so ranges have about equal numbers of rows unless one value has many.
    """
    key = _names(order_by)[0]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType.typeName()
    number = F.col(key) if kind in ("byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz") else F.conv(F.rpad(F.hex(F.substring(F.col(key).cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    marks = df.select(F.percentile_approx(number, [i / parts for i in range(1, parts)] or [1.0], 1000)).first()[0] or []
    bounds = sorted(set(marks)) if parts > 1 else []
    if not bounds:
        return F.lit(0), 1
    array = F.array(*[F.lit(b) for b in bounds])
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(array, lambda b: b <= number))), len(bounds) + 1


def ordinal(df: DataFrame, order_by: str | Sequence[str], to: str = "ord", dense: bool = False, parts: int | None = None) -> DataFrame:
    """df with the position (from 0) of each row in the global order.

    ``dense`` states that the one ordering column already holds 0, 1, 2, ...; then it is used as it is. Else
    rows are numbered within ranges, and a range starts where the counts of those before it end; only the
    counts, one for each range, come to the driver.
    """
    names = _names(order_by)
    if dense:
        return df.withColumn(to, F.col(names[0]).cast("long"))
    part, n = range_part(df, names, parts)
    rows = df.withColumn("__part", part)
    counts = dict(rows.groupBy("__part").count().collect())
    before, starts = 0, []
    for i in range(n):
        starts.append(before)
        before += counts.get(i, 0)
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*names))
    offset = F.element_at(F.array(*map(F.lit, starts)), F.col("__part") + 1)
    return rows.withColumn(to, (within - 1 + offset).cast("long")).drop("__part")


def chunked(df: DataFrame, size: int, order_by: str | Sequence[str], value: str, to: str = "chunk", **options) -> DataFrame:
    """Consecutive chunks of ``size`` rows, the last may be shorter: columns chunk (its number) and values."""
    if size < 1:
        raise ValueError("size must be at least 1")
    rows = ordinal(df, order_by, "__ord", **options)
    item = F.struct(F.col("__ord").alias("o"), F.col(value).alias("v"))
    chunks = rows.groupBy(F.floor(F.col("__ord") / size).cast("long").alias(to)).agg(F.sort_array(F.collect_list(item)).alias("__items"))
    return chunks.select(to, F.transform("__items", lambda x: x["v"]).alias("values"))


def ichunked(df: DataFrame, size: int, order_by: str | Sequence[str], value: str, **options) -> DataFrame:
    """As ``chunked``, a row for each value: chunk, pos and the value. Nothing is collected."""
    if size < 1:
        raise ValueError("size must be at least 1")
    rows = ordinal(df, order_by, "__ord", **options)
    return rows.select(F.floor(F.col("__ord") / size).cast("long").alias("chunk"), (F.col("__ord") % size).alias("pos"), value)


def windowed(df: DataFrame, size: int, order_by: str | Sequence[str], value: str, partition_by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Every run of ``size`` neighbouring values: the partition and ordering columns of the first row, and values.

    Without partition_by, ranges of the order are windowed apart; each gets the first size - 1 rows of the
    ranges after it as a halo. A size of 0 gives one empty window.
    """
    if size < 0:
        raise ValueError("size must not be negative")
    names = _names(order_by)
    if size == 0:
        return df.sparkSession.range(1).select(F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>").alias("values"))
    rows = df.select(*partition_by, *names, F.struct(F.col(value).alias("v")).alias("__item"))
    if partition_by:
        keys, own = list(partition_by), rows.withColumn("__own", F.lit(True))
    else:
        keys, own = ["__part"], _with_halo(rows, names, size, parts)
    frame = Window.partitionBy(*keys).orderBy(*names).rowsBetween(0, size - 1)
    found = own.withColumn("__items", F.collect_list("__item").over(frame)).where((F.size("__items") == size) & F.col("__own"))
    return found.select(*partition_by, *names, F.transform("__items", lambda x: x["v"]).alias("values"))


def _with_halo(rows: DataFrame, names: list[str], size: int, parts: int | None) -> DataFrame:
    part, n = range_part(rows, names, parts)
    tagged = rows.withColumn("__part", part)
    if n == 1:
        return tagged.withColumn("__own", F.lit(True))
    counts = dict(tagged.groupBy("__part").count().collect())
    # range i reaches into the ranges after it until size - 1 rows are found
    reach = {i: [] for i in range(n)}
    for i in range(n):
        need, j = size - 1, i + 1
        while need > 0 and j < n:
            take = min(need, counts.get(j, 0))
            if take:
                reach[j].append((i, take))
            need, j = need - take, j + 1
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*names))
    ranked = tagged.withColumn("__rank", rank)
    homes = F.array(*[F.array(*[F.struct(F.lit(i).alias("part"), F.lit(take).alias("take")) for i, take in reach[j]]) if reach[j] else F.array().cast("array<struct<part:int,take:int>>") for j in range(n)])
    guests = ranked.withColumn("__home", F.explode(F.filter(F.element_at(homes, F.col("__part") + 1), lambda h: h["take"] >= F.col("__rank"))))
    return ranked.withColumn("__own", F.lit(True)).drop("__rank").unionByName(guests.withColumn("__part", F.col("__home.part")).withColumn("__own", F.lit(False)).drop("__rank", "__home"))


def window_count(n: int, size: int) -> int:
    """How many windows n rows have."""
    return max(0, n + 1 - size)


def chunk_count(n: int, size: int) -> int:
    """How many chunks n rows have."""
    return -(-n // size)


def array_windows(array, size: int) -> Column:
    """The windows of an array column, as an array of slices."""
    if size < 0:
        raise ValueError("size must not be negative")
    array = F.col(array) if isinstance(array, str) else array
    if size == 0:
        return F.array(F.slice(array, 1, 0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(array) - size + 1))
    return F.when(F.size(array) >= size, F.transform(starts, lambda i: F.slice(array, i, size))).otherwise(F.filter(F.array(array), lambda _: F.lit(False)))


def array_chunks(array, size: int) -> Column:
    """The chunks of an array column, as an array of slices."""
    if size < 1:
        raise ValueError("size must be at least 1")
    array = F.col(array) if isinstance(array, str) else array
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(array) / size).cast("int") - 1))
    return F.when(F.size(array) > 0, F.transform(starts, lambda i: F.slice(array, i * size + 1, size))).otherwise(F.filter(F.array(array), lambda _: F.lit(False)))


def roundrobin(frames: Sequence[DataFrame], order_by: Sequence[str], value: Sequence[str], dense: bool = False) -> DataFrame:
    """Rows of the frames in turn: round, source and value; ordered by (round, source), exhausted frames drop out."""
    parts = [ordinal(df, key, "round", dense).select("round", F.lit(i).alias("source"), F.col(v).alias("value")) for i, (df, key, v) in enumerate(zip(frames, order_by, value))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def zip_rows(frames: Sequence[DataFrame], order_by: Sequence[str], strict: bool = False, dense: bool = False) -> DataFrame:
    """Rows of equal position side by side, with the position in ``ord``; as many as the shortest frame has.

    Column names must differ. ``strict`` raises if the frames differ in length.
    """
    numbered = [ordinal(df, key, "ord", dense) for df, key in zip(frames, order_by)]
    if strict:
        sizes = {df.count() for df in numbered}
        if len(sizes) > 1:
            raise ValueError(f"lengths differ: {sorted(sizes)}")
    out = numbered[0]
    for df in numbered[1:]:
        out = out.join(df, "ord")
    return out


def take(df: DataFrame, limit: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first ``limit`` rows; a top-k, so no total sort."""
    return df.orderBy(*_names(order_by)).limit(limit)


def repeat(spark, value, limit: int, to: str = "value") -> DataFrame:
    """A scalar, ``limit`` times."""
    return spark.range(limit).select(F.lit(value).alias(to))


def characters(df: DataFrame, text: str, to: str = "ch") -> DataFrame:
    """df with a row for each character of a text, and its position ``pos``."""
    return df.select("*", F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", to))
