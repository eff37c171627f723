"""What is in a column: distributions, ranges, invalid shares and gradients, each by one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.scalars import si


def describe_int(df: DataFrame, column: str) -> DataFrame:
    """n, low, high, mean, population std, number of distinct values and their share of the range."""
    return df.agg(
        F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.countDistinct(column).alias("n_distinct"),
        (F.countDistinct(column) / (F.max(column) - F.min(column) + 1)).alias("filled"),
    )


def value_weights(df: DataFrame, column: str) -> DataFrame:
    """Each value, how often it comes and its share; for a column of few values."""
    total = df.where(F.col(column).isNotNull()).count()
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(float(max(1, total))))


def describe_float(df: DataFrame, column: str) -> DataFrame:
    """n, the share of invalid values (NaN and infinities), and mean, population std, low and high of the others."""
    x = F.col(column)
    valid = ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.when(valid, x)
    return df.agg(F.count(x).alias("n"), (1 - F.count(v) / F.count(x)).alias("invalid"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.array_sort(F.collect_set(F.when(~valid, x.cast("string")))).alias("invalid_values"))


def describe_bool(df: DataFrame, column: str) -> DataFrame:
    """n, number and share of true values."""
    x = F.col(column).cast("boolean")
    return df.agg(F.count(x).alias("n"), F.count_if(x).alias("n_true"), F.avg(x.cast("int")).alias("share"))


def bool_bits(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """The values of a small column (below 500 rows) in order as hexadecimal digits, four a digit, zeros as ``_``."""
    n = df.count()
    if n >= 500:
        raise ValueError("500 rows or more: describe them by describe_bool")
    bits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order_by).alias("o"), F.col(column).cast("int").alias("b")))), lambda x: x["b"].cast("string")), "")
    full = F.rpad(bits, -(-max(n, 1) // 4) * 4, "0")
    digits = F.transform(F.sequence(F.lit(0), F.lit(-(-max(n, 1) // 4) - 1)), lambda i: F.conv(F.substring(full, i * 4 + 1, F.lit(4)), 2, 16))
    return df.agg(F.translate(F.array_join(digits, ""), "0", "_").alias("bits"))


def gradient(df: DataFrame, ordinal: str, value: str, size: int) -> DataFrame:
    """Mean of the upper half less mean of the lower half of an axis of a size; the middle of an odd one is left out."""
    half = size // 2
    return df.agg((F.avg(F.when(F.col(ordinal) >= size - half, F.col(value))) - F.avg(F.when(F.col(ordinal) < half, F.col(value)))).alias("gradient"))


def array_gradient(array: Column | str) -> Column:
    """``gradient`` of an array column along its index."""
    array = F.col(array) if isinstance(array, str) else array
    half = F.floor(F.size(array) / 2).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(array) > 1, (total(F.slice(array, F.size(array) - half + 1, half)) - total(F.slice(array, 1, half))) / half).otherwise(F.lit(0.0))


def kind_of(df: DataFrame, column: str) -> DataFrame:
    """``empty``, ``zeros``, ``ones``, ``full`` (one other value) or ``mixed``."""
    low, high = F.min(column), F.max(column)
    return df.agg(F.when(F.count(column) == 0, "empty").when(low != high, "mixed").when(low == 0, "zeros").when(low == 1, "ones").otherwise("full").alias("kind"))


def _leaves(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    if not isinstance(kind, T.StructType):
        return [(path, kind)]
    return [leaf for field in kind.fields for leaf in _leaves(field.dataType, (*path, field.name))]


def _measure(x: Column, kind: T.DataType) -> Column:
    """What is described of a value: a number, a truth as 0 or 1, the length of a text, the size of a collection,
    seconds or days of a time."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return x.cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.length(x).cast("double")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(x).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp")) / 1e6
    return F.lit(None).cast("double")


def describe_columns(df: DataFrame) -> DataFrame:
    """A row for each column, fields of structs apart: name, kind, n, n_null, low, high, mean and population std of
    what ``_measure`` says of it, and all this as a line of text. One pass over the data, whatever the columns."""
    about = []
    for path, kind in _leaves(df.schema):
        x = F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))
        m = _measure(x, kind)
        about.append(F.struct(
            F.lit(".".join(path)).alias("name"), F.lit(kind.simpleString()).alias("kind"), F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("n_null"),
            F.min(m).alias("low"), F.max(m).alias("high"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"),
        ))
    rows = df.agg(F.array(*about).alias("d")).select(F.explode("d").alias("d")).select("d.*")
    span = F.when(F.col("low") == F.col("high"), si("low")).otherwise(F.concat(si("low"), F.lit(".."), si("high"), F.lit(", mean "), si("mean")))
    return rows.withColumn("text", F.concat(
        "name", F.lit(": "), "kind", F.lit("["), F.col("n").cast("string"), F.lit("]"), F.coalesce(F.concat(F.lit(" "), span), F.lit("")),
        F.when(F.col("n_null") > 0, F.concat(F.lit(", "), F.col("n_null").cast("string"), F.lit(" null"))).otherwise(""),
    ))
