"""Numeric kernels on columns, arrays and small grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = {"byte": 8, "tinyint": 8, "short": 16, "smallint": 16, "int": 32, "integer": 32, "long": 64, "bigint": 64}


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _to_int(x: Column, dtype: str, wrap: bool) -> Column:
    if dtype not in _BITS:
        raise ValueError(f"not an integer type: {dtype}")
    bits = _BITS[dtype]
    if not wrap or bits == 64:
        return x.try_cast(dtype)
    low = F.shiftright(F.shiftleft(x.try_cast("long"), 64 - bits), 64 - bits)
    return low.try_cast(dtype)


def around(x: Column | str, dtype: str = "long", wrap: bool = False) -> Column:
    """The nearest integer, halves to even. Out of range is null, or wraps around."""
    return _to_int(F.rint(_column(x)), dtype, wrap)


def aceil(x: Column | str, dtype: str = "long", wrap: bool = False) -> Column:
    """The least integer not below x."""
    return _to_int(F.ceil(_column(x)), dtype, wrap)


def afloor(x: Column | str, dtype: str = "long", wrap: bool = False) -> Column:
    """The greatest integer not above x."""
    return _to_int(F.floor(_column(x)), dtype, wrap)


def smallest_type(low: Column | str, high: Column | str) -> Column:
    """The name of the narrowest signed integer type that holds both."""
    low, high = _column(low), _column(high)
    out = F.lit("bigint")
    for name, bits in (("int", 32), ("smallint", 16), ("tinyint", 8)):
        out = F.when((low >= -(2 ** (bits - 1))) & (high < 2 ** (bits - 1)), name).otherwise(out)
    return out


def pack(df: DataFrame, column: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """df with an integer column in the narrowest type for its values, or for the stated bounds."""
    if df.schema[column].dataType.simpleString() not in _BITS:
        raise ValueError(f"not a signed integer column: {column}")
    if low is None or high is None:
        least, most = df.agg(F.min(column), F.max(column)).first()
        low, high = least if low is None else low, most if high is None else high
    if low is None:
        return df
    kind = next(n for n, bits in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)) if -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1))
    return df.withColumn(column, F.col(column).cast(kind))


def pascal(n: int) -> Column:
    """Row n of Pascal's triangle (n values, the last that fit 64 bits being row 67) as an array."""
    if not 1 <= n <= 67:
        raise ValueError("n must be from 1 to 67")
    step = lambda row, _: F.concat(F.array(F.lit(1).cast("long")), F.zip_with(row, F.slice(row, 2, F.size(row)), lambda a, b: F.when(b.isNull(), a).otherwise(a + b)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array().cast("array<bigint>"), lambda row, i: F.when(i == 1, F.array(F.lit(1).cast("long"))).otherwise(step(row, i)))


def fma(x: Column | str, scale: float = 1, bias: float = 0, dtype: str = "float") -> Column:
    """x * scale + bias in a floating type; x as it is if nothing changes."""
    x = _column(x)
    if scale == 1 and bias == 0:
        return x
    x = x.cast(dtype)
    if scale != 1:
        x = x * F.lit(scale).cast(dtype)
    return (x + F.lit(bias).cast(dtype) if bias else x).cast(dtype)


def array_fma(array: Column | str, scale: float = 1, bias: float = 0, dtype: str = "float") -> Column:
    """``fma`` of each element."""
    return F.transform(_column(array), lambda x: fma(x, scale, bias, dtype))


def abs2(re: Column | str, im: Column | str) -> Column:
    """The squared magnitude of a complex number."""
    re, im = _column(re), _column(im)
    return re * re + im * im


def minmax_norm(x: Column, low: Column, high: Column, top: int = 255) -> Column:
    """x stretched from [low, high] to [0, top], halves to even; as it is where that is its range or it is constant."""
    same = (low == high) | ((low == 0) & (high == top))
    return F.when(same, x.cast("long")).otherwise(F.rint((x - low) * (F.lit(float(top)) / F.nullif(high - low, F.lit(0)))).cast("long"))


def array_minmax_norm(array: Column | str, top: int = 255) -> Column:
    """``minmax_norm`` of an array over its own range."""
    array = _column(array)
    low, high = F.array_min(array), F.array_max(array)
    return F.transform(array, lambda x: minmax_norm(x, low, high, top))


def column_minmax_norm(df: DataFrame, column: str, to: str, top: int = 255) -> DataFrame:
    """``minmax_norm`` of a column over its range in df; the range is two numbers on the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn(to, F.lit(None).cast("long") if low is None else minmax_norm(F.col(column), F.lit(low), F.lit(high), top))


def circle(spark, diameter: int = 45, gain: float = 2.0) -> DataFrame:
    """(y, x, value) of a radial field: distance ** gain from the centre, 0 outside the unit circle."""
    cells = spark.range(diameter * diameter).select(F.expr(f"id div {diameter}").alias("y"), (F.col("id") % diameter).alias("x"))
    at = lambda c: (2 * F.col(c) - (diameter - 1)) / float(diameter)
    r2 = at("y") * at("y") + at("x") * at("x")
    return cells.select("y", "x", F.when(r2 >= 1, 0.0).otherwise(F.pow(r2, F.lit(gain / 2))).alias("value"))


INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
