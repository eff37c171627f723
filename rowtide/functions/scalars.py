"""Text forms and sizes of values."""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefixes of powers of 1000, from 10**-30 to 10**30, and of 1024.
METRIC = ("q", "r", "y", "z", "a", "f", "p", "n", "u", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y", "R", "Q")
BINARY = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB", "RiB", "QiB")
#: A double times this, less the difference, leaves the upper half of its digits.
_SPLIT = 2.0**27 + 1


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _least(bound: str) -> float:
    """The least double that is not below a decimal number: a double is below the one if it is below the other."""
    near = float(bound)
    return near if Fraction(near) >= Fraction(bound) else math.nextafter(near, math.inf)


def _fixed(v: Column, digits: int) -> Column:
    """v with so many decimals, rounded as the double itself is, not as its product with a power of ten; ties to even,
    null stays null."""
    power = 10.0**digits
    product, whole = v * power, F.rint(v * power)
    high = v * _SPLIT - (v * _SPLIT - v)
    # product + rest is the exact product (Dekker), so rest says on which side of a tie v is
    rest = (high * power - product) + (v - high) * power
    whole = F.when((F.abs(product - whole) == 0.5) & (rest != 0), product + F.signum(rest) * 0.5).otherwise(whole)
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f", whole / power))


def _three(v: Column) -> Column:
    """v, below 1000 or so, to three significant digits without trailing zeros; whole numbers from 99.95 on."""
    size = F.abs(v)
    text = _fixed(v, 1)
    for digits, bound in ((2, "9.995"), (3, "0.9995"), (4, "0.09995"), (5, "0.009995"), (6, "0.0009995")):
        text = F.when(size < _least(bound), _fixed(v, digits)).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    text = F.when(size < _least("0.00009995"), F.regexp_replace(F.format_string("%.2e", v), r"\.?0+e", "e")).otherwise(text)
    text = F.when(size < 99.95, text).otherwise(_fixed(v, 0))
    return F.when(F.isnan(v), "nan").when(size == math.inf, F.when(v < 0, "-inf").otherwise("inf")).otherwise(text)


def _ladder(v: Column, base: float, units: tuple[str, ...], zero: int) -> Column:
    """v over the power of the first unit that leaves less than base - 0.5, in a struct so that it is computed once."""
    powers = F.array(*[F.lit(float(base) ** (i - zero)) for i in range(len(units))])
    passed = F.size(F.filter(F.slice(powers, 1, len(units) - 1), lambda p: F.abs(v) / p >= base - 0.5)) + 1
    one = F.array(F.struct((v / F.element_at(powers, passed)).alias("x"), F.element_at(F.array(*map(F.lit, units)), passed).alias("u")))
    return F.element_at(F.transform(one, lambda s: F.concat(_three(s["x"]), s["u"])), 1)


def si(value: Column | str, units: tuple[str, ...] = METRIC) -> Column:
    """A number with a metric prefix, to three digits: 10000 is ``10k``. Fewer ``units``, neighbours with the empty one
    among them, leave the numbers beyond to the first and the last."""
    v = _column(value).cast("double")
    return F.when(v == 0, "0").otherwise(_ladder(v, 1000, units, units.index("")))


def si_bin(value: Column | str) -> Column:
    """A number of bytes with a binary prefix: 4096 is ``4KiB``."""
    v = _column(value).cast("double")
    return F.when(v == 0, "0B").otherwise(_ladder(v, 1024, BINARY, 0))


def padded(text: Column | str, width: int) -> Column:
    """A text in a field of a width, to the right; a negative width, to the left."""
    text = _column(text)
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(abs(width)) - F.length(text)))
    return F.concat(fill, text) if width >= 0 else F.concat(text, fill)


def formatted(value: Column | str, spec: str) -> Column:
    """A number in a format ``[<>][0][width][,][.digits](d|f|e|x)``, or with ``widths`` its metric text in a field of
    that width; ``<`` puts it to the left. Decimals are rounded half to even; null stays null."""
    got = re.fullmatch(r"([<>]?)(0?)(\d*)(,?)(?:\.(\d+))?([dfexs])", spec)
    if got is None or got[6] in "dxs" and got[5] or got[6] == "s" and (got[2] or got[4]) or got[6] in "ex" and got[4]:
        raise ValueError(f"unknown format {spec!r}")
    left, zeros, width, commas, digits, kind = got.groups()
    v, n = _column(value), int(width or 0)
    if kind == "s":
        text = si(v)
    elif kind == "f":
        places = int(digits or 6)
        text = F.format_string(f"%{commas}.{places}f", F.rint(v.cast("double") * 10.0**places) / 10.0**places)
    elif kind == "e":
        text = F.format_string(f"%.{int(digits or 6)}e", v.cast("double"))
    else:
        text = F.format_string(f"%{commas}{kind}", v.cast("long"))
    text = F.when(v.isNotNull(), text)
    if zeros:
        sign = F.when(text.startswith("-"), "-").otherwise("")
        rest = F.regexp_replace(text, "^-", "")
        text = F.concat(sign, F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(n) - F.length(text))), rest)
    return padded(text, -n if left == "<" else n)


def repr_map(m: Column | str) -> Column:
    """The entries of a map as ``a=1, b=2``."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("NULL")))), ", ")


def short_size(value: Column | str) -> Column:
    """A number of bytes in five characters: a number below 1000 and a letter for its power of 1024."""
    v = _column(value).cast("double")
    out = None
    for i, unit in reversed(list(enumerate("BKMGTP"))):
        scaled = v / 1024.0**i
        text = F.when(scaled < 9.95, _fixed(scaled, 1)).otherwise(_fixed(scaled, 0)) if i else _fixed(scaled, 0)
        text = F.concat(F.lpad(text, 4, " "), F.lit(unit))
        out = text if out is None else F.when(scaled < 1000, text).otherwise(out)
    return out


_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}


def logical_size(value: Column | str, kind: T.DataType) -> Column:
    """Bytes of a value of a type: fixed widths, UTF-8 bytes of texts, sums over elements; null is 0."""
    v = _column(value)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(v).cast("long")
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(F.transform(v, lambda x: logical_size(x, kind.elementType)), F.lit(0).cast("long"), lambda a, b: a + b)
    elif isinstance(kind, T.MapType):
        size = logical_size(F.map_keys(v), T.ArrayType(kind.keyType)) + logical_size(F.map_values(v), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = F.lit(0).cast("long")
        for f in kind.fields:
            size = size + logical_size(v[f.name], f.dataType)
    else:
        size = F.lit(_WIDTH[type(kind)]).cast("long")
    return F.when(v.isNull(), F.lit(0).cast("long")).otherwise(size)


def clock(ts: Column | str) -> Column:
    """The time of day as HH:MM:SS.mmm."""
    return F.date_format(ts, "HH:mm:ss.SSS")


def duration(count: Column | str, rate: Column | str | int) -> Column:
    """The interval that a number of samples takes at a rate."""
    rate = F.lit(rate) if isinstance(rate, int) else _column(rate)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (_column(count) / rate).cast("decimal(18,6)"))
