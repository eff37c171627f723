"""Short identifiers: 128-bit numbers as 22 digits of base 57, with expressions only.

A number is four limbs of 32 bits, most significant first, in an array of longs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII letters and digits without those easily confused, sorted.
ALPHABET = "".join(c for c in sorted(string.ascii_letters + string.digits) if c not in "0O1Il")
DIGITS, BASE, LIMB = 22, len(ALPHABET), 1 << 32


def uuid_limbs(uuid: Column | str) -> Column:
    """The limbs of a UUID in text form; an error for other texts."""
    text = F.lower(F.regexp_replace(uuid, "[-{}]|^urn:uuid:", ""))
    checked = F.when(text.rlike(r"^[0-9a-f]{32}\z"), text).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), F.coalesce(F.col(uuid) if isinstance(uuid, str) else uuid, F.lit("null")))))
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(checked, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def _divide(state: Column) -> Column:
    """(limbs, text) after one more digit: limbs divided by 57, the remainder's digit before the text."""
    step = F.aggregate(
        state["limbs"], F.struct(F.lit(0).cast("long").alias("rest"), F.array().cast("array<bigint>").alias("limbs")),
        lambda acc, limb: F.struct(((acc["rest"] * LIMB + limb) % BASE).alias("rest"), F.concat(acc["limbs"], F.array(F.floor((acc["rest"] * LIMB + limb) / BASE).cast("long"))).alias("limbs")),
    )
    # the division above is exact: the numerator is below 57 * 2**32, far inside what a double holds
    return step


def encode(limbs: Column) -> Column:
    """The 22 digits of four limbs."""
    start = F.struct(limbs.alias("limbs"), F.lit("").alias("text"))

    def digit(state, _):
        step = _divide(state)
        return F.struct(step["limbs"].alias("limbs"), F.concat(F.substring(F.lit(ALPHABET), (step["rest"] + 1).cast("int"), F.lit(1)), state["text"]).alias("text"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(DIGITS)), start, digit, lambda s: s["text"])


def encode_uuid(uuid: Column | str) -> Column:
    """A UUID's 22 digits; null for null."""
    column = F.col(uuid) if isinstance(uuid, str) else uuid
    return F.when(column.isNotNull(), encode(uuid_limbs(column)))


def encode_integer(number: Column | str) -> Column:
    """The 22 digits of a whole number, 0 or more, of at most 38 decimal digits (what a decimal holds; larger ones
    come as UUIDs); null for null, an error below zero."""
    column = (F.col(number) if isinstance(number, str) else number).cast("decimal(38,0)")

    def split(n: Column) -> Column:
        base = F.lit(LIMB).cast("decimal(10,0)")
        rest = lambda x: (x % base).cast("decimal(10,0)")
        over = lambda x: ((x - rest(x)) / base).cast("decimal(38,0)")
        digits = F.aggregate(
            F.sequence(F.lit(1), F.lit(4)), F.struct(n.alias("n"), F.array().cast("array<bigint>").alias("limbs")),
            lambda acc, _: F.struct(over(acc["n"]).alias("n"), F.concat(F.array(rest(acc["n"]).cast("long")), acc["limbs"]).alias("limbs")), lambda acc: acc["limbs"],
        )
        return F.when(n < 0, F.raise_error(F.lit("a number below zero has no short identifier"))).when(n.isNotNull(), encode(digits))

    return F.element_at(F.transform(F.array(column), split), 1)


def random_uid() -> Column:
    """A new random identifier (of a version 4 UUID) for each row; another one whenever the row is computed again."""
    return F.element_at(F.transform(F.array(F.expr("uuid()")), encode_uuid), 1)


def decode(uid: Column | str) -> Column:
    """The UUID, in text form, of 22 digits; an error for other texts and for numbers over 128 bits."""
    # bound to a variable of a lambda, so that an expression for the text is computed once and not for each digit
    return F.element_at(F.transform(F.array(uid), _decode), 1)


def _decode(text: Column) -> Column:
    valid = text.rlike(rf"^[{ALPHABET}]{{{DIGITS}}}\z")
    zero = F.array(*[F.lit(0).cast("long")] * 4)

    def add(limbs, i):
        value = (F.instr(F.lit(ALPHABET), F.substring(text, i, F.lit(1))) - 1).cast("long")
        # from the least significant limb: carry starts as the digit
        step = F.aggregate(
            F.reverse(F.slice(limbs, -4, 4)), F.struct(value.alias("carry"), F.array().cast("array<bigint>").alias("limbs")),
            lambda acc, limb: F.struct(F.shiftright(limb * BASE + acc["carry"], 32).alias("carry"), F.concat(F.array((limb * BASE + acc["carry"]).bitwiseAND(F.lit(LIMB - 1))), acc["limbs"]).alias("limbs")),
            lambda acc: F.concat(F.array(acc["carry"]), acc["limbs"]),
        )
        return F.concat(F.array(F.element_at(limbs, 1) + F.element_at(step, 1)), F.slice(step, 2, 4))

    error = F.raise_error(F.concat(F.lit("not a short identifier: "), text))

    def finish(limbs):
        hex_ = F.lower(F.array_join(F.transform(F.slice(limbs, 2, 4), lambda x: F.lpad(F.hex(x), 8, "0")), ""))
        dashed = F.regexp_replace(hex_, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return F.when(F.element_at(limbs, 1) > 0, error).otherwise(dashed)

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(DIGITS)), F.concat(F.array(F.lit(0).cast("long")), zero), add, finish)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(~valid, error).otherwise(whole)
