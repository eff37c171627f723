import math
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions import arrays, describe, images, scalars, uid
from rowtide.sources import sound, vector


def one(spark, column, *data, schema="x double"):
    return [r[0] for r in spark.createDataFrame([(d,) for d in data], schema).select(column).collect()]


def test_around(spark):
    assert one(spark, arrays.around("x"), 0.5, 1.5, 2.5, -0.5) == [0, 2, 2, 0]
    assert one(spark, arrays.aceil("x"), 0.1, -0.1) == [1, 0] and one(spark, arrays.afloor("x"), 0.9, -0.1) == [0, -1]
    assert one(spark, arrays.around("x", "byte"), 127.0, 128.0) == [127, None]
    assert one(spark, arrays.around("x", "byte", wrap=True), 128.0, 300.0) == [-128, 44]
    with pytest.raises(ValueError):
        arrays.around("x", "float")


def test_pack(spark):
    df = spark.createDataFrame([(1,), (300,)], "x long")
    assert arrays.pack(df, "x").schema["x"].dataType == T.ShortType() and arrays.pack(df, "x", 0, 1).schema["x"].dataType == T.ByteType()
    assert arrays.pack(df.limit(0), "x").schema["x"].dataType == T.LongType()
    with pytest.raises(ValueError):
        arrays.pack(df.select(F.col("x").cast("double").alias("x")), "x")


@pytest.mark.parametrize("n", [1, 2, 5, 67])
def test_pascal(spark, n):
    assert spark.range(1).select(arrays.pascal(n)).first()[0] == [math.comb(n - 1, k) for k in range(n)]


def test_pascal_bounds():
    for n in (0, 68):
        with pytest.raises(ValueError):
            arrays.pascal(n)


def test_norm_and_fma(spark):
    df = spark.createDataFrame([([10, 20, 15],), ([7, 7],), ([0, 255, 3],)], "a array<long>")
    assert [r[0] for r in df.select(arrays.array_minmax_norm("a")).collect()] == [[0, 255, 128], [7, 7], [0, 255, 3]]
    assert one(spark, arrays.fma("x", 2, 1), 3.0) == [7.0] and one(spark, arrays.fma("x"), 0.1) == [0.1]


def test_si(spark):
    values = [10000, 0, 1, 999, 999.4, 999.5, 9.994, 9.996, 99.94, 99.96, 1e-3, 1234.5, 5e9, -1500, 1e33]
    assert one(spark, scalars.si("x"), *map(float, values)) == ["10k", "0", "1", "999", "999", "1k", "9.99", "10", "99.9", "100", "1m", "1.23k", "5G", "-1.5k", "1000Q"]
    assert one(spark, scalars.si_bin("x"), 4096.0, 0.0, 1023.0, 1023.5, 1536.0) == ["4KiB", "0B", "1023B", "1KiB", "1.5KiB"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(1.0, 99.94), min_size=1, max_size=50))
def test_three_digits(spark, xs):
    got = one(spark, scalars.si("x"), *xs)
    assert all(abs(float(a) - x) <= (0.00501 if x < 9.995 else 0.0501) for a, x in zip(got, xs))


def test_texts(spark):
    df = spark.createDataFrame([({"a": 1, "b": None},)], "m map<string,long>")
    assert df.select(scalars.repr_map("m")).first()[0] == "a=1, b=NULL"
    assert one(spark, scalars.short_size("x"), 5.0, 2048.0, 123456789.0) == ["   5B", " 2.0K", " 118M"]
    assert spark.range(1).select(scalars.padded(F.lit("ab"), 4), scalars.padded(F.lit("ab"), -4)).first()[:] == ("  ab", "ab  ")


def test_logical_size(spark):
    df = spark.createDataFrame([([1, 2, 3], {"a": 1, "bc": 2}, "né", None)], "a array<long>, m map<string,long>, s string, n string")
    sizes = df.select(*[scalars.logical_size(c, df.schema[c].dataType) for c in "amsn"]).first()
    assert sizes[:] == (24, 19, 3, 0)
    assert df.select(scalars.logical_size(F.struct("a", "s"), T.StructType([df.schema["a"], df.schema["s"]]))).first()[0] == 27


def test_uid(spark):
    golden = "3b1f8b40-222c-4a6e-b77e-779d5a94e21c"
    assert one(spark, uid.encode_uuid("x"), golden, None, schema="x string") == ["CXc85b4rqinB7s5J52TRYb", None]
    ids = [str(uuid.UUID(int=0)), str(uuid.UUID(int=2**128 - 1)), *[str(uuid.uuid5(uuid.NAMESPACE_DNS, str(i))) for i in range(200)]]
    short = one(spark, uid.encode_uuid("x"), *ids, schema="x string")
    assert {len(s) for s in short} == {22} and one(spark, uid.decode("x"), *short, schema="x string") == ids
    for bad in ("", "0", "z" * 22, "0" * 22):
        with pytest.raises(Exception, match="short identifier"):
            one(spark, uid.decode("x"), bad, schema="x string")
    with pytest.raises(Exception, match="UUID"):
        one(spark, uid.encode_uuid("x"), "nope", schema="x string")


def test_describe(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 3.0), (3, float("inf"))], "o long, x double")
    d = describe.describe_float(df, "x").first()
    assert (d["n"], d["invalid"], d["mean"], d["low"], d["high"], d["invalid_values"]) == (4, 0.5, 2.0, 1.0, 3.0, ["Infinity", "NaN"])
    assert describe.gradient(df, "o", "o", 4).first()[0] == 2.0
    assert describe.kind_of(df.where("o = 0"), "o").first()[0] == "zeros" and describe.kind_of(df.limit(0), "o").first()[0] == "empty"
    bits = spark.createDataFrame([(i, i % 3 == 0) for i in range(6)], "o long, b boolean")
    assert describe.bool_bits(bits, "b", "o").first()[0] == "9_"
    arrays_ = spark.createDataFrame([([1.0, 2.0, 9.0, 4.0, 5.0],)], "a array<double>")
    assert arrays_.select(describe.array_gradient("a")).first()[0] == 3.0


def test_rasters(spark):
    image = np.arange(12).reshape(3, 4)
    df = spark.createDataFrame([(0, y, x, int(image[y, x])) for y in range(3) for x in range(4)], "id long, y int, x int, value long")
    for h, w in ((6, 8), (2, 3), (1, 1), (5, 4)):
        got = np.full((h, w), -1)
        for r in images.resize_nearest(df, 3, 4, h, w).collect():
            got[r["y"], r["x"]] = r["value"]
        assert (got == image[np.arange(h) * 3 // h][:, np.arange(w) * 4 // w]).all()
    square = spark.createDataFrame([(0, y, x, 3 * y + x) for y in range(3) for x in range(3)], "id long, y int, x int, value int")
    got = np.full((3, 3), -1)
    for r in images.rotate_nearest(square, 3, 90).collect():
        got[r["y"], r["x"]] = r["value"]
    assert (got == np.rot90(np.arange(9).reshape(3, 3))).all()


def test_sound():
    x = np.array([[0, 1], [100, -100], [32767, -32768]], dtype=float)
    rate, back = sound.decode(sound.encode(x, 8000))
    assert rate == 8000 and (back == x).all()
    assert (sound.decode(sound.encode(x[:, 0] / 300, width=1))[1][:, 0] == np.rint(x[:, 0] / 300).clip(-128, 127)).all()
    with pytest.raises(ValueError):
        sound.encode(np.zeros((2, 3)))


def test_sound_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(sound.encode(np.arange(5.0), 10))
    samples = sound.read_wav(spark, str(tmp_path))
    assert [r["sample"] for r in samples.orderBy("t").collect()] == [0, 1, 2, 3, 4]
    assert sound.durations(samples).first()["duration"].total_seconds() == 0.5
    padded = sound.blocks(samples.select("t", "sample"), 3, "t", "sample").orderBy("block", "pos").collect()
    assert [r["sample"] for r in padded] == [0, 1, 2, 3, 4, 0]


def test_vector(spark, tmp_path):
    text = '<svg xmlns="http://www.w3.org/2000/svg"><g label="a &amp; b"><polygon points="0,0 1,0 1,1"/><polygon points="5,5 6,5 6.4,6"/></g><g><polygon points="9,9"/></g></svg>'
    (tmp_path / "x.svg").write_text(text)
    points = vector.read_svg(spark, str(tmp_path))
    row = vector.polygon_lists(points).first()
    assert row["label"] == "a & b" and [[tuple(p) for p in q] for q in row["polygons"]] == [[(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 5), (6, 6)]]
    again = vector.svg_texts(points, 10, 10).first()["text"]
    assert vector.parse_svg(again) == vector.parse_svg(text)


def test_formatted(spark):
    assert one(spark, scalars.formatted("x", "8.2f"), 1.005, -3.0, 12345.125) == ["    1.00", "   -3.00", "12345.12"]
    assert one(spark, scalars.formatted("x", "<9,.1f"), 12345.25, None) == ["12,345.2 ", None]
    assert one(spark, scalars.formatted("x", "06d"), 42, -42, schema="x long") == ["000042", "-00042"]
    assert one(spark, scalars.formatted("x", "x"), 255, schema="x long") == ["ff"]
    assert one(spark, scalars.formatted("x", "6s"), 10000.0) == ["   10k"]
    assert one(spark, scalars.formatted("x", ".3e"), 12340.0) == ["1.234e+04"]
    for spec in ("q", "3.2d", "05s", ".2s", ",e"):
        with pytest.raises(ValueError):
            scalars.formatted("x", spec)


def test_uid_numbers(spark):
    numbers = [0, 1, 56, 57, 2**32, 2**64 + 5, 10**38 - 1]
    got = one(spark, uid.encode_integer(F.col("x").cast("decimal(38,0)")), *map(str, numbers), schema="x string")
    assert got == one(spark, uid.encode_uuid("x"), *[str(uuid.UUID(int=n)) for n in numbers], schema="x string")
    assert one(spark, uid.encode_integer("x"), None, schema="x long") == [None]
    with pytest.raises(Exception, match="below zero"):
        one(spark, uid.encode_integer("x"), -1, schema="x long")
    made = [r[0] for r in spark.range(50).select(uid.decode(uid.random_uid())).collect()]
    assert len(set(made)) == 50 and all(uuid.UUID(m).version == 4 for m in made)


def test_resize(spark):
    r = np.random.default_rng(5)
    image = r.uniform(0, 1, (6, 9))
    pixels = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(6) for x in range(9)], "id long, y int, x int, value double")

    def made(df, h, w):
        out = np.full((h, w), np.nan)
        for p in df.collect():
            out[p["y"], p["x"]] = p["value"]
        return out

    assert np.allclose(made(images.resize_area(pixels, 6, 9, 3, 3), 3, 3), image.reshape(3, 2, 3, 3).mean((1, 3)))
    assert np.allclose(made(images.resize_area(pixels, 6, 9, 12, 9), 12, 9), image.repeat(2, 0))
    for h, w in ((6, 9), (13, 20), (4, 1)):
        at = [np.clip((np.arange(n) + 0.5) * s / n - 0.5, 0, s - 1) for n, s in ((h, 6), (w, 9))]
        low = [np.floor(a).astype(int) for a in at]
        up = [np.minimum(b + 1, s - 1) for b, s in zip(low, (6, 9))]
        fy, fx = (at[0] - low[0])[:, None], (at[1] - low[1])[None, :]
        want = (1 - fy) * ((1 - fx) * image[np.ix_(low[0], low[1])] + fx * image[np.ix_(low[0], up[1])]) + fy * ((1 - fx) * image[np.ix_(up[0], low[1])] + fx * image[np.ix_(up[0], up[1])])
        assert np.allclose(made(images.resize_linear(pixels, 6, 9, h, w), h, w), want)
    assert one(spark, images.to_rgb("x"), 0.5) == [(0.5, 0.5, 0.5)]


def test_describe_columns(spark):
    schema = "a long, `b.c` string, s struct<x:double,l:array<int>>, t boolean"
    df = spark.createDataFrame([(1, "ab", (float("nan"), [1, 2]), True), (3, None, (2.0, []), False), (None, "abcd", None, None)], schema)
    got = {r["name"]: r for r in describe.describe_columns(df).collect()}
    assert list(got) == ["a", "b.c", "s.x", "s.l", "t"]
    assert tuple(got["a"])[1:8] == ("bigint", 2, 1, 1.0, 3.0, 2.0, 1.0)
    assert tuple(got["b.c"])[1:7] == ("string", 2, 1, 2.0, 4.0, 3.0)
    assert (got["s.x"]["low"], got["s.x"]["n"], got["s.l"]["high"], got["t"]["mean"]) == (2.0, 2, 2.0, 0.5)
    assert got["a"]["text"] == "a: bigint[2] 1..3, mean 2, 1 null" and got["s.x"]["text"] == "s.x: double[2] 2, 1 null"
    assert [r["n"] for r in describe.describe_columns(df.limit(0)).collect()] == [0] * 5
