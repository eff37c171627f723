import random

import pytest
from pyspark.sql import functions as F

from rowtide.operators import grouping, running, sequence


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def five(rows):
    return rows([(i, i) for i in range(5)], "ord long, v long")


def test_windowed(five):
    assert [r["values"] for r in sequence.windowed(five, 3, "ord", "v").orderBy("ord").collect()] == [[0, 1, 2], [1, 2, 3], [2, 3, 4]]
    assert [r["values"] for r in sequence.windowed(five, 0, "ord", "v").collect()] == [[]]
    assert sequence.windowed(five, 6, "ord", "v").count() == 0
    with pytest.raises(ValueError):
        sequence.windowed(five, -1, "ord", "v")
    assert sequence.window_count(5, 3) == 3 and sequence.window_count(2, 3) == 0


@pytest.mark.parametrize("parts", [1, 3, 7, 40])
def test_windowed_crosses_ranges(rows, parts):
    data = [(i * i, None if i % 4 == 0 else i) for i in range(37)]
    found = sequence.windowed(rows(data, "ord long, v long"), 5, "ord", "v", parts=parts)
    got = [(r["ord"], r["values"]) for r in found.orderBy("ord").collect()]
    assert got == [(data[i][0], [v for _, v in data[i : i + 5]]) for i in range(33)]


def test_chunked(five):
    assert values(sequence.chunked(five, 3, "ord", "v"), "chunk") == [(0, [0, 1, 2]), (1, [3, 4])]
    assert values(sequence.ichunked(five, 3, "ord", "v"), "chunk", "pos") == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4)]
    for f in (sequence.chunked, sequence.ichunked):
        with pytest.raises(ValueError):
            f(five, 0, "ord", "v")
    assert sequence.chunk_count(5, 3) == 2


def test_chunked_keeps_nulls(rows):
    df = rows([(0, None), (1, 1), (2, None)], "ord long, v long")
    assert values(sequence.chunked(df, 2, "ord", "v"), "chunk") == [(0, [None, 1]), (1, [None])]


@pytest.mark.parametrize("kind", ["long", "double", "string", "timestamp"])
def test_ordinal(rows, kind):
    numbers = random.Random(3).sample(range(1000), 100)
    df = rows([(n,) for n in numbers], "n long").withColumn("k", F.lpad(F.col("n").cast("string"), 4, "0") if kind == "string" else F.col("n").cast(kind))
    assert values(sequence.ordinal(df, "k", parts=6).select("n", "ord"), "ord") == [(n, i) for i, n in enumerate(sorted(numbers))]


def test_ordinal_of_nothing(rows):
    assert sequence.ordinal(rows([], "k long"), "k").collect() == []


def test_roundrobin(rows):
    frames = [rows([(i, c) for i, c in enumerate(s)], "ord long, v string") for s in ("ABC", "D", "EF")]
    found = sequence.roundrobin(frames, ["ord"] * 3, ["v"] * 3).orderBy("round", "source")
    assert "".join(r["value"] for r in found.collect()) == "ADEBFC"


def test_zip(rows):
    a, b = rows([(i, i) for i in range(3)], "x long, a long"), rows([(i, -i) for i in range(2)], "y long, b long")
    assert values(sequence.zip_rows([a, b], ["x", "y"]).select("ord", "a", "b"), "ord") == [(0, 0, 0), (1, 1, -1)]
    with pytest.raises(ValueError):
        sequence.zip_rows([a, b], ["x", "y"], strict=True)


def test_take_repeat_characters(five, rows, spark):
    assert [r["v"] for r in sequence.take(five, 2, "ord").collect()] == [0, 1]
    assert [r[0] for r in sequence.repeat(spark, 7, 2).collect()] == [7, 7]
    assert values(sequence.characters(rows([("añ",), ("",)], "t string"), "t").select("pos", "ch"), "pos") == [(0, "a"), (1, "ñ")]


def test_arrays(spark):
    df = spark.createDataFrame([(list(range(5)),), ([],)], "a array<long>")
    got = [tuple(r) for r in df.select(sequence.array_windows("a", 3), sequence.array_chunks("a", 3)).collect()]
    assert got == [([[0, 1, 2], [1, 2, 3], [2, 3, 4]], [[0, 1, 2], [3, 4]]), ([], [])]
    assert df.select(sequence.array_windows("a", 0)).first()[0] == [[]]


def test_group_values(rows):
    df = rows([(0, "t", True), (1, "e", False), (2, "1", True), (3, None, False), (4, "n", None)], "ord long, v string, k boolean")
    assert values(grouping.group_values(df, "k", "v", "ord").select("k", "values"), F.col("values")[0]) == [(False, ["e", None]), (None, ["n"]), (True, ["t", "1"])]
    assert grouping.count_rows(df).first()[0] == 5


@pytest.mark.parametrize("parts", [1, 4])
def test_running(rows, parts):
    data = [-1, -2, 3, -4, 5, 7]
    df = rows([(i, v) for i, v in enumerate(data)], "ord long, v long")
    assert [r["cumsum"] for r in running.cumsum(df, "v", "ord", parts=parts).orderBy("ord").collect()] == [-1, -3, 0, -4, 1, 8]
    df = rows([(i, v) for i, v in enumerate([1, -1, 1, 1, -1, -1])], "ord long, v long")
    assert [r["max_cumsum"] for r in running.maximum_cumsum(df, "v", "ord", parts=parts).orderBy("ord").collect()] == [1, 1, 1, 2, 2, 2]
    falling = rows([(i, -1) for i in range(6)], "ord long, v long")
    assert [r["max_cumsum"] for r in running.maximum_cumsum(falling, "v", "ord", parts=parts).orderBy("ord").collect()] == [-1] * 6


def test_names_and_numbers(rows):
    df = rows([(0, "a"), (1, "b"), (2, "a"), (3, None), (4, None)], "ord long, k string")
    assert values(running.mangle(df, "k", "ord").select("ord", "mangled"), "ord") == [(0, "a"), (1, "b"), (2, "a:1"), (3, None), (4, None)]
    assert values(running.dense_ids(df, "k", "ord").select("ord", "id"), "ord") == [(0, 0), (1, 1), (2, 0), (3, 2), (4, 2)]
    counts = running.running_counts(rows([(0, "a", 1), (1, "a", 1), (2, None, 1), (3, "a", 1)], "ord long, k string, p long"), "k", "ord", ["p"])
    assert values(counts.select("ord", "n"), "ord") == [(0, 1), (1, 2), (2, None), (3, 1)]
    counts = running.running_counts(rows([(0, "a"), (1, "a"), (2, None), (3, "a")], "ord long, k string"), "k", "ord")
    assert values(counts.select("ord", "n"), "ord") == [(0, 1), (1, 2), (2, None), (3, 1)]


def test_concurrency_and_ema(rows):
    df = rows([("f", 0, 10), ("f", 5, 6), ("f", 6, 8), ("g", 1, 1)], "k string, s long, e long")
    assert values(running.max_concurrency(df, "s", "e", ["k"]), "k") == [("f", 2), ("g", 0)]
    df = rows([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 5.0)], "k string, o long, v double")
    assert values(running.ema(df, "v", "o", ["k"]), "k") == [("a", pytest.approx(1.2)), ("b", 5.0)]


def test_pareto(rows):
    df = rows([(i, float(w)) for i, w in enumerate([1, 2, 3, 94, 100, 200])], "k long, w double")
    assert {r["k"] for r in grouping.pareto_cut(df, "k", "w").collect()} == {3, 4, 5}
    assert grouping.pareto_cut(df.where("k < 5"), "k", "w").count() == 5
