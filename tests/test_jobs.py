import dataclasses
import pathlib
from typing import Literal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide import jobs
from rowtide.operators import execution


@dataclasses.dataclass
class Inner:
    rate: float = 0.5
    names: list[str] = dataclasses.field(default_factory=list)


@dataclasses.dataclass
class Job:
    source: pathlib.Path
    count: int = 3
    dry: bool = False
    mode: Literal["a", "b"] = "a"
    limit: int | None = None
    inner: Inner = dataclasses.field(default_factory=Inner)


def test_parse():
    assert jobs.parse(Job, ["x"]) == Job(pathlib.Path("x"))
    got = jobs.parse(Job, ["x", "--count", "4", "--dry", "--mode", "b", "--limit", "9", "--rate", "1", "--names", "p", "q"])
    assert got == Job(pathlib.Path("x"), 4, True, "b", 9, Inner(1.0, ["p", "q"]))
    for bad in ([], ["x", "--mode", "c"], ["x", "--count", "y"]):
        with pytest.raises(SystemExit):
            jobs.parse(Job, bad)


def make(**fields):
    return dataclasses.make_dataclass("Made", [(k, *v) if isinstance(v, tuple) else (k, v) for k, v in fields.items()])


@pytest.mark.parametrize("cls", [make(flag=bool), make(m=dict[str, int]), make(u=int | str), make(inner=make(x=int)), make(rate=(float, 1.0), inner=(Inner, None))])
def test_rejected(cls):
    with pytest.raises(ValueError):
        jobs.parse(cls, [])


def test_struct():
    assert jobs.struct_of(Job) == T.StructType([
        T.StructField("source", T.StringType(), False), T.StructField("count", T.LongType(), False), T.StructField("dry", T.BooleanType(), False), T.StructField("mode", T.StringType(), False), T.StructField("limit", T.LongType(), True),
        T.StructField("inner", T.StructType([T.StructField("rate", T.DoubleType(), False), T.StructField("names", T.ArrayType(T.StringType(), False), False)]), False),
    ])
    with pytest.raises(ValueError):
        jobs.struct_of(make(m=dict[str, int]))


def test_execution(spark):
    df = spark.range(100)
    assert execution.drain(df) is None
    execution.drain(df, daemon=True).join(60)
    assert [r[0] for r in execution.prefetched(df.orderBy("id"))] == list(range(100))
    seen, watch = execution.observed(df, "w", F.sum("id").alias("total"))
    execution.drain(seen)
    assert watch.get == {"rows": 100, "total": 4950}
    took = []
    with pytest.raises(KeyError), execution.timer(took.append):
        raise KeyError
    assert took[0] > 0
    assert execution.sampled(df, 0.5, 3).collect() == execution.sampled(df, 0.5, 3).collect()
