"""Functions over rows and values: in order or not, with results or errors as data."""

from __future__ import annotations

import asyncio
import functools
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_rows(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema, order_by: str | None = None) -> DataFrame:
    """func over Arrow batches of df. With order_by the result is sorted by it, else it comes as tasks end.
    A batch whose result has another length than schema and func promise fails the query."""
    out = df.mapInPandas(lambda batches: map(func, batches), schema)
    return out if order_by is None else out.orderBy(order_by)


def map_column(func: Callable[..., pd.Series], *columns: str, returns) -> Column:
    """A vectorised function of columns; its result must be as long as its input."""
    return F.pandas_udf(func, returns)(*columns)


def map_async(df: DataFrame, func: Callable[[tuple], Awaitable], to: str, returns: T.DataType, limit: int = 16) -> DataFrame:
    """df with the results of an async function of its rows, at most ``limit`` of a task's rows in flight. The
    first failure cancels the others and fails the query."""
    schema, columns = T.StructType([*df.schema.fields, T.StructField(to, returns)]), df.columns

    async def gather(rows):
        gate = asyncio.Semaphore(max(1, limit))

        async def one(row):
            async with gate:
                return await func(row)

        async with asyncio.TaskGroup() as group:
            tasks = [group.create_task(one(row)) for row in rows]
        return [t.result() for t in tasks]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[columns].assign(**{to: asyncio.run(gather(list(pdf[columns].itertuples(index=False, name=None))))})

    return df.mapInPandas(run, schema)


def fold_groups(df: DataFrame, key: str, value: str, partial: Callable[[pd.Series], list], merge: Callable[[list, list], list], finish: Callable[[list], object], returns: str, to: str = "result", most_keys: int = 100_000) -> DataFrame:
    """key and the result of an aggregation of one's own: ``partial`` makes a state (numbers in a list) of some
    values of a key, ``merge`` one state of two, ``finish`` the result of the last.

    States are merged before the shuffle, so a key with any number of rows sends a state or so a task; a task holds
    ``most_keys`` states at most and sends them on when it has more, which changes no result. Null is a key.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("state", T.ArrayType(T.DoubleType()))])

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        frame = lambda: pd.DataFrame({"key": pd.Series(list(held), dtype=object), "state": list(held.values())})
        for pdf in batches:
            for k, values in pdf.groupby(key, dropna=False, sort=False)[value]:
                k, state = None if pd.isna(k) else k, list(map(float, partial(values)))
                held[k] = merge(held[k], state) if k in held else state
                if len(held) >= most_keys:
                    yield frame()
                    held.clear()
        if held:
            yield frame()

    def last(states: pd.Series) -> float:
        return finish(functools.reduce(merge, map(list, states)))

    states = df.select(key, value).mapInPandas(partials, schema)
    return states.groupBy("key").agg(F.pandas_udf(last, returns)("state").alias(to)).withColumnRenamed("key", key)


def expand(df: DataFrame, func: Callable[..., Iterator[tuple]], *columns: str, returns: str) -> DataFrame:
    """df with each row as often as the generator function func of its columns gives a tuple, and the fields of that
    tuple; rows for which it gives none are left out. A row's results are never held together."""

    class Handler:
        def eval(self, *args):
            yield from func(*args)

    return df.lateralJoin(F.udtf(Handler, returnType=returns)(*[F.col(c).outer() for c in columns]))


def map_values(column: Column | str, func: Callable[[Column], Column]) -> Column:
    """The map with func applied to its values; keys stay."""
    return F.transform_values(column, lambda _, v: func(v))


def as_result(value: Column, error: Column) -> Column:
    """A value or an error as data: the value where the error is null."""
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def split_results(df: DataFrame, key: str, result: str) -> tuple[DataFrame, DataFrame]:
    """The rows (key, value) that have no error, and the distinct errors with their numbers."""
    ok = df.where(F.col(f"{result}.error").isNull()).select(key, F.col(f"{result}.value").alias("value"))
    errors = df.where(F.col(f"{result}.error").isNotNull()).groupBy(F.col(f"{result}.error").alias("error")).agg(F.count("*").alias("n"))
    return ok, errors
