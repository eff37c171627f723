"""One state for each key, carried over its rows in order: what a window cannot say, with memory for a batch only."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_rows(df: DataFrame, keys: Sequence[str], order_by: str | Column, start: Callable[[], object], step: Callable[[object, pd.DataFrame], list], to: str, returns: T.DataType, finish: Callable[[object], list] | None = None, helpers: dict[str, Column] | None = None) -> DataFrame:
    """df with ``to``: for each key, ``step(state, rows)`` is called on its rows in order, as many at a time as an
    Arrow batch holds, and returns the next values of the key in order.

    step may return fewer values than it got rows; the rows wait, and ``finish(state)`` returns the values of those
    that wait at the end. Spark sorts and spills (the order is that of a window), and the Python side holds a batch
    and the rows that wait, never a key's whole history. A key is still one task's work. Nulls of a key are one key,
    and null orders come first. ``helpers`` are further columns that step sees.
    """
    columns = df.columns
    position, taken = "__position", {c.lower() for c in columns}
    while position in taken:
        position += "_"
    window = Window.partitionBy(*keys).orderBy(order_by)
    rows = df.withColumns({**(helpers or {}), position: F.row_number().over(window)})
    schema = T.StructType([*df.schema.fields, T.StructField(to, returns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, waiting = None, []

        def out(values: list) -> Iterator[pd.DataFrame]:
            n = 0
            while waiting and n < len(values):
                head = waiting.pop(0)
                if len(head) > len(values) - n:
                    waiting.insert(0, head.iloc[len(values) - n :])
                    head = head.iloc[: len(values) - n]
                yield head.assign(**{to: pd.Series(values[n : n + len(head)], index=head.index, dtype=object)})
                n += len(head)

        def end() -> Iterator[pd.DataFrame]:
            if state is not None and finish is not None:
                yield from out(finish(state))

        for batch in batches:
            bounds = [0, *np.flatnonzero(batch[position].to_numpy() == 1), len(batch)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                part = batch.iloc[a:b]
                if part[position].iloc[0] == 1:
                    yield from end()
                    state, waiting = start(), []
                waiting.append(part[columns])
                yield from out(step(state, part))
        yield from end()

    return rows.mapInPandas(run, schema)
