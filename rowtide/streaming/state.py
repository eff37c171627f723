"""Stateful operators on streams, a state for each key. Rows of a batch are taken in their order; across batches,
as they come. Each class is the live form of a batch operator and gives the same rows where batches follow the
order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Running(StatefulProcessor):
    """Base of one-in-one-out operators: ``step(state, x)``, x from the column ``reads``, gives (state, output); state
    is a tuple of doubles."""

    width, reads = 1, "t"
    start: tuple = (0.0,)

    def __init__(self, order_by: str, columns: list[str], to: str):
        self.order_by, self.columns, self.to = order_by, columns, to

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"s{i} double" for i in range(self.width)))

    def step(self, state: tuple, x: float) -> tuple[tuple, object]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order_by, kind="stable")
        state = tuple(self.state.get()) if self.state.exists() else self.start
        out = []
        for x in pdf[self.reads].tolist():
            state, got = self.step(state, x)
            out.append(got)
        self.state.update(tuple(map(float, state)))
        yield pdf[self.columns].assign(**{self.to: out})

    def close(self) -> None:
        pass


class RunningTop(Running):
    """The running maximum of the running sum of ``v``."""

    width, start, reads = 2, (0.0, float("-inf")), "v"

    def step(self, state, x):
        total = state[0] + x
        top = max(state[1], total)
        return (total, top), int(top)


class TimeToLive(Running):
    """Whether the key was used less than ``ttl`` microseconds before ``t``."""

    start = (float("-inf"),)

    def __init__(self, order_by, columns, to, ttl: float):
        super().__init__(order_by, columns, to)
        self.ttl = ttl

    def step(self, state, x):
        return (x,), bool(x - state[0] < self.ttl)


class Batches(Running):
    """The number of the batch by count or time since its first item, in microseconds."""

    width, start = 3, (0.0, 0.0, 0.0)

    def __init__(self, order_by, columns, to, size: int, timeout: float):
        super().__init__(order_by, columns, to)
        self.size, self.timeout = size, timeout

    def step(self, state, x):
        number, held, deadline = state
        if held and (self.size and held >= self.size or x >= deadline):
            number, held = number + 1, 0
        if not held:
            deadline = x + self.timeout
        return (number, held + 1, deadline), int(number)


def with_state(stream: DataFrame, keys: list[str], processor: Running, schema: str) -> DataFrame:
    """The stream of a processor's rows; the state store must support it (see SETTINGS in session)."""
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "none")
