"""A replayable log with many readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay_from(log: DataFrame, readers: DataFrame, ord_column: str, pos: str = "pos") -> DataFrame:
    """What each reader sees: every row of the log from its own position on, so a late reader misses nothing.

    Readers are few and stated: their number is checked, then their table is joined as a range on the position.
    """
    n = readers.count()
    if n > 10_000:
        raise ValueError("over 10,000 readers: give them queries of their own")
    return log.join(F.broadcast(readers), F.col(ord_column) >= F.col(pos))


def lag_of(log: DataFrame, readers: DataFrame, ord_column: str, reader: str = "reader", pos: str = "pos") -> DataFrame:
    """How many rows each reader has still to see, and where it will be then."""
    top = log.agg(F.max(ord_column)).first()[0]
    end = 0 if top is None else top + 1
    return readers.select(reader, F.greatest(F.lit(0), F.lit(end) - F.col(pos)).cast("long").alias("behind"), F.greatest(F.col(pos), F.lit(end)).cast("long").alias("end"))
