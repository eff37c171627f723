"""Seeds of repeated passages: winnowed anchors, grouped exactly and without pairs.

A sequence of elements (words or bytes) has a window at every start where ``size`` elements follow. Of each
window, the k-gram with the least hash (the leftmost of equal ones) is its anchor, which depends on nothing
but the window, so equal windows have equal anchors at equal places. The windows of one anchor occurrence
are a run of starts; the elements under them are its context.

Occurrences with equal anchors and equal contexts form a class. Every occurrence in a class but the earliest
has all its windows earlier in that class: it is repeated and needs no further look. The earliest occurrence
of a class can have windows that start earlier only in other classes of the same anchor, so it has to be
compared (``refined``) only if the anchor has several classes. So work follows distinct contexts, not pairs,
and tasks drop later occurrences of what they have read before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.llm.arrow import column_of
from rowtide.llm.kernels import U64, mix64, powers, sliding_argmin
from rowtide.llm.storage import free_name, materialize

REPEATED, REFINED = 0, 1
#: Elements that are hashed at a time; longer documents are cut where no window is lost.
SEGMENT = 1 << 20
#: Bytes of seeds that are sifted at a time, whatever a partition holds.
SIFTED = 16 << 20


class Spans:
    """Hashes of all ranges of a sequence of 64-bit elements, from prefix sums."""

    def __init__(self, elements: np.ndarray):
        n = len(elements)
        power, self.inverse = powers(n + 1)
        self.sums = np.empty(n + 1, dtype=U64)
        self.sums[0] = 0
        np.cumsum(elements * power[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=U64)


def occurrences(elements: np.ndarray, bounds: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """anchor hash, context hash, text, first start, number of starts and place of the anchor after the first
    start, of each anchor occurrence of texts given as one sequence cut at bounds; starts count from the
    beginning of the sequence."""
    if size - k + 1 > 63:
        raise ValueError("size may exceed k by 62 at most")
    spans = Spans(elements)
    n = len(elements) - size + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (U64, U64, np.int64, np.int64, np.int64, np.int64))
    gram = spans.grams(k)
    anchor = sliding_argmin(gram, size - k + 1)
    closed = np.zeros(len(elements) + 1, dtype=np.int32)
    np.add.at(closed, np.maximum(bounds[:-1], bounds[1:] - size + 1), 1)
    np.add.at(closed, bounds[1:], -1)
    start = np.flatnonzero(np.cumsum(closed)[:n] == 0)
    if not len(start):
        return tuple(np.zeros(0, dtype=t) for t in (U64, U64, np.int64, np.int64, np.int64, np.int64))
    at = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    count = np.diff(np.append(first, len(start)))
    low, at = start[first], at[first]
    context = spans.hash(low, low + count + size - 1) ^ mix64((at - low).astype(U64) + U64(1))
    return gram[at], context, np.searchsorted(bounds, low, side="right") - 1, low, count, at - low


def segments(n: int, size: int) -> list[tuple[int, int]]:
    """Element ranges that together hold every window of n elements once."""
    return [(a, min(n, a + SEGMENT + size - 1)) for a in range(0, max(1, n - size + 1), SEGMENT)]


def pack(position: np.ndarray, count: np.ndarray, anchor: np.ndarray | int = 0) -> np.ndarray:
    """A run of ``count`` starts at a position, and the place of its anchor after the position; both below 64."""
    return position << 12 | anchor << 6 | count


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 12, packed & 63


def sift(anchor, context, doc, packed, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the occurrences, which of them (in that order) are repeated, and which anchors they start.

    ``within``: an earlier place in the same document counts; else only a smaller document does.
    """
    order = np.lexsort((packed, doc, context, anchor))
    a, c, d = anchor[order], context[order], doc[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=bool)
    new_class = new_anchor | np.concatenate([[True], c[1:] != c[:-1]]) if len(a) else new_anchor
    first = np.flatnonzero(new_class)[np.cumsum(new_class) - 1] if len(a) else order
    repeated = d > d[first]
    if within:
        p = packed[order]
        repeated |= p > p[first]
    return order, repeated, new_anchor


SEEDS = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "context", "doc", "packed")])
FOUND = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("packed", T.LongType()), T.StructField("kind", T.IntegerType())])


def seed_batch(parts: list[tuple[np.ndarray, ...]], within: bool) -> pa.RecordBatch:
    """Rows of SEEDS from (anchor, context, doc, position, count, place) arrays of one batch. Repeated ones have the
    context 0 and, as they need not meet anything, a random anchor."""
    anchor, context, doc, position, count, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), *[np.zeros(0, dtype=np.int64)] * 4)
    context[context == 0] = 1
    packed = pack(position, count, place)
    order, repeated, _ = sift(anchor, context, doc, packed, within)
    anchor, context, doc, packed = anchor[order], context[order], doc[order], packed[order]
    context[repeated] = 0
    anchor[repeated] = mix64(doc[repeated].astype(U64))
    return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(packed)], names=SEEDS.names)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by a long column, in lists of about ``most`` bytes, or more if one key has more; no key is in two lists."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column_of(batch, key).to_numpy()
        edge = int(np.searchsorted(keys, keys[-1]))
        ends = bool(held) and column_of(held[-1], key)[-1].as_py() != keys[0]
        if size + batch.nbytes > most and (edge or ends):
            yield [*held, batch.slice(0, edge)] if edge else held
            held, size = [], 0
            batch = batch.slice(edge)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield held


def found(seeds: DataFrame, within: bool) -> DataFrame:
    """Rows of FOUND: repeated occurrences, and those to be refined. One shuffle, by anchor; a task holds whole
    anchor groups of ``SIFTED`` bytes at a time."""
    most = SIFTED

    def run(batches):
        for whole in whole_groups(batches, "anchor", most):
            yield from sifted(whole)

    def sifted(whole):
        anchor, context, doc, packed = (np.concatenate([column_of(b, n).to_numpy(zero_copy_only=False) for b in whole]) for n in SEEDS.names)
        known = context == 0
        order, repeated, new_anchor = sift(anchor, context, doc, packed, within)
        group = np.cumsum(new_anchor) - 1
        changed = ~new_anchor & np.concatenate([[False], context[order][1:] != context[order][:-1]]) & ~known[order]
        several = np.zeros(int(group[-1]) + 1, dtype=bool) if len(group) else np.zeros(0, dtype=bool)
        several[group[changed]] = True
        repeated |= known[order]
        out = np.flatnonzero(repeated | several[group])
        kept = order[out]
        for a in range(0, len(kept), 100_000):
            rows = kept[a : a + 100_000]
            kind = np.where(repeated[out[a : a + 100_000]], REPEATED, REFINED).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[rows]), pa.array(doc[rows]), pa.array(packed[rows]), pa.array(kind)], names=FOUND.names)

    return seeds.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, FOUND)


def numbered(df: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one more column, a unique long in the order of doc_id (then of a hash of the text): the doc_id
    itself if no two different texts share one. A null doc_id gives a null. ``row`` must be a free name."""
    ids = df.where(F.col(doc_id).isNotNull()).select(doc_id)
    if ids.groupBy(doc_id).count().where("count > 1").isEmpty():
        return df.withColumn(row, F.col(doc_id).cast("long"))
    mark = free_name(df, "mark")
    marked = df.withColumn(mark, F.xxhash64(F.coalesce(text, F.lit(""))))
    keys = marked.where(F.col(doc_id).isNotNull()).select(doc_id, mark).distinct().orderBy(F.col(doc_id).cast("long"), mark)
    numbers = materialize(keys.withColumn(row, F.monotonically_increasing_id()), "numbers")
    return marked.join(numbers, [doc_id, mark], "left").select(*df.columns, row)
