"""Operator 7: repeated byte strings, by merging Burrows-Wheeler transforms of shards.

A byte is removed if a string of ``size`` bytes that covers it also starts in a document with a smaller
doc_id. Where strings repeat is found in two steps. Winnowed anchors of all documents (``seeds``) leave only
those contexts, a few dozen bytes each, that meet another context with the same anchor but not the same
bytes. These go, by anchor, into collections, whose suffixes are sorted as follows. Each shard of a
collection gets its suffix order and transform. Two transforms are merged by interleave refinement: the
interleave is a bit vector that says which shard each merged symbol comes from; sorting it stably by the
merged symbols orders it by one more symbol, and after as many rounds as a string has symbols it is exact.
Where neighbours part in round h, their common prefix is h - 1 long; so rounds also give the common prefixes,
and runs of neighbours that never part in ``size`` rounds are the repeated strings. No suffix is compared
with another, and shards are sorted only within themselves.

A null text is empty. A row with a null doc_id is neither changed nor compared. Rows with equal doc_id and
text count as one document; of different texts with one doc_id, the one with the smaller xxhash64 comes first.
Texts of any length are read whole. Further columns, whatever their names, are ignored. An empty table gives an
empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm import seeds
from rowtide.llm.arrow import binary_array, column_of, cut, only, ragged, slices, texts_of
from rowtide.llm.kernels import U64, mix64
from rowtide.llm.passages import covered
from rowtide.llm.storage import materialize

CHUNK = 1 << 20
_TABLE = mix64(np.arange(256, dtype=U64) + U64(0xA5A5A5A5))


# -- transforms ---------------------------------------------------------------------------------------------


def suffix_order(strings: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes of strings laid end to end (each ends before end[i], its terminator's place).

    strings are symbols 1 to 256 with 0 as terminator; terminators sort by their strings' numbers. Prefix
    doubling: ranks of 2h symbols are ranks of pairs of ranks of h symbols.
    """
    n = len(strings)
    rank = strings.astype(np.int64) + len(end)
    rank[end] = np.arange(len(end))
    h = 1
    while True:
        second = np.concatenate([rank[h:], np.zeros(min(h, n), dtype=np.int64)])[:n]
        key = rank * (n + 257 + len(end)) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2


class Shard:
    """Suffix order and transform of a collection of strings; ``end`` marks their terminators."""

    def __init__(self, strings: np.ndarray, end: np.ndarray):
        self.order = suffix_order(strings, end)
        self.transform = strings[self.order - 1]
        starts = np.concatenate([[0], end[:-1] + 1])
        first = np.zeros(len(strings), dtype=bool)
        first[starts] = True
        self.transform = np.where(first[self.order], 0, self.transform).astype(strings.dtype)


def interleave(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of two transforms (False: a) of n_a and n_b strings, and whether each place in it starts
    a new common prefix of ``depth`` symbols: refined in ``depth`` rounds.

    The terminators are kept in the order of the strings, a before b. They sort first and each parts from its
    neighbours in the first round, so a string that ends before ``depth`` symbols stands alone.
    """
    bit = np.concatenate([np.zeros(len(a), dtype=bool), np.ones(len(b), dtype=bool)])
    new = np.zeros(len(bit), dtype=bool)
    new[0] = True
    total = n_a + n_b
    merged = np.empty(len(bit), dtype=np.promote_types(a.dtype, b.dtype))
    for _ in range(depth):
        merged[~bit], merged[bit] = a, b
        order = np.argsort(merged, kind="stable")
        symbol = merged[order]
        block = np.cumsum(new)[order]
        part = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])])
        part[:total] = True
        if total < len(part):
            part[total] = True
        bit = bit[order]
        bit[:total] = np.arange(total) >= n_a
        new = part
    return bit, new


def repeated_strings(shards: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """string number, offset and class of every suffix of the shards' strings in sorted order: suffixes of one
    class share their first ``size`` bytes; those shorter than that are alone. Shards are merged two by two."""
    level = []
    number = 0
    for strings in shards:
        lengths = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        flat = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.uint16) + 1
        if flat.max() < 256:  # UTF-8 has no byte 255, and narrow symbols sort faster
            flat = flat.astype(np.uint8)
        end = np.cumsum(lengths) - 1
        flat[end] = 0
        shard = Shard(flat, end)
        which = np.searchsorted(end, shard.order)
        level.append((shard.transform, len(strings), number + which, shard.order - (end - lengths + 1)[which]))
        number += len(strings)
    new = np.zeros(0, dtype=bool)
    if len(level) == 1:
        level.append((np.zeros(0, dtype=np.uint8), 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
    while len(level) > 1:
        merged = []
        for i in range(0, len(level) - 1, 2):
            (a, n_a, string_a, offset_a), (b, n_b, string_b, offset_b) = level[i], level[i + 1]
            # all but the last merge need the exact order, so they refine over the longest string
            longest = int(max(offset_a.max(initial=0), offset_b.max(initial=0))) + 1
            bit, new = interleave(a, b, n_a, n_b, size if len(level) == 2 else longest)
            both = [np.empty(len(bit), dtype=np.promote_types(x.dtype, y.dtype)) for x, y in zip((a, string_a, offset_a), (b, string_b, offset_b))]
            for out, x, y in zip(both, (a, string_a, offset_a), (b, string_b, offset_b)):
                out[~bit], out[bit] = x, y
            merged.append((both[0], n_a + n_b, both[1], both[2]))
        level = merged + level[len(level) - len(level) % 2 :]
    return level[0][2], level[0][3], np.cumsum(new) - 1


# -- the operator --------------------------------------------------------------------------------------------


def _seeds(df: DataFrame, size: int, k: int) -> DataFrame:
    def run(batches):
        only()
        for batch in batches:
            parts = []
            for piece in slices(batch, "text", CHUNK):
                texts, rows = texts_of(piece, "text"), column_of(piece, "row").to_numpy(zero_copy_only=False)
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                bounds = np.cumsum([0] + [len(t) for t in texts])
                for low, high in seeds.segments(len(data), size) if len(texts) == 1 else [(0, len(data))]:
                    own = bounds if len(texts) > 1 else np.array([0, high - low])
                    anchor, context, text, start, count, place = seeds.occurrences(_TABLE[data[low:high]], own, size, k)
                    parts.append((anchor, context, rows[text], start - own[text] + low, count, place))
            yield seeds.seed_batch(parts, False)

    return df.where("row is not null").select("row", "text").mapInArrow(run, seeds.SEEDS)


def _contexts(texts: DataFrame, size: int) -> DataFrame:
    """anchor, doc, packed and the bytes of each context to be refined."""

    def run(batches):
        only()
        for batch in (part for whole in batches for part in slices(whole, "text", 2 * CHUNK)):
            data = texts_of(batch, "text")
            spans, anchors = column_of(batch, "spans"), column_of(batch, "anchors")
            counts = pc.list_value_length(spans).to_numpy()
            packed = spans.flatten().to_numpy()
            begin = np.cumsum([0] + [len(t) for t in data])[:-1]
            position, count = seeds.unpack(packed)
            length = count + size - 1
            flat = np.frombuffer(b"".join(data), dtype=np.uint8)[ragged(position + np.repeat(begin, counts), length)]
            row = np.repeat(column_of(batch, "row").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([anchors.flatten(), pa.array(row), pa.array(packed), binary_array(flat, np.concatenate([[0], np.cumsum(length)]))], names=["anchor", "doc", "packed", "context"])

    return texts.mapInArrow(run, "anchor long, doc long, packed long, context binary")


def alive(anchor: np.ndarray, doc: np.ndarray, packed: np.ndarray, begin: np.ndarray, flat: np.ndarray, size: int, k: int, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The first and last start of each context that can be repeated in another document; none if last < first.

    All windows whose anchor is from a to b bytes after their start have the bytes from a before the anchor to
    size - b after it in common. If no other document has these there, it has none of the windows.
    """
    _, count = seeds.unpack(packed)
    place = packed >> 6 & 63
    steps = [(a, min(a + width - 1, size - k)) for a in range(0, size - k + 1, width)]
    reach = [(np.maximum(0, place - b), np.minimum(count - 1, place - a)) for a, b in steps]
    hashes = np.zeros((len(steps), len(anchor)), dtype=U64)
    # range hashes need dozens of bytes for each of the contexts', so they are made of a few contexts at a time
    edges = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(flat), CHUNK)), len(begin)))
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        origin = begin[start]
        spans = seeds.Spans(_TABLE[flat[origin : begin[stop] if stop < len(begin) else len(flat)]])
        for (a, b), (low, high), key in zip(steps, reach, hashes):
            own = start + np.flatnonzero(low[start:stop] <= high[start:stop])
            at = begin[own] - origin + place[own]
            key[own] = mix64(spans.hash(at - a, at + size - b) ^ anchor[own].view(U64))
    first, last = np.full(len(anchor), 1 << 30), np.full(len(anchor), -1)
    for (low, high), hashed in zip(reach, hashes):
        own = np.flatnonzero(low <= high)
        key = hashed[own]
        order = np.lexsort((doc[own], key))
        group = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if len(own) else own
        edge = np.flatnonzero(np.diff(group, prepend=-1)) if len(own) else own
        sorted_doc = doc[own][order]
        several = sorted_doc[edge] != sorted_doc[np.append(edge[1:], len(own)) - 1] if len(own) else np.zeros(0, dtype=bool)
        hit = own[order[several[group]]] if len(own) else own
        first[hit], last[hit] = np.minimum(first[hit], low[hit]), np.maximum(last[hit], high[hit])
    return first, last


def _refined(contexts: DataFrame, size: int, k: int, collection: int, shard: int) -> DataFrame:
    """Packed runs of the starts in the contexts whose strings are in a smaller document; one shuffle, by anchor. A
    task holds whole anchor groups of two collections' bytes at a time."""

    def judge(doc, position, context):
        """Starts that are repeated, of contexts with whole anchor groups."""
        shards = [context[a:b] for a, b in cut([len(c) for c in context], shard)]
        string, offset, group = repeated_strings(shards, size)
        d = doc[string]
        least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, d)
        hit = d > least[group]
        return d[hit], seeds.pack(position[string[hit]] + offset[hit], np.ones(int(hit.sum()), dtype=np.int64))

    def run(batches):
        only()
        for whole in seeds.whole_groups(batches, "anchor", 2 * collection):
            yield from refined(whole)

    def refined(whole):
        anchor, doc, packed = (np.concatenate([column_of(b, n).to_numpy(zero_copy_only=False) for b in whole]) for n in ("anchor", "doc", "packed"))
        flat = np.frombuffer(b"".join(c for b in whole for c in column_of(b, "context").to_pylist()), dtype=np.uint8)
        length = np.concatenate([pc.binary_length(column_of(b, "context")).to_numpy() for b in whole])
        begin = np.cumsum(length) - length
        first, last = alive(anchor, doc, packed, begin, flat, size, k)
        order = np.flatnonzero(first <= last)
        order = order[np.argsort(anchor[order], kind="stable")]
        if not len(order):
            return
        position = seeds.unpack(packed)[0] + first
        begin, end = begin + first, begin + last + size
        filled = np.cumsum((end - begin)[order] + 1)
        edges = np.append(np.flatnonzero(np.diff(anchor[order])) + 1, len(order))
        at = 0
        while at < len(order):  # collections of whole anchor groups
            room = np.searchsorted(filled, (filled[at - 1] if at else 0) + collection, side="right")
            fit = np.searchsorted(edges, room, side="right") - 1
            stop = int(edges[fit]) if fit >= 0 and edges[fit] > at else int(edges[np.searchsorted(edges, at, side="right")])
            own = order[at:stop]
            d, p = judge(doc[own], position[own], [flat[a:b].tobytes() for a, b in zip(begin[own].tolist(), end[own].tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p)], names=["doc", "packed"])
            at = stop

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc long, packed long")


def repeated_starts(rows: DataFrame, size: int = 50, k: int = 20, collection: int = 2 << 20, shard: int = 1 << 20) -> DataFrame:
    """row and spans, for each row with repeated strings: packed runs of their starts."""
    first = materialize(seeds.found(_seeds(rows, size, k), False), "seeds")
    wanted = first.where(F.col("kind") == seeds.REFINED).groupBy(F.col("doc").alias("row")).agg(F.collect_list(F.struct("anchor", "packed")).alias("s")).select("row", F.col("s.anchor").alias("anchors"), F.col("s.packed").alias("spans"))
    second = materialize(_refined(_contexts(rows.join(wanted, "row").select("row", "text", "spans", "anchors"), size), size, k, collection, shard), "strings")
    both = first.where(F.col("kind") == seeds.REPEATED).select("doc", "packed").union(second)
    return both.groupBy(F.col("doc").alias("row")).agg(F.collect_list("packed").alias("spans"))


def remove_repeats(df: DataFrame, size: int = 50, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary) of every row."""
    rows = seeds.numbered(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "row")
    spans = repeated_starts(rows, size, **options)

    def run(batches):
        only()
        for batch in (part for whole in batches for part in slices(whole, "text", 2 * CHUNK)):
            removed, runs, kept = [], [], []
            texts = texts_of(batch, "text")
            for data, own in zip(texts, column_of(batch, "spans")):
                gone = covered(len(data), own.values.to_numpy() if own.is_valid else None, size)
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes() if removed[-1] else data)
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(runs, type=pa.int64()), pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
