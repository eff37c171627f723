"""Operator 6: repeated passages of words, by seed and extend.

Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. A word is removed if it is in a window of ``size``
words whose sequence starts earlier too: in a document with a smaller doc_id, or earlier in the same one.
Documents meet on winnowed anchors (``seeds``), matches are extended both ways to the context of the anchor,
and neighbouring windows make maximal repeats. Windows are judged on the input.

A null text has no words. A row with a null doc_id is neither changed nor compared. Rows with equal doc_id
and text count as one document and get equal results; of different texts with one doc_id, the one with the
smaller xxhash64 comes first. Texts of any length are read whole. Further columns, whatever their names, are
ignored by ``remove_passages`` and kept by ``strip_passages``. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm import seeds
from rowtide.llm.arrow import column_of, cut, only, slices, texts_of
from rowtide.llm.kernels import U64, span_hashes, word_spans
from rowtide.llm.storage import free_name, materialize

CHUNK = 1 << 21


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the bounds of the texts in them."""
    data = b"\n".join(texts)
    start, end = word_spans(data)
    return span_hashes(data, start, end), np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))


def _seeds(df: DataFrame, size: int, k: int) -> DataFrame:
    def run(batches):
        only()
        for batch in batches:
            texts, rows, parts = texts_of(batch, "text"), column_of(batch, "row").to_numpy(zero_copy_only=False), []
            for a, b in cut([len(t) for t in texts], CHUNK):
                words, bounds = _words(texts[a:b])
                for low, high in seeds.segments(len(words), size) if b - a == 1 else [(0, len(words))]:
                    own = bounds if b - a > 1 else np.array([0, high - low])
                    anchor, context, text, start, count, place = seeds.occurrences(words[low:high], own, size, k)
                    parts.append((anchor, context, rows[a:b][text], start - own[text] + low, count, place))
            yield seeds.seed_batch(parts, True)

    return df.where("row is not null").select("row", "text").mapInArrow(run, seeds.SEEDS)


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """anchor (hash of a window), context 1, doc and packed of each window to be refined."""

    def run(batches):
        only()
        for batch in batches:
            data, rows, parts = texts_of(batch, "text"), column_of(batch, "row").to_pylist(), []
            for text, row, spans in zip(data, rows, column_of(batch, "spans")):
                words, _ = _words([text])
                position, count = seeds.unpack(spans.values.to_numpy())
                start = np.concatenate([np.arange(p, p + c) for p, c in zip(position.tolist(), count.tolist())])
                low = int(start.min())
                hashes = seeds.Spans(words[low : int(start.max()) + size])
                parts.append((hashes.hash(start - low, start - low + size), np.ones(len(start), dtype=U64), np.full(len(start), row), start, np.ones(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)))
            yield seeds.seed_batch(parts, True)

    return texts.mapInArrow(run, seeds.SEEDS)


def repeated_windows(rows: DataFrame, size: int = 20, k: int = 8) -> DataFrame:
    """row and spans, for each row with repeated windows: packed runs of their starts."""
    first = materialize(seeds.found(_seeds(rows, size, k), True), "seeds")
    wanted = first.where(F.col("kind") == seeds.REFINED).groupBy(F.col("doc").alias("row")).agg(F.collect_list("packed").alias("spans"))
    texts = rows.join(wanted, "row")
    second = materialize(seeds.found(_windows(texts.select("row", "text", "spans"), size), True), "windows")
    both = first.where(F.col("kind") == seeds.REPEATED).select("doc", "packed").union(second.select("doc", "packed"))
    return both.groupBy(F.col("doc").alias("row")).agg(F.collect_list("packed").alias("spans"))


def covered(n: int, spans, size: int) -> np.ndarray:
    """Which of n elements a repeated window covers."""
    mark = np.zeros(n + 1, dtype=np.int32)
    if spans is not None and len(spans):
        position, count = seeds.unpack(np.asarray(spans))
        np.add.at(mark, position, 1)
        np.add.at(mark, position + count + size - 1, -1)
    return np.cumsum(mark)[:n] > 0


def remove_passages(df: DataFrame, size: int = 20, k: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay joined by single spaces (binary), of every row."""
    rows = seeds.numbered(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "row")
    spans = repeated_windows(rows, size, k)

    def run(batches):
        only()
        for batch in (part for whole in batches for part in slices(whole, "text", CHUNK)):
            total, removed, kept = [], [], []
            for data, own in zip(texts_of(batch, "text"), column_of(batch, "spans")):
                words = data.split()
                gone = covered(len(words), own.values.to_numpy() if own.is_valid else None, size)
                total.append(len(words)), removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(total, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(kept, type=pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def strip_passages(df: DataFrame, size: int = 20, k: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its repeated passages removed from the texts: a text that loses words has the others joined by
    single spaces, any other stays as it is. All rows and columns stay."""
    row, marks, names = free_name(df, "row"), free_name(df, "spans"), df.columns
    rows = seeds.numbered(df, row, doc_id, text)
    plain = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
    spans = repeated_windows(plain, size, k).select(F.col("row").alias(row), F.col("spans").alias(marks))

    def run(batches):
        only()
        for batch in (part for whole in batches for part in slices(whole, text, CHUNK)):
            out = []
            for data, own in zip(texts_of(batch, text), column_of(batch, marks)):
                if not own.is_valid:
                    out.append(data)
                    continue
                words = data.split()
                gone = covered(len(words), own.values.to_numpy(), size)
                out.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
            kept = pa.array([o.decode() for o in out], type=pa.string(), mask=column_of(batch, text).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([kept if c == text else column_of(batch, c) for c in names], names=names)

    return rows.join(spans, row, "left").select(*df.columns, marks).mapInArrow(run, df.schema)
