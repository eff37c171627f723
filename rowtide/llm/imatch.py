"""Operator 10: document fingerprints by I-Match with several randomised lexicons.

Terms are words with A-Z lower-cased. The lexicon holds the terms whose share of different texts lies in a band, so
that it leaves out both the terms that are everywhere and those of a few documents. As each lexicon term is in
``low`` of the different texts at least, there are at most (mean distinct terms of a text) / low of them, however
many texts there are. The band does not change with the table; a lexicon of over ``most`` terms is an error.

A fingerprint hashes the sorted distinct lexicon terms of a text, then those of them in each of several random
sub-lexicons that keep one term in 1, 2, 4, ... 1024. Two texts agree on a sub-lexicon of share p if none of the
D terms they differ in is in it, so with probability (1 - p)**D: the most likely D, against the texts' numbers
of terms, is their likeness 1 - D / (m + n). It is 1 if and only if the fingerprints are equal. All terms of a
text without lexicon terms count, and two texts without terms are alike.

A null text is an empty one; texts of any length are read whole. Documents with equal doc_id follow each other by
text, so repeated rows are each other's next document; a null doc_id comes first. Further columns, whatever their
names, are ignored, and an empty table gives an empty one. Of equally likely D (ties) the smaller holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.arrow import column_of, cut, only, texts_of
from rowtide.llm.kernels import U64, mix64, span_hashes, word_spans
from rowtide.llm.storage import materialize

LEVELS, EACH = 11, 12
#: Share of each sub-lexicon: all terms once, then EACH of every other level.
SHARES = np.array([1.0] + [2.0**-k for k in range(1, LEVELS) for _ in range(EACH)])
_SEEDS = mix64(np.arange(1, len(SHARES) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LIMITS = np.array([min(2**64 - 1, int(p * 2**64)) for p in SHARES], dtype=U64)
GRID = np.concatenate([[0.0], np.geomspace(0.002, 1, 60)])
CHUNK = 1 << 20
FLUSH = 1_000_000


def terms_of(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct term hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in cut([len(t) for t in texts], CHUNK):
        data = b"\n".join(texts[a:b]).lower()
        start, end = word_spans(data)
        hashes = span_hashes(data, start, end)
        bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts[a:b]]))
        out += [np.unique(hashes[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
    return out


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """term (a 64-bit hash) and df, the number of rows that have it. Tasks add up what they read before they send it on."""

    def run(batches):
        only()
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merge():
            term, inverse = np.unique(np.concatenate(held), return_inverse=True)
            return term, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        def send():
            term, n = merge()
            held.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "df"])

        for batch in batches:
            texts = texts_of(batch, text)
            for a, b in cut([len(t) for t in texts], 8 * CHUNK):
                term, n = np.unique(np.concatenate(terms_of(texts[a:b])), return_counts=True)
                held.append(term), counts.append(n)
                if sum(map(len, held)) > 2 * FLUSH:
                    term, n = merge()
                    held[:], counts[:] = [term], [n]
                    if len(term) > FLUSH:
                        yield send()
        if held:
            yield send()

    return df.select(text).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each different text (by hash); only rows of repeated texts are shuffled whole."""
    rows = df.select(text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash"))
    repeated = materialize(rows.groupBy("__hash").count().where("count > 1").select("__hash"), "repeated", small=True)
    again = rows.join(repeated, "__hash", "left_semi").dropDuplicates(["__hash"])
    return rows.join(repeated, "__hash", "left_anti").select(text).union(again.select(text))


def lexicon(df: DataFrame, low: float = 0.0005, high: float = 0.1, most: int = 2_000_000, text: str = "text") -> np.ndarray:
    """The sorted term hashes of the band [low, high] of shares of different texts; at most ``most``, so 16 MB."""
    df = distinct_texts(df, text)
    total = df.count()
    counted = materialize(document_frequencies(df, text).where(F.col("df") >= max(2, int(low * total))), "frequencies")
    band = counted.where(F.col("df") <= max(2, int(high * total)))
    if (n := band.count()) > most:
        raise ValueError(f"the band has {n} terms; raise low or most")
    return np.sort(np.array([r[0] for r in band.select("term").toLocalIterator()], dtype=np.int64).view(np.uint64))


def sub_hashes(terms: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 16-bit hash for each text and sub-lexicon (0: no term), and the number of terms of each text that count."""
    out = np.zeros((len(terms), len(SHARES)), dtype=np.uint16)
    count = np.zeros(len(terms), dtype=np.int64)
    for i, own in enumerate(terms):
        if len(words) and len(own):
            held = own[words[np.minimum(np.searchsorted(words, own), len(words) - 1)] == own]
            own = held if len(held) else own
        count[i] = len(own)
        if len(own):
            drawn = mix64(own[None, :] ^ _SEEDS[:, None])
            kept = drawn <= _LIMITS[:, None]
            value = mix64(np.where(kept, mix64(drawn + U64(1)), U64(0)).sum(axis=1, dtype=U64))
            out[i] = np.where(kept.any(axis=1), (value >> U64(48)) | U64(1), U64(0)).astype(np.uint16)
    return out, count


def likeness(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each pair of rows, from their sub-lexicon hashes and numbers of terms."""
    same = a == b
    total = (m + n)[:, None] * GRID[None, :]
    level = np.concatenate([same[:, 1:].reshape(len(a), LEVELS - 1, EACH).sum(2)], axis=1)
    logs = np.log1p(-(2.0 ** -np.arange(1, LEVELS)))
    stay = total[:, :, None] * logs[None, None, :]
    score = (level[:, None, :] * stay + (EACH - level[:, None, :]) * np.log(np.maximum(1e-12, -np.expm1(stay)))).sum(2)
    best = 1 - GRID[score[:, 1:].argmax(axis=1) + 1]
    return np.where(same.all(axis=1), 1.0, np.minimum(best, 1 - GRID[1]))


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, guest, doc_id, text) dealt by doc_id range and sorted: each part is followed by a guest, the
    row after its last one (the first row of all after the last). One shuffle of the texts."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    least, nulls, marks = rows.agg(F.min("doc_id"), F.max(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()
    starts = sorted({m for m in marks or [] if m > least or nulls})
    array = F.array(*map(F.lit, starts)) if starts else F.array().cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(array, lambda s: s <= F.col("doc_id"))), F.lit(0))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(part)
    first = F.col("doc_id").isNull() if nulls else F.coalesce(F.col("doc_id") == least, F.lit(False))
    before = F.when(F.col("doc_id").isin(starts) if starts else F.lit(False), part - 1)
    homes = F.filter(F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.struct(before.alias("part"), F.lit(True).alias("guest")), F.struct(F.when(first, len(starts)).alias("part"), F.lit(True).alias("guest"))), lambda h: h["part"].isNotNull())
    dealt = rows.select(F.explode(homes).alias("h"), "doc_id", "text").select("h.part", "h.guest", "doc_id", "text")
    return dealt.repartitionById(len(starts) + 1, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")


def fingerprint_edits(df: DataFrame, words: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of each text, of the text edited with the next document's start, and their likenesses."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def texts_hex(values, count):
        return [f"{c:08x}{row.tobytes().hex()}" for c, row in zip(count.tolist(), values.astype(">u2"))]

    def work(ids, texts):
        """All rows but the last, which is only the next one."""
        own = [t.decode("utf-8", "replace") for t in texts]
        size = [len(t) for t in own]
        edited = [(a[: n - n // 4] + b[: n // 4]).encode() for a, b, n in zip(own, own[1:], size)]
        a, m = sub_hashes(terms_of(texts), shared.value)
        b, n = sub_hashes(terms_of(edited), shared.value)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:-1], type=pa.int64()), pa.array(size[:-1], type=pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(texts_hex(a[:-1], m[:-1])), pa.array(texts_hex(b, n)), pa.array(likeness(a[:-1], m[:-1], b, n)), pa.array(likeness(a[:-1], m[:-1], a[1:], m[1:]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        only()
        ids, texts, done = [], [], False
        for batch in batches:
            if done:
                continue
            guest = column_of(batch, "guest").to_pylist()
            stop = guest.index(True) + 1 if True in guest else len(guest)
            done = True in guest
            ids += column_of(batch, "doc_id").to_pylist()[:stop]
            texts += texts_of(batch, "text")[:stop]
            for a, b in cut([len(t) for t in texts[:-1]], 4 * CHUNK):
                yield work(ids[a : b + 1], texts[a : b + 1])
            ids, texts = ids[-1:], texts[-1:]

    return with_next(df, doc_id, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
