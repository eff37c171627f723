"""Operator 3: language by bit-sliced Bloom filters of character trigrams.

Slot s of the filter is a 64-bit mask with a bit for each language; a trigram is in a language's set if the
language's bit is set in all its slots, so one AND of a few masks gives all languages that have it. A text's
masks are counted per language. A language's filter answers yes by chance with a probability that its fill
gives; the counts are corrected for that, and the largest decides. The score is its share of the sum.

A language's set holds trigrams (of letters and word borders, lower case) whose share in its own texts is
several times their mean share in all languages. It is learned from at most ``bound`` texts of each language
(about so many, chosen by a hash of doc_id and text if there are more); every text is judged whole, however long.
A text that is null or has no letter is ``und`` with score 0. Ties go to the language whose name comes first; so does
a text with no known trigram. Up to 64 languages. Repeated rows get equal results, a null doc_id is kept (and is no
held-out one), further columns, whatever their names, are ignored, and an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.arrow import column_of, cut, only, texts_of
from rowtide.llm.kernels import U64, mix64

_KEEP = np.arange(0x10000, dtype=np.uint32)
_KEEP[[c for c in range(0x10000) if not (0xD800 <= c < 0xE000) and not chr(c).isalpha()]] = 32
CHUNK = 1 << 20


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the trigrams that start at each character of each text, and the number of them per text."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer((" " + "  ".join(lower) + "   ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(code < 0x10000, _KEEP[np.minimum(code, 0xFFFF)], code).astype(np.uint64)
    key = code[:-2] | code[1:-1] << U64(21) | code[2:] << U64(42)
    sizes = np.array([len(t) + 2 for t in lower], dtype=np.int64)
    key[np.cumsum(sizes) - 1] = U64(32 | 32 << 21 | 32 << 42)  # these would reach into the next text
    return key, sizes


def _decoded(batch, text):
    return [t.decode("utf-8", "replace") for t in texts_of(batch, text)]


def trigram_counts(df: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram and n: how often each trigram starts in the texts of each language."""

    def run(batches):
        only()
        for batch in batches:
            texts, langs = _decoded(batch, text), np.array(column_of(batch, lang).to_pylist())
            for name in np.unique(langs):
                own = [texts[i] for i in np.flatnonzero(langs == name)]
                for a, b in cut([len(t) for t in own], CHUNK):
                    gram, n = np.unique(trigrams(own[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return df.select(lang, text).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """The masks, and what their fill says about chance hits."""

    def __init__(self, languages: list[str], sets: list[np.ndarray], log_slots: int = 18, hashes: int = 2):
        if len(languages) > 64:
            raise ValueError("at most 64 languages")
        self.languages, self.mask, self.hashes = languages, U64((1 << log_slots) - 1), hashes
        self.slots = np.zeros(1 << log_slots, dtype=np.uint64)
        for bit, grams in enumerate(sets):
            for at in self._at(grams):
                self.slots[np.unique(at)] |= U64(1 << bit)
        fill = np.array([(self.slots >> U64(b) & U64(1)).mean() for b in range(len(languages))])
        self.chance = fill**hashes

    def _at(self, grams):
        h = mix64(grams.astype(np.uint64) + U64(0x51ED270B))
        return [(h >> U64(k * 21) & self.mask).astype(np.int64) for k in range(self.hashes)]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Corrected counts; shape (texts, languages)."""
        key, sizes = trigrams(texts)
        first, *more = self._at(key)
        hit = self.slots[first]
        for at in more:
            hit &= self.slots[at]
        starts = np.cumsum(sizes) - sizes
        out = np.stack([np.add.reduceat((hit >> U64(b) & U64(1)).astype(np.int64), starts) for b in range(len(self.languages))], axis=1)
        return np.maximum(0, (out - sizes[:, None] * self.chance) / (1 - self.chance))


def learn(df: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", bound: int = 2_000, grams: int = 3_000, lift: float = 1.5) -> LanguageFilter:
    """The filter of df's texts; rows without a lang are left out. Counts by language (few rows) and at most
    ``grams`` trigrams a language come to the driver."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return LanguageFilter([], [])
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, min(1.0, bound / n)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 30)) < share * (1 << 30))
    n = trigram_counts(chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text")))
    shares = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    shares = shares.withColumn("mean", F.sum("p").over(Window.partitionBy("gram")) / len(sizes)).where(F.col("p") > lift * F.col("mean"))
    best = shares.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("p"), "gram"))).where(F.col("r") <= grams)
    found: dict[str, list[int]] = {name: [] for name in sorted(sizes)}
    for name, gram in best.select("lang", "gram").collect():
        found[name].append(gram)
    return LanguageFilter(list(found), [np.array(g, dtype=np.int64).view(np.uint64) for g in found.values()])


def predict(df: DataFrame, model: LanguageFilter, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row. The model is a table of fixed size (2 MB)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        only()
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            texts = _decoded(batch, text)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for a, b in cut([len(t) for t in texts], CHUNK):
                if not model.languages:
                    break
                counts = model.counts(texts[a:b])
                total = counts.sum(axis=1)
                top = counts.argmax(axis=1)
                score[a:b] = np.where(total > 0, counts[np.arange(len(top)), top] / np.maximum(total, 1e-9), 1 / len(model.languages))
                best[a:b] = top
            bare = np.array([not any(map(str.isalpha, t)) for t in texts], dtype=bool)
            best[bare], score[bare] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays([column_of(batch, doc_id), pa.array(names[best].tolist(), type=pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame, parts: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learned where crc32(doc_id as text) mod parts is not ``held``."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))
    model = learn(documents.where(~held_out), **options)
    return predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
