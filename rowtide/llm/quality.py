"""Operator 8: quality by a generalised additive model with pairwise interactions.

Features of a whole text are shares, logarithms of counts and means over its bytes, words and lines. Each is
cut into quantile bins. Training is cyclic boosting: in every round, each feature in turn gets a shallow tree
on its bins, fitted to what the sum so far leaves over, and the tree's leaves are added to the feature's
lookup table. Then the pairs of features that lower the loss most on a coarse grid get tables of two
dimensions in the same way. A score is the logistic function of a sum of table entries: bin, look up, add.

Fitting takes at most ``bound`` labelled rows (chosen by a hash of doc_id if there are more); features,
binning of rows and scores cover every row. A null text is scored as an empty one, whose features are all
zero. Equal texts get equal scores. Labels that are null are left out; if a doc_id has several, the least
holds. An empty table gives an empty one; without labelled rows every score is one half. Texts of any length are
read whole. Repeated rows and null ids are kept; a null doc_id is no held-out one. Ties between cuts go to the later
feature and place. ``judge`` ignores further columns; ``score_texts`` keeps them but replaces one with the name of the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.arrow import column_of, only, slices, texts_of
from rowtide.llm.kernels import word_spans
from rowtide.llm.storage import materialize

FEATURES = ("log_words", "mean_length", "deviation", "upper", "capitals", "digits", "symbols", "doubled", "log_doubled", "bare", "log_bare", "repeats", "log_repeats", "distinct", "log_capitals", "words_per_line", "repeated_lines", "longest", "high", "stops")
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 5


def features_of(data: bytes) -> np.ndarray:
    """The features of one text, in the order of FEATURES."""
    out = np.zeros(len(FEATURES))
    start, end = word_spans(data)
    n = len(start)
    if not n:
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = _CLASS[raw]
    counts = np.bincount(kind, minlength=6)
    seen = max(1, int(counts[1:].sum()))
    letters = max(1, int(counts[2] + counts[3]))
    length = end - start
    doubled = int(((raw[1:] == raw[:-1]) & (kind[1:] == 4)).sum())
    bare = int(((length <= 2) & (kind[start] == 4)).sum())
    upper, lower = (np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in (2, 3))
    capitals = int(((upper[end] - upper[start] > 1) & (lower[end] == lower[start])).sum())
    words = data.split()
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x]
    out[:] = (
        np.log1p(n), length.mean(), length.std(), counts[2] / letters, capitals / n, counts[1] / seen, counts[4] / seen, doubled / n, np.log1p(doubled), bare / n, np.log1p(bare), repeats / n, np.log1p(repeats), len(set(words)) / n,
        np.log1p(capitals), np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(length.max()), counts[5] / seen, data.count(b".") / n,
    )
    return out


def features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and features, an array of doubles, of every row."""

    def run(batches):
        only()
        for batch in (part for whole in batches for part in slices(whole, text)):
            rows = np.array([features_of(t) for t in texts_of(batch, text)]).reshape(-1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), type=pa.int32()), pa.array(rows, type=pa.float64()))
            yield pa.RecordBatch.from_arrays([column_of(batch, doc_id), flat], names=["doc_id", "features"])

    return df.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, "doc_id long, features array<double>")


class AdditiveModel:
    """Lookup tables per feature and per chosen pair."""

    def __init__(self, rounds: int = 150, rate: float = 0.1, bins: int = 32, leaves: int = 4, pairs: int = 6, coarse: int = 8, ridge: float = 2.0):
        self.rounds, self.rate, self.bins, self.leaves, self.n_pairs, self.coarse, self.ridge = rounds, rate, bins, leaves, pairs, coarse, ridge
        self.bias, self.edges, self.tables, self.pairs = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        total = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                step = self.rate * self._tree(*self._sums(at[j], len(table), total, y), self.leaves)
                table += step
                total += step[at[j]]
        grids = [np.linspace(0, len(t), min(self.coarse, len(t)) + 1).astype(int)[1:-1] for t in self.tables]
        cell = [np.searchsorted(g, a, side="right") for g, a in zip(grids, at)]
        gains = []
        for j in range(x.shape[1]):
            for k in range(j):
                g, h = self._sums(cell[j] * self.coarse + cell[k], self.coarse**2, total, y)
                gains.append(((g**2 / (h + self.ridge)).sum(), j, k))
        for _, j, k in sorted(gains, reverse=True)[: self.n_pairs]:
            self.pairs.append((j, k, grids[j], grids[k], np.zeros((self.coarse, self.coarse))))
        for _ in range(self.rounds // 3):
            for j, k, _, _, table in self.pairs:
                where = cell[j] * self.coarse + cell[k]
                g, h = (s.reshape(table.shape) for s in self._sums(where, table.size, total, y))
                step = self.rate * self._grid_tree(g, h)
                table += step
                total += step.reshape(-1)[where]
        return self

    def _sums(self, at, size, total, y):
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    def _best(self, g, h):
        """The cut of a row of bins that gains most, and its gain."""
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
        k = int(gain.argmax())
        return gain[k], k + 1

    def _tree(self, g, h, leaves):
        """Leaf values, spread over the bins, of a tree of at most so many leaves."""
        parts = [(0, len(g))]
        while len(parts) < leaves:
            cuts = [(*self._best(g[a:b], h[a:b]), a, b) for a, b in parts if b - a > 1]
            if not cuts or max(cuts)[0] <= 1e-9:
                break
            _, k, a, b = max(cuts)
            parts.remove((a, b))
            parts += [(a, a + k), (a + k, b)]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.ridge)
        return out

    def _grid_tree(self, g, h):
        """A tree of four leaves on a grid: a cut of the axis that gains more, then a cut of each part by the other."""
        flip = self._best(g.sum(1), h.sum(1))[0] < self._best(g.sum(0), h.sum(0))[0]
        if flip:
            g, h = g.T, h.T
        k = self._best(g.sum(1), h.sum(1))[1]
        out = np.zeros(g.shape)
        for part in (slice(0, k), slice(k, None)):
            out[part] = self._tree(g[part].sum(0), h[part].sum(0), 2)
        return out.T if flip else out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        total = np.full(len(x), self.bias)
        at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for a, table in zip(at, self.tables):
            total += table[a]
        for j, k, gj, gk, table in self.pairs:
            total += table[np.searchsorted(gj, at[j], side="right"), np.searchsorted(gk, at[k], side="right")]
        return 1 / (1 + np.exp(-total))


def sample(labels: DataFrame, label: str = "quality", bound: int = 40_000) -> DataFrame:
    """doc_id and label of about ``bound`` rows of labels, all of them if there are no more."""
    marked = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.min(label).alias("label"))
    count = marked.count()
    return marked if count <= bound else marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(bound / count * (1 << 30)))


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 40_000, **options) -> AdditiveModel:
    """The model of a table of features and at most about ``bound`` rows of labels. Of different texts with one
    doc_id, the least features count: so what comes to the driver is bounded by the sample."""
    own = rows.join(F.broadcast(sample(labels, label, bound)), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("features").alias("features"))
    got = own.toPandas()
    got = got.sort_values(["doc_id"], kind="stable")
    x = np.array(got["features"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return AdditiveModel(**options).fit(x, got["label"].to_numpy(dtype=float))


def score(rows: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of a table of features."""

    def run(batches):
        only()
        for batch in batches:
            flat = column_of(batch, "features").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(model.score(flat.reshape(-1, len(FEATURES))))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def score_texts(df: DataFrame, model: AdditiveModel, to: str = "score", text: str = "text") -> DataFrame:
    """df with the score of its texts in one more column."""
    from pyspark.sql import types as T

    kept = [c for c in df.columns if c != to]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(to, T.DoubleType())])

    def run(batches):
        only()
        for batch in (part for whole in batches for part in slices(whole, text)):
            x = np.array([features_of(t) for t in texts_of(batch, text)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([column_of(batch, c) for c in kept] + [pa.array(model.score(x))], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", parts: int = 5) -> F.Column:
    """Whether the crc32 of doc_id as text is divisible by parts; false for a null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0, F.lit(False))


def fit_texts(df: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 40_000, **options) -> AdditiveModel:
    """As fit, from texts; only those of the sample have their features computed."""
    chosen = materialize(sample(labels, label, bound), "sample", small=True)
    own = df.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    return fit(features(own), chosen.withColumnRenamed("label", label), label, 2 * bound, **options)


def judge(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, parts: int = 5, bound: int = 40_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; labels of held-out rows are not read."""
    rows = materialize(features(documents), "features")
    model = fit(rows, labels.where(~held_out(parts=parts)), label, bound)
    return score(rows, model).select("doc_id", held_out(parts=parts).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
