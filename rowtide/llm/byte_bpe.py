"""Operator 4: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a tokenizers model: every byte has a printable character, every token is a string of
such characters, and each way to put a token together from two others is a merge with that token's rank.
Texts are cut before every run of ASCII white space. No match of the split
pattern crosses such a cut, so the pieces can be encoded apart and kept in a bounded cache; a text with
other white space is encoded whole. Decoding reverses the byte table; offsets follow from token lengths,
as tokens tile the bytes of their text.

Null and empty texts have no ids; long texts are encoded whole, in slices of pieces. Repeated rows, ties, null ids
and further columns are kept as they are, but a column with the name of a result column is replaced by it, as
``withColumn`` does. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import codecs
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.llm.arrow import CACHES, binary_array, only, ragged, slices, texts_of
from rowtide.llm.kernels import word_spans
from rowtide.llm.tokens import PieceCache, in_groups, load_tokenizer, one_by_one, per_text

#: White space beyond ASCII, in UTF-8.
OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
CHUNK_BYTES = 1 << 20
JOINED = 2_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def model_json(tokens: list[bytes], pattern: str) -> str:
    """The tokenizers model of a rank list: all two-part splits of each token are merges, in rank order."""
    letters = byte_characters()
    text = {t: "".join(letters[b] for b in t) for t in tokens if t}
    merges = []
    for token in tokens:
        if len(token) > 1:
            merges += [[text[token[:i]], text[token[i:]]] for i in range(1, len(token)) if token[:i] in text and token[i:] in text]
    vocab = {text[t]: i for i, t in enumerate(tokens) if t}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": vocab, "merges": merges},
    })


def space_pieces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one, starts and ends of their pieces, and the number of the first piece of each text (and of all).
    A piece is a word with the ASCII white space before it, or the white space at the end of a text."""
    data = b"\n".join(texts)
    word, end = word_spans(data)
    low = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(word, low)
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    opens = np.flatnonzero(first[:-1] < first[1:])
    start[first[opens]] = low[opens]
    last = low[:-1].copy()
    last[opens] = end[first[opens + 1] - 1]
    tail = np.flatnonzero(last < low[1:] - 1)
    at = first[tail + 1]
    return data, np.insert(start, at, last[tail]), np.insert(end, at, low[tail + 1] - 1), first + np.concatenate([[0], np.cumsum(last < low[1:] - 1)])


class ByteBPE:
    """Encoder and decoder of one worker."""

    def __init__(self, tokens: list[bytes], model: str):
        self.model, self.tokenizer = model, None
        self.cache = PieceCache(self.encode_pieces)
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def encode_batch(self, texts, **options):
        if self.tokenizer is None:
            self.tokenizer = load_tokenizer(self.model)
        return self.tokenizer.encode_batch_fast(texts, **options)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with a space go in one text: what precedes a space does not change what follows."""
        space = [p[:1] == b" " for p in pieces]
        return in_groups(pieces, [([i for i, s in enumerate(space) if s], self.encode_joined), ([i for i, s in enumerate(space) if not s], lambda own: one_by_one(self.encode_batch, own))])

    def encode_joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.encode_batch([b"".join(g).decode("utf-8", "surrogatepass") for g in groups], add_special_tokens=False)])
        ends = np.cumsum(self.length[ids])
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))))
        return ids, np.diff(last, prepend=-1)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        odd = [i for i, t in enumerate(texts) if OTHER_SPACE.search(t)]
        if not odd:
            data, start, end, first = space_pieces(texts)
            ids, lengths = self.cache.encode_spans(data, start, end)
            return ids, per_text(lengths, first)
        got = [one_by_one(self.encode_batch, [t])[0] if i in odd else self.encode([t])[0] for i, t in enumerate(texts)]
        return np.concatenate(got), np.array([len(g) for g in got], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the number of bytes of each id."""
        length = self.length[ids]
        return self.flat[ragged(self.start[ids], length)], length

    def offsets(self, data: bytes, ids: np.ndarray) -> np.ndarray:
        """For each id the first character it touches and the one after its last; shape (ids, 2).

        A token inside a character covers the whole character, as do its neighbours there.
        """
        end = np.cumsum(self.length[ids])
        begins = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
        return np.stack([begins[end - self.length[ids]] - 1, begins[end - 1]], axis=1) if len(ids) else np.zeros((0, 2), dtype=np.int64)

    def decode_stream(self, ids: Iterator[int]) -> Iterator[str]:
        """The text that each id completes: a character split over ids comes with the last of them."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.flat[self.start[i] : self.start[i] + self.length[i]].tobytes())
        if rest := decoder.decode(b"", True):
            yield rest


_loaded: dict[str, ByteBPE] = {}
CACHES.append(_loaded)


def _worker(shared) -> ByteBPE:
    key, tokens, model = shared.value
    only(_loaded)
    if key not in _loaded:
        _loaded[key] = ByteBPE(tokens, model)
    return _loaded[key]


def share(spark, ranks_path: str, pattern: str):
    """The model for the workers: a broadcast of the vocabulary file's size (about 1 MB; it does not grow with data)."""
    tokens = read_ranks(ranks_path)
    return spark.sparkContext.broadcast((f"{ranks_path}\0{pattern}", tokens, model_json(tokens, pattern)))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "ids", with_offsets: bool = False) -> DataFrame:
    """df with a binary column of ids, little-endian unsigned 32-bit; with_offsets adds ``<to>_offsets``,
    the character span [start, end) of each id as an array of two-element arrays."""
    shared = share(df.sparkSession, ranks_path, pattern)
    kept = [c for c in df.columns if c not in (to, f"{to}_offsets")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(to, T.BinaryType())] + [T.StructField(f"{to}_offsets", T.ArrayType(T.ArrayType(T.LongType())))] * with_offsets)

    def run(batches):
        bpe = _worker(shared)
        for batch in (part for whole in batches for part in slices(whole, text, CHUNK_BYTES)):
            texts = texts_of(batch, text)
            ids, counts = bpe.encode(texts)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept] + [binary_array(ids.astype("<u4").view(np.uint8), bounds * 4)]
            if with_offsets:
                columns.append(pa.array([bpe.offsets(t, ids[a:b]).tolist() for t, a, b in zip(texts, bounds[:-1], bounds[1:])], type=pa.list_(pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df without its text, with its ids and the bytes they stand for, both made in one pass by one worker."""
    shared = share(df.sparkSession, ranks_path, pattern)
    kept = [c for c in df.columns if c not in (text, ids, decoded)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])

    def run(batches):
        bpe = _worker(shared)
        for batch in (part for whole in batches for part in slices(whole, text, CHUNK_BYTES)):
            flat, counts = bpe.encode(texts_of(batch, text))
            data, length = bpe.decode(flat)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            sums = np.concatenate([[0], np.cumsum(length)])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept] + [binary_array(flat.astype("<u4").view(np.uint8), bounds * 4), binary_array(data, sums[bounds])], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that ids stand for; a null is empty. Ids cut inside a character
    give the bytes there are: ``decode_text`` shows what is left of it as U+FFFD."""
    shared = share(df.sparkSession, ranks_path, pattern)
    kept = [c for c in df.columns if c != to]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(to, T.BinaryType())])

    def run(batches):
        bpe = _worker(shared)
        for batch in (part for whole in batches for part in slices(whole, ids, CHUNK_BYTES)):
            raw = texts_of(batch, ids)
            flat = np.frombuffer(b"".join(raw), dtype="<u4")
            data, length = bpe.decode(flat)
            sums = np.concatenate([[0], np.cumsum(length)])
            bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept] + [binary_array(data, sums[bounds])], names=schema.names)

    return df.mapInArrow(run, schema)


def decode_text(column) -> F.Column:
    """A decoded binary column as text, incomplete characters as U+FFFD."""
    return F.decode(column, "UTF-8")
