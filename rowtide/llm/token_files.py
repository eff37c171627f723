"""Operator 9: token ids as flat unsigned integer files with 64-bit document offsets.

Format of a folder: for part n (five digits at least), ``n.ids`` holds the ids of the part's documents one
after another (little-endian, 16 bits if the vocabulary fits, else 32), ``n.offsets`` has one 64-bit integer
more than documents: where each starts in the part, in ids, and the end; ``n.docs`` has their 64-bit doc_id
(a null is -2**63). Parts are in ascending doc_id order, nulls first, as are documents in a part; equal doc_ids go
by the xxhash64 of the text, so no id, not even null, has to fit in one part. A part's base, the number of ids before it, is the prefix sum over the parts' counts, which are in
the table ``manifest``. Readers map files into memory where the folder is local or mounted.

A task writes under a name of its own attempt and renames at the end, so a task run twice leaves one part.
Null and empty texts have just the end id; texts of any length are written whole. Ids are those of the library,
added tokens found in texts (such as an end-of-text mark) included. Repeated rows are written as often as they come.
Further columns, whatever their names, are ignored. An empty table has an empty manifest and no parts.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.arrow import CACHES, binary_array, column_of, cut, only, slices, texts_of
from rowtide.llm.kernels import word_spans
from rowtide.llm.storage import write
from rowtide.llm.tokens import PieceCache, in_groups, load_tokenizer, one_by_one, per_text

NULL_ID = -(2**63)
CHUNK_BYTES = 1 << 20
_loaded: dict[str, PieceCache] = {}
CACHES.append(_loaded)


def filesystem(uri: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_END = np.zeros(256, dtype=bool)
_END[list(b".,!?;:")] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True


def word_pieces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts in one, starts and ends of their pieces, and the number of the first piece of each text
    (and of all). End punctuation after a letter or digit of ASCII is a piece of its own: the tokenizer cuts there."""
    data = b"\n".join(texts).lower()
    start, end = word_spans(data)
    raw = np.frombuffer(data, dtype=np.uint8)
    middle = end.copy()
    for _ in range(4):
        middle -= (middle > start) & _END[raw[np.maximum(middle - 1, 0)]]
    cut_here = np.flatnonzero((middle > start) & (middle < end) & _ALNUM[raw[np.maximum(middle - 1, 0)]])
    first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
    first += np.searchsorted(cut_here, first)
    return data, np.insert(start, cut_here + 1, middle[cut_here]), np.insert(end, cut_here, middle[cut_here]), first


_PLAIN = re.compile(rb"[a-z]+").fullmatch
JOINED = 2_000


def _cache(shared) -> PieceCache:
    key, model = shared.value
    only(_loaded)
    if key not in _loaded:
        from tokenizers import normalizers, pre_tokenizers

        whole, bare = load_tokenizer(model), load_tokenizer(model)
        whole.encode_special_tokens = bare.encode_special_tokens = True
        # of words of a to z alone, normalising changes nothing and splitting makes one token list each
        bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        suffix = json.loads(model)["model"].get("end_of_word_suffix")
        vocab = bare.get_vocab()
        ends = np.zeros(1 + max(vocab.values()), dtype=bool)
        ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

        def each(pieces):
            return one_by_one(whole.encode_batch_fast, pieces)

        def joined(pieces, by=bare):
            """Words of letters in one text; the end of word in the vocabulary tells them apart again."""
            groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in by.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)])
            last = np.flatnonzero(ends[ids])
            return (ids, np.diff(last, prepend=-1)) if len(last) == len(pieces) and last[-1] == len(ids) - 1 else each(pieces)

        def encode(pieces):
            kind = [0 if _PLAIN(p) else 1 if p.decode("utf-8", "surrogatepass").isalpha() else 2 for p in pieces]
            own = [[i for i, k in enumerate(kind) if k == n] for n in range(3)]
            return in_groups(pieces, [(own[0], joined), (own[1], lambda words: joined(words, whole)), (own[2], each)])

        _loaded[key] = PieceCache(encode)
        library = load_tokenizer(model)
        _loaded[key].library = library
        _loaded[key].added = [t.content.lower().encode() for t in library.get_added_tokens_decoder().values()]
    return _loaded[key]


def write_tokens(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Write df's texts under the folder and return the manifest: part, n_docs, n_tokens, width in bytes.

    For lower-casing tokenizers that drop white space and never join words over it: words are encoded apart,
    through a bounded cache. One shuffle, by doc_id range.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    shared = spark.sparkContext.broadcast((tokenizer_path, model))  # a vocabulary file; it does not grow with data
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1) <= 65536 else 4
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    dealt = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order, "text")

    def run(batches):
        context = TaskContext.get()
        part, cache = context.partitionId(), _cache(shared)
        store, root = filesystem(folder)
        names = ("ids", "offsets", "docs")
        temporary = [f"{root}/.{part:05d}.{n}.{context.taskAttemptId()}" for n in names]
        files, docs, tokens = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [store.open_output_stream(t) for t in temporary]
                files[1].write(np.zeros(1, dtype="<i8").tobytes())
            for part_of in slices(batch, "text", CHUNK_BYTES):
                texts = texts_of(part_of, "text")
                # an added token in a text, in whatever case, is the library's to find: such texts go to it whole
                odd = {i: cache.library.encode(t.decode(), add_special_tokens=False).ids for i, t in enumerate(texts) if any(a in t.lower() for a in cache.added)}
                data, start, end, first = word_pieces([b"" if i in odd else t for i, t in enumerate(texts)])
                ids, lengths = cache.encode_spans(data, start, end)
                counts = per_text(lengths, first)
                if odd:
                    own = np.split(ids, np.cumsum(counts)[:-1])
                    for i, found in odd.items():
                        own[i] = np.array(found, dtype=np.uint32)
                    ids, counts = np.concatenate(own), np.array([len(o) for o in own], dtype=np.int64)
                ends = np.cumsum(counts)
                files[0].write(np.insert(ids, ends, end_id).astype(f"<u{width}").tobytes())
                files[1].write((tokens + ends + np.arange(1, len(ends) + 1)).astype("<i8").tobytes())
                tokens += len(ids) + len(ends)
            files[2].write(column_of(batch, "doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs += batch.num_rows
        if files is not None:
            for f, source, name in zip(files, temporary, names):
                f.close()
                store.move(source, f"{root}/{part:05d}.{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [docs], "n_tokens": [tokens], "width": [width]}, schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    write(dealt.mapInArrow(run, "part int, n_docs long, n_tokens long, width int"), f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of a folder: doc_id, start (ids before it in all parts), n_tokens and ids
    (binary, little-endian unsigned 32-bit)."""
    manifest = sorted(map(tuple, spark.read.parquet(f"{folder}/manifest").collect()))  # a row for each part
    rows, base = [], 0
    for part, docs, tokens, width in manifest:
        rows.append((part, docs, width, base))
        base += tokens
    parts = spark.createDataFrame(rows, "part int, n_docs long, width int, base long").repartition(max(1, len(rows)), "part")

    def run(batches):
        store, root = filesystem(folder)
        local = store.type_name == "local"

        def load(name, kind):
            if local:
                return np.memmap(name, dtype=kind, mode="r") if store.get_file_info(name).size else np.zeros(0, dtype=kind)
            with store.open_input_file(name) as f:
                return np.frombuffer(f.read_buffer(), dtype=kind)

        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/{row['part']:05d}"
                ids, offsets, docs = load(f"{name}.ids", f"<u{row['width']}"), load(f"{name}.offsets", "<i8"), load(f"{name}.docs", "<i8")
                for a, b in cut(np.diff(offsets).tolist(), CHUNK_BYTES):
                    own = np.array(docs[a:b])
                    flat = np.asarray(ids[offsets[a] : offsets[b]]).astype("<u4").view(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(row["base"] + np.array(offsets[a:b])), pa.array(np.diff(offsets[a : b + 1])), binary_array(flat, 4 * (np.array(offsets[a : b + 1]) - offsets[a]))],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
