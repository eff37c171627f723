"""Array kernels shared by the operators of this subpackage.

Nothing here knows about Spark. Texts are UTF-8 bytes; a null text is treated as empty. Words are maximal
runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``, which is exactly how ``bytes.split()`` cuts.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64


def as_bytes(text) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    if text is None:
        return b""
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a splitmix generator: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed % 2**64)) | U64(1)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13))) & 1
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over a random byte table, mixed at the end.

    Prefix sums of table[byte] * B**position give any span in O(1); dividing by B**start (B is odd, so it
    has an inverse modulo 2**64) makes the value independent of the place.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    if not len(start):
        return np.zeros(0, dtype=U64)
    table = mix64(np.arange(256, dtype=U64) + U64(seed * BASE % 2**64))
    power, inverse = powers(n + 1)
    sums = np.empty(n + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(table[raw] * power[:n], out=sums[1:])
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i below n at least; grown by doubling and kept for the worker's life."""
    while len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * U64(pow(b, len(have), 1 << 64))])
    return _powers[0], _powers[1]


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the index of its leftmost minimum; by doubling, O(n log w)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    value, index, size = h, np.arange(len(h), dtype=np.int64), 1
    while size * 2 <= w:
        left, right = value[:-size], value[size:]
        take = right < left
        value, index = np.where(take, right, left), np.where(take, index[size:], index[:-size])
        size *= 2
    if size < w:
        shift = w - size
        left, right = value[:-shift], value[shift:]
        index = np.where(right < left, index[shift:], index[:-shift])
    return index[:n]


def simhash(texts: list, words: int, bits: int = 64, block: int = 50_000) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, ``words``-word shingles with repeats, XXH64 with seed 42.

    A bit is 1 if it is set in over half the shingles. A text of fewer words is one shingle; one without
    words gets 0. ``bits`` over 64 appends words of 64 bits, each from the hashes mixed with its number.
    Returns an array of shape (texts, bits / 64).
    """
    lanes = bits // 64
    out = np.zeros((len(texts), lanes), dtype=U64)
    at: list[int] = []
    sizes: list[int] = []
    hashes: list[np.ndarray] = []
    pending = 0
    digest = xxhash.xxh64_intdigest

    def flush():
        nonlocal pending
        if not at:
            return
        every = np.concatenate(hashes)
        starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
        half = np.asarray(sizes, dtype=np.int32)[:, None]
        for lane in range(lanes):
            value = every if lane == 0 else mix64(every ^ U64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            ones = np.add.reduceat(np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
            out[at, lane] = np.packbits(2 * ones > half, axis=1, bitorder="little").view(U64)[:, 0]
        at.clear(), sizes.clear(), hashes.clear()
        pending = 0

    for i, text in enumerate(texts):
        parts = as_bytes(text).lower().split()
        n = len(parts)
        if not n:
            continue
        joined = b" ".join(parts)
        if n <= words:
            got = [digest(joined, 42)]
        else:
            lengths = np.fromiter(map(len, parts), dtype=np.int64, count=n)
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[: n - words + 1].tolist()
            got = [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
        at.append(i), sizes.append(len(got)), hashes.append(np.array(got, dtype=U64))
        pending += len(got)
        if pending >= block:
            flush()
    flush()
    return out


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; A-Z lower-cased, a text of fewer words is one shingle."""
    out = []
    scale = odd_constants(words, 11)
    for text in texts:
        data = as_bytes(text).lower()
        start, end = word_spans(data)
        if not len(start):
            out.append(np.zeros(0, dtype=U64))
            continue
        own = span_hashes(data, start, end)
        n = max(1, len(own) - words + 1)
        total = np.zeros(n, dtype=U64)
        for j in range(min(words, len(own))):
            total += mix64(own[j : j + n] ^ scale[j]) * scale[j]
        out.append(np.unique(mix64(total)))
    return out


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` 32-bit minimum hashes of each set; those of an empty set are all ones."""
    scale = odd_constants(count, 23)
    shift, scale = (scale >> U64(32)).astype(np.uint32)[:, None], (scale & U64(0xFFFFFFFF)).astype(np.uint32)[:, None]
    out = np.full((len(sets), count), 0xFFFFFFFF, dtype=np.uint32)
    for i, own in enumerate(sets):
        low = own.astype(np.uint32)
        for a in range(0, len(low), 1024):
            np.minimum(out[i], ((low[None, a : a + 1024] ^ shift) * scale).min(axis=1), out=out[i])
    return out
