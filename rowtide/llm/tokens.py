"""A cache of encoded pieces: the tokenizer sees each distinct piece once in a while, not once an occurrence."""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from rowtide.llm.arrow import ragged, trim
from rowtide.llm.kernels import U64, span_hashes


def load_tokenizer(model: str):
    """A tokenizer for one task's core: threads of its own would take other tasks' cores, and memory each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    trim()
    return tokenizer


class PieceCache:
    """Token ids of byte pieces, found by a 64-bit hash of their bytes in an open-addressing table.

    ``encode`` gives the ids of a list of distinct pieces, one after another, and the number of ids of each.
    When more than ``limit`` pieces are held, the half used least is forgotten. All steps but encode work on
    arrays of pieces; a piece is made into an object only when it is new. Two different pieces are confused
    with a chance of 2**-64 for each pair of a new piece and one held.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 350_000):
        self.encode, self.limit = encode, limit
        self.mask = U64((1 << (2 * limit).bit_length()) - 1)
        self.ids, self.used, self.held = np.zeros(4096, dtype=np.uint32), 0, 0
        self.hash = np.zeros(1024, dtype=U64)
        self.start, self.length, self.uses = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, dtype=U64)
        self.slots = np.zeros(int(self.mask) + 1, dtype=np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it is not there."""
        at = (hashes & self.mask).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == hashes, self.slots[at], -1)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            key = self.keys[at[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.slots[at[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def _insert(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        at = (hashes & self.mask).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.slots[at[won]] = hashes[won], slots[won]
            left = left[self.keys[at[left]] != hashes[left]]
            at[left] = (at[left] + 1) & int(self.mask)

    def _grow(self, rows: int, ids: int) -> None:
        if rows > len(self.start):
            more = max(rows, 2 * len(self.start)) - len(self.start)
            self.start, self.length, self.uses, self.hash = (np.concatenate([a, np.zeros(more, dtype=a.dtype)]) for a in (self.start, self.length, self.uses, self.hash))
        if ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(ids, 2 * len(self.ids)) - len(self.ids), dtype=np.uint32)])

    def _forget(self) -> None:
        keep = np.sort(np.argpartition(self.uses[: self.held], self.held // 2)[self.held // 2 :])
        ids = self.ids[ragged(self.start[keep], self.length[keep])]
        self.held = len(keep)
        for a in (self.length, self.uses, self.hash):
            a[: self.held] = a[keep]
        self.uses[: self.held] //= 2
        self.start[: self.held] = np.cumsum(self.length[: self.held]) - self.length[: self.held]
        self.used = len(ids)
        self.ids[: self.used] = ids
        self._empty()
        self._insert(self.hash[: self.held], np.arange(self.held, dtype=np.int32))

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids, lengths = self.encode(pieces)
        first, last = self.held, self.held + len(pieces)
        self._grow(last, self.used + len(ids))
        self.length[first:last], self.hash[first:last], self.uses[first:last] = lengths, hashes, 0
        self.start[first:last] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.held = last
        self._insert(hashes, np.arange(first, last, dtype=np.int32))

    def encode_spans(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of data between starts and ends, one after another, and the number of ids of each."""
        if self.held > self.limit:
            self._forget()
        hashes = np.maximum(span_hashes(data, start, end), U64(1))
        slots = self._find(hashes)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            for i in range(0, len(new), self.limit // 2):  # a text of any size leaves room in the table
                if self.held > self.limit:
                    break
                self._add(new[i : i + self.limit // 2], [data[a:b] for a, b in zip(start[at[i : i + self.limit // 2]].tolist(), end[at[i : i + self.limit // 2]].tolist())])
            slots = self._find(hashes)
            if (slots < 0).any():
                half = len(start) // 2
                parts = [self.encode_spans(data, start[:half], end[:half]), self.encode_spans(data, start[half:], end[half:])]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        np.add.at(self.uses, slots, 1)
        lengths = self.length[slots]
        return self.ids[ragged(self.start[slots], lengths)], lengths


def per_text(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of ids of each text, from those of its pieces; first has the number of the first piece of each
    text, and of all pieces."""
    return np.diff(np.concatenate([[0], np.cumsum(lengths)])[first])


def one_by_one(encode_batch: Callable, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers of pieces that are encoded as texts of their own."""
    got = [e.ids for e in encode_batch([p.decode("utf-8", "surrogatepass") for p in pieces], add_special_tokens=False)]
    lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
    return np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(lengths.sum())), lengths


def in_groups(pieces: list[bytes], groups: list[tuple[list[int], Callable]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers of pieces whose indices are dealt to groups, each with its own encode, in the pieces' order."""
    lengths = np.zeros(len(pieces), dtype=np.int64)
    start = np.zeros(len(pieces), dtype=np.int64)
    flat, used = [], 0
    for own, encode in groups:
        if own:
            ids, n = encode([pieces[i] for i in own])
            lengths[own], start[own] = n, used + np.cumsum(n) - n
            flat.append(ids)
            used += len(ids)
    return (np.concatenate(flat)[ragged(start, lengths)] if flat else np.zeros(0, dtype=np.uint32)), lengths
