"""Encoding of a corpus by a public byte-level BPE vocabulary.

Texts are cut by `pretokens`; every distinct slice is merged once per worker and cached; the ids of a batch are then
put together by array operations. Null and empty texts have no ids. No special tokens: their strings are ordinary
text. Texts are encoded whole, of any length; white space, odd characters and null characters included.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import Batch, Words, portions, split

#: Folder of the public vocabularies; a parameter everywhere.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of a slice: always the pair with the lowest rank is merged, the leftmost of equals first. A linked list
    and a heap, so long slices take n log n."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    nxt, prv, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := rank.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0:
            p = prv[i]
            if (r := rank.get(piece[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i]))
    return [rank[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    def __init__(self, path: str):
        self.rank, self.words = ranks(path), Words()
        self._reset()

    def _reset(self):
        self.count, self.offset, self.flat, self.done, self.seen = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0, 0

    def _number(self, b: Batch) -> np.ndarray:
        if self.words.full():
            self.words = Words(self.words.most, self.words.bytes)
            self._reset()
        number = self.words.number(b)
        new = self.words.values[self.seen :]
        if new:
            ids = [merged(v, self.rank) for v in new]
            total, n = self.done + sum(map(len, ids)), self.seen + len(new)
            while len(self.count) < n:
                self.count, self.offset = np.r_[self.count, np.zeros_like(self.count)], np.r_[self.offset, np.zeros_like(self.offset)]
            while len(self.flat) < total:
                self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.count[self.seen : n] = size
            self.offset[self.seen : n] = self.done + np.cumsum(size) - size
            self.flat[self.done : total] = np.fromiter((x for i in ids for x in i), np.int32, total - self.done)
            self.seen, self.done = n, total
        return number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        b = split(texts)
        number = self._number(b)
        size = self.count[number]
        upto = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.offset[number] - upto[:-1], size) + np.arange(upto[-1])
        return upto[b.first], self.flat[at]

    def lengths(self, texts: list[str]) -> np.ndarray:
        b = split(texts)
        number = self._number(b)  # first: it may replace the arrays
        upto = np.r_[0, np.cumsum(self.count[number])]
        return np.diff(upto[b.first])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encoded(docs: DataFrame, id_: str, text: str, folder: str = VOCABULARIES, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(id_, ids array<int>)."""
    path = os.path.join(folder, vocabulary)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = _texts(batch.column(1))
            for a, b in portions(texts):
                offsets, ids = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_, "ids"])

    kind = dict(docs.dtypes)[id_]
    return docs.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str, folder: str = VOCABULARIES, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(keep, tokens bigint)."""
    path = os.path.join(folder, vocabulary)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = _texts(batch.column(len(keep)))
            for a, b in portions(texts):
                n = pa.array(enc.lengths(texts[a:b]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), n], names=[*keep, "tokens"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", tokens bigint")


def decoded(ids: list[int], path: str) -> str:
    """The text of ids; encoding is an exact round trip."""
    back = {i: t for t, i in ranks(path).items()}
    return b"".join(back[i] for i in ids).decode("utf-8")
