"""Vectorised pre-tokenisation: texts to slices without a regular expression.

A batch of texts is one array of code points and one of their classes (letter, number, white space, other). The
automaton behind the usual byte-BPE pattern changes state only where the class changes, so the transition function of
a character is either a reset (a run begins here) or the identity. Such functions compose associatively, and the scan
over them is a running maximum of the last reset; with it, and the classes of the neighbours, every boundary is found
for the whole batch at once. The slices come back as offsets into the UTF-8 bytes, so they can be decoded again.

`Words` gives equal slices equal numbers: slices of up to seven bytes are packed with their length into one integer
(exactly, so no two differ and collide) and numbered by a hash table over integers; only longer ones become objects.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Code points with the Unicode property White_Space, as ranges.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

#: What an apostrophe at the start of a slice keeps with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in WHITE:
        t[a : b + 1] = SPACE
    return t


@dataclass
class Batch:
    data: np.ndarray  # UTF-8 bytes of all texts, one after the other, and eight zero bytes
    start: np.ndarray  # first byte of each slice
    length: np.ndarray  # bytes of each slice
    first: np.ndarray  # number of the first slice of each text, and of all slices
    kind: np.ndarray  # class of the last code point of each slice
    text_at: np.ndarray  # first byte of each text, and of all bytes


def split(texts: list[str]) -> Batch:
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(cp)
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.r_[0, np.cumsum(chars)]
    raw = joined.encode("utf-8")
    data = np.empty(len(raw) + 8, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    data[len(raw) :] = 0
    if not n:
        z = np.zeros(0, np.int64)
        return Batch(data, z, z, np.zeros(len(texts) + 1, np.int64), z.astype(np.uint8), np.zeros(len(texts) + 1, np.int64))
    cls = classes()[cp]
    fresh = np.zeros(n + 1, bool)  # a text begins here
    fresh[at[:-1]] = True
    fresh = fresh[:n]
    reset = np.empty(n, bool)
    reset[0] = True
    np.not_equal(cls[1:], cls[:-1], out=reset[1:])
    reset |= fresh
    begin = reset.copy()
    # white space before something else gives up its last character: a blank joins what follows, another stands alone
    b = np.flatnonzero(reset[1:] & ~fresh[1:] & (cls[:-1] == SPACE)) + 1
    begin[b - 1] = True
    joins = cp[b - 1] == 32
    begin[b[joins]] = False
    # an apostrophe that begins a slice and is followed at once by one of the endings
    q = np.flatnonzero(begin & (cp == 39))
    q = q[q + 1 < n]
    q = q[~fresh[q + 1] & (cls[q + 1] == LETTER)]
    if len(q):
        last = np.searchsorted(at, q, side="right")  # end of the text it is in
        end = at[last]
        run = np.maximum.accumulate(np.where(reset, np.arange(n), 0))  # the scan over the transition functions
        one, two = cp[q + 1], cp[np.minimum(q + 2, n - 1)]
        wide = (q + 2 < end) & (run[np.minimum(q + 2, n - 1)] == q + 1)
        size = np.zeros(len(q), np.int64)
        for e in CONTRACTIONS:
            hit = one == ord(e[0])
            if len(e) == 2:
                hit &= wide & (two == ord(e[1]))
            size = np.where((size == 0) & hit, len(e), size)
        hit = size > 0
        begin[q[hit] + 1] = False
        after = q[hit] + 1 + size[hit]
        begin[after[after < end[hit]]] = True
    where = np.flatnonzero(begin)
    stop = np.r_[where[1:], n]
    kind = cls[stop - 1]
    if len(raw) == n:
        start, edge = where, at
    else:
        width = 1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF)
        upto = np.r_[0, np.cumsum(width, dtype=np.int64)]
        start, edge = upto[where], upto[at]
    length = np.diff(np.r_[start, len(raw)])
    return Batch(data, start, length, np.searchsorted(where, at), kind, edge)


class Words:
    """Numbers for slices, the same for equal slices over all batches seen; what is kept between batches is bounded by
    `most` slices and `bytes` of them."""

    def __init__(self, most: int = 1_500_000, bytes: int = 64 << 20):
        self.most, self.bytes, self.numbers, self.values, self.size = most, bytes, {}, [], 0

    def full(self) -> bool:
        return len(self.values) > self.most or self.size > self.bytes

    def number(self, b: Batch, keep: np.ndarray | None = None) -> np.ndarray:
        """The number of each slice (of those in `keep`); self.values[number] are its bytes."""
        if self.full():
            self.__init__(self.most, self.bytes)
        start, length = (b.start, b.length) if keep is None else (b.start[keep], b.length[keep])
        key = np.zeros(len(start), np.uint64)
        for j in range(7):
            byte = b.data[start + j].astype(np.uint64)
            byte[length <= j] = 0
            key |= byte << np.uint64(8 * j)
        key |= length.astype(np.uint64) << np.uint64(56)
        long = length > 7
        out = np.empty(len(start), np.int64)
        codes, uniques = pd.factorize(key[~long])
        known = np.fromiter((self._of(int(u)) for u in uniques), np.int64, len(uniques))
        out[~long] = known[codes] if len(uniques) else 0
        if long.any():
            raw, get = b.data.tobytes(), self._of
            at = start[long]
            out[long] = np.fromiter((get(raw[i:j]) for i, j in zip(at.tolist(), (at + length[long]).tolist())), np.int64, len(at))
        return out

    def _of(self, k) -> int:
        n = self.numbers.get(k)
        if n is None:
            n = self.numbers[k] = len(self.values)
            self.values.append(k if isinstance(k, bytes) else (k & ((1 << 56) - 1)).to_bytes(7, "little")[: k >> 56])
            self.size += len(self.values[-1])
        return n


def portions(texts: list[str | None], most: int = 2_000_000):
    """(first, last) of consecutive texts with about `most` characters together; a longer text stands alone."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
