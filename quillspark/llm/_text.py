"""Whole texts as arrays: words and their 64-bit hashes, many documents at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled together; a longer text is handled alone.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words without visible pattern (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def groups(lengths: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts that hold about limit characters each."""
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(lengths):
        yield at, len(lengths)


def slices(batch: pa.RecordBatch, limit: int = CHUNK, name: str = "text") -> Iterator[tuple[int, list[str]]]:
    """(place, texts): a column of a batch, a bounded part of it at a time; null counts as empty."""
    column = batch.column(name)
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in groups(lengths, limit):
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def release() -> None:
    """Gives memory that isn't used back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f: Callable) -> Callable:
    """f, a function of batches for mapInArrow, that gives unused memory back when a task ends: Spark keeps workers for later stages."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers or more; one table is kept for usual lengths, and none for longer texts."""
    return _kept_powers() if bits <= 20 else _new_powers(bits)


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(20)


def _new_powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full((1 << bits) - 1, x, np.uint64)))) for x in (_BASE, _INVERSE))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text begins (one more for the end)."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes, starts


def lower_ascii(codes: np.ndarray) -> np.ndarray:
    return codes + (((codes - np.uint32(65)) < 26).astype(np.uint32) << np.uint32(5))


def white(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes - np.uint32(9)) < 5)


class Words:
    """The words (runs without space, tab, line feed, vertical tab, form feed, return) of texts, A-Z lower-cased.

    start, end: where each word lies in codes; hash: of its characters; first: index of each text's first word, one more for the end.
    """

    def __init__(self, texts: list[str]):
        codes, self.text_start = code_points(texts)
        self.codes = lower_ascii(codes)
        gap = white(self.codes)
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        power, inverse = _powers(max(int(len(codes)).bit_length(), 16))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((self.codes + np.uint32(1)) * power[: len(codes)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the words i..i+size-1 for each i (texts aside), and per text how many start in it; a text of fewer words has one, of them all."""
        n = len(self.hash)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            part = self.hash[k:] if k else self.hash
            rolled[: n - k] += mix(part + np.uint64(k + 1)) if k else mix(part)
        words = np.diff(self.first)
        count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
        for i in np.flatnonzero((words > 0) & (words < size)):
            lo, hi = self.first[i], self.first[i + 1]
            own = sum((int(mix(self.hash[lo + k : lo + k + 1] + np.uint64(k + 1) * np.uint64(k > 0))[0]) for k in range(hi - lo)), int(hi - lo))
            rolled[lo] = own & 0xFFFFFFFFFFFFFFFF
        return mix(rolled), count
