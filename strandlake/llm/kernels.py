"""Numpy kernels on Arrow text: words, their 64-bit hashes and hashes of word windows, a few MB at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C13)  # 3 mod 8: its low powers minus 1 have few factors of 2
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
_POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(65535, BASE, np.uint64)]))
CHUNK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))[:n]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: Python workers are used again, by other stages too."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about size bytes of text; a longer text is a piece of its own."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        done = lengths[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(lengths, done + size, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array end to end, and where each text starts (one more for the end); nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes outside space and U+0009..U+000D, no run crossing texts; and for each
    text where its words begin (one more for the end)."""
    word = ~SPACES[data]
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    values = BYTE[data[np.repeat(starts, n) + at]] * _POW[at & 0xFFFF]
    return mix(np.add.reduceat(values, np.cumsum(n) - n) + n.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each text's words begin); with lower, A-Z count as a-z."""
    data, offsets = raw(texts)
    if lower:
        data = LOW[data]
    starts, ends, at = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), at


class Rolling:
    """Hashes of any word ranges of a sequence, each in constant time (Karp-Rabin on 64-bit words)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, n), dtype=np.uint64)])
        self.inverse = powers(BASE_INV, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))


def window_starts(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all k-word windows inside texts, and the text of each."""
    n = np.maximum(np.diff(at) - (k - 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[:-1][text], text


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
