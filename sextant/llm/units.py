"""Vectorised text units: words, rolling fingerprints and window minimisers.

Every function works on one slice of an Arrow string column: the UTF-8 bytes
of its texts lie one behind the other, so that numpy treats thousands of
documents at once.  `Rolling` fingerprints are polynomials modulo 2**64 with a
fixed random byte table: equal content gives equal values on every executor, but
structured content that differs can, too, so they only choose places and buckets.
Whether contents are equal is decided by SHA-256 (`word_ids`, `digests`) or by
the contents themselves.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; bounds the memory of a task.
SLICE_BYTES = 1 << 20

#: Units of one text that are worked on at once; a longer text is worked through in segments. Must stay well below 2**26.
SEGMENT_UNITS = 1 << 22

#: Bytes of contexts that are copied out at once.
CONTEXT_BYTES = 1 << 22

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Words and bytes of them that a worker remembers the digests of.
MEMORY_WORDS, MEMORY_BYTES = 1 << 17, 1 << 23

#: Cached functions whose results a worker keeps for tasks that tokenise; tasks that work on slices empty them.
TOKENISERS: list[Callable] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Fingerprints of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.inverse[:n] + np.uint64(size * 0xD6E8FEB86659FD93 % 2**64))


class Texts:
    """Some texts of a column, as bytes: text i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)

    def word_ids(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The first 16 bytes of the SHA-256 of every word, as two 64-bit columns, and the bounds of each text's words."""
        if len(_memory.known) > MEMORY_WORDS or _memory.size > MEMORY_BYTES:
            _memory.forget()
        places, bounds = [], np.zeros(len(self) + 1, np.int64)
        for i in range(len(self)):
            text = self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()
            words = (text.lower() if lower else text).split()  # cuts at 0x20 and 0x09 to 0x0D, lowers A-Z, and nothing else
            places.append(np.fromiter(map(_memory.known.__getitem__, words), np.int64, len(words)))
            bounds[i + 1] = bounds[i] + len(words)
        return _memory.ids[np.concatenate(places) if places else np.zeros(0, np.int64)], bounds


class _Known(dict):
    """The place of each word's digest in a table that grows; a worker's memory."""

    def __missing__(self, word: bytes) -> int:
        return _memory.learn(word)


class _Memory:
    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.size = _Known(), np.zeros((1 << 12, 2), np.uint64), 0

    def learn(self, word: bytes) -> int:
        at = len(self.known)
        if at == len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at] = np.frombuffer(hashlib.sha256(word).digest(), "<u8", 2)
        self.known[word] = at
        self.size += len(word)
        return at


_memory = _Memory()


def digests(content: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the SHA-256 of each range of rows of `content`."""
    raw, width = memoryview(np.ascontiguousarray(content).reshape(-1).view(np.uint8)), content.itemsize * (content.shape[1] if content.ndim > 1 else 1)
    sha = hashlib.sha256
    out = b"".join(sha(raw[a:b]).digest()[:8] for a, b in zip((start * width).tolist(), (end * width).tolist()))
    return np.frombuffer(out, "<u8").copy()


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts; those of text i are bounds[i] to bounds[i + 1]."""

    def __init__(self, texts: Texts, lower: bool):
        data = _LOWER[texts.data] if lower else texts.data
        solid = ~_SPACE[data]
        edge = np.ones(len(data) + 1, bool)
        if len(data):
            edge[1:-1] = ~solid[:-1]
            edge[texts.bounds] = True
        self.data, self.read = texts.data, data
        self.start = np.flatnonzero(solid & edge[:-1])
        last = np.ones(len(data), bool)
        if len(data):
            last[:-1] = ~solid[1:]
            ends = texts.bounds[1:]
            last[ends[ends > 0] - 1] = True
        self.end = np.flatnonzero(solid & last) + 1
        self.bounds = np.searchsorted(self.start, texts.bounds)

    def hashes(self) -> np.ndarray:
        """A fingerprint of each word (see `Rolling`)."""
        out = np.zeros(len(self.start), np.uint64)
        for i, j in pieces(np.diff(self.start, prepend=0), SEGMENT_UNITS):
            first = self.start[i]
            out[i:j] = Rolling(_TABLE[self.read[first : self.end[j - 1]]]).ranges(self.start[i:j] - first, self.end[i:j] - first)
        return out


def pieces(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items whose sizes together are about `limit`, or one item; none without items."""
    cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
    return ((i, j) for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(size)]) if i < j)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's texts in slices of about `limit` bytes; null counts as empty."""
    forget_tokenisers()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j
    give_back()


def forget_tokenisers() -> None:
    """A worker that turns to other work keeps no tokeniser with the units that it remembers, which are its largest tables."""
    kept = [f for f in TOKENISERS if f.cache_info().currsize]
    for f in kept:
        f.cache_clear()
    if kept:
        give_back()


def forget_words() -> None:
    """A worker that turns to tokenising keeps no digests of words."""
    _memory.forget()


def give_back() -> None:
    """Memory that was freed goes back to the system, as workers live from task to task and share their machine's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def chosen(grams: np.ndarray, gram: int, window: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of the smallest gram of every window that lies within one text, as runs: place, first and last window start.

    A window covers `window` units, hence window - gram + 1 grams; of equal
    grams the leftmost counts.  Windows with the same content choose the same
    place within them, and windows that choose one place follow each other.
    Takes less than 2**26 grams.
    """
    total = int(bounds[-1])
    none = np.zeros(0, np.int64)
    if total < window:
        return none, none, none
    width = window - gram + 1
    size, low = 1, (grams >> np.uint64(26) << np.uint64(26)) | np.arange(len(grams), dtype=np.uint64)
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    starts = np.arange(total - window + 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(starts)]
    inside = starts + window <= ends
    starts, place = starts[inside], (low[: len(inside)][inside] & np.uint64((1 << 26) - 1)).astype(np.int64)
    if not len(starts):
        return none, none, none
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[head], starts[head], starts[np.append(head[1:], len(starts)) - 1]
