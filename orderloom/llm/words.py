"""Vectorised tokenising of Arrow text columns.

Texts are read as UTF-8 bytes.  A word is a maximal run of bytes that the
alphabet does not name as separators, inside one document; it is represented by
a 64-bit hash, so no Python object is made per word.  Sequences of words are
hashed with prefix sums modulo 2**64 (the base is odd and so invertible).
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64


def _give_back() -> None:
    """Workers are kept between tasks: blocks of 256 KB and more go back to the system as soon as they are freed."""
    if sys.platform == "linux":
        mmap_threshold = -3  # of mallopt in glibc; setting it ends its growth with the largest block freed
        getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)(mmap_threshold, 1 << 18)
    pa.set_memory_pool(pa.system_memory_pool())


_give_back()

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=U64)
_BASE, _WORD_BASE = int(_rng.integers(2**62, 2**63)) * 2 + 1, int(_rng.integers(2**62, 2**63)) * 2 + 1
_OTHER_VALUE = _rng.integers(0, 2**64, 256, dtype=U64)
_OTHER_BASE = int(_rng.integers(2**62, 2**63)) * 2 + 1
_MASK = 2**64 - 1


class Alphabet(NamedTuple):
    separator: np.ndarray  # bool per byte
    value: np.ndarray  # hash value per byte, upper and lower case alike where folded


def _alphabet(separators: set[int], fold: bool) -> Alphabet:
    sep = np.zeros(256, bool)
    value = _BYTE_VALUE.copy()
    if fold:
        value[0x41:0x5B] = value[0x61:0x7B]
    for b in separators:
        sep[b] = True
    return Alphabet(sep, value)


WHITE = {0x20, *range(0x09, 0x0E)}
#: `[^\x20\x09-\x0D]+`, unchanged.
SPACED = _alphabet(WHITE, fold=False)
#: `[^\x20\x09-\x0D]+`, A-Z lower-cased.
SPACED_FOLDED = _alphabet(WHITE, fold=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z was lower-cased.
ALNUM_FOLDED = _alphabet({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, fold=True)


class _Powers:
    """Powers of an odd base and of its inverse, as far as they were needed yet."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_bytes, _words, _others = _Powers(_BASE), _Powers(_WORD_BASE), _Powers(_OTHER_BASE)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = h ^ U64((salt * 0x9E3779B97F4A7C15) & _MASK)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers | None = None) -> np.ndarray:
    """Hash of each ``values[start[i]:end[i]]``."""
    up, down = (powers or _bytes).upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


class Tokens(NamedTuple):
    hash: np.ndarray  # uint64 of each word
    start: np.ndarray  # first byte of each word, in the slice
    end: np.ndarray  # byte after it
    bounds: np.ndarray  # words of document d: bounds[d]:bounds[d + 1]


def tokenize(data: np.ndarray, at: np.ndarray, alphabet: Alphabet) -> Tokens:
    """Words of the documents ``data[at[d]:at[d + 1]]`` (uint8)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, U64), none, none, np.zeros(len(at), np.int64))
    word = ~alphabet.separator[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    start = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    return Tokens(span_hashes(alphabet.value[data], start, end), start, end, np.searchsorted(start, at))


def second_hashes(data: np.ndarray, words: Tokens, alphabet: Alphabet) -> np.ndarray:
    """A second hash of each word, by other byte values and another base than the first one's."""
    value = _OTHER_VALUE.copy()
    if alphabet.value[0x41] == alphabet.value[0x61]:
        value[0x41:0x5B] = value[0x61:0x7B]
    return span_hashes(value[data], words.start, words.end, _others)


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, over document ends too."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _words.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + counts[i] - 1`` for each i, one after another."""
    counts = np.maximum(counts, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's place in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


#: Of texts that go to a Python worker at once; Spark's own bound is 64 MB, held by the JVM and by the worker.
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def sized(docs: DataFrame) -> DataFrame:
    """``docs``; its session sends batches of about ``BATCH_BYTES`` from now on, unless it names a size itself."""
    conf = docs.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs


def slices(at: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``most`` bytes; a longer row is alone."""
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi
