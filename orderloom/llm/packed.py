"""A radix exchange of hashes in packed rows: what do all entries of one hash say together?

A flush is a run of whole documents of about ``FLUSH`` words that one task holds
at a time.  It combines its own entries first, so it sends one entry a hash,
with a value; entries are dealt to ``COARSE`` buckets by the hash, sorted and
written as one row per bucket (sorted differences as compressed byte planes).

Flushes are grouped into parts of about ``FLUSHES_PER_PART``.  A bucket of one
part fits a task at any input size: it holds at most one entry of a hash for each
of the part's flushes.  With several parts, each (bucket, part) first combines its
entries and deals them on to as many fine buckets as there are parts; there a
hash has one entry for each part.  What changed by that goes back to the parts,
and every flush is told from its own (bucket, part).  So neither a frequent hash
nor a large input makes a large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..scratch import free, settle
from .words import U64

FLUSH = 250_000  # words
COARSE = 384  # buckets; a flush's row has about FLUSH / COARSE entries
FLUSHES_PER_PART = 2048
#: own: what the flush keeps for its return, in the row of bucket -1 - flush.
PACKED = "bucket long, flush long, data binary, own binary"
_COLUMNS = ["bucket", "flush", "data", "own"]


@lru_cache(1)
def _coders():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes; small or similar ones take few bytes."""
    v = np.ascontiguousarray(values, "<u8")
    return len(v).to_bytes(8, "little") + _coders()[0].compress(v.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(_coders()[1].decompress(blob[8:]), np.uint8).reshape(8, n).T.copy().view("<u8").ravel() if n else np.zeros(0, U64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(np.ascontiguousarray(values, U64), prepend=U64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=U64)


def pack_many(*arrays: np.ndarray) -> bytes:
    blobs = [pack(a) for a in arrays]
    return b"".join([len(b).to_bytes(8, "little") + b for b in blobs])


def unpack_many(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(unpack(blob[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def pack_entries(low: np.ndarray, offsets: np.ndarray, value: np.ndarray, check: np.ndarray | None) -> bytes:
    """Entries in ascending order of ``low``, as one blob."""
    planes = [np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T for x in (np.diff(low, prepend=U64(0)), offsets, value, *(() if check is None else (check,)))]
    return len(low).to_bytes(8, "little") + _coders()[0].compress(np.concatenate(planes).tobytes())


def unpack_entries(blob: bytes) -> list[np.ndarray]:
    """low, offsets, value and, if it was there, check."""
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(_coders()[1].decompress(blob[8:]), np.uint8).reshape(-1, 8, n)
    low, *rest = (x.T.copy().view("<u8").ravel() for x in raw)
    return [np.cumsum(low, dtype=U64), *rest]


def flush_ids() -> Iterator[int]:
    """Ids that no other task has."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def grouped(low: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by hash and check value, and where a new one begins in it."""
    order = np.argsort(low)
    s = low[order]
    new = s[1:] != s[:-1]
    if check is not None:
        c = check[order]
        if (~new & (c[1:] != c[:-1])).any():  # equal hashes of different words
            order = np.lexsort((check, low))
            s, c = low[order], check[order]
            new = s[1:] != s[:-1]
        new |= c[1:] != c[:-1]
    return order, np.flatnonzero(np.concatenate(([True], new))) if len(s) else np.zeros(0, np.int64)


class Kind(NamedTuple):
    """How values of equal hashes combine (of sorted values, where groups begin, their sizes), and which entries are told."""

    merge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    told: Callable[[np.ndarray, np.ndarray], np.ndarray]  # own value, merged value


def coarse_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> U64(40)) * U64(COARSE)) >> U64(24)


def deal(bucket: np.ndarray, flush: int, low: np.ndarray, check: np.ndarray | None, offsets: np.ndarray, value: np.ndarray) -> list[tuple]:
    """A packed row per bucket, of entries sorted by bucket and hash."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return [
        (int(bucket[a]), flush, pack_entries(low[a:b], offsets[a:b], value[a:b], None if check is None else check[a:b]), None)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True)
        if b > a
    ]


class _Entries:
    """All entries of a group's rows, combined by hash."""

    def __init__(self, frame: pd.DataFrame, kind: Kind):
        self.cuts = np.concatenate(([0], np.cumsum([int.from_bytes(b[:8], "little") for b in frame["data"]])))
        n = self.cuts[-1]
        self.low, self.offsets, self.value, self.check = np.empty(n, U64), np.empty(n, U64), np.empty(n, U64), None
        for a, b, blob in zip(self.cuts[:-1], self.cuts[1:], frame["data"], strict=True):
            self.low[a:b], self.offsets[a:b], self.value[a:b], *check = unpack_entries(blob)
            if check:
                self.check = np.empty(n, U64) if self.check is None else self.check
                self.check[a:b] = check[0]
        self.order, self.first = grouped(self.low, self.check)
        sizes = np.diff(self.first, append=len(self.order))
        self.merged = kind.merge(self.value[self.order], self.first, sizes) if len(self.order) else self.value
        self.every = np.empty(len(self.order), U64)  # each entry's merged value
        self.every[self.order] = np.repeat(self.merged, sizes)


def exchange(sent: DataFrame, kind: Kind, parts: int = 1) -> DataFrame:
    """(flush, offsets, own): the offsets of told entries, and each flush's own row, from PACKED rows.

    Rows of a negative bucket are handed on as they are, through the same
    shuffle as the entries, so both come from one run of the task that made them.
    """
    part = F.pmod(F.xxhash64("flush"), F.lit(parts))

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] < 0:
            return pd.DataFrame({"flush": frame["flush"], "offsets": None, "own": frame["own"]})
        e = _Entries(frame, kind)
        hit = np.flatnonzero(kind.told(e.value, e.every))
        row = np.searchsorted(e.cuts, hit, "right") - 1
        out, flush = [], frame["flush"].to_numpy()
        which, first = np.unique(row, return_index=True)
        for r, a, b in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(row)][: len(which)], strict=True):
            if flush[r] >= 0:
                out.append((flush[r], pack_sorted(np.sort(e.offsets[hit[a:b]])), None))
        return pd.DataFrame(out, columns=["flush", "offsets", "own"])

    def condense(frame: pd.DataFrame) -> pd.DataFrame:
        """One entry a hash of this (bucket, part), dealt to fine buckets; the flush is now the part."""
        e = _Entries(frame, kind)
        at = e.order[e.first]
        fine = ((e.low[at] & U64((1 << 24) - 1)) * U64(parts)) >> U64(24)
        order = np.argsort(fine, kind="stable")
        at = at[order]
        rows = deal(fine[order], int(frame["part"].iloc[0]), e.low[at], None if e.check is None else e.check[at], np.zeros(len(at), U64), e.merged[order])
        return pd.DataFrame(rows, columns=_COLUMNS).assign(coarse=int(frame["bucket"].iloc[0]))

    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        """Entries whose value other parts have changed, for the part they came from."""
        e = _Entries(frame, kind)
        out = []
        for k, (a, b) in enumerate(zip(e.cuts[:-1], e.cuts[1:], strict=True)):
            new = a + np.flatnonzero(e.every[a:b] != e.value[a:b])
            if len(new):
                blob = pack_entries(e.low[new], np.zeros(len(new), U64), e.every[new], None if e.check is None else e.check[new])
                out.append((int(frame["coarse"].iloc[0]), -1, blob, None, int(frame["flush"].iloc[k])))
        return pd.DataFrame(out, columns=[*_COLUMNS, "part"])

    answered = "flush long, offsets binary, own binary"
    if parts > 1:  # the entries are read twice
        sent = settle(sent)
    rows = sent.withColumn("part", part)
    if parts > 1:
        condensed = settle(rows.where("bucket >= 0").groupBy("bucket", "part").applyInPandas(condense, f"{PACKED}, coarse long"))
        news = settle(condensed.groupBy("coarse", "bucket").applyInPandas(resolve, f"{PACKED}, part long"))
        free(condensed)
        rows = rows.union(news)
    out = settle(rows.groupBy("bucket", "part").applyInPandas(answer, answered))
    free(sent)
    return out
