"""Exact substring deduplication by fixed-block anchors.

Any window of W words holds a whole block of (W + 1) // 2 words that starts at a
multiple of that in its document.  Those non-overlapping blocks are the index;
every rolling block of every document probes it (both travel in one packed
exchange).  A block that is indexed and occurs again is an anchor, and the
windows around anchors are the candidates: they are exchanged once more to find
each one's smallest document, which extends the hits to maximal repeats.  Words
of windows that a smaller document has too are removed.

Anchors only say where to look, so 40 bits and the bucket's tell them apart.
Candidate windows are told apart by two 64-bit hashes, each of its own hashes of
the words (other byte values, other bases): the exchange goes by the first, and
every match is confirmed by the second, so one of different words would need
both to agree (2**-128 for a pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import free, settle
from .packed import FLUSH, FLUSHES_PER_PART, PACKED, Kind, coarse_of, deal, exchange, flush_ids, grouped, pack_many, pack_sorted, unpack_many, unpack_sorted
from .words import SPACED, U64, Tokens, mix, ranges, second_hashes, sequences, sized, slices, tokenize, utf8

SIGN = U64(1 << 63)  # makes the order of signed ids that of unsigned ones
INDEXED, MANY = U64(1), U64(2)


def _merge_anchors(value: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduceat(value, first) | np.where(sizes > 1, MANY, U64(0))


def _merge_windows(value: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(value, first)


#: Blocks that are indexed and occur twice at least; windows that a smaller document has.
ANCHORS = Kind(_merge_anchors, lambda own, merged: merged == (INDEXED | MANY))
WINDOWS = Kind(_merge_windows, lambda own, merged: own > merged)


class _Flush:
    """Documents that were taken in but not yet written, with their entries."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.keys: list[int] = []
        self.starts: list[int] = []
        self.words = 0
        self.parts: list[tuple[np.ndarray, ...]] = []  # hashes, check values or nothing, word offsets, values

    def add(self, ids: list[int], keys: list[int], bounds: np.ndarray, hashes: np.ndarray, check: np.ndarray | None, at: np.ndarray, value: np.ndarray) -> None:
        self.ids += ids
        self.keys += keys
        self.starts += (bounds[:-1] + self.words).tolist()
        self.parts.append((hashes, check, (at + self.words).astype(U64), value))
        self.words += int(bounds[-1])

    def emit(self, flush: int, kind: Kind) -> pa.RecordBatch | None:
        """A row per bucket with one entry a hash, and the flush's own row.

        Of equal hashes the entry is an occurrence with the smallest value.  The
        own row keeps the documents, the other occurrences with their entry, and
        those that are told already because the flush itself has a smaller value.
        """
        if not self.ids:
            return None
        hashes, check, at, value = (np.concatenate(x) if x[0] is not None else None for x in zip(*self.parts, strict=True))
        self.parts = []
        anchors = kind is ANCHORS
        key = coarse_of(hashes) << U64(40) | hashes & U64((1 << 40) - 1) if anchors else hashes  # ascending within and over buckets
        order, first = grouped(key, check)
        del key
        sizes = np.diff(first, append=len(order))
        merged = kind.merge(value[order], first, sizes) if len(order) else value
        many = np.flatnonzero(sizes > 1)
        same = ranges(first[many], sizes[many])  # places in order of entries whose hash occurs again
        group = np.repeat(many, sizes[many])
        if not anchors and len(same):  # an occurrence with the smallest value first
            order[same] = order[same][np.lexsort((value[order[same]], group))]
        lead = np.zeros(len(same), bool)
        lead[np.cumsum(sizes[many]) - sizes[many]] = True
        told = np.zeros(len(same), bool) if anchors else value[order[same]] > merged[group]
        others = ~lead & ~told
        take = order[first]
        own = pack_many(
            np.array(self.ids, np.int64).view(U64), np.array(self.keys, np.int64).view(U64), np.array(self.starts, U64),
            at[order[same[others]]], at[take][group[others]], at[order[same[told]]],
        )
        low = hashes[take] & U64((1 << 40) - 1) if anchors else hashes[take]
        rows = deal(coarse_of(hashes[take]), flush, low, check[take] if check is not None else None, at[take], merged)
        rows.append((-1 - flush, flush, None, own))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "flush", "data", "own"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], Tokens, pa.RecordBatch, np.ndarray]]:
    """(ids, text hashes, words, rows, bytes) of slices of (doc_id, text_key, text, ...) batches."""
    for batch in batches:
        data, at = utf8(batch.column(2))
        for lo, hi in slices(at, 1 << 18):
            part, own = batch.slice(lo, hi - lo), data[at[lo] : at[hi]]
            yield part.column(0).to_pylist(), part.column(1).to_pylist(), tokenize(own, at[lo : hi + 1] - at[lo], SPACED), part, own


def _probe(block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, f, mask = flush_ids(), _Flush(), U64((1 << bits) - 1)
        for ids, keys, words, _, _ in _documents(batches):
            counts = np.diff(words.bounds)
            at = ranges(words.bounds[:-1], counts - block + 1)
            inside = at - np.repeat(words.bounds[:-1], np.maximum(counts - block + 1, 0))
            f.add(ids, keys, words.bounds, sequences(words.hash, block)[at] & mask, None, at, (inside % block == 0).astype(U64))
            if f.words >= FLUSH:
                yield f.emit(next(numbers), ANCHORS)
                f = _Flush()
        if (last := f.emit(next(numbers), ANCHORS)) is not None:
            yield last

    return run


def _windows(window: int, block: int, bits: int):
    """Hashes of the windows that hold an anchor, of (doc_id, text_key, text, places) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, f, mask = flush_ids(), _Flush(), U64((1 << bits) - 1)
        for ids, keys, words, part, data in _documents(batches):
            wanted, owner = [], []
            for i, places, lo, hi in zip(ids, part.column(3).to_pylist(), words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                last = hi - lo - window
                p = unpack_sorted(places).astype(np.int64)
                if last < 0 or not len(p):
                    continue
                mark = np.zeros(last + 2, np.int64)
                np.add.at(mark, np.clip(p - (window - block), 0, last + 1), 1)
                np.add.at(mark, np.clip(p + 1, 0, last + 1), -1)
                wanted.append(lo + np.flatnonzero(np.cumsum(mark[:-1]) > 0))
                owner.append(np.full(len(wanted[-1]), i, np.int64).view(U64) ^ SIGN)
            at = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
            value = np.concatenate(owner) if owner else np.zeros(0, U64)
            h = mix(sequences(words.hash, window)[at], 32) if len(at) else np.zeros(0, U64)
            check = sequences(second_hashes(data, words, SPACED), window)[at] if len(at) else np.zeros(0, U64)
            f.add(ids, keys, words.bounds, h & mask, check, at, value)
            if f.words >= FLUSH:
                yield f.emit(next(numbers), WINDOWS)
                f = _Flush()
        if (last := f.emit(next(numbers), WINDOWS)) is not None:
            yield last

    return run


def _back(frame: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, text_key, places in the document) of a flush: its documents, and the entries that were told."""
    own = frame["own"].dropna()
    none = pd.DataFrame({"doc_id": [], "text_key": [], "places": []})
    if not len(own):
        return none
    ids, keys, starts, others, leaders, told = unpack_many(own.iloc[0])
    answers = frame.loc[frame["own"].isna(), "offsets"]
    hit = np.sort(np.concatenate([np.zeros(0, U64), *(unpack_sorted(b) for b in answers)]))
    if len(hit) and len(leaders):
        others = others[hit[np.minimum(np.searchsorted(hit, leaders), len(hit) - 1)] == leaders]
    else:
        others = others[:0]
    off = np.unique(np.concatenate([hit, others, told]))
    if not len(off):
        return none
    doc = np.searchsorted(starts, off, "right") - 1
    which, first = np.unique(doc, return_index=True)
    cuts = [*first.tolist(), len(off)]
    return pd.DataFrame(
        {"doc_id": ids.view(np.int64)[which], "text_key": keys.view(np.int64)[which], "places": [pack_sorted(off[a:b] - starts[d]) for d, a, b in zip(which, cuts[:-1], cuts[1:], strict=True)]}
    )


def _told(sent: DataFrame, kind: Kind, parts: int) -> DataFrame:
    """(doc_id, text_key, places) of the told entries."""
    answered = exchange(sent, kind, parts)
    found = settle(answered.groupBy("flush").applyInPandas(_back, "doc_id long, text_key long, places binary"))
    free(answered)
    return found


def _cut(window: int):
    """Removes the words of the windows at ``places`` from (doc_id, text_key, text, places, extra, own id) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for lo, hi in slices(at):
                part, d = batch.slice(lo, hi - lo), data[at[lo] : at[hi]]
                words = tokenize(d, at[lo : hi + 1] - at[lo], SPACED)
                raw = d.tobytes()
                n, removed, spans, kept = [], [], [], []
                bounds, text_at = words.bounds.tolist(), (at[lo : hi + 1] - at[lo]).tolist()
                for k, places in enumerate(part.column(3).to_pylist()):
                    a, b = bounds[k], bounds[k + 1]
                    n.append(b - a)
                    if places is None:
                        removed.append(0)
                        spans.append([])
                        kept.append(raw[text_at[k] : text_at[k + 1]])
                        continue
                    p = unpack_sorted(places).astype(np.int64)
                    edge = np.flatnonzero(np.concatenate(([True], p[1:] > p[:-1] + window)))
                    first, after = p[edge], np.concatenate((p[edge[1:] - 1], p[-1:])) + window
                    removed.append(int((after - first).sum()))
                    spans.append([{"first": int(x), "after": int(y)} for x, y in zip(first, after, strict=True)])
                    pieces, here = [], text_at[k]
                    for x, y in zip(words.start[a + first].tolist(), words.end[a + after - 1].tolist(), strict=True):
                        pieces.append(raw[here:x])
                        here = y
                    kept.append(b"".join([*pieces, raw[here : text_at[k + 1]]]))
                yield pa.record_batch(
                    [part.column(5), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string()), part.column(4)],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept_text", "extra"],
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, parts: int | None = None, hash_bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text, extra) of every row.

    A word goes if a window of ``window`` words that covers it also
    starts in a row with a smaller id; windows are judged on the input.  spans:
    the removed words as [first, after) pairs; kept_text: the text without
    them, white space around them left in place; extra: a struct of the other
    columns.  A null text has no words and an empty kept_text.  A null id counts
    as larger than all others (as large as 2**63 - 1).  Rows with the same id
    don't remove each other's words; repeated rows are treated alike.  An empty
    table gives an empty result.  ``hash_bits``: how much of the first hash the
    exchange goes by; fewer are slower, not less exact.  ``parts``: of the exchange,
    by default as many as the input's size asks for.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    block = (window + 1) // 2
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    extra = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    text, own = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    base = sized(docs).select(F.coalesce(own, F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), extra.alias("extra"), own.alias("own"))
    lean = base.select("doc_id", "text_key", "text")
    once = lambda df: df.dropDuplicates(["doc_id", "text_key"]).hint("merge")
    if parts is None:
        size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-size // (6 * FLUSH * FLUSHES_PER_PART)))  # about 6 bytes a word
    # The hits grow with the corpus, so they are joined by exchange at every size.
    hits = _told(lean.mapInArrow(_probe(block, hash_bits), PACKED), ANCHORS, parts)
    around = lean.join(once(hits), ["doc_id", "text_key"]).mapInArrow(_windows(window, block, hash_bits), PACKED)
    found = _told(around, WINDOWS, parts)
    free(hits)
    kind = base.schema["extra"].dataType.simpleString()
    joined = base.join(once(found), ["doc_id", "text_key"], "left").select("doc_id", "text_key", "text", "places", "extra", "own")
    return joined.mapInArrow(_cut(window), f"doc_id long, n_words long, n_removed long, spans array<struct<first:long,after:long>>, kept_text string, extra {kind}")
