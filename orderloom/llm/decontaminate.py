"""Benchmark decontamination with a positional inverted index.

The index is document-partitioned: a shard holds about a quarter million consecutive
words of whole documents, and for each term the ascending positions of its
postings, packed.  It is built once without a shuffle and stored.  A query's
terms are intersected shard by shard from the rarest one (by postings over the
whole index) with offset-adjusted lists; what is left are exact phrase matches.
Test items are taken in blocks of a bounded number of windows, so what is
broadcast is bounded, and every block meets every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import settle
from .packed import flush_ids, pack, pack_sorted, unpack, unpack_sorted
from .words import ALNUM_FOLDED, U64, ranges, sized, slices, tokenize, utf8

#: Words of a shard, if no document has more; a task holds one shard at a time.
SHARD_WORDS = 1 << 18
#: Windows looked up at once.
AT_ONCE = 1 << 15
SHARD = "shard long, doc_ids binary, no_id binary, starts binary, n_words long, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the positional index of every row; a null text has no words, a null id is marked as such."""

    def shard(number: int, ids: list[int | None], starts: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        steps = np.diff(order, prepend=0)
        if len(first):
            steps[first] = order[first]  # each list starts anew
        known = np.array([0 if i is None else i for i in ids], np.int64).view(U64)
        columns = [number, pack(known), pack(np.array([i is None for i in ids], U64)), pack_sorted(np.array(starts, U64)), len(h), pack_sorted(s[first]), pack(np.diff([*first, len(s)])), pack(steps)]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "doc_ids", "no_id", "starts", "n_words", "terms", "counts", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = flush_ids()
        ids: list[int | None] = []
        starts: list[int] = []
        hashes: list[np.ndarray] = []
        n = 0
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in slices(at):
                words = tokenize(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM_FOLDED)
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                starts += (words.bounds[:-1] + n).tolist()
                hashes.append(words.hash)
                n += len(words.hash)
                if n >= SHARD_WORDS:
                    yield shard(next(numbers), ids, starts, hashes)
                    ids, starts, hashes, n = [], [], [], 0
        if ids:
            yield shard(next(numbers), ids, starts, hashes)

    return sized(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SHARD)


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    data, at = utf8(pa.array(texts, pa.string()))
    words = tokenize(data, at, ALNUM_FOLDED)
    return [words.hash[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Lists of (item, windows as a matrix of term hashes) of about ``most`` windows."""
    block, n = [], 0
    for row in items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).toLocalIterator():
        words = _item_words([row[1]])[0]
        if not len(words):
            continue
        w = min(window, len(words))
        at = np.lib.stride_tricks.sliding_window_view(words, w)
        for lo in range(0, len(at), most):
            if n and n + len(at[lo : lo + most]) > most:
                yield block
                block, n = [], 0
            block.append((row[0], np.unique(at[lo : lo + most], axis=0)))
            n += len(block[-1][1])
    if block:
        yield block


def _by_width(block: list[tuple[int | None, np.ndarray]], terms: np.ndarray, rare: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item's place in the block, places of its words in ``terms``, those from the rarest on) of the windows of each width."""
    out = []
    for width in sorted({w.shape[1] for _, w in block}):
        own = [(place, w) for place, (_, w) in enumerate(block) if w.shape[1] == width]
        at = np.searchsorted(terms, np.concatenate([w for _, w in own])).astype(np.int32)
        order = np.argsort(rare[at], axis=1, kind="stable").astype(np.int32)
        out.append((np.repeat([place for place, _ in own], [len(w) for _, w in own]), at, order))
    return out


class _Shard:
    """A stored shard, with its lists and the words in their order."""

    def __init__(self, row: dict):
        self.ids = unpack(row["doc_ids"]).view(np.int64)
        self.starts = unpack_sorted(row["starts"]).astype(np.int64)
        self.bounds = np.append(self.starts, row["n_words"])
        self.terms = unpack_sorted(row["terms"])
        self.counts = unpack(row["counts"]).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.positions = unpack(row["positions"]).astype(np.int64)
        if len(self.positions):
            total = np.cumsum(self.positions, out=self.positions)
            before = np.concatenate(([0], total[self.first[1:] - 1]))
            total -= np.repeat(before, self.counts)
        self.term_at = np.empty(len(self.positions), np.int32)
        self.term_at[self.positions] = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.counts)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term here, or -1."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def phrase(self, numbers: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Where a phrase begins, inside one document: lists intersected in the given order of its terms."""
        o = int(order[0])
        t = int(numbers[o])
        begin = self.positions[self.first[t] : self.first[t] + self.counts[t]] - o
        begin = begin[(begin >= 0) & (begin + len(numbers) <= len(self.positions))]
        for o in order[1:].tolist():
            if not len(begin):
                return begin
            begin = begin[self.term_at[begin + o] == numbers[o]]
        if not len(begin):
            return begin
        doc = np.searchsorted(self.bounds, begin, "right")
        return begin[doc == np.searchsorted(self.bounds, begin + len(numbers) - 1, "right")]

    def near(self, numbers: np.ndarray, order: np.ndarray, width: int) -> list[tuple[int, int]]:
        """All spans of at most ``width`` words of one document that hold every term, in any order, and no smaller such span.

        Only places around the occurrences of the rarest term are looked at.
        """
        terms = list(dict.fromkeys(numbers[order].tolist()))
        rare = self.positions[self.first[terms[0]] : self.first[terms[0]] + self.counts[terms[0]]]
        at, kind = [rare], [np.zeros(len(rare), np.int64)]
        for k, t in enumerate(terms[1:], 1):
            own = self.positions[self.first[t] : self.first[t] + self.counts[t]]
            here = np.searchsorted(rare, own)
            gap = np.minimum(np.abs(own - rare[np.minimum(here, len(rare) - 1)]), np.abs(own - rare[np.maximum(here - 1, 0)]))
            at.append(own[gap < width])
            kind.append(np.full(len(at[-1]), k))
            if not len(at[-1]):
                return []
        places, kinds = np.concatenate(at), np.concatenate(kind)
        sort = np.argsort(places)
        places, kinds = places[sort].tolist(), kinds[sort].tolist()
        doc = np.searchsorted(self.bounds, places, "right").tolist()
        out, last = [], {}  # last: each term's latest place in this document
        for i, (p, k) in enumerate(zip(places, kinds, strict=True)):
            if i and doc[i] != doc[i - 1]:
                last = {}
            last[k] = p
            if len(last) == len(terms) and p - (begin := min(last.values())) < width and (not out or out[-1][0] < begin):
                out.append((begin, p + 1))
        return out


def rarity(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Postings of each asked term over the whole index."""
    asked = index.sparkSession.sparkContext.broadcast(np.sort(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.value), np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1), strict=True):
                own, c = unpack_sorted(t.as_py()), c.as_py()
                if len(own) and len(total):
                    at = np.minimum(np.searchsorted(own, asked.value), len(own) - 1)
                    total += np.where(own[at] == asked.value, unpack(c).astype(np.int64)[at], 0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(asked.value[some].view(np.int64)), pa.array(total[some])], names=["term", "n"])

    counts = index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n"))
    return {r[0] % 2**64: r[1] for r in counts.collect()}  # as many as the block's terms at most


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 13, windows_per_block: int = 200_000, width: int | None = None) -> DataFrame:
    """(shard, doc, item_id, first, after): occurrences of the items' windows; doc is a row of the shard.

    A window is ``window`` consecutive words of an item, or all of a shorter
    one; first and after are word offsets in the document, of exact phrases, or
    with ``width`` of the proximity matches within so many words.  Adjoining
    occurrences of one item in a document come as one row; proximity matches, each
    of which holds no smaller one, come as they are.  An item without id has a null
    item_id.  Each block of ``windows_per_block`` windows is one pass over the
    index, so a benchmark of 10**8 words takes 500 passes; raise it with memory.
    """
    spark = index.sparkSession
    found = None
    for block in _blocks(items, id_col, text_col, window, windows_per_block):
        terms = np.unique(np.concatenate([w.ravel() for _, w in block]))
        held = rarity(index, terms)
        rare = np.array([held.get(int(t), 0) for t in terms], np.int64)
        shared = spark.sparkContext.broadcast((terms, _by_width(block, terms, rare), [item for item, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, widths, names = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    s, out = _Shard(row), []
                    here = s.number(terms)
                    for owner, at, order in widths:
                        for lo in range(0, len(at), AT_ONCE):
                            numbers = here[at[lo : lo + AT_ONCE]]
                            for k in np.flatnonzero((numbers >= 0).all(1)).tolist():
                                item = int(owner[lo + k])
                                if width is None:
                                    begin = s.phrase(numbers[k], order[lo + k])
                                    out += [(item, b, b + at.shape[1]) for b in begin.tolist()]
                                else:
                                    out += [(item, a, b) for a, b in s.near(numbers[k], order[lo + k], width)]
                    if out:
                        yield _merged(row["shard"], s, np.array(out, np.int64), names, width is None)

        part = settle(index.mapInArrow(run, "shard long, doc int, item_id long, first long, after long"))
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "shard long, doc int, item_id long, first long, after long")
    return found


def _merged(shard: int, s: _Shard, hits: np.ndarray, names: list[int | None], join: bool) -> pa.RecordBatch:
    doc = np.searchsorted(s.bounds, hits[:, 1], "right") - 1
    order = np.lexsort((hits[:, 1], hits[:, 0], doc))
    doc, (item, first, after) = doc[order], hits[order].T
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((first[1:] > after[:-1]) if join else ((first[1:] != first[:-1]) | (after[1:] != after[:-1])))
    at = np.flatnonzero(fresh)
    begin = s.bounds[doc[at]]
    return pa.record_batch(
        [pa.array(np.full(len(at), shard)), pa.array(doc[at].astype(np.int32)), pa.array([names[i] for i in item[at].tolist()], pa.int64()), pa.array(first[at] - begin), pa.array(np.maximum.reduceat(after, at) - begin)],
        names=["shard", "doc", "item_id", "first", "after"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, parts: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every row.

    n_hit counts the words inside any occurrence of a window; items are the ids
    with occurring windows, ascending; contaminated: n_hit > 0 and ``parts`` *
    n_hit >= n_words.  A null or wordless text has no hits, nor has an item
    without words.  An item without id counts for n_hit but isn't in items.
    Repeated rows are judged each.  Empty tables give no
    hits or no rows.  Other columns are not read.
    """
    index = settle(build_index(docs, id_col, text_col))
    hits = search(index, items, item_col, item_text_col, window)
    # Words covered by the spans: the part of each that reaches beyond the spans before it.
    spans = F.array_sort(F.collect_set(F.struct("first", "after")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["after"] - F.greatest(s["first"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], s["after"]).alias("reach")
        ),
        lambda acc: acc["n"],
    )
    by_doc = settle(hits.groupBy("shard", "doc").agg(spans.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")).select("shard", "doc", covered.alias("n_hit"), "items"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, starts = unpack(r["doc_ids"]).view(np.int64), unpack_sorted(r["starts"]).astype(np.int64)
                no_id = unpack(r["no_id"]).astype(bool)
                yield pa.record_batch(
                    [pa.array(np.full(len(ids), r["shard"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, mask=no_id), pa.array(np.diff(np.append(starts, r["n_words"])))],
                    names=["shard", "doc", "doc_id", "n_words"],
                )

    every = index.select("shard", "doc_ids", "no_id", "starts", "n_words").mapInArrow(rows, "shard long, doc int, doc_id long, n_words long")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return every.join(by_doc, ["shard", "doc"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"), ((n_hit > 0) & (n_hit * parts >= F.col("n_words"))).alias("contaminated"),
    )
