"""Language identification by rank-order profiles (out-of-place distance).

A profile is the ranking of the most frequent 1- to ``longest``-grams of padded,
lower-cased words of letters.  A document's profile is compared with each
language's: a gram counts the difference of its ranks, or the profile's length
where the language doesn't have it.  The nearest language wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import settle
from .words import U64, ranges, sized, slices, utf8

PAD = U64(1)
#: More languages than that meet their rows by exchange.
BROADCAST_LANGS = 100_000
#: Bytes of text whose grams are counted at once; grams take many times that in a worker.
AT_ONCE = 1 << 17


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter; its lower case."""
    n = 0x110000
    letter = np.zeros(n, bool)
    lower = np.arange(n, dtype=np.uint32)
    for c in range(n):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            letter[c] = True
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
    return letter, lower


def grams(data: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count) of the documents' n-grams, by document and gram; a gram is 44 bits of a hash."""
    letter, lower = _letters()
    lead = (data & 0xC0) != 0x80
    place = np.cumsum(lead)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.concatenate(([0], place))[at]
    is_letter = letter[points]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    # A pad before and after every word of letters.
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    begin = is_letter & (~np.concatenate(([False], is_letter[:-1])) | edge[:-1]) if len(points) else is_letter
    kept = np.flatnonzero(is_letter)
    word = np.cumsum(begin)[kept]
    n_words = int(begin.sum())
    size = len(kept) + 2 * n_words
    symbol = np.full(size, PAD, U64)
    slot = np.arange(len(kept)) + 2 * word - 1
    symbol[slot] = lower[points[kept]].astype(U64) + U64(2)
    word_of = np.zeros(size, np.int64)
    doc_of = np.zeros(size, np.int64)
    word_of[slot], doc_of[slot] = word, doc[kept]
    pads = symbol == PAD
    first = slot[np.flatnonzero(np.diff(word, prepend=0))] - 1 if len(kept) else slot
    last = np.append(first[1:] - 1, size - 1) if len(kept) else slot
    for p in (first, last):
        word_of[p] = np.arange(1, n_words + 1)
    doc_first = doc_of[first + 1] if len(kept) else doc_of[:0]
    doc_of[first], doc_of[last] = doc_first, doc_first
    keys = []
    rolled = np.zeros(size, U64)
    for n in range(1, longest + 1):
        m = size - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * U64(0x9E3779B97F4A7C15) + symbol[n - 1 :]
        inside = word_of[:m] == word_of[n - 1 :]
        if n == 1:
            inside &= ~pads
        keys.append((doc_of[:m][inside].astype(U64) << U64(44)) | ((rolled[inside] * U64(0xD6E8FEB86659FD93)) >> U64(20)))
    every = np.sort(np.concatenate(keys)) if keys else np.zeros(0, U64)
    at_ = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.append(at_, len(every)))
    return (every[at_] >> U64(44)).astype(np.int64), every[at_] & U64((1 << 44) - 1), count


def top_grams(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, rank from 0) of each document's most frequent grams; ties to the smaller gram."""
    # grams come in order, and the sort is stable
    key = (doc.astype(U64) << U64(32)) | (U64(2**32 - 1) - np.minimum(count, 2**32 - 1).astype(U64))
    order = np.argsort(key, kind="stable")
    doc, gram = doc[order], gram[order]
    first = np.searchsorted(doc, doc)
    rank = np.arange(len(doc)) - first
    keep = rank < size
    return doc[keep], gram[keep], rank[keep]


class Profiles(NamedTuple):
    """Ranks by gram, as long as the profiles together: those of ``gram[i]`` are at ``first[i]`` to ``first[i + 1]``."""

    langs: list[str]
    gram: np.ndarray  # of any language, ascending
    first: np.ndarray
    lang: np.ndarray  # place in langs
    rank: np.ndarray
    size: int
    longest: int

    def distances(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, languages) of out-of-place distances, and how many grams each document's profile has."""
        n, k = len(at) - 1, len(self.langs)
        doc, gram, rank = top_grams(*grams(data, at, self.longest), self.size)
        held = np.bincount(doc, minlength=n)
        where = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        known = np.flatnonzero(self.gram[where] == gram)
        times = self.first[where[known] + 1] - self.first[where[known]]
        entry, of = ranges(self.first[where[known]], times), np.repeat(known, times)
        saved = self.size - np.abs(self.rank[entry] - rank[of])  # of the distance that a missing gram has
        return (held * self.size)[:, None] - np.bincount(doc[of] * k + self.lang[entry], saved, n * k).reshape(n, k), held

    def judge(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Nearest language of each document, and how near it is, 0 to 1; memory follows ``AT_ONCE`` or the longest document."""
        langs, score = ["und"] * (len(at) - 1), np.zeros(len(at) - 1)
        for lo, hi in slices(at, AT_ONCE) if self.langs else ():
            distance, held = self.distances(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            best = distance.argmin(1)
            least = distance.min(1) / np.maximum(1, held * self.size)
            langs[lo:hi] = ["und" if not h else self.langs[b] for h, b in zip(held, best, strict=True)]
            score[lo:hi] = np.where(held > 0, np.clip(1 - least, 0, 1), 0.0)
        return langs, score


def learn_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_per_lang: int = 500, size: int = 400, longest: int = 3) -> Profiles:
    """Profiles from about ``docs_per_lang`` labelled rows of each language.

    A language's rows are taken at a rate of docs_per_lang / its rows (all, if it
    has fewer), by a hash of id and language.  Rows without a language or text
    are left out, and languages beyond the ``most_langs`` most frequent.  The
    texts are counted whole, on the executors; ``size`` grams a language come back.
    """
    rows = sized(labelled).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)), lang_col).alias("h")).where("lang is not null")
    rates = settle(rows.groupBy("lang").count())
    if rates.count() <= BROADCAST_LANGS:
        rates = F.broadcast(rates)
    part = F.pmod(F.col("h"), F.lit(1_000_000)) * F.col("count") < F.lit(docs_per_lang * 1_000_000)
    sample = rows.join(rates, "lang").where(part & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, index = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            data, at = utf8(batch.column(1))
            for lo, hi in slices(at, AT_ONCE):
                doc, gram, n = grams(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], longest)
                key = (index[lo:hi][doc].astype(U64) << U64(44)) | gram
                own, back = np.unique(key, return_inverse=True)
                yield pa.record_batch(
                    [pa.array(langs[(own >> U64(44)).astype(np.int64)].astype(str)), pa.array((own & U64((1 << 44) - 1)).astype(np.int64)), pa.array(np.bincount(back, n, len(own)).astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counts = settle(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = (F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).alias("rank")
    got = counts.select("lang", "gram", rank).where(F.col("rank") < size).toArrow()  # `size` rows a language
    langs = sorted(set(got.column("lang").to_pylist()))
    place = {name: k for k, name in enumerate(langs)}
    lang = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    gram, rank = got.column("gram").to_numpy().astype(U64), got.column("rank").to_numpy().astype(np.int64)
    order = np.lexsort((lang, gram))
    every, first = np.unique(gram[order], return_index=True)
    return Profiles(langs, every, np.append(first, len(order)), lang[order], rank[order], size, longest)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, for every whole text; no shuffle.

    lang_pred is `und`, with score 0, for a null text, one without letters, or
    without profiles.  Equal distances go to the language that sorts first.
    Columns of ``docs`` named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # bounded by the profiles' size
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = sized(docs).select(F.col(f"`{text_col}`").cast("string").alias("_judged"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(0))
            for lo, hi in slices(at):
                langs, score = shared.value.judge(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                yield pa.record_batch([batch.column(1).slice(lo, hi - lo), pa.array(langs), pa.array(score)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double").select("row.*", "lang_pred", "score")
