"""Toxicity by a gap-weighted subsequence string kernel, Nyström landmarks and a linear SVM.

Strings are the words of a text, and runs of very short words (spelled-out
insults).  They are read as code points: every letter of any script (Unicode L,
and the marks M that many scripts write vowels with) is its own symbol, upper and
lower case alike.  The kernel counts common subsequences of three letters; each
skipped character of a gap of up to two costs a factor, so inserted characters and
separators lower a similarity only a little.  It is normalised, so 1 is the same
word.  Composed and decomposed accents are different letters, and where words are
not spaced, a landmark can only be a whole run of letters.  Landmarks are words that mark label 1 in the fitted sample.  A text's
feature for a landmark is its best string's similarity (0 below ``FLOOR``).  The
kernel is raised to each of ``POWERS`` and the results are added (a kernel too):
the low powers follow altered insults, the high one sets a landmark's own forms
apart from words that merely share syllables.  The Nyström map of that sum goes
into a linear SVM, whose margin is calibrated to a probability.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import settle
from .words import SPACED, U64, mix, ranges, sized, slices, span_hashes, tokenize, utf8

GAP, DECAY, FLOOR, POWERS = 1, 0.5, 0.45, (1, 2, 8)  # GAP: the symbol of what is no letter
WIDE, STEP, SHORT = 24, 12, 2  # of a string's window, between windows, of a short word
STEPS = [(a, b, DECAY ** (a + b - 2)) for a in (1, 2, 3) for b in (1, 2, 3)]
STEMS = (5, 7)  # lengths of word beginnings that are candidates beside the words
BITS, SEEN = 21, 18  # of a code point, of a hashed subsequence


@functools.cache
def symbols() -> np.ndarray:
    """The symbol of each code point: a letter's own code point, folded, and GAP for others; none is 0."""
    out = np.full(0x110000, GAP, np.int32)
    for c in range(0x41, 0x40000):
        if unicodedata.category(chr(c))[0] in "LM":
            fold = chr(c).casefold()
            out[c] = ord(fold) if len(fold) == 1 else c
    out[0xE0100:0xE01F0] = np.arange(0xE0100, 0xE01F0)  # the marks beyond
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the number of them before each byte (and in all)."""
    lead = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    at = np.flatnonzero(lead)
    out = data[at].astype(np.int32)
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        those = np.flatnonzero(data[at] >= least)
        value = data[at[those]].astype(np.int32) & mask
        for k in range(1, more + 1):
            value = value << 6 | (data[np.minimum(at[those] + k, len(data) - 1)] & 0x3F)
        out[those] = np.minimum(value, 0x10FFFF)
    return out, before


class Strings(NamedTuple):
    hash: np.ndarray  # of each distinct string, ascending
    code: np.ndarray  # (distinct strings, WIDE); 0 pads
    doc: np.ndarray  # of each occurrence
    which: np.ndarray  # its string


def strings_of(data: np.ndarray, at: np.ndarray) -> Strings:
    words = tokenize(data, at, SPACED)
    points, before = code_points(data)
    start, end = before[words.start], before[words.end]
    n = len(start)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(words.bounds))
    if n:
        short = end - start <= SHORT
        same = np.zeros(n, bool)
        same[1:] = short[1:] & short[:-1] & (doc[1:] == doc[:-1])
        head = np.flatnonzero(short & ~same)
        size = np.diff(np.append(np.flatnonzero(~same), n))[np.searchsorted(np.flatnonzero(~same), head)]
        head, size = head[size >= 3], size[size >= 3]
        start, end, doc = np.concatenate([start, start[head]]), np.concatenate([end, end[head + size - 1]]), np.concatenate([doc, doc[head]])
    pieces = np.maximum(1, -(-(end - start - WIDE) // STEP) + 1)
    begin = np.repeat(start, pieces) + STEP * ranges(np.zeros(len(start), np.int64), pieces)
    stop = np.minimum(begin + WIDE, np.repeat(end, pieces))
    doc = np.repeat(doc, pieces)
    code = symbols()[points]
    distinct, first, which = np.unique(span_hashes(mix(code.astype(U64)), begin, stop), return_index=True, return_inverse=True)
    cells = begin[first][:, None] + np.arange(WIDE)
    matrix = np.where(cells < stop[first][:, None], np.concatenate([code, np.zeros(1, np.int32)])[np.minimum(cells, len(code))], 0) if len(first) else np.zeros((0, WIDE), np.int32)
    return Strings(distinct, matrix, doc, which)


def subsequences(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight), each (strings, positions * gaps); weight 0 where there is none."""
    features, weights = [], []
    c = code.astype(np.int64)
    letter = c > GAP
    for a, b, w in STEPS:
        m = max(0, c.shape[1] - a - b)
        ok = letter[:, :m] & letter[:, a : a + m] & letter[:, a + b : a + b + m]
        features.append((c[:, :m] << 2 * BITS | c[:, a : a + m] << BITS | c[:, a + b : a + b + m]) * ok)
        weights.append(ok * np.float32(w))
    return np.concatenate(features, 1), np.concatenate(weights, 1)


def norms(f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Lengths of the feature vectors; equal features of a string add up first."""
    n, m = f.shape
    order = np.argsort(f, axis=1)
    f, w = np.take_along_axis(f, order, 1).ravel(), np.take_along_axis(w, order, 1).ravel()
    fresh = np.ones(n * m, bool)
    fresh[1:] = f[1:] != f[:-1]
    fresh[::m] = True
    at = np.flatnonzero(fresh)
    return np.sqrt(np.bincount(at // m, np.add.reduceat(w.astype(float), at) ** 2, n))


def encode_words(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), WIDE), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = symbols()[[ord(c) for c in w[:WIDE]]]
    return out


def _hashed(f: np.ndarray) -> np.ndarray:
    return ((f.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - SEEN)).astype(np.int32)


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        f, w = subsequences(encode_words(words))
        row, cell = np.nonzero(w)
        self.used, where = np.unique(f[row, cell], return_inverse=True)
        phi = np.zeros((len(words), len(self.used)))
        np.add.at(phi, (row, where), w[row, cell])
        phi /= np.maximum(np.linalg.norm(phi, axis=1), 1e-12)[:, None]
        # Landmarks and their weights by subsequence: those of ``used[i]`` are at first[i + 1] to first[i + 2]; place 0 has none.
        at, self.mark = np.nonzero(phi.T)
        self.weight = phi.T[at, self.mark]
        self.first = np.concatenate(([0], np.searchsorted(at, np.arange(len(self.used) + 1))))
        self.seen = np.zeros(1 << SEEN, bool)
        self.seen[_hashed(self.used)] = True
        self.most = np.zeros(len(self.used) + 1, np.float32)
        self.most[1:] = phi.max(0) if len(words) else 0
        self.dull = np.zeros(0, U64)  # hashes of strings that were found similar to no landmark
        self.whiten = []
        for power in POWERS if len(words) else ():
            values, basis = np.linalg.eigh((phi @ phi.T) ** power)
            good = values > 1e-8
            self.whiten.append(basis[:, good] / np.sqrt(values[good] * len(POWERS)))

    def nystroem(self, similar: np.ndarray) -> np.ndarray:
        return np.hstack([similar**power @ w for power, w in zip(POWERS, self.whiten, strict=True)])

    def places(self, f: np.ndarray) -> np.ndarray:
        """1 and more: the subsequence's place in ``used``; 0: in no landmark."""
        out = np.zeros(f.size, np.int32)
        if len(self.used):
            maybe = np.flatnonzero(self.seen[_hashed(f.ravel())])
            own = f.ravel()[maybe]
            at = np.minimum(np.searchsorted(self.used, own), len(self.used) - 1)
            out[maybe] = np.where(self.used[at] == own, at + 1, 0)
        return out.reshape(f.shape)

    def _similar(self, f: np.ndarray, w: np.ndarray, places: np.ndarray) -> np.ndarray:
        """(strings, landmarks), through the landmarks that have a string's subsequences."""
        n, k = len(f), len(self.words)
        cell = np.flatnonzero(places.ravel())
        at = places.ravel()[cell]
        begin, times = self.first[at], self.first[at + 1] - self.first[at]
        entry = ranges(begin, times)
        out = np.bincount(np.repeat(cell // places.shape[1] * k, times) + self.mark[entry], np.repeat(w.ravel()[cell], times) * self.weight[entry], n * k).reshape(n, k)
        return out / np.maximum(norms(f, w), 1e-12)[:, None]

    def features(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Best similarity of each text's strings to each landmark."""
        out = np.zeros((len(at) - 1, len(self.words)))
        s = strings_of(data, at)
        if not len(s.code) or not self.words:
            return out
        fresh = self.dull[np.minimum(np.searchsorted(self.dull, s.hash), len(self.dull) - 1)] != s.hash if len(self.dull) else np.ones(len(s.hash), bool)
        string, mark, value = [], [], []
        length = (s.code > 0).sum(1)
        for wide, those in ((10, np.flatnonzero(fresh & (length <= 10))), (WIDE, np.flatnonzero(fresh & (length > 10)))):
            for lo in range(0, len(those), 4096):
                some = those[lo : lo + 4096]
                f, w = subsequences(s.code[some, :wide])
                places = self.places(f)
                # No similarity is larger than this bound; most strings stay below the floor.
                maybe = np.flatnonzero((self.most[places] * w).sum(1) >= FLOOR * np.sqrt(np.maximum((w * w).sum(1), 1e-12)))
                if len(maybe):
                    got = self._similar(f[maybe], w[maybe], places[maybe])
                    near, which = np.nonzero(got >= FLOOR)
                    string.append(some[maybe[near]])
                    mark.append(which)
                    value.append(got[near, which])
        none = np.zeros(0, np.int64)
        string, mark, value = np.concatenate([none, *string]), np.concatenate([none, *mark]), np.concatenate([none.astype(float), *value])
        similar = np.zeros(len(s.hash), bool)
        similar[string] = True
        self._remember(s.hash[fresh & ~similar])
        order = np.argsort(string, kind="stable")
        mark, value = mark[order], value[order]
        first = np.searchsorted(string[order], np.arange(len(s.hash) + 1))
        hit = np.flatnonzero(similar[s.which])
        times = first[s.which[hit] + 1] - first[s.which[hit]]
        entry = ranges(first[s.which[hit]], times)
        np.maximum.at(out.reshape(-1), np.repeat(s.doc[hit], times) * len(self.words) + mark[entry], value[entry])
        return out

    def _remember(self, hashes: np.ndarray, most: int = 1 << 20) -> None:
        """So that words of one worker's texts are compared once; when there are too many, only the last are kept."""
        if len(hashes):
            self.dull = np.sort(np.concatenate([self.dull, hashes])) if len(self.dull) + len(hashes) <= most else hashes


def spread(words: Iterator[str], most: int, near: float = 0.6) -> list[str]:
    """The first ``most`` words that are less similar than ``near`` to each word taken before; places left go to the first of the others."""
    taken, others, held = [], [], {}  # held: subsequence -> (place in taken, weight)
    for word in words:
        f, w = subsequences(encode_words([word]))
        own = {}
        for key, weight in zip(f[w > 0].tolist(), w[w > 0].tolist(), strict=True):
            own[key] = own.get(key, 0.0) + weight
        length = math.sqrt(sum(x * x for x in own.values())) or 1.0
        sims = {}
        for key, weight in own.items():
            for place, other in held.get(key, ()):
                sims[place] = sims.get(place, 0.0) + weight / length * other
        if own and max(sims.values(), default=0.0) < near:
            for key, weight in own.items():
                held.setdefault(key, []).append((len(taken), weight / length))
            taken.append(word)
            if len(taken) == most:
                break
        elif own and len(others) < most:
            others.append(word)
    return taken + others[: most - len(taken)]


class Model(NamedTuple):
    landmarks: Landmarks
    weight: np.ndarray
    slope: float
    shift: float

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.landmarks.words:
            return np.full(len(at) - 1, 1 / (1 + np.exp(-self.shift)))
        margin = _plus_one(self.landmarks.nystroem(self.landmarks.features(data, at))) @ self.weight
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _plus_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Linear SVM with a bias, classes weighted alike, by dual coordinate descent."""
    x, t = _plus_one(x), np.where(y > 0, 1.0, -1.0)
    upper = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y <= 0).sum()))
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(y)), (x * x).sum(1)
    rng = np.random.default_rng(3)
    # Rows without any similarity are alike: they are one row with their bounds' sum.
    same, back = np.unique(np.round(np.hstack([x, t[:, None]]), 6), axis=0, return_inverse=True)
    total = np.bincount(back.ravel(), upper)
    x, t, square, alpha, upper = same[:, :-1], same[:, -1], (same[:, :-1] ** 2).sum(1), np.zeros(len(same)), total
    for _ in range(rounds):
        for i in rng.permutation(len(t)).tolist():
            new = min(max(alpha[i] + (1 - t[i] * (x[i] @ w)) / square[i], 0.0), upper[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * t[i] * x[i]
                alpha[i] = new
    return w


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a little shrinkage."""
    a = np.stack([margin, np.ones(len(margin))], 1)
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        g = a.T @ (p - target) + 1e-3 * v
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        v -= np.clip(step, -2, 2)
    return float(v[0]), float(v[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_label: int = 8_000, landmarks: int = 256, least_docs: int = 3, chance: float = 1.0) -> Model:
    """A model from at most ``docs_per_label`` labelled ids of either label (the smallest by a hash of the id) and their texts.

    An id with several labels counts as 1 if any is.
    Landmarks are words, or beginnings of words (so that the forms of a stem count
    together), that mark label 1 more than chance explains: of all those held by ``least_docs`` texts, ``chance`` at most are expected to do so by
    accident (Chernoff's bound on their share of texts with label 1, over all words
    tested).  The clearest come first; words beyond the third whose first and last
    text are the same come after all others.  Words similar to one taken before
    (0.6), such as forms of its stem, get only the places that the rest leave.  Of
    equal texts with one label one is taken; near copies all are.
    """
    spark = docs.sparkSession
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    told = told.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    picks = [told.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(docs_per_label) for y in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    chosen = texts.join(F.broadcast(picks[0].union(picks[1])), "id")  # 2 * docs_per_label rows at most
    spelled = F.split(F.lower("text"), r"[^\p{L}\p{M}]+")
    tokens = F.array_distinct(F.flatten(F.transform(spelled, lambda w: F.array(w, *(F.substring(w, 1, n) for n in STEMS)))))
    rows = settle(chosen.select(F.xxhash64("text").alias("h"), "y", "text", tokens.alias("words")))
    sample = settle(rows.dropDuplicates(["y", "h"]))
    sizes = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    words = settle(
        sample.select("h", "y", F.explode("words").alias("w")).where(F.col("w").rlike(r"^[\p{L}\p{M}]{3,24}$"))
        .groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"), F.min(F.when(F.col("y") > 0, F.col("h"))).alias("first"), F.max(F.when(F.col("y") > 0, F.col("h"))).alias("last"))
    )
    n, base = F.col("a") + F.col("b"), pos / (pos + neg or 1)
    p = F.col("a") / n
    part = lambda x, of: F.when(x > 0, x * F.log(x / max(of, 1e-12))).otherwise(0.0)
    tested = words.where(n >= least_docs)
    clear = F.when(p > base, n * (part(p, base) + part(1 - p, 1 - base))).otherwise(0.0)
    least = math.log(max(1, tested.count()) / chance)
    top = (
        tested.withColumn("z", clear).where((F.col("z") >= least) & (F.col("a") >= least_docs)).withColumn("k", F.row_number().over(Window.partitionBy("first", "last").orderBy(F.desc("z"), "w")))
        .orderBy(F.col("k") > 3, F.desc("z"), "w").select("w")
    )
    marks = Landmarks(spread((r["w"] for r in top.toLocalIterator()), landmarks))
    rate = (pos + 0.5) / (pos + neg + 1)
    constant = Model(Landmarks([]), np.zeros(1), 1.0, float(np.log(rate / (1 - rate))))
    if not marks.words or not pos or not neg:
        return constant
    shared = spark.sparkContext.broadcast(marks)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in slices(at):
                f = shared.value.features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                bounds = np.arange(hi - lo + 1, dtype=np.int32) * f.shape[1]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.ravel()))], names=["y", "f"])

    got = sized(sample).select("y", "text").mapInArrow(measure, "y int, f array<double>").toArrow()  # 2 * docs_per_label rows at most
    y = np.array(got.column("y").to_pylist())
    x = marks.nystroem(np.array(got.column("f").to_pylist()))
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    w = fit_svm(x, y)
    slope, shift = calibrate(_plus_one(x) @ w, y)
    return Model(marks, w, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text; no shuffle.

    A null, empty or wordless text has no similarity to any landmark and gets
    the score of such texts.  Repeated rows are scored each; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in slices(at, 1 << 20):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))], names=["doc_id", "score"])

    return sized(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")
