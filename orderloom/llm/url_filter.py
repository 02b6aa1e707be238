"""URL filters: host rules first, boosted trees on lexical features for the rest.

The trees learn from labelled URLs.  Where no labels are given, the URLs that a
rule decides are the labelled ones.  A URL's own label never enters the suffix
rates that it is learnt with: these come from the other folds.  The fit reads at
most ``fit_rows`` distinct labelled URLs (the smallest by hash, so the choice
doesn't depend on layout); scoring covers every row.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import BoostedTrees
from .words import SPACED_FOLDED, U64, slices, span_hashes, utf8

#: The rules of the shipped query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last one set wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


class Rates(NamedTuple):
    """Smoothed rate of label 1 by hash of a host's last label or last two."""

    key: np.ndarray
    rate: np.ndarray
    prior: float

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(keys), self.prior)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.rate[at], self.prior)


def suffix_rates(suffixes: np.ndarray, y: np.ndarray, smooth: float = 5.0) -> Rates:
    prior = (y.sum() + 0.5) / (len(y) + 1)
    key, at = np.unique(suffixes, return_inverse=True)
    one = np.where(suffixes[:, 0] == suffixes[:, 1], 0.5, 1.0)[:, None]  # a host of one label counts once
    n = np.bincount(at.ravel(), np.broadcast_to(one, suffixes.shape).ravel(), len(key))
    bad = np.bincount(at.ravel(), (one * y[:, None] * np.ones((1, 2))).ravel(), len(key))
    return Rates(key, (bad + smooth * prior) / (n + smooth), float(prior))


def _next(places: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first of the places from ``start`` on, or ``end``."""
    at = np.searchsorted(places, start)
    return np.minimum(np.append(places, np.iinfo(np.int64).max)[at], end)


def lexical_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each URL (UTF-8 bytes): length, host length, path depth, digit ratio, entropy, parameters, hyphens, host labels, upper case;
    and hashes of its host's last label and last two."""
    rows, begin, end = len(at) - 1, at[:-1], at[1:]
    where = lambda chars: np.flatnonzero(np.isin(data, np.frombuffer(chars, np.uint8)))
    n = np.maximum(1, end - begin)

    def count(places: np.ndarray, lo: np.ndarray = begin, hi: np.ndarray = end) -> np.ndarray:
        return np.searchsorted(places, hi) - np.searchsorted(places, lo)

    colon = where(b":")
    colon = colon[colon + 2 < len(data)]
    colon = colon[(data[colon + 1] == 0x2F) & (data[colon + 2] == 0x2F)] if len(colon) else colon
    mark = _next(colon, begin, end)
    host = np.where(mark + 3 <= end, mark + 3, end)
    after = _next(where(b"/?#"), host, end)
    path_end = _next(where(b"?#"), after, end)
    query = np.minimum(path_end + 1, end)
    asked = (query < end) & (np.append(data, 0)[np.minimum(path_end, len(data))] == 0x3F)
    query_end = _next(where(b"#"), query, end)
    dots = where(b".")
    labels = count(dots, host, after)
    last = np.searchsorted(dots, after)
    cut = lambda k: np.where(labels >= k, np.append(dots, 0)[np.maximum(last - k, 0)] + 1, host)
    value = SPACED_FOLDED.value[data]
    suffixes = np.stack([span_hashes(value, cut(1), after), span_hashes(value, cut(2), after)], 1)
    entropy = np.zeros(rows)
    owner = np.repeat(np.arange(rows), end - begin)
    for lo in range(0, rows, 4096):
        hi = min(rows, lo + 4096)
        own = slice(at[lo], at[hi])
        share = np.bincount((owner[own] - lo) * 256 + data[own], minlength=(hi - lo) * 256).reshape(-1, 256) / n[lo:hi, None]
        entropy[lo:hi] = -(share * np.log2(np.maximum(share, 1e-300))).sum(1)
    digits, upper = np.flatnonzero((data >= 0x30) & (data <= 0x39)), np.flatnonzero((data >= 0x41) & (data <= 0x5A))
    parameters = np.where(asked & (query_end > query), count(where(b"&"), query, query_end) + 1, 0)
    columns = (end - begin, after - host, count(where(b"/"), after, path_end), count(digits) / n, entropy, parameters, count(where(b"-")), labels + 1, count(upper) / n)
    return np.stack([np.asarray(c, float) for c in columns], 1), suffixes


class Model(NamedTuple):
    trees: BoostedTrees
    rates: Rates

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, suffixes = lexical_features(data, at)
        return self.trees.predict(np.hstack([x, self.rates.of(suffixes[:, 0])[:, None], self.rates.of(suffixes[:, 1])[:, None]]))


def fit(urls: Sequence[str], labels: Sequence[int], folds: int = 5) -> Model:
    """Trees on lexical features and suffix rates; each fold's rates come from the others."""
    data, at = utf8(pa.array(urls, pa.string()))
    y = np.asarray(labels, float)
    x, suffixes = lexical_features(data, at)
    own, fold = np.zeros((len(y), 2)), np.arange(len(y)) % folds
    for f in range(folds):
        others = suffix_rates(suffixes[fold != f], y[fold != f])
        for c in range(2):
            own[fold == f, c] = others.of(suffixes[fold == f, c])
    return Model(BoostedTrees().fit(np.hstack([x, own]), y), suffix_rates(suffixes, y))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    fit_rows: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score: probability of block.

    ``labelled``: (url, label) with label 1 for block; by default what the rules
    decide.  A null url, or one without ``://``, has an empty host and path and
    is judged by the trees alone.  Without labels of both kinds the score is
    their constant rate (allow if there are none).  Repeated rows get the same
    verdict each, a URL labelled both ways counts as 1, and of rules of one length
    the later one by (verdict, host, path) holds; other columns are not read.
    """
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_of(url), path_of(url)
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path")).select(
        "*", rule.alias("rule"), verdict.alias("told")
    )
    if labelled is None:
        labelled = judged.where("rule is not null").select("url", (F.col("told") == "block").cast("int").alias("label"))
    sample = (
        labelled.where("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(fit_rows).collect()
    )  # bounded by fit_rows
    model = fit([r[0] for r in sample], [int(r[1]) for r in sample]) if sample else None
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by fit_rows too

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            scores = [shared.value.score(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in slices(at)] if shared.value else [np.zeros(batch.num_rows)]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*batch.schema.names, "score"])

    scored = judged.mapInArrow(score, "page_id long, url string, host string, path string, rule string, told string, score double")
    said = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("told", said).alias("verdict"), "score")
