"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is the set of its distinct word shingles (one shingle of the whole
sequence where it has fewer words).  Equal sets are one class.  A class is
posted under each (coordinate, value) pair of its signature; a coordinate is a
run of ``rows`` min-hashes.  Classes whose posting lists collide at least
``matches`` times are candidates, and each candidate pair is confirmed on the
full sets, so nothing is linked that isn't similar.

Prefix: a pair with T of k matches shares one of the first k - T + 1
coordinates, so only those are posted.  Skip: a list of any length is first
compared with its leader alone.  What that confirms is contracted, and only
lists that still hold several components are merged further.  There the classes
meet under the rarest shingles of their sets: of two sets that are similar
enough, either's prefix of n - ceil(threshold * n) + 1 rarest ones has one of the
other's prefix.  Members of one component don't meet, nor do independent edits of
one text, whose rarest shingles are their own; pairs that met need T matches as
before.  So no list makes all its pairs, and no pair that could link two
components is lost.

With the defaults a pair at exactly the threshold is missed with a probability
of 2e-7 (32 coordinates of 5, similarity 0.85).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import connected_components
from ..scratch import free, settle
from .words import SPACED_FOLDED, U64, mix, sized, slices, tokenize, utf8

_rng = np.random.default_rng(7)
#: Bytes of text whose shingles are held at once.
AT_ONCE = 1 << 17


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and each document's place in them."""
    words = tokenize(data, at, SPACED_FOLDED)
    h, sets, counts = words.hash, [], np.zeros(len(at), np.int64)
    rolled = np.zeros(max(0, len(h) - n + 1), U64)
    for j in range(n):
        rolled = mix(rolled + h[j : j + len(rolled)], j + 1)
    for d, (lo, hi) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
        if hi == lo:
            continue
        if hi - lo < n:
            own = np.zeros(1, U64)
            for j in range(hi - lo):
                own = mix(own + h[lo + j], j + 1)
            own = mix(own, 1000 + hi - lo)
        else:
            own = np.sort(rolled[lo : hi - n + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        sets.append(own)
        counts[d + 1] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.cumsum(counts)


def class_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit value per set, equal for equal sets; 0 for an empty one."""
    out, full = np.zeros(len(bounds) - 1, U64), np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[full]
        total = mix(np.add.reduceat(mix(sets, 11), starts), 13) + np.add.reduceat(mix(sets, 12), starts)
        out[full] = np.maximum(mix(total, 14), U64(1))
    return out


def signatures(sets: np.ndarray, bounds: np.ndarray, coordinates: int, rows: int) -> np.ndarray:
    """(documents, coordinates): values that hold their coordinate's number too."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, coordinates), U64)
    if len(full):
        rng = np.random.default_rng(42)
        x, starts = (sets >> U64(32)).astype(np.uint32), bounds[full]
        for c in range(coordinates):
            value = np.full(len(full), c + 1, U64)
            for _ in range(rows):
                flip, by = rng.integers(0, 2**32, 2, dtype=np.uint32)
                value = mix(value + np.minimum.reduceat((x ^ flip) * (by | np.uint32(1)), starts), 21)
            out[full, c] = value
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int, coordinates: int, rows: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, keys) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in slices(at, AT_ONCE):
                sets, bounds = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n)
                sig = signatures(sets, bounds, coordinates, rows).astype(np.int64)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(np.diff(bounds)),
                        pa.array(class_of(sets, bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * coordinates), pa.array(sig.ravel())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "cls", "keys"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_key long, n_shingles long, cls long, keys array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, text_key); the text's hash names a text where the id is null."""
    text = F.col(f"`{text_col}`").cast("string")
    return sized(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(cls, members) of (doc_id, text) rows; equal texts may come in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in slices(at, AT_ONCE):
                sets, bounds = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n)
                yield pa.record_batch(
                    [pa.array(class_of(sets, bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.astype(np.int64)))],
                    names=["cls", "members"],
                )

    return docs.mapInArrow(run, "cls long, members array<long>")


def rows_for(percent: int, coordinates: int, miss: float = 1e-6) -> int:
    """Most min-hashes a coordinate can hold if a pair at the threshold may be missed so rarely."""
    r = 1
    while r < 12:
        p = (percent / 100) ** (r + 1)
        if (1 - p) ** coordinates + coordinates * p * (1 - p) ** (coordinates - 1) > miss:
            break
        r += 1
    return r


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    coordinates: int = 32,
    matches: int = 2,
    rows: int | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Rows are linked if 100 * |A and B| >= ``percent`` * |A or B|; component_id
    is the smallest id that is reachable.  A null or wordless text has an empty
    set and is linked with nothing.  Rows that share an id and a set are one
    node; all of them are returned.  A row without an id is linked like any other
    and may bridge two documents; its component is the smallest id that it
    reaches, or null if it reaches none, and then it is kept.  Other columns of
    ``docs`` are not read.  An empty table gives an empty result.
    """
    rows = rows or rows_for(percent, coordinates)
    prints = settle(fingerprints(docs, id_col, text_col, shingle_words, coordinates, rows))
    classes = settle(
        prints.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys"))
    )
    posts = classes.select("cls", "n", F.explode(F.slice("keys", 1, coordinates - matches + 1)).alias("key"))
    # A list's leader is the class with the smallest id: copies tend to come after what they were copied from.
    order = F.coalesce("rep", F.lit(2**62) + F.pmod("cls", F.lit(2**62)))  # classes of rows without ids come last, each for itself
    lists = settle(
        classes.select("cls", order.alias("o"), F.explode(F.slice("keys", 1, coordinates - matches + 1)).alias("key"))
        .groupBy("key")
        .agg(F.min("o").alias("o"), F.count("*").alias("size"))
        .where("size > 1")
        .select("key", "o")
    )
    by_rep = classes.groupBy(order.alias("o")).agg(F.min("cls").alias("lead"))
    led = (
        posts.join(lists, "key")
        .groupBy("cls", "o")
        .agg(F.max("n").alias("n"))
        .join(by_rep, "o")
        .where("cls <> lead")
        .select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b"))
        .distinct()
    )
    near = _near(led, classes, percent, matches)
    asked = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    links = _confirm(near, settle(_sets_of(asked, classes, docs, id_col, text_col, shingle_words)), percent)
    parts = settle(connected_components(links))
    # Lists that still hold several components.
    held = settle(
        posts.join(lists.select("key"), "key")
        .join(parts.withColumnsRenamed({"node": "cls"}), "cls", "left")
        .select("key", "cls", "n", F.coalesce("component", "cls").alias("part"))
    )
    open_ = held.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    rest = held.join(settle(open_), "key")
    # Sets as similar as that share one of the n - least + 1 rarest shingles of either; those held by one class alone are counted, not posted.
    asked = settle(rest.select("cls", "n", "part").distinct())
    sets = settle(_sets_of(asked, classes, docs, id_col, text_col, shingle_words))
    held_by = sets.select("cls", F.explode("members").alias("shingle"))
    common = settle(held_by.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1"))
    rarest = held_by.join(common.hint("merge"), "shingle").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("common"))
    least = F.floor((F.col("n") * percent + 99) / 100)
    room = (F.size("common") - least + 1).cast("int")  # of the prefix, beyond what the class holds alone
    dealt = settle(
        asked.join(rarest, "cls").where(room > 0).select("cls", "n", "part", F.size("common").alias("left"), F.posexplode(F.slice("common", F.lit(1), room)["shingle"]).alias("at", "key"))
        .select("key", "cls", "n", "part", (F.col("left") - F.col("at")).cast("long").alias("most"))
    )
    # Components meet, not their members: the largest component under a shingle is never on the left.
    sizes = dealt.groupBy("key", "part").count().groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("count", "part"))["part"].alias("big"))
    every = dealt.join(settle(sizes.where("parts > 1").select("key", "big")), "key")
    left = every.where("part <> big")
    right = every.select("key", *(F.col(c).alias(f"{c}2") for c in ("cls", "n", "part", "most")))
    # `most`: what a class can share with another whose first common shingle is this one.
    shared = F.least("most", "most2")
    once = (F.col("part") != F.col("part2")) & ((F.col("part2") == F.col("big")) | (F.col("part") < F.col("part2")))
    across = (
        left.join(right, "key")
        .where(once & (shared * 100 >= (F.col("n") + F.col("n2") - shared) * percent))
        .select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"))
        .distinct()
    )
    more = _confirm(_near(across, classes, percent, matches), sets, percent)
    parts = settle(connected_components(links.union(more)))
    least = (
        parts.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
        .groupBy("component")
        .agg(F.min("rep").alias("low"))
    )
    named = settle(parts.join(settle(least), "component").select(F.col("node").alias("cls"), "low"))
    owner = settle(classes.select("cls", "rep").join(named, "cls", "left").select("cls", F.coalesce("low", "rep").alias("component_id")))
    free(classes, lists, near, held, asked, sets, common, dealt, links, more, parts, named)
    full = prints.where("n_shingles > 0").select("doc_id", "n_shingles", "cls").join(owner, "cls", "left").select("doc_id", "n_shingles", "component_id")
    bare = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _sets_of(asked: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(cls, members) of the classes asked for; one text is read of each."""
    ids = settle(classes.join(asked, "cls", "left_semi").select(F.col("rep").alias("doc_id"), F.when(F.col("rep").isNull(), F.col("text_key")).alias("text_key")).distinct())
    rows = _rows(docs, id_col, text_col)
    named = rows.join(ids.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi")
    bare = rows.where("doc_id is null").join(ids.where("doc_id is null"), "text_key", "left_semi").dropDuplicates(["text_key"])
    return full_sets(named.select("doc_id", "text").union(bare.select("doc_id", "text")), n).dropDuplicates(["cls"])


def _near(pairs: DataFrame, classes: DataFrame, percent: int, matches: int) -> DataFrame:
    """Those of the pairs (a, b) that have enough matches, with their sizes."""
    side = classes.select("cls", "n", "keys")
    return settle(
        pairs.join(side.toDF("a", "na", "ka"), "a")
        .join(side.toDF("b", "nb", "kb"), "b")
        .where(_fits(F.col("na"), F.col("nb"), percent))
        .where(F.size(F.array_intersect("ka", "kb")) >= matches)
        .select("a", "b", "na", "nb")
    )


def _confirm(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets are similar enough."""
    shared = F.size(F.array_intersect("ma", "mb")).cast("long")
    return settle(
        near.join(sets.toDF("a", "ma"), "a")
        .join(sets.toDF("b", "mb"), "b")
        .withColumn("shared", shared)
        .where(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent)
        .select("a", "b")
    )
