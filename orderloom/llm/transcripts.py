"""Chat formatting: roles of transcript blocks by a hidden Markov model, then canonical turns.

A block is a line or paragraph of a transcript.  What is seen of it is its
speaker marker, its length, whether it asks, and whether it has several lines;
its hidden state is its role.  Viterbi finds the likeliest roles of a whole
conversation.

All blocks are range-partitioned by conversation and place, so that a huge
conversation lies in many partitions, and numbered.  A chunk is what a
conversation has among ``CHUNK`` consecutive numbers.  A chunk's best scores
from any role to any role are a small matrix; the matrices of a conversation are
folded per partition, then over the partitions, and the way back gives each
chunk its first and last role, between which it is traced by itself.  So a
conversation of any length is exact without meeting in one task, and all chunks
of an Arrow batch are computed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import settle

CHUNK = 256
#: Speaker markers by role.
MARKERS = {
    "user": "user|human|customer|question|q|me",
    "assistant": "assistant|ai|bot|agent|model|answer|a",
    "system": "system|instructions?",
}


def _marker(words: str) -> str:
    """A name before a colon or ``>``, in brackets, between asterisks, or as a heading of its own line."""
    return rf"(?is)^\s*(?:(?:{words})\s*[:>]|\[(?:{words})\]\s*:?|<\|?(?:{words})\|?>\s*:?|\*{{1,2}}(?:{words})\s*:?\*{{1,2}}\s*:?|#{{1,4}}[ \t]*(?:{words})[ \t]*(?::|\n|$))\s*"


LENGTHS = (40, 100, 200, 400, 800)
SYMBOLS = (len(MARKERS) + 1) * (len(LENGTHS) + 1) * 4


def marker(text: Column) -> Column:
    """0 without a speaker marker, else the place of its role in MARKERS, from 1."""
    out = F.lit(0)
    for k, words in enumerate(MARKERS.values(), 1):
        out = F.when(text.rlike(_marker(words)), k).otherwise(out)
    return out


def observed(text: Column) -> Column:
    """Number of the symbol that a block shows, below SYMBOLS."""
    size, length = F.length(text), F.lit(0)
    for n in LENGTHS:
        length = length + (size > n).cast("int")
    asks = text.rlike(r"\?\s*$").cast("int")
    many = text.contains("\n").cast("int")
    return ((marker(text) * (len(LENGTHS) + 1) + length) * 2 + asks) * 2 + many


def blocks_of(transcripts: DataFrame, conv_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, text): a raw transcript's blocks, cut before speaker markers and at blank lines."""
    cut = "|".join(MARKERS.values())
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), rf"(?i)\n\s*\n|\n(?=\s*(?:<\|?|\[|#{{1,4}}\s*|\*{{1,2}})?(?:{cut})(?:\|?>|\]|\*{{1,2}})?\s*:)")
    return transcripts.select(F.col(conv_col).alias("conv_id"), F.posexplode(parts).alias("turn", "text")).where(F.trim("text") != "")


class Chain(NamedTuple):
    roles: list[str]
    start: np.ndarray
    move: np.ndarray  # from, to
    show: np.ndarray  # role, symbol; all are logarithms


def fit_chain(labelled: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str = "role", conversations: int = 5_000, smooth: float = 0.5) -> Chain:
    """Counts of starts, moves and symbols in at most ``conversations`` conversations (the smallest by a hash of the id).

    Before any is counted, a block of a role is taken to bear its own name's
    marker at a rate of 0.01 and another's at 0.00001, so markers that the labelled
    conversations lack are understood too.
    """
    rows = labelled.select(F.col(conv_col).alias("c"), F.col(order_col).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("x"), F.col(role_col).cast("string").alias("role")).where("c is not null and role is not null")
    some = rows.select("c").distinct().orderBy(F.xxhash64("c"), "c").limit(conversations)  # so the broadcast is bounded
    rows = rows.join(F.broadcast(some), "c").select("c", "t", "role", observed(F.col("x")).alias("o"), F.xxhash64("x").alias("h"))
    before = F.lag("role").over(Window.partitionBy("c").orderBy("t", "h"))
    counts = rows.withColumn("was", before).groupBy("was", "role", "o").count().collect()
    roles = sorted({r["role"] for r in counts})
    k = len(roles)
    start, move, show = np.full(k, smooth), np.full((k, k), smooth), np.full((k, SYMBOLS), smooth / 10)
    for r in counts:
        to = roles.index(r["role"])
        show[to, r["o"]] += r["count"]
        if r["was"] is None:
            start[to] += r["count"]
        else:
            move[roles.index(r["was"]), to] += r["count"]
    total, per_marker = show.sum(1), SYMBOLS // (len(MARKERS) + 1)
    for r, role in enumerate(roles):
        for number, name in enumerate(MARKERS, 1):
            show[r, number * per_marker : (number + 1) * per_marker] += total[r] / per_marker * (0.01 if name == role else 0.00001) - smooth / 10
    return Chain(roles, np.log(start / max(start.sum(), 1e-9)), np.log(move / np.maximum(move.sum(1, keepdims=True), 1e-9)), np.log(show / np.maximum(show.sum(1, keepdims=True), 1e-9)))


def _stack(symbols: list[np.ndarray], chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks by falling length as one matrix of shown scores' symbols, their lengths, and the order taken."""
    length = np.array([len(s) for s in symbols])
    order = np.argsort(-length, kind="stable")
    out = np.zeros((len(symbols), int(length.max())), np.int64)
    for row, i in enumerate(order.tolist()):
        out[row, : length[i]] = symbols[i]
    return out, length[order], order


def chunk_matrices(chain: Chain, symbols: list[np.ndarray]) -> np.ndarray:
    """(chunks, from, to): best score of a path from a first to a last state, that of showing the first symbol included."""
    k = len(chain.roles)
    if not symbols:
        return np.zeros((0, k, k))
    o, length, order = _stack(symbols, chain)
    m = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None] + chain.show[:, o[:, 0]].T[:, None, :]
    for t in range(1, o.shape[1]):
        n = int(np.searchsorted(-length, -t, "left"))  # chunks longer than t
        m[:n] = (m[:n, :, :, None] + chain.move[None, None]).max(2) + chain.show[:, o[:n, t]].T[:, None, :]
    out = np.empty_like(m)
    out[order] = m
    return out


def trace_chunks(chain: Chain, symbols: list[np.ndarray], enter: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Likeliest states of each chunk between its given first and last one."""
    if not symbols:
        return []
    k = len(chain.roles)
    o, length, order = _stack(symbols, chain)
    best = np.where(np.arange(k)[None] == enter[order][:, None], 0.0, -np.inf) + chain.show[:, o[:, 0]].T
    back = []
    for t in range(1, o.shape[1]):
        n = int(np.searchsorted(-length, -t, "left"))
        step = best[:n, :, None] + chain.move[None]
        back.append(step.argmax(1))
        best[:n] = step.max(1) + chain.show[:, o[:n, t]].T
    path = np.zeros(o.shape, np.int64)
    state = last[order].copy()
    path[np.arange(len(path)), length - 1] = state
    for t in range(o.shape[1] - 1, 0, -1):
        n = len(back[t - 1])
        state[:n] = back[t - 1][np.arange(n), state[:n]]
        path[:n, t - 1] = state[:n]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(symbols)
    for row, i in enumerate(order.tolist()):
        out[i] = path[row, : length[row]]
    return out


def product(chain: Chain, matrices: np.ndarray) -> np.ndarray:
    """Best score from the first state of the first to the last state of the last one."""
    out = matrices[0]
    for m in matrices[1:]:
        out = ((out[:, :, None] + chain.move[None]).max(1)[:, :, None] + m[None]).max(1)
    return out


def ends(chain: Chain, matrices: np.ndarray, first: np.ndarray, last: int | None = None) -> list[tuple[int, int]]:
    """First and last state in each of a row of pieces on the best path; ``first``: scores of the first state before it shows anything; ``last``: a given end."""
    steps, best = [], first
    for m in matrices:
        full = best[:, None] + m
        after = full.max(0)
        move = after[:, None] + chain.move
        steps.append((full.argmax(0), move.argmax(0)))
        best = move.max(0)
    out, end = [], int(after.argmax()) if last is None else last
    for i in range(len(steps) - 1, -1, -1):
        enter = int(steps[i][0][end])
        out.append((enter, end))
        if i:
            end = int(steps[i - 1][1][enter])
    return out[::-1]


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, cuts = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def recover_turns(blocks: DataFrame, chain: Chain, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, role_pred, starts_turn, rendered) of every block.

    Blocks of a conversation are taken by ``order_col`` (null first), equal ones
    by a hash of the text.  rendered: the block without the one marker that was
    recognised, behind ``<|role|>`` where the role changes; a conversation's
    blocks one after another are its canonical form.  A null text is an empty
    block.  A null conversation id: each such block is a conversation of its own.
    Repeated rows are blocks of their own.  Without fitted roles every role is
    null and nothing is rendered.  Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = blocks.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{order_col}`").cast("long").alias("turn"), text.alias("text"))
    if not chain.roles:
        none = F.lit(None)
        return rows.select("conv_id", "turn", none.cast("string").alias("role_pred"), none.cast("boolean").alias("starts_turn"), none.cast("string").alias("rendered"))
    spark, k = blocks.sparkSession, len(chain.roles)
    shared = spark.sparkContext.broadcast(chain)
    own = F.monotonically_increasing_id()
    key = F.when(F.col("conv_id").isNull(), F.concat(F.lit("-"), own.cast("string"))).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    order = ["key", "turn", "h", "own"]
    dealt = rows.select("*", key.alias("key"), F.xxhash64("text").alias("h"), own.alias("own")).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # partition and place in it
    seen = settle(dealt.select("key", at.alias("at"), "conv_id", "turn", "text").withColumn("o", observed(F.col("text")).cast("int")))
    piece = F.floor(F.col("at") / chunk).alias("chunk")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("at", "o"))), lambda x: x["o"])  # `chunk` of them at most
    chunks = seen.groupBy("key", piece).agg(F.min("at").alias("first"), shown.alias("symbols"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = chunk_matrices(shared.value, _lists(batch.column(3)))
            cuts = pa.array(np.arange(len(m) + 1, dtype=np.int32) * k * k)
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(m.ravel()))], names=["key", "chunk", "first", "symbols", "m"])

    measured = settle(chunks.mapInArrow(matrices, "key string, chunk long, first long, symbols array<int>, m array<double>"))
    # A partition's chunks of a conversation, in order; then its partitions, in order.
    part = F.shiftright("first", 33).alias("part")
    parts = measured.groupBy("key", part).agg(F.array_sort(F.collect_list(F.struct("chunk", "m"))).alias("own")).select("key", "part", F.col("own.chunk").alias("chunks"), F.flatten("own.m").alias("ms"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = [product(shared.value, x.reshape(-1, k, k)).ravel() for x in _lists(batch.column(3))]
            cuts = pa.array(np.arange(len(ms) + 1, dtype=np.int32) * k * k)
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0), *ms])))], names=["key", "part", "chunks", "ms", "m"])

    folded = settle(parts.mapInArrow(products, "key string, part long, chunks array<long>, ms array<double>, m array<double>"))
    whole = folded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("own")).select("key", F.col("own.part").alias("parts"), F.flatten("own.m").alias("ms"))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ends(shared.value, x.reshape(-1, k, k), shared.value.start) for x in _lists(batch.column(2))]
            n = [len(x) for x in found]
            flat = np.array([y for x in found for y in x], np.int32).reshape(-1, 2)
            before = [y for x in found for y in [-1, *(z[1] for z in x[:-1])]]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), batch.column(1).flatten(), pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(before, pa.int32())], names=["key", "part", "enter", "last", "before"]
            )

    bounds = whole.mapInArrow(outer, "key string, part long, enter int, last int, before int")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chunk_ids, out = batch.column(0), _lists(batch.column(1)), []
            for row, (x, a, b, was) in enumerate(zip(_lists(batch.column(2)), *(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                found = ends(shared.value, x.reshape(-1, k, k), np.where(np.arange(k) == a, 0.0, -np.inf), b)
                out += [(row, int(c), e, z, w) for c, (e, z), w in zip(chunk_ids[row], found, [was, *(y[1] for y in found[:-1])], strict=True)]
            row, *rest = zip(*out, strict=True) if out else ([], [], [], [], [])
            yield pa.record_batch([keys.take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True))], names=["key", "chunk", "enter", "last", "before"])

    known = folded.select("key", "part", "chunks", "ms").join(bounds, ["key", "part"]).select("key", "chunks", "ms", "enter", "last", "before")
    known = known.mapInArrow(inner, "key string, chunk long, enter int, last int, before int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enter, last, before = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (4, 5, 6))
            paths = trace_chunks(shared.value, _lists(batch.column(3)), enter, last)
            flat = np.concatenate([np.zeros(0, np.int64), *paths])
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32))
            was = np.concatenate([np.zeros(0, np.int64), *(np.concatenate([[b], p[:-1]]) for b, p in zip(before, paths, strict=True))])
            # A state and whether it differs from the one before, in one number.
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(cuts, pa.array((flat * 2 + (flat != was)).astype(np.int32)))], names=["key", "chunk", "first", "states"])

    traced = measured.select("key", "chunk", "first", "symbols").join(known, ["key", "chunk"]).mapInArrow(trace, "key string, chunk long, first long, states array<int>")
    traced = settle(traced)
    state = F.get("states", (F.col("at") - F.col("first")).cast("int"))
    told = (
        seen.withColumn("chunk", F.floor(F.col("at") / chunk)).join(traced.hint("merge"), ["key", "chunk"])
        .select("conv_id", "turn", "text", state.alias("s"), marker(F.col("text")).alias("mark"))
        .select("conv_id", "turn", "text", "mark", F.element_at(F.array(*map(F.lit, chain.roles)), F.shiftright("s", 1) + 1).alias("role_pred"), (F.col("s") % 2 == 1).alias("starts_turn"))
    )
    body = F.col("text")
    for number, words in enumerate(MARKERS.values(), 1):
        body = F.when(F.col("mark") == number, F.regexp_replace("text", _marker(words), "")).otherwise(body)
    head = F.when(F.col("starts_turn"), F.concat(F.lit("<|"), "role_pred", F.lit("|>\n"))).otherwise(F.lit(""))
    return told.select("conv_id", "turn", "role_pred", "starts_turn", F.concat(head, F.trim(body), F.lit("\n")).alias("rendered"))
