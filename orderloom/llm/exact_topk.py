"""Exact top-k by integer inner product with KD-trees per shard.

Rows are dealt to shards of a bounded size.  Each shard is one KD-tree: median
splits on the widest dimension down to small leaves, with the tight bounding box
of every node.  A block of queries walks a tree best-first: a node's bound for a
query is the largest inner product any point of its box can have, the node with
the largest lead over the queries' kth scores comes first, and a node is opened
only for queries whose bound reaches their kth score.

Blocks of queries meet shards in waves of 1, then about a tenth, then all others;
after each wave every query's kth score over all it has seen is propagated to
the next.  A wave brings a tree and a run of blocks together once, so a tree is
sent and read once for ``blocks_per_run`` blocks.  Trees are stored, so shards
can be searched again after a lost executor.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import settle

LEAF = 256


def quantised(vector: Column, levels: int = 256) -> Column:
    """floor(levels * x) of each component, x as double; null if a component is null or not finite."""
    xs = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(xs, lambda x: F.floor(x * levels).cast("long")))


class KDTree:
    """Nodes in breadth order of splits; leaves hold rows of ``points``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.left, self.span = [], [], [], []
        stack = [(0, len(ids), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            own = points[order[lo:hi]]
            at = len(self.span)
            self.low.append(own.min(0))
            self.high.append(own.max(0))
            self.left.append([])
            self.span.append((lo, hi))
            if parent >= 0:
                self.left[parent].append(at)
            width = self.high[at] - self.low[at]
            if hi - lo > LEAF and width.max() > 0:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, width.argmax()], mid)]
                stack += [(lo + mid, hi, at), (lo, lo + mid, at)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray, node: int) -> np.ndarray:
        """Largest inner product of each query with any point of the node's box."""
        return np.maximum(queries, 0) @ self.high[node] + np.minimum(queries, 0) @ self.low[node]

    def search(self, qids: np.ndarray, queries: np.ndarray, best: Best) -> None:
        """Improves ``best`` with this tree's points."""
        first = self.bounds(queries, 0)
        heap = [(-np.inf, 0, np.arange(len(queries)), first)]
        while heap:
            _, node, who, bound = heapq.heappop(heap)
            still = bound >= best.kth[who]  # a tie may still win by its id
            who = who[still]
            if not len(who):
                continue
            if not self.left[node]:
                lo, hi = self.span[node]
                best.offer(who, qids[who], self.ids[lo:hi], queries[who] @ self.points[lo:hi].T)
                continue
            for child in self.left[node]:
                b = self.bounds(queries[who], child)
                lead = (b - np.where(np.isfinite(best.kth[who]), best.kth[who], b - 1e18)).max()
                heapq.heappush(heap, (-lead, child, who, b))


class Best:
    """The k best (score, smaller id first) of each query yet; kth: the score to reach."""

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None):
        self.k, self.kth = k, np.full(n, -np.inf) if kth is None else kth.copy()
        self.scores: list[np.ndarray] = [np.zeros(0)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def offer(self, who: np.ndarray, qids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        reach = (scores >= self.kth[who, None]) & (ids[None, :] != qids[:, None])
        for i in np.flatnonzero(reach.any(1)).tolist():
            q, own = who[i], reach[i]
            s, v = np.concatenate([self.scores[q], scores[i][own]]), np.concatenate([self.ids[q], ids[own]])
            order = np.lexsort((v, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], v[order]
            if len(order) == self.k:
                self.kth[q] = max(self.kth[q], s[order[-1]])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 1))


def _stored(tree: KDTree) -> list[bytes]:
    left = np.array([c or [0, 0] for c in tree.left], np.int64)
    return [x.tobytes() for x in (tree.ids, tree.points.astype("<i4"), tree.low.astype("<i4"), tree.high.astype("<i4"), np.array(tree.span, np.int64), left)]


def _read(row: dict) -> KDTree:
    tree = KDTree.__new__(KDTree)
    tree.ids = np.frombuffer(row["ids"], np.int64)
    wide = len(row["points"]) // 4 // len(tree.ids)
    tree.points, tree.low, tree.high = (np.frombuffer(row[c], "<i4").reshape(-1, wide).astype(float) for c in ("points", "low", "high"))
    tree.span = np.frombuffer(row["span"], np.int64).reshape(-1, 2).tolist()
    tree.left = [c if c[1] else [] for c in np.frombuffer(row["children"], np.int64).reshape(-1, 2).tolist()]
    return tree


def top_k(
    vectors: DataFrame,
    query_ids: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    rows_per_shard: int = 8_192,
    queries_per_block: int = 512,
    blocks_per_run: int = 32,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best other rows of each query row.

    ``query_ids``: condition on a row that makes it a query (default: id
    divisible by 50).  Equal scores: the smaller id first; fewer rows, fewer
    ranks.  Null or empty vectors, null ids, and vectors with null or non-finite
    components, take no part, nor do vectors of another length than the most
    common one (of equally common lengths the longest).  A query's own id is no
    candidate, in repeated rows neither; a row that is repeated counts once, an
    id with several vectors once for each.  Scores are exact: components are
    integers below 2**31 (a larger one raises) and sums stay below 2**53.  Other
    columns are not read, apart from those that ``query_ids`` names: id and v.
    """
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`")).alias("v"))
        .where("id is not null and v is not null and size(v) > 0")
        .dropDuplicates(["id", "v"])
    )
    rows = settle(rows)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("of")).orderBy(F.desc("of"), F.desc("n")).limit(1).collect()
    length, count = lengths[0] if lengths else (0, 0)
    rows = rows.where(F.size("v") == length)
    shards = max(1, -(-count // rows_per_shard))
    queries = rows.where((F.col("id") % 50 == 0) if query_ids is None else query_ids)
    blocks = max(1, -(-queries.count() // queries_per_block))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(frame["v"])
        if np.abs(points).max() >= 2**31:
            raise ValueError("a component is too large for exact scores")
        return pd.DataFrame([[frame["shard"].iloc[0], *_stored(KDTree(frame["id"].to_numpy(np.int64), points))]], columns=["shard", "ids", "points", "low", "high", "span", "children"])

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    trees = settle(rows.select(shard, "id", "v").groupBy("shard").applyInPandas(grow, "shard int, ids binary, points binary, low binary, high binary, span binary, children binary"))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked = settle(queries.select(block, "id", "v").groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("qs")))

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One tree and a run of blocks of queries (with the score each has to reach)."""
        out = []
        if len(left):
            tree = _read(left.iloc[0].to_dict())
            for qs in right["qs"]:
                qids = np.array([q["id"] for q in qs], np.int64)
                best = Best(len(qids), k, np.array([-np.inf if q["kth"] is None else q["kth"] for q in qs], float))
                tree.search(qids, _matrix([q["v"] for q in qs]), best)
                n = [len(x) for x in best.ids]
                out.append(pd.DataFrame({"query_id": np.repeat(qids, n), "vec_id": np.concatenate(best.ids), "score": np.concatenate(best.scores).astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # Each block meets every shard: a stated query set against all rows, in blocks.  A block starts in a shard of its own.
    found, done = None, 0
    for upto in dict.fromkeys((1, max(1, shards // 10), shards)):
        kth = (found.where(F.col("rank") == k) if found else queries.where("false").select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("score"))).select("query_id", F.col("score").alias("kth"))
        told = asked.select("block", F.explode("qs").alias("q")).join(kth, F.col("q.id") == F.col("query_id"), "left")
        told = told.groupBy("block").agg(F.collect_list(F.struct(F.col("q.id").alias("id"), F.col("q.v").alias("v"), "kth")).alias("qs"))
        step = F.explode(F.sequence(F.lit(done), F.lit(upto - 1)))
        sent = told.withColumn("step", step).select(F.pmod(F.col("block") + F.col("step"), F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("block") / blocks_per_run).cast("int").alias("run"), "qs")
        sent = settle(sent)
        runs = sent.select(F.col("shard").alias("s"), F.col("run").alias("r")).distinct()
        new = trees.join(runs, F.col("shard") == F.col("s")).drop("shard").groupBy("s", "r").cogroup(sent.groupBy("shard", "run")).applyInPandas(walk, "query_id long, vec_id long, score long")
        found = settle(ranked(new if found is None else found.drop("rank").unionByName(new)))
        done = upto
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
