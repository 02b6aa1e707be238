"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import free, settle


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node of an edge.

    Each round hooks every neighbour onto the smallest node around it (large
    star), then every smaller neighbour (small star), so the longest chain
    shortens by a constant factor.  Nodes with many neighbours are aggregated
    map-side and joined between two plain exchanges, which AQE can split.
    Null ends and self-loops are ignored.  Nothing but the edge count and a
    checksum reaches the driver.
    """
    now = settle(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, settle(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        free(before, large)
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
