"""Sharding by longest-processing-time scheduling.

Documents of equal text are a group and stay together.  Groups, the largest
first, go to the least-loaded shard, which a heap keeps at hand.  Groups of one
size are interchangeable, so the heap deals them out a class at a time: how many
of a class each shard gets is what one placement after another would give.  The
driver therefore sees one row per distinct group size, at most
sqrt(2 * total bytes) of them, and which group of a class goes where is decided
by the groups' ranks within the class, on the executors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import free, settle


def schedule(items: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """(item, shard) of (item, size) by longest processing time; ties to the smaller item and shard."""
    heap = [(0, s) for s in range(shards)]
    placed = []
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed.append((item, shard))
    return placed


def schedule_classes(classes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """How many groups of each (size, number of groups) class each shard gets, the largest size first.

    Shard k takes its j-th group of a class at the load L + j * size that it then
    has, and the heap takes the smallest of these first.  Whole rounds below the
    load that all shards reach are counted at once; the few placements left go
    through the heap one by one.
    """
    loads, out = [0] * shards, {}
    for size, n in sorted(classes, reverse=True):
        taken = [0] * shards

        def below(level: int, size: int = size) -> list[int]:
            return [max(0, -(-(level - load) // size)) for load in loads]

        lo, hi = min(loads), max(loads) + size * (n // shards + 1)
        while lo < hi:  # the highest level below which there are n placements at most
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if sum(below(mid)) <= n else (lo, mid - 1)
        taken = below(lo)
        heap = [(loads[k] + taken[k] * size, k) for k in range(shards)]
        heapq.heapify(heap)
        for _ in range(n - sum(taken)):  # fewer than `shards`, as all of them are at one level
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            taken[k] += 1
        for k in range(shards):
            loads[k] += taken[k] * size
        out[size] = taken
    return out


def assign_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 200_000, large: int = 4096
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; shard sizes in bytes are near equal.

    size is the UTF-8 bytes of the text plus 1.  A null text counts as the empty
    one (size 1, CRC 0, the same group).  A group larger than total / shards is
    whole in one shard, which is then the largest.  Repeated rows and null ids
    get slots of their own; slots of a shard run from 0 without gaps, in no
    promised order.  Other columns are not read; no rows give no rows.  Groups
    with more than 1 / ``large`` of all rows (fewer than ``large``) are sent to
    the rows, the others meet them by exchange.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = settle(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"))
        .withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    )
    groups = settle(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    n_groups, count = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    cells = max(1, -(-n_groups // rows_per_bucket))
    cell = F.pmod(F.xxhash64("group"), F.lit(cells)).alias("cell")
    sizes = settle(groups.groupBy("bytes", cell).agg(F.count("*").alias("n")))
    plan = schedule_classes([tuple(r) for r in sizes.groupBy("bytes").agg(F.sum("n")).collect()], shards)
    upto = [(size, [sum(taken[: k + 1]) for k in range(shards)]) for size, taken in plan.items()]
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = sizes.withColumn("ahead", ahead).join(spark.createDataFrame(upto, "bytes long, upto array<long>"), "bytes").select("bytes", "cell", "ahead", "upto")
    rank = F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("group")) - 1
    place = groups.select("group", "bytes", "n", cell).withColumn("rank", rank).join(known, ["bytes", "cell"])
    shard = F.size(F.filter("upto", lambda x: x <= F.col("ahead") + F.col("rank"))).alias("shard")
    placed = settle(place.select("group", "n", shard))
    hot = F.col("n") * large > F.lit(count)
    buckets = 256 * max(1, -(-count // (256 * shards * rows_per_bucket)))
    bucket = F.pmod("salt", F.lit(buckets)).alias("bucket")
    few = placed.where(hot).select("group", F.col("shard").alias("own"))  # fewer than `large`
    marked = rows.join(F.broadcast(few), "group", "left")
    dealt = settle(
        marked.where("own is not null").select("doc_id", "size", "text_crc32", F.col("own").alias("shard"), bucket)
        .union(marked.where("own is null").join(placed.where(~hot), "group").select("doc_id", "size", "text_crc32", "shard", bucket))
    )
    free(rows, groups, sizes, placed)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return (
        dealt.withColumn("rank", rank)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
