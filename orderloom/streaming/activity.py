"""Activity events: windowed aggregates that run on a table or on a stream alike, and stateful parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(df: DataFrame) -> DataFrame:
    """With an event-time column that watermarks accept, and the item out of props."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("item", F.get_json_object("props", "$.k").cast("long"))


def stream(spark: SparkSession, folder: str, schema: str | StructType = EVENT, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """Files that arrive in a folder; JSON lines need fmt="json"."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)


def socket(spark: SparkSession, host: str, port: int, schema: str = EVENT) -> DataFrame:
    """JSON lines from a TCP socket."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def windowed(df: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; rows later than ``late`` behind are dropped on streams."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = df.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, finish, n): runs of a user's events with gaps below ``gap``."""
    rows = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def distinct_users(df: DataFrame, length: str = "1 day", exact: bool = False, late: str = "1 hour") -> DataFrame:
    """(start, users, items) per window: sketches, or exact counts on tables."""
    count = F.countDistinct if exact else lambda c: F.approx_count_distinct(c, 0.02)
    rows = df.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w")).agg(count("user_id").alias("users"), count("item").alias("items"))
    return rows.select(F.col("w.start").alias("start"), "users", "items")


def once(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeated ids."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def in_focus(df: DataFrame, focus: DataFrame, key: str = "item") -> DataFrame:
    """Events whose item is in the focus set: exact membership by semi-join."""
    return df.join(focus.select(key).distinct(), key, "left_semi")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def window_sample(df: DataFrame, length: str = "1 hour", size: int = 50_000) -> DataFrame:
    """At most ``size`` events of each window, the smallest by a hash of the id, so the same at every run.

    The rank limit is applied before the shuffle too (a window group limit), so a
    crowded window sends ``size`` rows of each task at most.
    """
    from pyspark.sql import Window

    spread = F.pmod(F.col("event_id") % (1 << 31) * 2654435761, F.lit(1 << 32))  # a multiplicative hash
    rank = F.row_number().over(Window.partitionBy("start").orderBy("h", "event_id"))
    w = df.withColumn("start", F.window("ts", length)["start"]).withColumn("h", spread)
    return w.withColumn("rnk", rank).where(F.col("rnk") <= size).drop("h", "rnk")


def alerts(df: DataFrame, kind: str = "error", over: int = 1000, length: str = "1 day") -> DataFrame:
    """(start, n) of windows where a kind's count passes ``over`` while armed.

    An alert disarms; a window below ``over`` arms again, and so does one without
    any event of the kind, which is no row here but a gap between rows.
    """
    from pyspark.sql import Window

    counts = df.where(F.col("event_type") == kind).groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")
    order = Window.orderBy("start")  # one row a window
    gap = F.coalesce(F.lag("finish").over(order) < F.col("start"), F.lit(True))
    runs = counts.withColumn("run", F.sum(gap.cast("long")).over(order))
    was = F.last(F.when(F.col("n") != over, F.col("n")), ignorenulls=True).over(Window.partitionBy("run").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("was", F.coalesce(was, F.lit(0))).where((F.col("n") > over) & (F.col("was") < over)).select("start", "n")


def alert_stream(df: DataFrame, over: int = 1000, length: str = "1 day") -> DataFrame:
    """(event_type, start, at, n) of a stream, in append mode: an alert as soon as a kind's count in its window passes ``over`` while armed.

    The state of a kind is its window, the count there, and whether it is armed,
    by the rules of ``alerts``.  Events of a window before the present one come too
    late to count.  Write it with ``run`` to keep an alerts table.
    """
    span = int(df.sparkSession.sql(f"SELECT unix_seconds(timestamp_seconds(0) + interval {length})").first()[0])
    rows = df.select("event_type", F.unix_micros("ts").alias("us"), "event_id")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window, n, armed = state.get if state.exists else (-1, 0, True)
        out = []
        events = pd.concat(list(frames)).sort_values(["us", "event_id"])
        for at in events["us"]:
            own = at // (span * 1_000_000)
            if own < window:
                continue
            if own > window:
                armed = armed or n < over or own > window + 1
                window, n = own, 0
            n += 1
            if n > over and armed:
                out.append((key[0], window * span * 1_000_000, at, n))
                armed = False
        state.update((int(window), int(n), bool(armed)))
        yield pd.DataFrame(out, columns=["event_type", "start", "at", "n"])

    found = rows.groupBy("event_type").applyInPandasWithState(update, "event_type string, start long, at long, n long", "window long, n long, armed boolean", "append", "NoTimeout")
    return found.select("event_type", F.timestamp_micros("start").alias("start"), F.timestamp_micros("at").alias("at"), "n")


BLOOM_BITS, BLOOM_HASHES = 95_850, 6  # for 10,000 keys at one false hit in 100
CELLS, CELL_HASHES = 1_000, 3


def _digest(key: Column, seed: int | Column, most: int) -> Column:
    """A number below ``most`` from the first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("_"), F.lit(seed).cast("string"))), 1, 15), 16, 10).cast("long") % most


def bloom_filter(keys: DataFrame, key: str = "item", bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """(bit): the set bits of a Bloom filter, ``bits`` rows at most."""
    return keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*(_digest(F.col(key), i, bits) for i in range(hashes)))).alias("bit")).distinct()


def bloom_hits(df: DataFrame, bloom: DataFrame, key: str = "item", bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and a few others."""
    asked = df.where(F.col(key).isNotNull()).select(key).distinct()
    known = asked.select(key, F.explode(F.array_distinct(F.array(*(_digest(F.col(key), i, bits) for i in range(hashes))))).alias("bit"))
    missed = known.join(F.broadcast(bloom), "bit", "left_anti").select(key).distinct()  # `bits` rows at most
    return df.where(F.col(key).isNotNull()).join(missed, key, "left_anti")


def invertible_table(keys: DataFrame, key: str, cells: int = CELLS, hashes: int = CELL_HASHES) -> DataFrame:
    """(cell, n, keys, checks): an invertible Bloom lookup table of integer keys, ``cells`` rows at most; each key has a cell in each of ``hashes`` stripes."""
    stripe = cells // hashes
    own = keys.select(F.col(key).cast("long").alias("k")).where("k is not null")
    at = F.explode(F.array(*(_digest(F.col("k"), i, stripe) + i * stripe for i in range(hashes))))
    return own.select(at.alias("cell"), "k", _digest(F.col("k"), "check", 1 << 60).alias("c")).groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor("k").alias("keys"), F.bit_xor("c").alias("checks"))


def decode_difference(left: DataFrame, right: DataFrame, cells: int = CELLS, hashes: int = CELL_HASHES) -> tuple[set[int], set[int], bool]:
    """Keys that only the left table has, only the right one, and whether that is all; both tables are collected, ``cells`` rows each."""
    import hashlib

    digest = lambda k, seed, most: int(hashlib.md5(f"{k}_{seed}".encode()).hexdigest()[:15], 16) % most
    stripe = cells // hashes
    table = {c: [0, 0, 0] for c in range(cells)}
    for sign, df in ((1, left), (-1, right)):
        for r in df.collect():
            t = table[r["cell"]]
            t[0], t[1], t[2] = t[0] + sign * r["n"], t[1] ^ r["keys"], t[2] ^ r["checks"]
    only: dict[int, set[int]] = {1: set(), -1: set()}
    todo = list(table)
    while todo:
        n, key, check = table[todo.pop()]
        if abs(n) != 1 or digest(key, "check", 1 << 60) != check:
            continue
        only[n].add(key)
        for i in range(hashes):
            cell = digest(key, i, stripe) + i * stripe
            t = table[cell]
            t[0], t[1], t[2] = t[0] - n, t[1] ^ key, t[2] ^ check
            todo.append(cell)
    return only[1], only[-1], not any(any(t) for t in table.values())


class Dgim:
    """Approximate count of ones among the last ``window`` of a stream of bits; at most half of the oldest bucket off."""

    def __init__(self, window: int = 3600, buckets: list[tuple[int, int]] | None = None, now: int = 0):
        self.window, self.buckets, self.now = window, buckets or [], now  # buckets: (time of the newest one, size), newest first

    def add(self, bit: bool) -> None:
        self.now += 1
        while self.buckets and self.buckets[-1][0] <= self.now - self.window:
            self.buckets.pop()
        if not bit:
            return
        self.buckets.insert(0, (self.now, 1))
        size, at = 1, 0
        while True:
            same = [i for i in range(at, len(self.buckets)) if self.buckets[i][1] == size]
            if len(same) < 3:
                return
            newer, older = same[-2], same[-1]
            self.buckets[newer : older + 1] = [(self.buckets[newer][0], 2 * size)]
            size, at = 2 * size, newer

    def estimate(self) -> int:
        return sum(s for _, s in self.buckets) - (self.buckets[-1][1] // 2 if self.buckets else 0)


def dgim_counts(df: DataFrame, window: int = 3600, bit: Column | None = None) -> DataFrame:
    """(event_type, estimate) of a stream, in update mode: DGIM state per kind of event; ``bit`` says which events count."""
    rows = df.select("event_type", "ts", "event_id", (bit if bit is not None else F.lit(True)).alias("bit"))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ends, sizes, now = state.get if state.exists else ([], [], 0)
        d = Dgim(window, list(zip(ends, sizes, strict=True)), now)
        for f in frames:
            for b in f.sort_values(["ts", "event_id"])["bit"]:
                d.add(bool(b))
        state.update(([b[0] for b in d.buckets], [b[1] for b in d.buckets], d.now))
        yield pd.DataFrame({"event_type": [key[0]], "estimate": [d.estimate()]})

    return rows.groupBy("event_type").applyInPandasWithState(update, "event_type string, estimate long", "ends array<long>, sizes array<long>, now long", "update", "NoTimeout")


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None):
    """Everything that is there now, then stops; offsets in ``checkpoint`` make a restart go on where it was."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    return query


def segment_batches(df: DataFrame, features: tuple[str, ...], path: str, checkpoint: str, k: int = 5):
    """k-means of every micro-batch, refit each time; batches below two rows are left out."""
    from ..operators.segmentation import segment, silhouette

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if batch.count() > 1:
            told = segment(batch, features, k)
            score = silhouette(told)
            told.drop("features").withColumn("batch", F.lit(number)).withColumn("silhouette", F.lit(score)).write.mode("append").parquet(path)
        batch.unpersist()

    return run(df, path, checkpoint, each=each)
