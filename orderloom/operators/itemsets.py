"""Baskets, frequent itemsets, association rules and co-occurrence as joins and aggregates.

A basket table holds one row per (order, item); baskets are never gathered into
arrays, so a very common item is only a common join key of small groups.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..scratch import settle
from ..sources.tables import POPULAR, Model


def baskets(m: Model, item: str = "item_type", share_of_mean: float = 0.2, popular: int | None = None, least: int = 2) -> DataFrame:
    """(order_id, item) of orders above ``share_of_mean`` of the mean payment that hold ``least`` items; each item once."""
    mean = m.orders().agg((F.avg("total_payment") * share_of_mean).alias("over"))
    orders = m.orders().join(F.broadcast(mean), F.col("total_payment") > F.col("over")).select("order_id")  # one row
    lines = m.lines().join(m.items(), "item_id").join(m.vendors(), "vendor_id")
    if popular:
        often = m.lines().groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") > popular).select("item_id")
        lines = lines.join(often, "item_id", "left_semi")
    rows = lines.join(orders, "order_id", "left_semi").select("order_id", F.col(item).alias("item")).distinct()
    wide = rows.groupBy("order_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("order_id")
    return rows.join(wide, "order_id", "left_semi")


def sample_baskets(rows: DataFrame, most: int = 100_000, seed: int = 42) -> tuple[DataFrame, float]:
    """About ``most`` of the baskets (all, if there are fewer) without replacement, by a hash of the order, and the share taken."""
    total = rows.select("order_id").distinct().count()
    share = min(1.0, most / max(1, total))
    return rows.where(F.pmod(F.xxhash64("order_id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000), share


class Itemsets:
    """Counts of frequent 1-, 2- and 3-itemsets of a basket table.

    ``sampled``: the table is a sample of that many baskets' worth; thresholds
    are those of the whole times the share that is there.

    ``buckets`` counts hashed pairs first and prunes pairs in rare buckets; it
    can't change the result, and as a shuffle already combines equal pairs
    map-side it is off by default.
    """

    def __init__(self, rows: DataFrame, min_support: float, buckets: int | None = None, sampled: int | None = None):
        rows = settle(rows.select("order_id", "item"))
        self.total = rows.select("order_id").distinct().count()
        whole = sampled or self.total
        self.least = max(1, math.floor(whole * min_support) * (self.total / max(1, whole)))
        often = F.col("n") >= self.least
        counts = settle(rows.groupBy("item").agg(F.count("*").alias("n")))
        self.items, self.singles = counts, counts.where(often)
        kept = settle(rows.join(self.singles, "item", "left_semi"))
        pairs = kept.withColumnRenamed("item", "a").join(kept.withColumnRenamed("item", "b"), "order_id").where("a < b")
        counted = pairs
        if buckets:
            bucket = F.pmod(F.xxhash64("a", "b"), F.lit(buckets))
            full = pairs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(often).select("bucket")
            counted = pairs.withColumn("bucket", bucket).join(full, "bucket", "left_semi")
        self.candidates = settle(counted.groupBy("a", "b").agg(F.count("*").alias("n")))
        self.pairs = self.candidates.where(often)
        # A candidate is the union of two frequent pairs that share one member.
        ends = self.pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(self.pairs.select("b", "a"))
        three = F.array_sort(F.array("x", "y", "z"))
        candidates = (
            ends.join(ends.select("x", F.col("y").alias("z")), "x").where("y < z").select(three.alias("t")).select(*(F.col("t")[i].alias(c) for i, c in enumerate("abc"))).distinct()
        )
        triples = pairs.join(self.pairs, ["a", "b"], "left_semi").join(kept.withColumnRenamed("item", "c"), "order_id").where("b < c")
        self.triples = settle(triples.join(candidates, ["a", "b", "c"], "left_semi").groupBy("a", "b", "c").agg(F.count("*").alias("n")).where(often))

    def progression(self) -> DataFrame:
        """(stage, n): how many items, frequent ones, counted pairs, and frequent pairs and triples there are."""
        stages = (("items", self.items), ("frequent items", self.singles), ("candidate pairs", self.candidates), ("frequent pairs", self.pairs), ("frequent triples", self.triples))
        out = None
        for name, df in stages:
            own = df.agg(F.lit(name).alias("stage"), F.count("*").alias("n"))
            out = own if out is None else out.union(own)
        return out

    def table(self) -> DataFrame:
        """(size, itemset, n, support)."""
        parts = [(self.singles, ["item"]), (self.pairs, ["a", "b"]), (self.triples, ["a", "b", "c"])]
        out = None
        for df, cols in parts:
            own = df.select(F.lit(len(cols)).cast("long").alias("size"), F.concat_ws(" + ", *cols).alias("itemset"), "n", F.round(F.col("n") / self.total, 9).alias("support"))
            out = own if out is None else out.unionByName(own)
        return out

    def rules(self, min_confidence: float, lift: str = "true") -> DataFrame:
        """(antecedent, consequent, n, support, antecedent_support, consequent_support, confidence, lift) of all splits of frequent 2- and 3-itemsets.

        ``lift``: "true" divides by the consequent's support; "single" does so
        for one-item consequents and gives 1 otherwise.
        """
        made = None
        for df, ways in ((self.pairs, [("a", "b")]), (self.triples, [("a", "bc"), ("b", "ac"), ("c", "ab")])):
            for one, rest in ways:
                for left, right in ((one, rest), (rest, one)):
                    own = df.select(F.array(*left).alias("x"), F.array(*right).alias("y"), "n")
                    made = own if made is None else made.union(own)
        known = settle(self.singles.select(F.array("item").alias("set"), "n").union(self.pairs.select(F.array("a", "b"), "n")))
        out = (
            made.join(known.select(F.col("set").alias("x"), F.col("n").alias("nx")), "x")
            .join(known.select(F.col("set").alias("y"), F.col("n").alias("ny")), "y")
            .withColumn("confidence", F.col("n") / F.col("nx"))
            .where(F.col("confidence") >= min_confidence)
        )
        value = F.col("confidence") / (F.col("ny") / self.total)
        if lift == "single":
            value = F.when(F.size("y") == 1, value).otherwise(1.0)
        share = lambda c: F.round(F.col(c) / self.total, 9)
        return out.select(
            F.concat_ws(" + ", "x").alias("antecedent"), F.concat_ws(" + ", "y").alias("consequent"), "n", share("n").alias("support"), share("nx").alias("antecedent_support"), share("ny").alias("consequent_support"),
            F.round("confidence", 9).alias("confidence"), F.round(value, 9).alias("lift"),
        )

    def cooccurrence(self) -> DataFrame:
        """(a, b, rate) of ordered pairs of frequent items, as a share of all baskets."""
        both = self.pairs.select("a", "b", "n").union(self.pairs.select("b", "a", "n"))
        return both.select("a", "b", F.round(F.col("n") / self.total, 9).alias("rate"))


def diversity(m: Model, item: str = "item_type") -> DataFrame:
    """(size, baskets, mean_value, mean_quantity) by the number of distinct items of an order."""
    lines = m.lines().join(m.items(), "item_id").join(m.vendors(), "vendor_id")
    orders = lines.groupBy("order_id").agg(F.countDistinct(item).alias("size"), F.sum("total_price").alias("v"), F.sum("quantity").alias("q"))
    return orders.groupBy("size").agg(F.count("*").alias("baskets"), F.round(F.avg("v"), 2).alias("mean_value"), F.round(F.avg("q"), 4).alias("mean_quantity"))


def baskets_sql(item: str, popular: int | None = None, share: float = 0.2) -> str:
    often = f" AND item_id IN (SELECT item_id FROM lines GROUP BY 1 HAVING count(*) > {popular})" if popular else ""
    return f"""bk0 AS (SELECT DISTINCT order_id, {item} AS item FROM lines JOIN items USING (item_id) JOIN vendors USING (vendor_id) JOIN sales USING (order_id)
        WHERE total_payment > {share} * (SELECT avg(total_payment) FROM sales){often}),
    bk AS (SELECT * FROM bk0 WHERE order_id IN (SELECT order_id FROM bk0 GROUP BY 1 HAVING count(*) >= 2)),
    tot AS (SELECT count(DISTINCT order_id) AS t FROM bk)"""


def itemsets_sql(item: str, min_support: float, popular: int | None = None) -> str:
    return f"""{baskets_sql(item, popular)},
    raw AS (SELECT 1 AS size, item AS itemset, count(*) AS n FROM bk GROUP BY item
        UNION ALL SELECT 2, a.item || ' + ' || b.item, count(*) FROM bk a JOIN bk b ON a.order_id = b.order_id AND a.item < b.item GROUP BY a.item, b.item
        UNION ALL SELECT 3, a.item || ' + ' || b.item || ' + ' || c.item, count(*) FROM bk a JOIN bk b ON a.order_id = b.order_id AND a.item < b.item
            JOIN bk c ON c.order_id = a.order_id AND b.item < c.item GROUP BY a.item, b.item, c.item),
    sets AS (SELECT CAST(size AS BIGINT) AS size, itemset, n, round(n / t, 9) AS support, t FROM raw, tot WHERE n >= greatest(1, floor(t * {min_support})))"""


POPULAR_ITEMS = POPULAR
