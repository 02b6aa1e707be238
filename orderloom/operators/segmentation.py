"""Feature tables and k-means segmentation with MLlib."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import settle
from ..sources.tables import AS_OF, Model

CUSTOMER = ("balance", "total_orders", "avg_order_value", "total_spent", "active_days")
INVENTORY = ("item_price", "recent_orders", "avg_quantity", "total_quantity")
ORDER = ("total_payment", "balance", "days_since", "n_lines", "avg_item_price")


def customer_features(m: Model) -> DataFrame:
    """Customers with at least one order."""
    per = m.orders().groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"), F.round(F.avg("total_payment"), 6).alias("avg_order_value"), F.round(F.sum("total_payment"), 2).alias("total_spent"),
        F.max("date_of_order").alias("last_order_date"), F.countDistinct(F.to_date("date_of_order")).alias("active_days"),
    )
    return m.customers().join(per, "customer_id").join(m.places(), "nation_id").select("customer_id", "balance", "total_orders", "avg_order_value", "total_spent", "last_order_date", "active_days", "country", "region")


def inventory_features(m: Model, as_of: str = AS_OF, days: int = 30) -> DataFrame:
    """Every item; recent: ordered within ``days`` before ``as_of``."""
    lines = m.lines().join(m.orders().select("order_id", "date_of_order"), "order_id")
    recent = F.col("date_of_order") >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days")
    per = lines.groupBy("item_id").agg(F.countDistinct(F.when(recent, F.col("order_id"))).alias("recent_orders"), F.round(F.avg("quantity"), 4).alias("avg_quantity"), F.sum("quantity").alias("total_quantity"))
    return m.items().join(per, "item_id", "left").select("item_id", "item_name", "item_type", "item_price", "recent_orders", "avg_quantity", "total_quantity").na.fill(0, ["recent_orders", "avg_quantity", "total_quantity"])


def order_features(m: Model, as_of: str = AS_OF) -> DataFrame:
    per = m.lines().groupBy("order_id").agg(F.count("*").alias("n_lines"), F.round(F.avg(F.col("total_price") / F.col("quantity")), 6).alias("avg_item_price"))
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("date_of_order").cast("timestamp"))) / 86_400_000_000
    return m.orders().join(m.customers(), "customer_id").join(per, "order_id", "left").select("order_id", "status", "total_payment", "balance", F.round(days, 6).alias("days_since"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "avg_item_price")


def segment(df: DataFrame, features: tuple[str, ...], k: int = 5, seed: int = 42, rounds: int = 20) -> DataFrame:
    """``df`` with its cluster and the standardised ``features`` vector: nulls as 0, k-means.  Needs two features that df has."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    used = [f for f in features if f in df.columns]
    if len(used) < 2:
        raise ValueError("two features at least are needed")
    df = settle(df)  # scaling, every round of k-means and the score read it
    ready = VectorAssembler(inputCols=used, outputCol="raw_vector").transform(df.na.fill(0, used))
    scaled = StandardScaler(inputCol="raw_vector", outputCol="features", withMean=True, withStd=True).fit(ready).transform(ready)
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="features", predictionCol="cluster").fit(scaled).transform(scaled).drop("raw_vector")


def silhouette(told: DataFrame) -> float:
    """Mean silhouette of a segmented table; 0 with one cluster."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    many = told.agg(F.min("cluster") < F.max("cluster")).first()[0]
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(told) if many else 0.0


def cluster_summary(told: DataFrame, features: tuple[str, ...]) -> DataFrame:
    stats = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", lambda c: F.round(F.avg(c), 3)), ("std", lambda c: F.round(F.stddev_samp(c), 3)))]
    return told.groupBy("cluster").agg(F.count("*").alias("size"), *stats)

