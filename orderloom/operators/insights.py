"""What the segmentation scenarios report: metrics of batches, their history, summaries and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import title_case
from ..sources.tables import Model
from . import segmentation as S


@dataclass(frozen=True)
class Scenario:
    k: int
    features: tuple[str, ...]
    names: tuple[str, ...]  # of the clusters
    insights: tuple[str, ...]
    recommendations: tuple[str, ...]


# Scenarios with their cluster names, insights and recommendations, as reports show them.
SCENARIOS = {
    "customer_segmentation": Scenario(
        5, S.CUSTOMER, ("High Value", "Regular", "New Customer", "At Risk", "Inactive"),
        ("High Value customers show 3x higher average order value", "At Risk customers have declining purchase frequency", "New customers require onboarding optimization", "Regular customers drive 60% of total revenue"),
        ("Implement VIP program for High Value customers", "Create win-back campaigns for At Risk segment", "Optimize onboarding flow for New Customers", "Develop loyalty rewards for Regular customers"),
    ),
    "inventory_intelligence": Scenario(
        4, S.INVENTORY, ("High Velocity", "Steady Movers", "Slow Movers", "Dead Stock"),
        ("High Velocity items need stock replenishment alerts", "Dead Stock represents 15% of inventory value", "Seasonal patterns affect 40% of product categories", "Slow Movers require promotional strategies"),
        ("Set automated reorder points for High Velocity items", "Implement clearance strategies for Dead Stock", "Adjust purchasing based on seasonal forecasts", "Create promotional bundles with Slow Movers"),
    ),
    "order_patterns": Scenario(
        4, S.ORDER, ("High Value", "Bulk Orders", "Regular Orders", "Small Orders"),
        ("Bulk orders have 25% higher profit margins", "High value orders correlate with customer loyalty", "Order complexity affects fulfillment time", "Geographic patterns influence delivery costs"),
        ("Offer bulk discounts to encourage larger orders", "Implement tiered pricing for High Value orders", "Optimize picking routes for complex orders", "Implement zone-based delivery optimization"),
    ),
}
#: Scores of the suite's parts that aren't measured.
GIVEN_SCORES = {"data_quality": 85.0, "system_performance": 90.0, "business_logic": 88.0}
METRICS = "batch long, scenario string, silhouette double, records long, features array<string>"


def rotation(batch: int, enabled: tuple[str, ...] = ("customer_segmentation",)) -> str:
    """The scenario of a batch: the enabled ones in turn."""
    return enabled[batch % len(enabled)]


def table_of(m: Model, scenario: str) -> DataFrame:
    return {"customer_segmentation": S.customer_features, "inventory_intelligence": S.inventory_features, "order_patterns": S.order_features}[scenario](m)


def insights(spark: SparkSession) -> DataFrame:
    """(scenario, kind, place, text): the lookup of insights, recommendations and cluster names."""
    rows = [(name, kind, i, text) for name, s in SCENARIOS.items() for kind, texts in (("insight", s.insights), ("recommendation", s.recommendations), ("cluster", s.names)) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "scenario string, kind string, place int, text string")


def measure(df: DataFrame, scenario: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """(segmented rows, one row of METRICS) of a batch."""
    s = SCENARIOS[scenario]
    told = S.segment(df, s.features, s.k)
    used = [f for f in s.features if f in df.columns]
    return told, df.sparkSession.createDataFrame([(batch, scenario, float(S.silhouette(told)), told.count(), used)], METRICS)


def history(metrics: DataFrame, keep: int = 100) -> DataFrame:
    """The last ``keep`` batches of each scenario."""
    place = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("batch")))
    return metrics.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def report(kept: DataFrame) -> DataFrame:
    """(scenario, name, batches, latest, mean, records, features, clusters, last_batch) from a history."""
    last = F.max_by(F.struct("silhouette", "features"), "batch")
    clusters = F.create_map(*(F.lit(x) for name, s in SCENARIOS.items() for x in (name, s.k)))
    rows = kept.groupBy("scenario").agg(F.count("*").alias("batches"), last.alias("l"), F.avg("silhouette").alias("mean"), F.sum("records").alias("records"), F.max("batch").alias("last_batch"))
    return rows.select("scenario", title_case(F.col("scenario")).alias("name"), "batches", F.round("l.silhouette", 3).alias("latest"), F.round("mean", 3).alias("mean"), "records", "l.features", clusters[F.col("scenario")].alias("clusters"), "last_batch")


def indicators(reported: DataFrame) -> DataFrame:
    """(records, quality, scenarios): totals over the scenarios that ran; one row."""
    return reported.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.round(F.coalesce(F.avg("mean"), F.lit(0.0)), 3).alias("quality"), F.count("*").alias("scenarios"))


def suite(kept: DataFrame) -> DataFrame:
    """(part, score, status): each scenario's model score, the given parts, and their overall mean (models count as one part)."""
    models = kept.groupBy("scenario").agg(F.avg("silhouette").alias("s")).select(F.col("scenario").alias("part"), F.round(F.least(F.lit(100.0), F.col("s") / 0.5 * 100), 1).alias("score"), F.when(F.col("s") > 0.3, "good").otherwise("needs work").alias("status"))
    given = kept.sparkSession.createDataFrame([(k, v, "given") for k, v in GIVEN_SCORES.items()], "part string, score double, status string")
    model = models.agg(F.lit("model_performance").alias("part"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("score"), F.lit("measured").alias("status"))
    overall = model.union(given).agg(F.lit("overall").alias("part"), F.round(F.avg("score"), 2).alias("score"), F.lit("mean").alias("status"))
    return models.union(given).union(model).union(overall)
