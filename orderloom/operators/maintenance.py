"""Derived totals that the order model keeps up to date, as views over the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import Model


def order_totals(m: Model) -> DataFrame:
    """(order_id, total): sum of each order's lines, 0 without any."""
    sums = m.lines().groupBy("order_id").agg(F.sum("total_price").alias("t"))
    return m.orders().join(sums, "order_id", "left").select("order_id", F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


def item_purchases(m: Model, status: str = "F") -> DataFrame:
    """(item_id, purchased) of orders in a status."""
    done = m.orders().where(F.col("status") == status).select("order_id")
    return m.lines().join(done, "order_id", "left_semi").groupBy("item_id").agg(F.sum("quantity").cast("long").alias("purchased"))


def item_ratings(m: Model) -> DataFrame:
    """(item_id, rating, n) of rated items; six places, so that no engine rounds a tie."""
    return m.lines().where("line_rating is not null").groupBy("item_id").agg(F.round(F.avg("line_rating"), 6).alias("rating"), F.count("*").alias("n"))


def last_activity(events: DataFrame) -> DataFrame:
    """(user_id, last_activity): the time of each user's last inserted event."""
    return events.groupBy("user_id").agg(F.max_by("ts", "event_id").alias("last_activity"))


def unprocessed(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the table of processed keys."""
    return rows.join(processed.select(key).distinct(), key, "left_anti")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n): equal-width bins from the smallest to the largest value; the last one is closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    place = F.least(F.floor((F.col(column) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1)), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def rolling_mean(df: DataFrame, order: str, column: str, window: int = 5) -> DataFrame:
    """(order, column, rolling): mean of the last ``window`` rows, null until there are as many; for small histories."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(1 - window, 0)
    return df.select(order, column, F.when(F.count(column).over(w) >= window, F.avg(column).over(w)).alias("rolling"))
