"""The denormalised tables that reports start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import POPULAR, Model

VOID = ("cancelled", "failed")


def all_lines(m: Model) -> DataFrame:
    """Order lines with their order, customer, place, item and vendor; inner joins, so lines without one of them go.

    No side is hinted: Spark broadcasts a dimension while its size allows it.
    """
    return (
        m.lines().join(m.orders(), "order_id").join(m.customers(), "customer_id").join(m.places(), "nation_id").join(m.items(), "item_id").join(m.vendors(), "vendor_id")
    )


def order_data(m: Model, limit: int | None = None) -> DataFrame:
    """Lines of unprocessed orders.  ``limit`` takes that many arbitrary lines and is off by default."""
    df = (
        m.orders().where("not is_processed").join(m.lines(), "order_id").join(m.customers(), "customer_id").join(m.places(), "nation_id").join(m.items(), "item_id").join(m.vendors(), "vendor_id")
    )
    return df.limit(limit) if limit else df


def analytics_base(m: Model, popular: int = POPULAR, orders_over: int = 5, share_of_mean: float = 0.75) -> DataFrame:
    """Lines of large enough valid orders, popular items, frequent customers and active vendors; unrated lines keep a null rating."""
    valid = m.orders().where(~F.lower("status").isin(*VOID))
    mean = valid.agg((F.avg("total_payment") * share_of_mean).alias("least"))
    orders = valid.join(F.broadcast(mean), F.col("total_payment") >= F.col("least")).drop("least")  # one row
    frequent = m.orders().groupBy("customer_id").agg(F.count("*").alias("n")).where(F.col("n") > orders_over).select("customer_id")
    wanted = m.lines().groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= popular).select("item_id")
    return (
        m.lines()
        .join(orders.join(frequent, "customer_id", "left_semi"), "order_id")
        .join(wanted, "item_id", "left_semi")
        .join(m.vendors().where("vendor_active"), "vendor_id")
        .join(m.customers(), "customer_id")
        .join(m.places(), "nation_id")
        .join(m.items(), "item_id")
    )


def signups(m: Model) -> DataFrame:
    """Month of each customer's first order."""
    return m.orders().groupBy("customer_id").agg(F.substring(F.min("date_of_order").cast("string"), 6, 2).alias("month"))


def customer_sales(m: Model) -> DataFrame:
    """Every customer with each order, or once with nulls."""
    return m.customers().join(m.orders().select("customer_id", "order_id", "date_of_order"), "customer_id", "left")


def sales_places(m: Model) -> DataFrame:
    return m.orders().join(m.customers(), "customer_id").join(m.places(), "nation_id")


BASES: dict[str, Callable[[Model], DataFrame]] = {
    "all_lines": all_lines,
    "order_data": order_data,
    "analytics_base": analytics_base,
    "signups": signups,
    "customer_sales": customer_sales,
    "sales_places": sales_places,
    "sales": lambda m: m.orders(),
}
