"""Grouped reports as declarations, rendered as a DataFrame plan or as DuckDB SQL.

A report groups a base by keys, computes measures, and may keep only the groups
of the top keys (``among``), the best rows per group (``best``), the first rows
(``top``), running totals, or a second grouping into buckets.  Every order ends
with the keys, so ties are decided alike everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.bases import BASES
from ..sources.tables import AS_OF, MODEL_SQL, Model


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str  # rows, count, distinct, sum, whole, mean, max, min
    column: str = "*"

    def column_of(self) -> Column:
        c = F.col(self.column) if self.column != "*" else None
        return {
            "rows": lambda: F.count("*"),
            "count": lambda: F.count(c),
            "distinct": lambda: F.countDistinct(c),
            "sum": lambda: F.round(F.sum(c), 2),
            "whole": lambda: F.sum(c).cast("long"),
            "mean": lambda: F.round(F.avg(c), 4),
            "max": lambda: F.max(c),
            "min": lambda: F.min(c),
        }[self.kind]().alias(self.name)

    def sql(self) -> str:
        c = self.column
        return {
            "rows": "count(*)", "count": f"count({c})", "distinct": f"count(DISTINCT {c})", "sum": f"round(sum({c}), 2)", "whole": f"CAST(sum({c}) AS BIGINT)",
            "mean": f"round(avg({c}), 4)", "max": f"max({c})", "min": f"min({c})",
        }[self.kind] + f" AS {self.name}"


@dataclass(frozen=True)
class Report:
    base: str
    keys: tuple[str, ...]
    measures: tuple[Measure, ...]
    where: str | None = None
    among: tuple[str, Measure, int] | None = None  # key, its measure, how many
    best: tuple[str, str, int] | None = None  # within, by measure (descending), how many
    top: tuple[tuple[str, ...], int] | None = None  # order ("-x" descending), how many
    running: tuple[str, str] | None = None  # measure, name of its running total over the keys
    buckets: tuple[str, str, tuple[tuple[str, str], ...], str] | None = None  # name, count's name, (condition, label), else

    def plan(self, m: Model) -> DataFrame:
        base = BASES[self.base](m)
        if self.where:
            base = base.where(self.where)
        if self.among:
            key, by, n = self.among
            chosen = base.groupBy(key).agg(by.column_of()).orderBy(F.desc_nulls_last(by.name), key).limit(n).select(key)
            base = base.join(F.broadcast(chosen), key, "left_semi")  # n rows
        out = base.groupBy(*self.keys).agg(*(x.column_of() for x in self.measures))
        if self.running:
            of, name = self.running  # one row per month: a handful of rows in one partition
            out = out.withColumn(name, F.sum(of).over(Window.orderBy(*self.keys)))
        if self.buckets:
            name, count, cases, rest = self.buckets
            label: Column = F.lit(rest)
            for cond, text in reversed(cases):
                label = F.when(F.expr(cond), text).otherwise(label)
            out = out.groupBy(label.alias(name)).agg(F.count("*").alias(count))
        if self.best:
            within, by, n = self.best
            rank = F.row_number().over(Window.partitionBy(within).orderBy(F.desc(by), *self.keys))
            out = out.withColumn("rnk", rank.cast("long")).where(F.col("rnk") <= n)
        if self.top:
            order, n = self.top
            out = out.orderBy(*(F.desc_nulls_last(o[1:]) if o[0] == "-" else F.asc_nulls_last(o) for o in order), *self.keys).limit(n)
        return out

    def sql(self) -> str:
        keys = ", ".join(self.keys)
        said = [self.where] if self.where else []
        where = f" WHERE {self.where}" if self.where else ""
        if self.among:
            key, by, n = self.among
            said.append(f"{key} IN (SELECT {key} FROM (SELECT {key}, {by.sql()} FROM {self.base}{where} GROUP BY {key}) ORDER BY {by.name} DESC NULLS LAST, {key} LIMIT {n})")
        text = f"SELECT {keys}, {', '.join(x.sql() for x in self.measures)} FROM {self.base}" + (f" WHERE {' AND '.join(said)}" if said else "") + f" GROUP BY {keys}"
        if self.running:
            of, name = self.running
            text = f"SELECT *, CAST(sum({of}) OVER (ORDER BY {keys}) AS BIGINT) AS {name} FROM ({text})"
        if self.buckets:
            name, count, cases, rest = self.buckets
            case = " ".join(f"WHEN {c} THEN '{t}'" for c, t in cases)
            text = f"SELECT CASE {case} ELSE '{rest}' END AS {name}, count(*) AS {count} FROM ({text}) GROUP BY 1"
        if self.best:
            within, by, n = self.best
            text = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY {by} DESC, {keys}) AS rnk FROM ({text})) WHERE rnk <= {n}"
        if self.top:
            order, n = self.top
            said_order = ", ".join(f"{o[1:]} DESC NULLS LAST" if o[0] == "-" else f"{o} ASC NULLS LAST" for o in order)
            text = f"SELECT * FROM ({text}) ORDER BY {said_order}, {keys} LIMIT {n}"
        return f"WITH {MODEL_SQL} {text}"


_orders = Measure("total_orders", "distinct", "order_id")
_order_count = Measure("order_count", "distinct", "order_id")
_sold = Measure("total_quantity", "whole", "quantity")
_revenue = Measure("revenue", "sum", "total_price")
_customers = Measure("customer_count", "distinct", "customer_id")
_vendor = ("vendor_id", "vendor_name")
_top_vendors = ("vendor_id", _revenue, 10)

REPORTS: dict[str, Report] = {
    # Unprocessed orders.
    "orders_by_country": Report("order_data", ("country",), (_orders,)),
    "orders_by_city": Report("order_data", ("country", "region"), (_orders,)),
    "top_customers": Report("order_data", ("customer_id",), (_orders,), top=(("-total_orders",), 100)),
    "top_selling_vendors_1": Report("order_data", ("vendor_name",), (Measure("total_items_sold", "distinct", "item_id"), _sold)),
    "top_items_per_vendor": Report("order_data", ("vendor_name", "item_id"), (Measure("sold_count", "rows"),)),
    "most_sold_items": Report("order_data", ("item_id",), (Measure("sold_count", "rows"),)),
    "top_vendors_in_top_countries": Report("order_data", ("vendor_name", "country"), (Measure("items_sold", "count", "item_id"),), among=("country", _orders, 10), top=(("-items_sold",), 10)),
    "top_itemtypes_per_vendor": Report("order_data", ("vendor_name", "item_type"), (Measure("sold_count", "rows"),)),
    "most_sold_itemtypes": Report("order_data", ("item_type",), (Measure("sold_count", "rows"),)),
    # Ad-hoc reports over all orders.
    "cumulative_customers_monthly": Report("sales", ("month",), (_customers,), running=("customer_count", "cumulative_customers")),
    "top_loyal_customers": Report("sales_places", ("customer_id", "customer_name"), (_orders, Measure("total_spent", "sum", "total_payment")), top=(("-total_orders",), 10)),
    "customer_segments": Report("customer_sales", ("customer_id",), (Measure("n", "count", "order_id"),), buckets=("segment", "customer_count", (("n > 10", "Premium"), ("n > 5", "Regular")), "Casual")),
    "top_selling_vendors_2": Report("all_lines", _vendor, (_sold, _revenue), top=(("-total_quantity",), 10)),
    "top_10_items": Report("all_lines", ("item_id", "item_name"), (_order_count,), top=(("-order_count",), 10)),
    "monthly_order_estimates": Report("sales", ("month",), (_order_count,)),
    "customers_per_region_2": Report("sales_places", ("country",), (_customers,)),
    "customer_activity": Report(
        "customer_sales", ("customer_id",), (Measure("last_order", "max", "date_of_order"),),
        buckets=("activity", "customer_count", ((f"last_order >= TIMESTAMP '{AS_OF}' - INTERVAL '3' MONTH", "Active"), (f"last_order >= TIMESTAMP '{AS_OF}' - INTERVAL '12' MONTH", "Less Active")), "Inactive"),
    ),
    "vendor_profits_monthly": Report("all_lines", (*_vendor, "month"), (_revenue,), top=(("-revenue",), 10)),
    "top_items_for_top_vendors": Report("all_lines", (*_vendor, "item_id", "item_name"), (_sold,), among=_top_vendors, top=(("-total_quantity",), 30)),
    "top_items_for_top_vendors_each": Report("all_lines", (*_vendor, "item_id", "item_name"), (_sold,), among=_top_vendors, best=("vendor_id", "total_quantity", 3)),
    "item_types_by_region": Report("all_lines", ("country", "item_type"), (_sold,), top=(("-total_quantity",), 6)),
    "item_types_by_region_each": Report("all_lines", ("country", "item_type"), (_sold,), best=("country", "total_quantity", 6)),
    "item_types_by_month": Report("all_lines", ("month", "item_type"), (_sold,), top=(("-total_quantity",), 36)),
    "item_types_by_month_each": Report("all_lines", ("month", "item_type"), (_sold,), best=("month", "total_quantity", 3)),
    "monthly_sales": Report("sales", ("month",), (Measure("total_sales", "sum", "total_payment"),)),
    "orders_per_region_2": Report("sales_places", ("country",), (Measure("order_count", "rows"),)),
    # Reports over the analytics base.
    "total_customers_trend": Report("signups", ("month",), (Measure("customer_count", "rows"),), running=("customer_count", "cumulative_count")),
    "most_loyal_customers": Report(
        "analytics_base", ("customer_id", "customer_name"), (_orders, Measure("total_spent", "sum", "total_price"), Measure("last_order_date", "max", "date_of_order")), top=(("-total_orders",), 10)
    ),
    "customers_per_region_3": Report("analytics_base", ("country",), (_customers,)),
    "customer_activity_segments": Report(
        "analytics_base", ("customer_id",), (Measure("n", "distinct", "order_id"),),
        buckets=("activity_segment", "customer_count", (("n >= 10", "Highly Active"), ("n >= 5", "Active"), ("n >= 1", "Less Active")), "Inactive"),
    ),
    "top_selling_vendors_3": Report("analytics_base", _vendor, (_orders, Measure("total_items_sold", "whole", "quantity"), Measure("total_revenue", "sum", "total_price"))),
    "vendor_monthly_profits": Report("analytics_base", (*_vendor, "month"), (_revenue,), among=_top_vendors),
    "top_vendors_top_items": Report("analytics_base", (*_vendor, "item_name"), (_sold,), among=_top_vendors, best=("vendor_id", "total_quantity", 3)),
    "top_vendors_item_types": Report("analytics_base", (*_vendor, "item_type"), (_sold,), among=_top_vendors, best=("vendor_id", "total_quantity", 3)),
    "vendor_country_distribution": Report("analytics_base", (*_vendor, "country"), (_order_count,), among=("vendor_id", _revenue, 5)),
    "underperforming_vendors": Report("analytics_base", _vendor, (_order_count, _sold, _revenue), top=(("revenue",), 20)),
    "top_items_by_orders": Report("analytics_base", ("item_id", "item_name", "month"), (_order_count,), among=("item_id", _order_count, 10)),
    "top_item_types_by_orders": Report("analytics_base", ("item_type", "month"), (_order_count,), among=("item_type", _order_count, 10)),
    "top_item_types_by_region": Report("analytics_base", ("country", "item_type"), (_order_count,), best=("country", "order_count", 6)),
    "top_items_by_region": Report("analytics_base", ("country", "item_id", "item_name"), (_order_count,), best=("country", "order_count", 10)),
    "top_item_types_ratings": Report("analytics_base", ("item_type",), (Measure("avg_rating", "mean", "line_rating"), Measure("rating_count", "rows")), where="line_rating IS NOT NULL", top=(("-avg_rating",), 10)),
    "underperforming_items": Report("analytics_base", ("item_id", "item_name", "item_type"), (_order_count, _sold, Measure("avg_rating", "mean", "line_rating")), top=(("order_count", "avg_rating"), 10)),
    "item_types_monthly_orders": Report("analytics_base", ("item_type", "month"), (_order_count,), among=("item_type", _order_count, 3)),
    "monthly_order_counts": Report("analytics_base", ("month",), (_order_count,)),
    "monthly_sales_estimate": Report("analytics_base", ("month",), (_revenue,)),
    "orders_by_status": Report("analytics_base", ("status",), (_order_count,)),
    "orders_per_region_3": Report("analytics_base", ("country",), (_order_count,)),
    "profits_per_region": Report("analytics_base", ("country",), (_revenue,)),
}
