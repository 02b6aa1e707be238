"""Wall time of headline queries as one JSON line."""

import json
import os
import time

from orderloom.plans.registry import QUERIES
from orderloom.session import build_session

HEADLINE = [
    "orders_by_country", "top_selling_vendors_1", "top_vendors_in_top_countries", "cumulative_customers_monthly", "customer_segments", "vendor_profits_monthly",
    "item_types_by_region_each", "most_loyal_customers", "top_selling_vendors_3", "vendor_monthly_profits", "top_vendors_top_items", "underperforming_items",
    "itemsets_item_types", "rules_vendors_fine", "lsh_candidates", "vendor_type_metrics", "pagerank", "customer_clusters", "events_hourly", "event_sessions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    QUERIES["orders_by_country"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
