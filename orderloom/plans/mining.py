"""Registered queries of the mining, ranking, feature and activity operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import recent_or_never, shuffled
from ..operators import insights as N, itemsets as I, maintenance as K, ranking as R, segmentation as S, similarity as L
from ..sources.tables import AS_OF, MODEL_SQL, Model
from ..streaming import activity as A

Query = Callable[[SparkSession, str], DataFrame]


def _model(f: Callable[[Model], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Model(spark, sf_dir))


def _events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(A.events(Model(spark, sf_dir).raw("events")))


def _plain(df: DataFrame) -> DataFrame:
    """Times without zone, as the tables have them."""
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


def _similar(m: Model) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    from ..scratch import settle

    sets = settle(L.item_sets(m))
    sigs = settle(L.signatures(sets))
    buckets = settle(L.bands(sigs))
    return sets, sigs, buckets, settle(L.candidates(buckets))


def _ranked(m: Model) -> DataFrame:
    from ..scratch import settle

    table = settle(R.scored(R.metrics(m)))
    return R.ranking(table, R.pagerank(table))


def _nine(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _summary(table: DataFrame, scenario: str) -> DataFrame:
    s = N.SCENARIOS[scenario]
    return S.cluster_summary(S.segment(table, s.features, s.k), s.features)


def _metrics(m: Model) -> DataFrame:
    """One batch of every scenario."""
    out = None
    for batch, scenario in enumerate(N.SCENARIOS):
        row = N.measure(N.table_of(m, scenario), scenario, batch)[1]
        out = row if out is None else out.union(row)
    return out


def _bloom(e: DataFrame) -> DataFrame:
    focus = e.where("item % 7 = 3").select("item").distinct()
    return A.bloom_hits(e, A.bloom_filter(focus, bits=2048), bits=2048).groupBy("item").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    "itemsets_item_types": _model(lambda m: I.Itemsets(I.baskets(m, "item_type"), 0.005).table()),
    "itemsets_items": _model(lambda m: I.Itemsets(I.baskets(m, "brand", 1.0, I.POPULAR_ITEMS), 0.001, buckets=1_000_000).table()),
    "itemsets_vendors": _model(lambda m: I.Itemsets(I.baskets(m, "vendor_name"), 0.01).table()),
    "itemsets_vendors_fine": _model(lambda m: I.Itemsets(I.baskets(m, "vendor_name"), 0.001).table()),
    "pcy_progression": _model(lambda m: I.Itemsets(I.baskets(m, "item_type"), 0.005).progression()),
    "rules_item_types": _model(lambda m: I.Itemsets(I.baskets(m, "item_type"), 0.005).rules(0.005)),
    "rules_items": _model(lambda m: I.Itemsets(I.baskets(m, "brand", 1.0, I.POPULAR_ITEMS), 0.001).rules(0.001, lift="single")),
    "rules_vendors": _model(lambda m: I.Itemsets(I.baskets(m, "vendor_name"), 0.01).rules(0.01)),
    "rules_vendors_fine": _model(lambda m: I.Itemsets(I.baskets(m, "vendor_name"), 0.001).rules(0.01)),
    "cooccurrence_item_types": _model(lambda m: I.Itemsets(I.baskets(m, "item_type"), 0.005).cooccurrence()),
    "basket_diversity": _model(I.diversity),
    "user_item_sets": _model(lambda m: L.item_sets(m).groupBy("customer_id").agg(F.count("*").alias("num_items"), F.array_join(F.array_sort(F.collect_set("item")), "|").alias("item_set"))),
    "user_item_sets_popular": _model(lambda m: L.item_sets(m, popular=I.POPULAR_ITEMS).groupBy("customer_id").agg(F.count("*").alias("num_items"), F.array_join(F.array_sort(F.collect_set("item")), "|").alias("item_set"))),
    "minhash_signatures": _model(lambda m: L.signatures(L.item_sets(m)).select("customer_id", F.array_join("sig", ",").alias("sig"))),
    "lsh_candidates": _model(lambda m: _similar(m)[3]),
    "lsh_verified": _model(lambda m: (lambda x: L.verified(x[3], x[0], x[1]))(_similar(m))),
    "lsh_diagnostics": _model(lambda m: L.diagnostics(_similar(m)[2])),
    "lsh_summary": _model(lambda m: (lambda x: L.lsh_summary(x[2], L.verified(x[3], x[0], x[1])))(_similar(m))),
    "lsh_matrix": _model(lambda m: L.estimate_matrix(L.signatures(L.item_sets(m)))),
    "similar_users": _model(lambda m: L.similar_users(_similar(m)[3], 7)),
    "recommend_items": _model(lambda m: (lambda x: L.recommend_items(x[3], x[0]))(_similar(m))),
    "recommend_users": _model(lambda m: (lambda x: L.recommend_users(x[3], x[0], "Brand#11-ECONOMY"))(_similar(m))),
    "vendor_type_metrics": _model(lambda m: R.metrics(m)),
    "vendor_type_metrics_fanout": _model(lambda m: R.metrics(m, fan_out=True)),
    "vendor_type_scores": _model(lambda m: R.scored(R.metrics(m)).select("node", "score")),
    "similarity_edges": _model(lambda m: R.edges(R.scored(R.metrics(m)))),
    "pagerank": _model(lambda m: _ranked(m).select("node", "place", F.round("pagerank", 9).alias("pagerank"))),
    "pagerank_tiers": _model(lambda m: R.tiers(_ranked(m)).select("tier", "nodes", F.round("mean", 9).alias("mean"))),
    "pagerank_top": _model(lambda m: _ranked(m).where("place <= 10").select("node", "vendor_name", "item_type", "place", F.round("pagerank", 9).alias("pagerank"), F.round("score", 9).alias("score"))),
    "pagerank_summary": _model(lambda m: _nine(R.rank_summary(_ranked(m)))),
    "pagerank_means": _model(lambda m: _nine(R.rank_means(_ranked(m)))),
    "pagerank_heatmap": _model(lambda m: _nine(R.rank_heatmap(_ranked(m)))),
    "graph_stats": _model(lambda m: R.graph_stats(R.scored(R.metrics(m)))),
    "customer_features": _model(S.customer_features),
    "inventory_features": _model(S.inventory_features),
    "order_features": _model(S.order_features),
    "customer_clusters": _model(lambda m: _summary(S.customer_features(m), "customer_segmentation")),
    "inventory_clusters": _model(lambda m: _summary(S.inventory_features(m), "inventory_intelligence")),
    "order_clusters": _model(lambda m: _summary(S.order_features(m), "order_patterns")),
    "segmentation_report": _model(lambda m: N.report(N.history(_metrics(m))).withColumn("features", F.array_join("features", ","))),
    "segmentation_insights": _model(lambda m: N.insights(m.spark)),
    "recent_inventory": _model(lambda m: m.items().select("item_id").join(m.lines().select("item_id", "order_id"), "item_id", "left").join(m.orders().select("order_id", "date_of_order"), "order_id", "left").where(recent_or_never(F.col("date_of_order"), AS_OF, 30)).groupBy("item_id").agg(F.countDistinct("order_id").alias("orders"))),
    "random_customers": _model(lambda m: shuffled(m.customers().select("customer_id", "customer_name"), "customer_id", seed=7, limit=100, offset=20)),
    "order_totals": _model(K.order_totals),
    "item_purchases": _model(K.item_purchases),
    "item_ratings": _model(K.item_ratings),
    "payment_histogram": _model(lambda m: K.histogram(m.orders(), "total_payment", 20)),
    "last_activity": _events(lambda e: _plain(K.last_activity(e))),
    "events_hourly": _events(lambda e: _plain(A.windowed(e, "1 hour"))),
    "events_sliding": _events(lambda e: _plain(A.windowed(e, "1 day", "6 hours"))),
    "event_sessions": _events(lambda e: _plain(A.sessions(e))),
    "daily_distinct": _events(lambda e: _plain(A.distinct_users(e, exact=True))),
    "daily_distinct_sketch": _events(lambda e: _plain(A.distinct_users(e))),
    "events_in_focus": _events(lambda e: A.in_focus(e, e.select("item").distinct().orderBy("item").limit(1000)).groupBy("event_type").agg(F.count("*").alias("n"))),
    "event_alerts": _events(lambda e: _plain(A.alerts(e, over=60))),
    "activity_reconcile": _events(lambda e: A.reconcile(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id", "item"])),
    "bloom_focus": _events(_bloom),
    "invertible_table": _events(lambda e: A.invertible_table(e.select("item").distinct(), "item")),
    "window_sample": _events(lambda e: _plain(A.window_sample(e).select("start", "event_id"))),
    "window_sample_small": _events(lambda e: _plain(A.window_sample(e, size=5).select("start", "event_id"))),
}

_PARAMS = ", ".join(f"({i}, {a}, {b})" for i, a, b in L.hash_parameters())
_SETS = """isets AS (SELECT DISTINCT customer_id, brand || '-' || item_type AS item FROM lines JOIN sales USING (order_id) JOIN customers USING (customer_id) JOIN items USING (item_id)
    WHERE line_rating IS NOT NULL AND customer_active AND total_payment > (SELECT avg(total_payment) FROM sales)
    AND customer_id IN (SELECT customer_id FROM sales GROUP BY 1 HAVING count(*) > 2))"""
_SIGS = f"""{_SETS},
    nums AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS x FROM (SELECT DISTINCT item FROM isets)), params(i, a, b) AS (VALUES {_PARAMS}),
    mins AS (SELECT customer_id, i, min((a * x + b) % 7919) AS h FROM isets JOIN nums USING (item), params GROUP BY 1, 2)"""
_BANDS = f"""{_SIGS}, bands AS (SELECT customer_id, i // 5 AS band, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS k FROM mins GROUP BY 1, 2),
    cand AS (SELECT DISTINCT a.customer_id AS u, b.customer_id AS v FROM bands a JOIN bands b ON a.band = b.band AND a.k = b.k AND a.customer_id < b.customer_id),
    near AS (SELECT u, v FROM cand UNION ALL SELECT v, u FROM cand)"""
_VERIFIED = f"""{_BANDS}, n AS (SELECT customer_id, count(*) AS n FROM isets GROUP BY 1),
        x AS (SELECT u, v, (SELECT count(*) FROM isets a JOIN isets b USING (item) WHERE a.customer_id = u AND b.customer_id = v) AS k,
            (SELECT count(*) FROM mins a JOIN mins b USING (i) WHERE a.customer_id = u AND b.customer_id = v AND a.h = b.h) / 100 AS g FROM cand),
        checked AS (SELECT u, v, round(k / (a.n + b.n - k), 9) AS jaccard, round(g, 9) AS estimate, round(abs(k / (a.n + b.n - k) - g), 9) AS error FROM x JOIN n a ON a.customer_id = u JOIN n b ON b.customer_id = v)"""
_RULES = """one AS (SELECT itemset AS name, n FROM sets WHERE size < 3), parts AS (SELECT itemset, size, n, t, string_split(itemset, ' + ') AS p FROM sets WHERE size > 1),
    splits AS (
        SELECT p[1] AS antecedent, p[2] AS consequent, n, t, 1 AS w FROM parts WHERE size = 2 UNION ALL SELECT p[2], p[1], n, t, 1 FROM parts WHERE size = 2
        UNION ALL SELECT p[1], p[2] || ' + ' || p[3], n, t, 2 FROM parts WHERE size = 3 UNION ALL SELECT p[2], p[1] || ' + ' || p[3], n, t, 2 FROM parts WHERE size = 3
        UNION ALL SELECT p[3], p[1] || ' + ' || p[2], n, t, 2 FROM parts WHERE size = 3 UNION ALL SELECT p[2] || ' + ' || p[3], p[1], n, t, 1 FROM parts WHERE size = 3
        UNION ALL SELECT p[1] || ' + ' || p[3], p[2], n, t, 1 FROM parts WHERE size = 3 UNION ALL SELECT p[1] || ' + ' || p[2], p[3], n, t, 1 FROM parts WHERE size = 3)
    SELECT antecedent, consequent, s.n, round(s.n / t, 9) AS support, round(a.n / t, 9) AS antecedent_support, round(c.n / t, 9) AS consequent_support, round(s.n / a.n, 9) AS confidence, {lift} AS lift
    FROM splits s JOIN one a ON a.name = antecedent JOIN one c ON c.name = consequent WHERE s.n / a.n >= {least}"""
_LIFT = "round(s.n / a.n / (c.n / t), 9)"


def _metrics_sql(fan: bool) -> str:
    t, n = ("greatest(nr, 1)", "n") if fan else ("1", "1")
    return f"""it AS (SELECT vendor_id, item_id, sum(quantity) AS q, sum(total_price) AS v, sum(line_rating) AS r, count(line_rating) AS nr, count(*) AS n FROM lines GROUP BY 1, 2),
    s AS (SELECT vendor_id, item_type, sum(q * {t}) AS q, sum(v * {t}) AS v, sum(r * {n}) AS r, sum(nr * {n}) AS nr, count(*) AS k, sum(n) AS n FROM it JOIN items USING (item_id) GROUP BY 1, 2),
    o AS (SELECT vendor_id, item_type, count(DISTINCT order_id) AS o FROM lines JOIN items USING (item_id) GROUP BY 1, 2),
    m AS (SELECT v.vendor_id, vendor_name, g.item_type, CAST(coalesce(o, 0) AS BIGINT) AS total_orders, coalesce(q, 0.0) AS total_quantity, round(coalesce(v, 0.0), 2) AS total_revenue,
        coalesce(round(r / nullif(nr, 0), 6), 0.0) AS avg_rating, CAST(coalesce(nr, 0) AS BIGINT) AS total_ratings, CAST(coalesce(k, 0) AS BIGINT) AS total_items,
        CAST(coalesce(n, 0) AS BIGINT) AS total_purchases, v.vendor_id || '_' || g.item_type AS node
        FROM (SELECT * FROM vendors WHERE vendor_active) v CROSS JOIN (SELECT DISTINCT item_type FROM items) g
        LEFT JOIN s ON s.vendor_id = v.vendor_id AND s.item_type = g.item_type LEFT JOIN o ON o.vendor_id = v.vendor_id AND o.item_type = g.item_type)"""


_SCORE = f"""{_metrics_sql(False)}, sc AS (SELECT node, vendor_id, item_type, round(.25 * total_orders / (SELECT max(total_orders) FROM m) + .25 * total_revenue / (SELECT max(total_revenue) FROM m)
    + .2 * total_quantity / (SELECT max(total_quantity) FROM m) + .15 * avg_rating / (SELECT max(avg_rating) FROM m) + .1 * total_items / (SELECT max(total_items) FROM m)
    + .05 * total_purchases / (SELECT max(total_purchases) FROM m), 9) AS score FROM m)"""
_EDGES = f"""{_SCORE}, e0 AS (SELECT a.node AS src, b.node AS dst, CASE WHEN a.vendor_id = b.vendor_id THEN .4 ELSE 0 END + CASE WHEN a.item_type = b.item_type THEN .4 ELSE 0 END
    + CASE WHEN abs(a.score - b.score) < .2 THEN .2 ELSE 0 END AS w FROM sc a JOIN sc b ON a.node <> b.node)"""
_ROUNDS = 24
_RANKS = f"""{_EDGES}, ed AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS weight FROM e0 WHERE w > 0), nn AS (SELECT count(*) AS n FROM sc),
    v0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS r FROM sc, nn),
    """ + ",\n    ".join(
    f"v{k} AS MATERIALIZED (SELECT node, .85 * coalesce(g, 0) + .15 / n AS r FROM sc CROSS JOIN nn LEFT JOIN (SELECT dst, sum(weight * r) AS g FROM ed JOIN v{k - 1} ON node = src GROUP BY 1) ON dst = node)" for k in range(1, _ROUNDS)
) + ", moves AS (" + " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(abs(a.r - b.r)) FROM v{k} a JOIN v{k - 1} b USING (node)) AS d" for k in range(1, _ROUNDS)) + """),
    done AS (SELECT min(k) - 1 AS k FROM moves WHERE d < 1e-6), every AS (""" + " UNION ALL ".join(f"SELECT {k} AS k, node, r FROM v{k}" for k in range(_ROUNDS)) + """),
    pr0 AS (SELECT node, r / sum(r) OVER () AS pagerank FROM every JOIN done USING (k)),
    pr AS (SELECT m.*, pagerank, score, row_number() OVER (ORDER BY round(pagerank, 12) DESC, m.node) AS place FROM pr0 JOIN m USING (node) JOIN (SELECT node, score FROM sc) USING (node))"""


def _sql(ctes: str, text: str) -> str:
    return f"WITH {MODEL_SQL}, {ctes} {text}"


_types, _brands, _vendors, _fine = I.itemsets_sql("item_type", 0.005), I.itemsets_sql("brand", 0.001, I.POPULAR_ITEMS).replace("0.2 *", "1.0 *"), I.itemsets_sql("vendor_name", 0.01), I.itemsets_sql("vendor_name", 0.001)
_DIGEST = "CAST(concat('0x', substr(md5({key} || '_' || {seed}), 1, 15)) AS BIGINT)"
_EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events)"

ORACLES: dict[str, str] = {
    **{f"itemsets_{k}": _sql(s, "SELECT size, itemset, n, support FROM sets") for k, s in (("item_types", _types), ("items", _brands), ("vendors", _vendors), ("vendors_fine", _fine))},
    "pcy_progression": _sql(_types, """, tops AS (SELECT itemset AS item FROM sets WHERE size = 1)
        SELECT 'items' AS stage, count(DISTINCT item) AS n FROM bk UNION ALL SELECT 'frequent items', count(*) FROM tops
        UNION ALL SELECT 'candidate pairs', count(*) FROM (SELECT DISTINCT a.item, b.item FROM bk a JOIN bk b ON a.order_id = b.order_id AND a.item < b.item WHERE a.item IN (SELECT item FROM tops) AND b.item IN (SELECT item FROM tops))
        UNION ALL SELECT 'frequent pairs', count(*) FROM sets WHERE size = 2 UNION ALL SELECT 'frequent triples', count(*) FROM sets WHERE size = 3"""),
    "rules_item_types": _sql(_types + ", ", "") .rstrip() + " " + _RULES.format(lift=_LIFT, least=0.005),
    "rules_items": _sql(_brands + ", ", "").rstrip() + " " + _RULES.format(lift=f"CASE WHEN w = 1 THEN {_LIFT} ELSE 1.0 END", least=0.001),
    "rules_vendors": _sql(_vendors + ", ", "").rstrip() + " " + _RULES.format(lift=_LIFT, least=0.01),
    "rules_vendors_fine": _sql(_fine + ", ", "").rstrip() + " " + _RULES.format(lift=_LIFT, least=0.01),
    "cooccurrence_item_types": _sql(_types, "SELECT p[1] AS a, p[2] AS b, support AS rate FROM (SELECT string_split(itemset, ' + ') AS p, support FROM sets WHERE size = 2) UNION ALL SELECT p[2], p[1], support FROM (SELECT string_split(itemset, ' + ') AS p, support FROM sets WHERE size = 2)"),
    "basket_diversity": f"WITH {MODEL_SQL}, o AS (SELECT order_id, count(DISTINCT item_type) AS size, sum(total_price) AS v, sum(quantity) AS q FROM lines JOIN items USING (item_id) JOIN vendors USING (vendor_id) GROUP BY 1) SELECT size, count(*) AS baskets, round(avg(v), 2) AS mean_value, round(avg(q), 4) AS mean_quantity FROM o GROUP BY 1",
    "user_item_sets": _sql(_SETS, "SELECT customer_id, count(*) AS num_items, string_agg(item, '|' ORDER BY item) AS item_set FROM isets GROUP BY 1"),
    "user_item_sets_popular": _sql(_SETS.replace("AND customer_active", f"AND item_id IN (SELECT item_id FROM lines GROUP BY 1 HAVING count(*) > {I.POPULAR_ITEMS}) AND customer_active"), "SELECT customer_id, count(*) AS num_items, string_agg(item, '|' ORDER BY item) AS item_set FROM isets GROUP BY 1"),
    "minhash_signatures": _sql(_SIGS, "SELECT customer_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS sig FROM mins GROUP BY 1"),
    "lsh_candidates": _sql(_BANDS, "SELECT u, v FROM cand"),
    "lsh_verified": _sql(_VERIFIED, "SELECT * FROM checked"),
    "lsh_summary": _sql(_VERIFIED, """, bs AS (SELECT count(*) AS s FROM bands GROUP BY band, k) SELECT (SELECT count(*) FROM bs) AS buckets, (SELECT round(avg(s), 9) FROM bs) AS mean_size, (SELECT max(s) FROM bs) AS max_size,
        count(*) AS pairs, round(avg(error), 9) AS mean_error, round(stddev_pop(error), 9) AS std_error FROM checked"""),
    "lsh_matrix": _sql(_SIGS, ", eight AS (SELECT DISTINCT customer_id FROM mins ORDER BY 1 LIMIT 8) SELECT a.customer_id AS u, b.customer_id AS v, round(count(*) FILTER (a.h = b.h) / 100, 9) AS estimate FROM mins a JOIN mins b USING (i) WHERE a.customer_id IN (FROM eight) AND b.customer_id IN (FROM eight) GROUP BY 1, 2"),
    "similar_users": _sql(_BANDS, "SELECT v AS customer_id FROM near WHERE u = 7"),
    "lsh_diagnostics": _sql(_BANDS, "SELECT bucket_size, count(*) AS buckets FROM (SELECT count(*) AS bucket_size FROM bands GROUP BY band, k) GROUP BY 1"),
    "recommend_items": _sql(_BANDS, """, votes AS (SELECT u AS customer_id, item, count(*) AS votes FROM near JOIN isets s ON s.customer_id = v WHERE NOT EXISTS (SELECT 1 FROM isets o WHERE o.customer_id = u AND o.item = s.item) GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY votes DESC, item) AS rnk FROM votes) WHERE rnk <= 3"""),
    "recommend_users": _sql(_BANDS, """SELECT DISTINCT v AS customer_id FROM near WHERE u IN (SELECT customer_id FROM isets WHERE item = 'Brand#11-ECONOMY')
        AND v NOT IN (SELECT customer_id FROM isets WHERE item = 'Brand#11-ECONOMY') ORDER BY 1 LIMIT 5"""),
    "vendor_type_metrics": _sql(_metrics_sql(False), "SELECT * FROM m"),
    "vendor_type_metrics_fanout": _sql(_metrics_sql(True), "SELECT * FROM m"),
    "vendor_type_scores": _sql(_SCORE, "SELECT node, score FROM sc"),
    "similarity_edges": _sql(_EDGES, "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 12) AS weight FROM e0 WHERE w > 0"),
    "pagerank": _sql(_RANKS, "SELECT node, CAST(place AS INTEGER) AS place, round(pagerank, 9) AS pagerank FROM pr"),
    "pagerank_tiers": _sql(_RANKS, """SELECT CASE WHEN place <= 5 THEN 'Top 5' WHEN place <= 10 THEN '6-10' WHEN place <= 20 THEN '11-20' WHEN place <= 50 THEN '21-50' ELSE 'Others' END AS tier,
        count(*) AS nodes, round(avg(pagerank), 9) AS mean FROM pr GROUP BY 1"""),
    "pagerank_top": _sql(_RANKS, "SELECT node, vendor_name, item_type, CAST(place AS INTEGER) AS place, round(pagerank, 9) AS pagerank, score FROM pr WHERE place <= 10"),
    "pagerank_summary": _sql(_RANKS, "SELECT count(*) AS nodes, round(avg(pagerank), 9) AS mean, round(max(pagerank), 9) AS most, round(min(pagerank), 9) AS least, count(DISTINCT vendor_id) AS vendors, count(DISTINCT item_type) AS types FROM pr"),
    "pagerank_means": _sql(_RANKS, "SELECT 'vendor' AS kind, vendor_name AS name, count(*) AS nodes, round(avg(pagerank), 9) AS mean FROM pr GROUP BY 2 UNION ALL SELECT 'type', item_type, count(*), round(avg(pagerank), 9) FROM pr GROUP BY 2"),
    "pagerank_heatmap": _sql(_RANKS, """, tv AS (SELECT vendor_name FROM pr GROUP BY 1 ORDER BY round(sum(pagerank), 12) DESC, 1 LIMIT 5), tt AS (SELECT item_type FROM pr GROUP BY 1 ORDER BY round(sum(pagerank), 12) DESC, 1 LIMIT 7)
        SELECT vendor_name, item_type, round(coalesce(avg(pagerank), 0), 9) AS mean FROM tv CROSS JOIN tt LEFT JOIN pr USING (vendor_name, item_type) GROUP BY 1, 2"""),
    "graph_stats": _sql(_EDGES, """, t AS (SELECT w / sum(w) OVER (PARTITION BY src) AS x FROM e0 WHERE w > 0)
        SELECT (SELECT count(*) FROM sc) AS node_count, 0.0::DOUBLE AS min_value, round(max(x), 9) AS max_value, round(sum(x) / (SELECT count(*) FROM sc) ** 2, 9) AS mean_value, round(count(*) / (SELECT count(*) FROM sc) ** 2, 9) AS density FROM t"""),
    "customer_features": f"""WITH {MODEL_SQL} SELECT customer_id, any_value(balance) AS balance, count(order_id) AS total_orders, round(avg(total_payment), 6) AS avg_order_value, round(sum(total_payment), 2) AS total_spent,
        max(date_of_order) AS last_order_date, count(DISTINCT CAST(date_of_order AS DATE)) AS active_days, any_value(country) AS country, any_value(region) AS region FROM sales_places GROUP BY 1""",
    "inventory_features": f"""WITH {MODEL_SQL}, p AS (SELECT item_id, count(DISTINCT CASE WHEN date_of_order >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY THEN order_id END) AS recent_orders, round(avg(quantity), 4) AS avg_quantity, sum(quantity) AS total_quantity
        FROM lines JOIN sales USING (order_id) GROUP BY 1) SELECT item_id, item_name, item_type, item_price, coalesce(recent_orders, 0) AS recent_orders, coalesce(avg_quantity, 0.0) AS avg_quantity, coalesce(total_quantity, 0.0) AS total_quantity FROM items LEFT JOIN p USING (item_id)""",
    "order_features": f"""WITH {MODEL_SQL}, p AS (SELECT order_id, count(*) AS n_lines, round(avg(total_price / quantity), 6) AS avg_item_price FROM lines GROUP BY 1)
        SELECT order_id, status, total_payment, balance, round(epoch_us(TIMESTAMP '2001-08-01') / 86400000000 - epoch_us(date_of_order) / 86400000000, 6) AS days_since, coalesce(n_lines, 0) AS n_lines, avg_item_price FROM sales JOIN customers USING (customer_id) LEFT JOIN p USING (order_id)""",
    "order_totals": f"WITH {MODEL_SQL} SELECT order_id, round(coalesce(sum(total_price), 0.0), 2) AS total FROM sales LEFT JOIN lines USING (order_id) GROUP BY 1",
    "item_purchases": f"WITH {MODEL_SQL} SELECT item_id, CAST(sum(quantity) AS BIGINT) AS purchased FROM lines WHERE order_id IN (SELECT order_id FROM sales WHERE status = 'F') GROUP BY 1",
    "item_ratings": f"WITH {MODEL_SQL} SELECT item_id, round(avg(line_rating), 6) AS rating, count(*) AS n FROM lines WHERE line_rating IS NOT NULL GROUP BY 1",
    "payment_histogram": "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1",
    "last_activity": "SELECT user_id, arg_max(ts, event_id) AS last_activity FROM events GROUP BY 1",
    "events_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, unnest([0, 1, 2, 3]) t(k) GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, k""",
    "daily_distinct": f"WITH {_EV} SELECT date_trunc('day', ts) AS start, count(DISTINCT user_id) AS users, count(DISTINCT item) AS items FROM ev GROUP BY 1",
    "events_in_focus": f"WITH {_EV} SELECT event_type, count(*) AS n FROM ev WHERE item IN (SELECT DISTINCT item FROM ev ORDER BY item NULLS FIRST LIMIT 1000) GROUP BY 1",
    "event_alerts": """WITH c AS (SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
        days AS (SELECT start, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(start), max(start), INTERVAL 1 DAY)) AS start FROM c) LEFT JOIN c USING (start)),
        w AS (SELECT *, last_value(CASE WHEN n <> 60 THEN n END IGNORE NULLS) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM days) SELECT start, n FROM w WHERE n > 60 AND coalesce(was, 0) < 60""",
    "activity_reconcile": f"WITH {_EV}, a AS (SELECT DISTINCT user_id, item FROM ev WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, item FROM ev WHERE event_type = 'click') SELECT *, 'left' AS side FROM a ANTI JOIN b USING (user_id, item) UNION ALL SELECT *, 'right' FROM b ANTI JOIN a USING (user_id, item)",
    **{name: f"SELECT start, event_id FROM (SELECT date_trunc('hour', ts) AS start, event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY (event_id % 2147483648 * 2654435761) % 4294967296, event_id) AS k FROM events) WHERE k <= {size}" for name, size in (("window_sample", 50_000), ("window_sample_small", 5))},
    "bloom_focus": f"WITH {_EV}, h(i) AS (VALUES (0), (1), (2), (3), (4), (5)), b AS (SELECT DISTINCT {_DIGEST.format(key='item', seed='i')} % 2048 AS bit FROM ev, h WHERE item % 7 = 3),"
    f" hit AS (SELECT DISTINCT item FROM ev WHERE item IS NOT NULL AND item NOT IN (SELECT item FROM ev, h WHERE item IS NOT NULL AND {_DIGEST.format(key='item', seed='i')} % 2048 NOT IN (FROM b))) SELECT item, count(*) AS n FROM ev JOIN hit USING (item) GROUP BY 1",
    "invertible_table": f"WITH {_EV}, k AS (SELECT DISTINCT item AS k FROM ev WHERE item IS NOT NULL), h(i) AS (VALUES (0), (1), (2)) SELECT CAST({_DIGEST.format(key='k', seed='i')} % 333 + i * 333 AS BIGINT) AS cell, count(*) AS n, bit_xor(k) AS keys, bit_xor({_DIGEST.format(key='k', seed=chr(39) + 'check' + chr(39))} % (1::BIGINT << 60)) AS checks FROM k, h GROUP BY 1",
    "recent_inventory": f"WITH {MODEL_SQL} SELECT item_id, count(DISTINCT sales.order_id) AS orders FROM items LEFT JOIN lines USING (item_id) LEFT JOIN sales USING (order_id) WHERE date_of_order IS NULL OR date_of_order >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1",
    "random_customers": f"WITH {MODEL_SQL} SELECT customer_id, customer_name FROM customers ORDER BY ((customer_id + 7) % 2147483648 * 2654435761) % 4294967296, customer_id LIMIT 100 OFFSET 20",
    "segmentation_insights": "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', {}, '{}')".format(n, kind, i, t) for n, x in N.SCENARIOS.items() for kind, ts in (("insight", x.insights), ("recommendation", x.recommendations), ("cluster", x.names)) for i, t in enumerate(ts)) + ") t(scenario, kind, place, text)",
}
