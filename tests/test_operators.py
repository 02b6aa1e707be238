"""Operators that no registered query covers, or SQL can't check."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from orderloom import functions as X, scratch
from orderloom.operators import insights as N, itemsets as I, segmentation as S
from orderloom.sources import sinks, tables


def test_functions(spark):
    df = spark.createDataFrame([("12345", "2024-01-02T03:04:05Z", "customer_segmentation"), ("1234a", "soon", "a"), (None, None, None)], "z string, t string, n string")
    got = df.select(X.is_zipcode(F.col("z")), X.iso_time(F.col("t")).cast("long"), X.title_case(F.col("n"))).collect()
    assert list(map(tuple, got)) == [(True, 1704164645, "Customer Segmentation"), (False, None, "A"), (None, None, None)]
    one = df.select(X.decode_json(X.encode_json("z", "n"), "z string, n string").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in one] == [("12345", "customer_segmentation"), ("1234a", "a"), (None, None)]
    pages = [r["id"] for k in range(3) for r in X.shuffled(spark.range(30), "id", limit=10, offset=10 * k).collect()]
    assert sorted(pages) == list(range(30)) != pages


def test_history_report_and_suite(spark):
    rng = random.Random(1)
    rows = [(b, s, rng.random(), rng.randint(1, 50), ["x", "y"]) for s in list(N.SCENARIOS)[:2] for b in range(130)]
    kept = N.history(spark.createDataFrame(rows, N.METRICS))
    got = {r["scenario"]: r for r in N.report(kept).collect()}
    for s in list(N.SCENARIOS)[:2]:
        own = [r for r in rows if r[1] == s][-100:]
        mean = sum(r[2] for r in own) / 100
        r = got[s]
        assert (r["batches"], r["latest"], r["mean"], r["records"], r["last_batch"]) == (100, round(own[-1][2], 3), round(mean, 3), sum(x[3] for x in own), 129)
        assert r["name"] == s.replace("_", " ").title() and r["clusters"] == N.SCENARIOS[s].k
    total = N.indicators(N.report(kept)).first()
    assert (total["records"], total["scenarios"]) == (sum(r["records"] for r in got.values()), 2)
    parts = {r["part"]: r["score"] for r in N.suite(kept).collect()}
    models = [parts[s] for s in got]
    assert parts["model_performance"] == pytest.approx(sum(models) / 2, abs=0.06) and parts["overall"] == pytest.approx((parts["model_performance"] + 85 + 90 + 88) / 4, abs=0.01)
    assert [N.rotation(b, ("a", "b")) for b in range(4)] == ["a", "b", "a", "b"] and N.rotation(3) == "customer_segmentation"


def test_segments(spark):
    df = spark.createDataFrame([(i, float(i % 3) * 10, float(i % 3) + 0.01 * (i % 5), None) for i in range(90)], "id long, a double, b double, c double")
    told = S.segment(df, ("a", "b", "c", "not there"), k=3)
    assert {(r["a"], r["cluster"]) for r in told.collect()}.__len__() == 3 and S.silhouette(told) > 0.9
    sizes = S.cluster_summary(told, ("a", "b")).collect()
    assert sorted(r["size"] for r in sizes) == [30, 30, 30] and sorted(r["a_mean"] for r in sizes) == [0.0, 10.0, 20.0]
    with pytest.raises(ValueError):
        S.segment(df, ("a", "not there"))


def test_itemsets_of_odd_names_and_samples(spark):
    rows = [(o, i) for o in range(40) for i in (("a + b", "c") if o % 2 else ("a", "b"))]
    rules = I.Itemsets(spark.createDataFrame(rows, "order_id long, item string"), 0.1).rules(0.1).collect()
    assert {(r["antecedent"], r["consequent"]) for r in rules} == {("a + b", "c"), ("c", "a + b"), ("a", "b"), ("b", "a")} and all(r["confidence"] == 1 for r in rules)
    big = spark.range(20_000).select(F.col("id").alias("order_id"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("item"))
    some, share = I.sample_baskets(big, most=5000)
    sets = I.Itemsets(some, 0.5, sampled=20_000)
    assert share == 0.25 and 4500 < sets.total < 5500 and sets.least == pytest.approx(10_000 * sets.total / 20_000)
    assert sets.table().count() == 3


def test_local_masters():
    assert scratch.is_local("local") and scratch.is_local("local[8]") and not scratch.is_local("local-cluster[3,2,1000]") and not scratch.is_local("spark://x:7077")


def test_jdbc_options_and_views(spark, tmp_path):
    tables.register(spark, {"few": spark.range(3)})
    assert spark.sql("SELECT count(*) FROM few").first()[0] == 3
    with pytest.raises(Exception, match="(?i)driver|suitable"):
        tables.jdbc(spark, "jdbc:none:x", "t", partitionColumn="a", lowerBound="0", upperBound="9", numPartitions="2")
    sinks.write_parquet(spark.range(4), str(tmp_path / "p"))
    sinks.write_parquet(spark.range(2), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE t (a INTEGER)")
    con.close()


def test_unprocessed_and_heatmap(spark):
    from orderloom.operators.maintenance import unprocessed
    from orderloom.operators.ranking import heatmap

    assert sorted(r[0] for r in unprocessed(spark.range(5), spark.createDataFrame([(1,), (1,), (3,)], "id long"), "id").collect()) == [0, 2, 4]
    ranked = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.25), (2, "b", 1.0)], "vendor_id long, item_type string, pagerank double")
    assert sorted(map(tuple, heatmap(ranked, ["a", "b"]).collect())) == [(1, 0.375, 0.0), (2, 0.0, 1.0)]


def test_edges_of_ties_and_repeats(spark, monkeypatch):
    """As the SQL has them, over many cells, and no pair is shuffled or added up; scores tie at the width, nodes repeat or have no type."""
    import duckdb

    from orderloom.operators import ranking as R
    from orderloom.plans import mining

    rng = random.Random(3)
    scores = [round(rng.choice((0.1, 0.05)) * rng.randint(-3, 12), 9) for _ in range(239)] + [None]
    rows = [(f"{v}_{t}", v, t, scores[6 * v + k]) for v in range(40) for k, t in enumerate("abcdef")]
    rows += rows[50:60] + rows[50:55] + [("7", 7, None, 0.3)]
    monkeypatch.setattr(R, "CELL", 2000, raising=False)
    monkeypatch.setattr(R, "ROWS", 60, raising=False)
    df = R.edges(spark.createDataFrame(rows, "node string, vendor_id long, item_type string, score double"))
    got = df.collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE sc (node VARCHAR, vendor_id BIGINT, item_type VARCHAR, score DOUBLE)")
    con.executemany("INSERT INTO sc VALUES (?, ?, ?, ?)", [(n if t else None, v, t, s) for n, v, t, s in rows])
    want = con.sql("WITH e0 AS" + mining._EDGES.split(", e0 AS")[1] + " SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 12) AS weight FROM e0 WHERE w > 0").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 20_000
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert R.edges(spark.createDataFrame([], df.sparkSession.createDataFrame(rows[:1], "node string, vendor_id long, item_type string, score double").schema)).count() == 0
    one = R.edges(spark.createDataFrame(rows[:1] + [("99_z", 99, "z", 9.0)], "node string, vendor_id long, item_type string, score double"))
    assert one.count() == 0


def test_edges_repeat_themselves_on_disk(spark, tmp_path):
    """A page of edges is made of like runs, which take less than half a byte each; a node is sent to as many cells as there are blocks."""
    from orderloom.operators import ranking as R

    rng = random.Random(4)
    rows = [(f"{v}_{t}", v, t, round(0.5 + rng.gauss(0, 0.04), 9)) for v in range(400) for t in "abcdef"]
    df = R.edges(spark.createDataFrame(rows, "node string, vendor_id long, item_type string, score double"))
    df.write.parquet(f"{tmp_path}/edges")
    n = spark.read.parquet(f"{tmp_path}/edges").count()
    assert n > 5_000_000 and sum(p.stat().st_size for p in (tmp_path / "edges").glob("*.parquet")) < 0.5 * n


def test_metrics_of_odd_tables_in_one_pass(spark, tmp_path):
    """As the SQL has them, with repeated parts, lines without keys and unknown ones; lines are read once."""
    import duckdb

    from orderloom.operators import ranking as R
    from orderloom.plans import mining
    from orderloom.sources.tables import Model

    rng, con = random.Random(5), duckdb.connect()
    some = lambda n: None if rng.random() < 0.05 else rng.randint(1, n)
    tables = {
        "supplier": ("s_suppkey BIGINT, s_name VARCHAR, s_acctbal DOUBLE", [(k, f"v{k}", k - 1.5) for k in range(1, 8)]),
        "part": ("p_partkey BIGINT, p_name VARCHAR, p_type VARCHAR, p_brand VARCHAR, p_retailprice DOUBLE", [(k, "p", t, "b", 1.0) for k, t in [*((k, "xyz"[k % 3]) for k in range(1, 10)), (1, "y"), (1, "x"), (2, "z"), (2, "z"), (3, "z")]]),
        "lineitem": (
            "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_returnflag VARCHAR, l_discount DOUBLE",
            [(some(30), some(11), some(9), 1, float(rng.randint(1, 50)), rng.randint(1, 10**6) / 4, rng.choice("ANR"), rng.randint(0, 10) / 100) for _ in range(600)],
        ),
    }
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    for name in ("customer", "orders", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, fan_out in (("vendor_type_metrics", False), ("vendor_type_metrics_fanout", True)):
        df = R.metrics(Model(spark, str(tmp_path)), fan_out)
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(mining.ORACLES[name]).fetchall())
        assert sum("l_suppkey" in x and "Relation" in x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 1
