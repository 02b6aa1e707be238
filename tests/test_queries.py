"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from orderloom.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _row(values):
    return tuple("%.9g" % v if isinstance(v, float) else repr(v) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert sorted(_row(r[c] for c in cols) for r in df.collect()) == sorted(_row(r[i] for i in order) for r in want.fetchall())


def test_pagerank_sums_to_one(spark):
    from orderloom.operators.ranking import pagerank_of_edges as pagerank

    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 0.5), ("c", "a", 1.0)], "src string, dst string, weight double")
    got = {r["node"]: r["rank"] for r in pagerank(nodes, links, tolerance=1e-9).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] > got["b"] > got["c"] > got["d"]
    v = dict.fromkeys("abcd", 0.25)
    for _ in range(200):
        spare = v["d"] / 4
        v = {"a": v["b"] * 0.5 + v["c"], "b": v["a"], "c": v["b"] * 0.5, "d": 0.0}
        v = {k: 0.85 * (x + spare) + 0.15 / 4 for k, x in v.items()}
    assert all(abs(got[k] - v[k]) < 1e-6 for k in v)


def test_components(spark):
    from orderloom.operators.components import connected_components

    edges = [(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (None, 2)] + [(100, 100 + i) for i in range(1, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pagerank_without_edges(spark):
    """The sums by vendor, type and score band give what the edge table gives."""
    from orderloom.operators import ranking as R
    from orderloom.sources.tables import Model

    table = R.scored(R.metrics(Model(spark, "/root/testdata/sf0.01"))).select("node", "vendor_id", "item_type", "score").cache()
    got = dict(map(tuple, R.pagerank(table).collect()))
    want = dict(map(tuple, R.pagerank_of_edges(table, R.edges(table)).collect()))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    one = table.limit(1)
    assert [r["rank"] for r in R.pagerank(one).collect()] == [1.0] and R.pagerank(table.limit(0)).count() == 0
    assert R.graph_stats(one).first()["density"] == 1.0
