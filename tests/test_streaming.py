"""Streams over files give what the same operator gives over the table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orderloom.sources import sinks
from orderloom.streaming import activity as A

FILE = "/root/testdata/sf0.001/events.parquet"


def _folder(spark, tmp_path):
    A.events(spark.read.parquet(FILE)).drop("item").repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_windows_on_a_stream(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    live = A.windowed(A.stream(spark, folder), "1 day", late="60 days")
    kept = {}

    def each(batch, number):
        kept.update({(r["start"], r["event_type"]): (r["n"], r["total"]) for r in batch.collect()})

    A.run(live, "", str(tmp_path / "cp"), mode="update", each=each)
    table = {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in A.windowed(A.events(spark.read.parquet(FILE)), "1 day").collect()}
    assert kept == table


def test_restart_goes_on(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    for _ in range(2):
        A.run(A.once(A.stream(spark, folder), "60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(FILE).count()


def test_dgim_bound():
    rng = random.Random(1)
    for window in (50, 500):
        d, bits = A.Dgim(window), []
        for _ in range(3000):
            bits.append(rng.random() < 0.4)
            d.add(bits[-1])
            true = sum(bits[-window:])
            assert abs(d.estimate() - true) <= max(1, true / 2)


def test_dgim_on_a_stream(spark, tmp_path):
    got = {}
    live = A.dgim_counts(A.stream(spark, _folder(spark, tmp_path)), window=1000)
    A.run(live, "", str(tmp_path / "cp"), mode="update", each=lambda b, n: got.update(map(tuple, b.collect())))
    want = {r["event_type"]: r["count"] for r in spark.read.parquet(FILE).groupBy("event_type").count().collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - min(want[k], 1000)) <= want[k] / 2 for k in got)


def test_sketch_is_near(spark):
    e = A.events(spark.read.parquet(FILE))
    for a, b in zip(A.distinct_users(e).orderBy("start").collect(), A.distinct_users(e, exact=True).orderBy("start").collect(), strict=True):
        assert abs(a["users"] - b["users"]) <= max(1, 0.05 * b["users"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a + b", 3, 0.25), (2, "c", 2, 0.5)], "size long, itemset string, n long, support double")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json_lines(df, str(tmp_path / "j"))
    sinks.write_itemset_report(df, str(tmp_path / "t"))
    sinks.write_document(df, str(tmp_path / "d"))
    with pytest.raises(ValueError):
        sinks.write_document(df, str(tmp_path / "e"), rows=1)
    rules = spark.createDataFrame([("a", "b", 0.2, 0.5, 1.25, 0.4, 0.4), ("b", "a + c", 0.1, 0.75, 2.0, 0.4, 0.1)], "antecedent string, consequent string, support double, confidence double, lift double, antecedent_support double, consequent_support double")
    sinks.write_rules_report(rules, str(tmp_path / "r"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[:3] == ["1. b \u2192 a + c", "   Support: 0.1000", "   Confidence: 0.7500"] and lines[7] == "2. a \u2192 b"
    assert sinks.read_csv(spark, str(tmp_path / "c")).count() == 2
    assert sinks.read_json(spark, str(tmp_path / "j"), df.schema.simpleString()[7:-1].replace(":", " ")).count() == 2
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a + b: 3 (0.2500)", "c: 2 (0.5000)"]
    assert spark.read.text(str(tmp_path / "d")).first()[0].startswith("[{")
    src = spark.read.parquet(FILE).groupBy("event_type").count()
    assert sorted(map(tuple, sinks.cached(src, str(tmp_path / "k")).collect())) == sorted(map(tuple, sinks.cached(src, str(tmp_path / "k")).collect()))
    assert len(list((tmp_path / "k").iterdir())) == 1


def test_cache_sees_a_replaced_file(spark, tmp_path):
    place = tmp_path / "in.parquet"
    spark.range(3).toPandas().to_parquet(place)
    assert sinks.cached(spark.read.parquet(str(place)), str(tmp_path / "k")).count() == 3
    spark.range(5).toPandas().to_parquet(place)
    spark.catalog.refreshByPath(str(place))
    assert sinks.cached(spark.read.parquet(str(place)), str(tmp_path / "k")).count() == 5


def _days(counts):
    """(day, events) as errors a minute apart; other kinds never count."""
    at = lambda d, i: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d, minutes=i)
    rows = [(d * 1000 + i, at(d, i), "error") for d, n in counts.items() for i in range(n)]
    return rows + [(10**6 + d, at(d, 3), "view") for d in range(12)]


ALERT_DAYS = {0: 70, 2: 70, 3: 70, 4: 60, 5: 70, 6: 59, 7: 61, 8: 100}


def test_alerts_after_gaps(spark):
    """A day without events and one below the limit arm again; one at the limit doesn't."""
    df = spark.createDataFrame(_days(ALERT_DAYS), "event_id long, ts timestamp, event_type string")
    assert [(r["start"].day - 1, r["n"]) for r in A.alerts(df, over=60).orderBy("start").collect()] == [(0, 70), (2, 70), (7, 61)]


def test_alert_stream(spark, tmp_path):
    """The stream's alerts table, over a restart, names the days that the table's alerts do."""
    df = spark.createDataFrame(_days(ALERT_DAYS), "event_id long, ts timestamp, event_type string")
    for part, cond in enumerate(("ts < '2024-01-04 00:30:00'", "ts >= '2024-01-04 00:30:00'")):
        df.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = A.alert_stream(A.stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string"), over=60)
        A.run(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["event_type"], r["start"].day - 1, r["n"]) for r in got] == [("error", 0, 61), ("error", 2, 61), ("error", 7, 61)]


def test_bloom_and_invertible_table(spark):
    keys = lambda ns: spark.createDataFrame([(n,) for n in ns], "item long")
    focus = keys(range(0, 3000, 3))
    bloom = A.bloom_filter(focus)
    hits = {r[0] for r in A.bloom_hits(keys([*range(3000), None]), bloom).collect()}
    assert set(range(0, 3000, 3)) <= hits and len(hits) < 1050 and bloom.count() <= A.BLOOM_BITS
    left, right = A.invertible_table(keys([*range(5000), 9001, 9002]), "item"), A.invertible_table(keys([*range(3, 5000), 8000]), "item")
    assert A.decode_difference(left, right) == ({0, 1, 2, 9001, 9002}, {8000}, True)
    assert not A.decode_difference(left, A.invertible_table(keys([]), "item"))[2]


def test_batches_are_segmented(spark, tmp_path):
    rows = [(i, float(i % 3) * 10, float(i % 3) + 0.01 * (i % 5)) for i in range(60)]
    spark.createDataFrame(rows, "id long, a double, b double").coalesce(1).write.parquet(str(tmp_path / "in"))
    A.segment_batches(A.stream(spark, str(tmp_path / "in"), "id long, a double, b double"), ("a", "b"), str(tmp_path / "out"), str(tmp_path / "cp"), k=3)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 60 and len({(r["a"], r["cluster"]) for r in got}) == 3 and got[0]["silhouette"] > 0.9


def test_rolling_mean(spark):
    from orderloom.operators.maintenance import rolling_mean

    df = spark.range(1, 8).select(F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    assert [r["rolling"] for r in rolling_mean(df, "t", "x").orderBy("t").collect()] == [None] * 4 + [3.0, 4.0, 5.0]
