"""Null keys, groups and times; the retry loop; brokers that are not there."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.operators import splits as sp
from riskspark.operators.windows import anchored_windows
from riskspark.plans import q_dashboard, q_sources
from riskspark.plans.prior import prior_scan
from riskspark.sources import files
from riskspark.streaming import jobs

SF001 = "/root/testdata/sf0.001"


def test_null_classes_stay_in_splits_and_samples(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "k long, y int")
    s = sp.stratified_split(df, "y", ["k"])
    assert s.count() == 100 and s.where("y is null").groupBy("split").count().count() == 3
    assert sp.stratified_sample(df, "y", ["k"], 50).where("y is null").count() == 5


def test_hot_null_key_is_split_and_exact(spark):
    rows = [(i, None if i % 5 < 3 else i % 7, float(i % 13), i % 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "t long, a long, v double, x long")
    out = prior_scan(df, "a", ["t"], value="v", firsts=("x",), chunk_rows=100)
    got = {r["t"]: r for r in out.collect()}
    seen, firsts = {}, set()
    for t, a, v, x in rows:
        r = got[t]
        assert r["_prior_n"] == len(seen.get(a, [])) and r["_first_x"] == ((a, x) not in firsts)
        if seen.get(a):
            assert r["_prior_mean"] == pytest.approx(sum(seen[a]) / len(seen[a]))
        seen.setdefault(a, []).append(v)
        firsts.add((a, x))


def test_anchored_windows_with_null_and_unique_keys(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, None, t0 + dt.timedelta(seconds=10 * i)) for i in range(20)]
    rows += [(100 + i, f"k{i}", t0) for i in range(50)]
    out = anchored_windows(spark.createDataFrame(rows, "row_id long, k string, ts timestamp_ntz"), "k", "ts", ["row_id"], 60, 3)
    assert out.columns == ["row_id", "k", "ts", "window_start", "count_in_window", "allowed"]
    got = {r["row_id"]: r for r in out.collect()}
    assert len(got) == 70
    for i in range(20):
        assert got[i]["count_in_window"] == i % 6 + 1 and got[i]["allowed"] == (i % 6 < 3)
    assert all(got[100 + i]["count_in_window"] == 1 for i in range(50))


def test_retries_end_in_the_dead_letter_queue(spark, tmp_path):
    event = ('{{"transaction_id":"{0}","user_id":"u","timestamp":"{1}","amount":1.5,"merchant":"m","currency":"USD",'
             '"fraud_probability":0.9,"status":"{2}","retry_count":{3}}}')
    values = [event.format(1, "2026-01-01T00:00:00Z", "FAILED", 0), event.format(2, "2026-01-01T00:00:00.123456Z", "PENDING", 0),
              event.format(3, "junk", "PENDING", 0), event.format(4, "2026-01-01T00:00:00Z", "FAILED", 2), "not json"]
    spark.createDataFrame([("k", v) for v in values], "key string, value string").write.json(str(tmp_path / "in"))
    s = spark.readStream.schema("key string, value string").json(str(tmp_path / "in"))
    rounds = jobs.run_with_retries(spark, s, str(tmp_path / "out"))
    e = F.from_json("value", files.EVENT_SCHEMA)
    read = lambda here, sink: sorted((r["e"]["transaction_id"], r["e"]["retry_count"], r["e"]["merchant"], r["e"]["timestamp"] is not None)
                                     for r in spark.read.schema("key string, value string").json(f"{here}/{sink}").select(e.alias("e")).collect())
    assert [read(h, "retry") for h in rounds] == [[("1", 1, "m", True), ("4", 3, "m", True)], [("1", 2, "m", True)], [("1", 3, "m", True)], []]
    assert [x for h in rounds for x in read(h, "dlq")] == [("4", 3, "m", True), ("1", 3, "m", True)]
    assert [r["transaction_id"] for r in spark.read.parquet(f"{rounds[0]}/alerts").collect()] == ["2"]
    good, bad = jobs.decision_stream(spark.createDataFrame([(v,) for v in values], "value string"))
    assert good.count() == 3 and {r["reason"] for r in bad.collect()} == {"BAD_TIMESTAMP", "UNDECODABLE"}


def test_a_named_broker_needs_its_connector(spark, tmp_path):
    df = spark.range(3)
    if files.kafka_available(spark):
        pytest.skip("the connector is there")
    with pytest.raises(RuntimeError):
        files.publish(df, "id", "t", str(tmp_path), bootstrap="broker:9092")
    with pytest.raises(RuntimeError):
        files.read_topic_stream(spark, "t", str(tmp_path), bootstrap="broker:9092")


def test_queries_run_twice_alike_and_lookup_is_pushed(spark):
    assert q_sources.o07(spark, SF001).count() == q_sources.o07(spark, SF001).count() == A.predictions(spark, SF001).count()
    plan = q_dashboard.o83(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_id,4242)" in plan
