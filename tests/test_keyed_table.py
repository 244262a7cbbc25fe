"""The keyed table: buckets rewritten, replays, half-written batches."""

import pytest
from pyspark.sql import functions as F

from riskspark.operators import baseline as bl
from riskspark.plans import q_streaming as q
from riskspark.sources.keyed_table import KeyedTable
from riskspark.streaming import jobs


def rows_of(table):
    return sorted((r["k"], r["v"]) for r in table.read().collect())


def test_merge_rewrites_only_touched_buckets_and_replays_change_nothing(spark):
    t = KeyedTable(spark, q._fresh(spark, "keyed"), "k", 8)
    assert t.read() is None and t.manifest() is None
    first = spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    assert len(t.merge(first, 0)) == 8
    change = spark.createDataFrame([(5, "new"), (1000, "new")], "k long, v string")
    touched = t.merge(change, 1)
    assert 1 <= len(touched) <= 2
    want = sorted([(k, "new" if k == 5 else "old") for k in range(100)] + [(1000, "new")])
    assert rows_of(t) == want
    assert {b for b, w in t.manifest().items() if w == 1} == set(touched)
    assert t.merge(change.withColumn("v", F.lit("replayed")), 1) == [] and rows_of(t) == want


def test_a_batch_without_its_manifest_shows_nowhere(spark):
    t = KeyedTable(spark, q._fresh(spark, "keyed"), "k", 4)
    t.merge(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string"), 0)
    before = sorted(map(str, t.read().collect()))
    spark.createDataFrame([(1, "half")], "k long, v string").withColumn("bucket", t.bucket()).write.partitionBy("bucket").parquet(f"{t.path}/data/wrote=1")
    assert sorted(map(str, t.read().collect())) == before
    t.merge(spark.createDataFrame([(1, "whole"), (None, "m")], "k long, v string"), 1)
    assert sorted(map(str, (r["v"] for r in t.read().collect()))) == ["b", "m", "whole"]


def test_upserted_baselines_equal_those_of_all_rows(spark):
    t = q.A.events_txn(spark, "/root/testdata/sf0.001").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    base = q._fresh(spark, "upsert")
    write = jobs.baseline_upsert_writer(base, buckets=4)
    parts = [t.where(F.col("row_id") % 3 == i) for i in range(3)]
    for i in (0, 1, 1, 2, 0):  # replays among them
        write(parts[i], i)
    got = KeyedTable(spark, f"{base}/baselines", "user_id", 4).read()
    want = bl.user_baselines(t)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_unseen_channel_scores_as_code_zero(spark):
    from riskspark.operators import train as tr

    cols = ", ".join(f"{c} double" for c in tr.NUMERIC_FEATURES) + ", payment_channel string, is_fraud int"
    rows = [tuple([float(i % 7)] * len(tr.NUMERIC_FEATURES)) + (("a", "b", "c")[i % 3], int(i % 3 == 0)) for i in range(60)]
    model = tr.gbt_pipeline(weight=None, maxIter=2, maxDepth=2).fit(spark.createDataFrame(rows, cols))
    probe = [tuple([1.0] * len(tr.NUMERIC_FEATURES)) + (ch, 0) for ch in ("a", "never seen", None, "c")]
    got = [r for r in tr.score(model, spark.createDataFrame(probe, cols)).select("payment_channel", "raw_probability").collect()]
    assert [r[0] for r in got] == ["a", "never seen", None, "c"]
    assert got[0][1] == got[1][1] == got[2][1] and got[3][1] != pytest.approx(got[0][1])
