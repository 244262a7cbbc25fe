"""Sources and sinks: CSV export layout, keyed messages, topic replay,
prediction log round trip, reliable checkpoints."""

import json

from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.plans import q_sources, q_streaming
from riskspark.session import cut_lineage
from riskspark.sources import files
from tests.conftest import SF001


def test_feature_csv_export_layout(spark):
    out = q_sources.o05(spark, SF001)
    assert out.columns == [h for h, _ in files.FEATURE_CSV_COLUMNS]
    flags = [r.RiskFlags for r in out.select("RiskFlags").collect() if r.RiskFlags]
    assert all("," not in f for f in flags)


def test_published_messages_are_keyed_json(spark):
    msgs = q_sources.o07(spark, SF001)
    rows = msgs.limit(20).collect()
    for r in rows:
        body = json.loads(r.value)
        assert body["user_id"] == r.key
    assert msgs.count() == A.predictions(spark, SF001).count()


def test_topic_stream_replays_all_messages(spark):
    out = q_streaming.o08(spark, SF001)
    assert out.count() == A.predictions(spark, SF001).count()


def test_event_decode_quarantines_truncated_messages(spark):
    good = q_sources.o02(spark, SF001).count()
    bad = q_sources.o02b(spark, SF001).first()[0]
    errors = A.events_txn(spark, SF001).where(F.col("payment_channel") == "error").count()
    assert bad == errors and good + bad == A.events_txn(spark, SF001).count()


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and df.count() == 10
    assert spark.sparkContext.getCheckpointDir()
