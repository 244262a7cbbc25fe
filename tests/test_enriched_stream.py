"""O-72: keyed state gives every row the baseline that the batch scan gives it,
a fitted model scores inside the micro-batch, and batches commit as a whole."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.operators import baseline as bl
from riskspark.operators import decide as dc
from riskspark.operators import train as tr
from riskspark.plans import q_streaming as q
from riskspark.sources import files
from riskspark.streaming import jobs
from tests.conftest import SF001


def vectors(df):
    return {r["row_id"]: r.asDict() for r in df.drop("ts", "payment_channel").collect()}


def test_stream_equals_batch_with_nulls(spark):
    rows = []
    for i in range(120):
        at = None if i == 7 else datetime(2024, 3, 1) + timedelta(minutes=17 * i)
        amount = None if i % 13 == 5 else Decimal(100 + (i * 37) % 400) / 100 * (-1 if i % 29 == 3 else 1)
        rows.append((i, None if i % 17 == 0 else i % 3, at, amount, ("card", "wire", None)[i % 3], ("m1", "m2")[i % 2], (i % 4) or None,
                     "PENDING" if i % 5 else "DONE"))
    t = spark.createDataFrame(rows, "row_id long, account long, ts timestamp_ntz, amount decimal(18,2), payment_channel string, "
                                    "merchant string, location long, status string")
    base = q._fresh(spark, "nulls")
    schema = q._stage(t, f"{base}/in")
    s = jobs.enrich_stream(jobs.file_stream(spark, f"{base}/in", schema, max_files=q.FILES))
    jobs.run_available_now(s, f"{base}/out", f"{base}/ckpt")
    got, want = vectors(spark.read.parquet(f"{base}/out")), vectors(bl.running_online_features(t))
    timed = {r[0] for r in rows if r[2] is not None}
    assert got.keys() == want.keys()
    # rows without a time come first in the batch order and last in the stream
    nothing_timeless = [k for k in timed if not any(r[2] is None and r[1] == rows[k][1] for r in rows)]
    assert len(nothing_timeless) > 30
    for k in nothing_timeless:
        assert {c: pytest.approx(v) if isinstance(v, float) else v for c, v in want[k].items()} == got[k]


def test_fitted_model_scores_in_the_stream(spark):
    t = A.events_txn(spark, SF001).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    features = bl.running_online_features(t, keep=["payment_channel", "ts", "is_fraud"])
    x = bl.to_model_input(features, keep=["row_id", "is_fraud"])
    model = tr.gbt_pipeline(weight=None, maxIter=3, maxDepth=3).fit(x)
    base = q._fresh(spark, "fitted")
    q.enriched(spark, SF001, lambda rows: tr.score(model, rows), base, slices=3)
    got = {r["transaction_id"]: r["fraud_probability"] for r in files.read_committed(spark, base, "predictions").collect()}
    want = {str(r["row_id"]): r["p"] for r in tr.score(model, x).select("row_id", F.round("raw_probability", 4).alias("p")).collect()}
    assert got == want and len(set(got.values())) > 1
    assert spark.read.option("header", True).csv(f"{base}/features_csv").count() == len(got)


def test_a_batch_that_fails_between_sinks_shows_in_none(spark, monkeypatch):
    base, calls, records = q._fresh(spark, "fails"), [], dc.anomaly_records

    def fails_once(d):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the sink is away")
        return records(d)

    monkeypatch.setattr(dc, "anomaly_records", fails_once)
    with pytest.raises(StreamingQueryException):
        q.enriched(spark, SF001, q.linear_score, base, slices=3)
    seen = {sink: {r["transaction_id"] for r in files.read_committed(spark, base, sink).collect()} for sink in ("scored", "predictions", "anomalies")}
    n = A.events_txn(spark, SF001).count()
    assert seen["scored"] == seen["predictions"] == seen["anomalies"] and 0 < len(seen["scored"]) < n
    s = jobs.enrich_stream(jobs.file_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, max_files=q.FILES))
    jobs.run_foreach_batch(s, jobs.enriched_batch_writer(base, q.linear_score), f"{base}/ckpt")
    for sink in seen:
        ids = [r["transaction_id"] for r in files.read_committed(spark, base, sink).collect()]
        assert len(ids) == len(set(ids)) == n


def test_first_result_and_expired_state(spark):
    day = datetime(2024, 5, 1)
    rows = [(1, "a", day), (2, "a", day + timedelta(hours=1)), (3, "b", day + timedelta(hours=2)), (4, "a", day + timedelta(hours=25)),
            (5, "a", day + timedelta(hours=26)), (6, "c", day + timedelta(hours=200)), (7, "d", day + timedelta(hours=400))]
    base = q._fresh(spark, "expire")
    schema = "row_id long, k string, ts timestamp_ntz"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    s = jobs.file_stream(spark, f"{base}/in", spark.createDataFrame(rows, schema).schema, max_files=1)
    s = jobs.anchored_window_stream(s, "k", "ts", 86400, 1, ["row_id", "k"], ["row_id"], result="row_id", delay="1 minute")
    query = (s.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/out")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r["row_id"]: (r["allowed"], r["result"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: (True, "1"), 2: (False, "1"), 3: (True, "3"), 4: (True, "4"), 5: (False, "4"), 6: (True, "6"), 7: (True, "7")}
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 3, "only the last window and its timer stay"


def test_feature_stream_survives_nulls(spark):
    from riskspark.operators import features as feat

    t = A.events_txn(spark, SF001).withColumns({
        "amount": F.when(F.col("row_id") % 11 != 3, F.col("amount"))})
    base = q._fresh(spark, "nulls70")
    schema = q._stage(t, f"{base}/in")
    jobs.run_available_now(jobs.account_feature_stream(jobs.file_stream(spark, f"{base}/in", schema, max_files=q.FILES)), f"{base}/out", f"{base}/ckpt")
    got = {r["row_id"]: r for r in spark.read.parquet(f"{base}/out").collect()}
    for w in feat.feature_rows(t, A.EVENTS_TIE, keep=["row_id"]).collect():
        g = got[w["row_id"]]
        for c in ("spending_deviation_score", "time_since_last_transaction"):
            assert g[c] == (None if w[c] is None else pytest.approx(w[c], abs=1e-9)), (w["row_id"], c)
