"""Registered source/sink queries (O-01, O-02, O-04..O-07, O-09).

Each writes data derived from the driver tables into a folder under the
checkpoint directory and reads it back through the operator under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.functions.calendar import ntz_lit
from riskspark.operators import decide as dc
from riskspark.operators import features as feat
from riskspark.plans.q_features import FEATURE_ROW_SQL, feature_rows_query
from riskspark.plans.registry import r6, register
from riskspark.session import table_dir
from riskspark.sources import files

P = A.PREDICTIONS_SQL


def _dir(spark, sf, name):
    """A new folder for each call, so that a query can be run again."""
    return table_dir(spark, f"{name}_{uuid.uuid4().hex[:12]}")


def raw_transfer_frame(spark, sf):
    """Raw transfer rows (CSV layout) derived from ``ship_txn``."""
    t = A.ship_txn(spark, sf)
    return t.select(
        F.date_format("ts", "yyyy/MM/dd HH:mm").alias("Timestamp"),
        F.col("from_bank").cast("long").alias("From Bank"), F.col("account").cast("string").alias("Account"),
        F.col("to_bank").cast("long").alias("To Bank"), F.col("receiver").cast("string").alias("Account.1"),
        F.col("amount").alias("Amount Received"), F.col("receiving_currency").cast("string").alias("Receiving Currency"),
        F.col("amount").alias("Amount Paid"), F.col("payment_currency").cast("string").alias("Payment Currency"),
        F.col("payment_channel").alias("Payment Format"), F.col("is_fraud").alias("Is Laundering"))


@register("o01_raw_csv_scan", f"""
SELECT strftime(ts, '%Y/%m/%d %H:%M') AS "Timestamp", CAST(from_bank AS BIGINT) AS "From Bank",
       CAST(account AS VARCHAR) AS "Account", CAST(to_bank AS BIGINT) AS "To Bank",
       CAST(receiver AS VARCHAR) AS "Account.1", round(amount, 6) AS "Amount Received",
       CAST(receiving_currency AS VARCHAR) AS "Receiving Currency", round(amount, 6) AS "Amount Paid",
       CAST(payment_currency AS VARCHAR) AS "Payment Currency", payment_channel AS "Payment Format",
       CAST(is_fraud AS BIGINT) AS "Is Laundering"
FROM ({A.SHIP_TXN_SQL}) t""")
def o01(spark, sf):
    base = _dir(spark, sf, "raw_csv")
    raw = raw_transfer_frame(spark, sf)
    # two input files, as the dataset build reads several CSVs in order
    raw.where(F.col("Is Laundering") == 0).write.mode("overwrite").option("header", True).csv(f"{base}/a")
    raw.where(F.col("Is Laundering") == 1).write.mode("overwrite").option("header", True).csv(f"{base}/b")
    return files.read_raw_transfers(spark, [f"{base}/a", f"{base}/b"]).drop("source_file")


def _event_json(spark, sf, failed=None):
    """Bus messages: events as JSON; error events arrive truncated, and those
    that the SQL condition ``failed`` names have failed."""
    t = A.transactions(spark, sf).join(
        A.predictions(spark, sf).select("transaction_id", "fraud_probability"), "transaction_id")
    ev = t.select(
        "transaction_id", "user_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "amount",
        F.lit("USD").alias("currency"), F.lit("TRANSFER").alias("transaction_type"),
        "payment_method", "merchant", "location", "fraud_probability",
        (F.when(F.expr(failed), "FAILED").otherwise(F.col("status")) if failed else F.col("status")).alias("status"),
        F.lit(0).alias("retry_count"))
    js = F.to_json(F.struct(*ev.columns))
    bad = F.col("payment_method") == "error"
    return ev.select(F.when(bad, F.substring(js, 1, 25)).otherwise(js).alias("value"))


@register("o02_event_decode", f"""
SELECT transaction_id, t.user_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, round(t.amount, 6) AS amount,
       payment_method, merchant, t.location, round(p.fraud_probability, 6) AS fraud_probability, t.status,
       CAST(0 AS BIGINT) AS retry_count
FROM ({A.TRANSACTIONS_SQL}) t JOIN ({P}) p USING (transaction_id) WHERE payment_method <> 'error'""")
def o02(spark, sf):
    good, _ = files.decode_events(_event_json(spark, sf))
    return good.select("transaction_id", "user_id", "timestamp", "amount", "payment_method", "merchant",
                       "location", "fraud_probability", "status", "retry_count")


@register("o02_event_quarantine", f"""
SELECT count(*) AS quarantined FROM ({A.TRANSACTIONS_SQL}) t WHERE payment_method = 'error'""")
def o02b(spark, sf):
    _, bad = files.decode_events(_event_json(spark, sf))
    return bad.agg(F.count(F.lit(1)).alias("quarantined"))


@register("o04_parquet_roundtrip", f"""WITH f AS ({FEATURE_ROW_SQL})
SELECT {', '.join(feat.FEATURE_COLUMNS)} FROM f""")
def o04(spark, sf):
    path = _dir(spark, sf, "features_parquet")
    files.write_parquet(feature_rows_query(spark, sf), path)
    return files.read_parquet(spark, path, feat.FEATURE_COLUMNS)


@register("o05_feature_csv_export")
def o05(spark, sf):
    from riskspark.plans.q_online import _online

    path = _dir(spark, sf, "features_csv")
    online = _online(spark, sf).withColumnRenamed("row_id", "transaction_id").withColumn(
        "user_id", F.col("user_id").cast("string"))
    frame = files.feature_csv_frame(online)
    frame.write.mode("overwrite").option("header", True).csv(path)
    return spark.read.option("header", True).csv(path)


@register("o06_fan_out", f"""
SELECT 'review_queue' AS sink, transaction_id, {r6('fraud_probability', 'fraud_probability')}
FROM ({P}) p WHERE decision = 'REVIEW'
UNION ALL SELECT 'alerts', transaction_id, round(fraud_probability, 6) FROM ({P}) p WHERE decision = 'BLOCK'""")
def o06(spark, sf):
    base = _dir(spark, sf, "fan_out")
    pred = A.predictions(spark, sf)

    def to_review(df):
        dc.route(df)[0].write.mode("overwrite").parquet(f"{base}/review_queue")

    def to_alerts(df):
        dc.route(df)[1].write.mode("overwrite").parquet(f"{base}/alerts")

    files.fan_out(pred, [to_review, to_alerts])
    r = spark.read.parquet(f"{base}/review_queue").select(F.lit("review_queue").alias("sink"), "transaction_id",
                                                          "fraud_probability")
    a = spark.read.parquet(f"{base}/alerts").select(F.lit("alerts").alias("sink"), "transaction_id",
                                                    "fraud_probability")
    return r.unionByName(a)


TOPIC_SQL = f"""WITH m AS (SELECT CAST(user_id AS VARCHAR) AS key, transaction_id, created_at,
  CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 8 AS part FROM ({P}) p)
SELECT key, transaction_id, coalesce(part, 0) AS "partition",
       row_number() OVER (PARTITION BY coalesce(part, 0) ORDER BY created_at, transaction_id) - 1 AS "offset" FROM m"""


def topic_places(messages):
    """Where each prediction's message stands (as ``TOPIC_SQL``)."""
    return messages.select("key", F.get_json_object("value", "$.transaction_id").alias("transaction_id"),
                           "partition", "offset")


@register("o07_publish")
def o07(spark, sf):
    """Two calls, of the earlier and the later half of the time: the second continues the offsets."""
    base = _dir(spark, sf, "bus")
    p = A.predictions(spark, sf).drop("risk_flags")
    lo, hi = p.agg(F.min("created_at"), F.max("created_at")).first()
    late = F.col("created_at") >= ntz_lit(lo + (hi - lo) / 2) if lo else F.lit(False)
    for half in (p.where(~late), p.where(late)):
        files.publish(half, "user_id", "transactions.raw", base, order=["created_at", "transaction_id"])
    return spark.read.schema("key string, value string, offset long, partition int").json(f"{base}/transactions.raw")


@register("o07_topic_offsets", TOPIC_SQL)
def o07_offsets(spark, sf):
    return topic_places(o07(spark, sf))


@register("o09_prediction_log", f"""
SELECT strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, transaction_id,
       {r6('fraud_probability', 'fraud_probability')}, {r6('confidence', 'confidence')}, prediction
FROM ({P}) p""")
def o09(spark, sf):
    path = _dir(spark, sf, "prediction_log")
    pred = A.predictions(spark, sf)
    files.prediction_log_frame(pred, ["transaction_id", "user_id", "amount"]).write.mode("overwrite").json(path)
    log = files.read_prediction_log(spark, path)
    return log.select("timestamp", F.col("transaction")["transaction_id"].alias("transaction_id"),
                      "prediction.fraud_probability", "prediction.confidence", "prediction.prediction")
