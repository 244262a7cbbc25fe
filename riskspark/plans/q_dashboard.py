"""Registered dashboard and risk-queue queries (O-80..O-89)."""

from __future__ import annotations

from riskspark import adapters as A
from riskspark.operators import dashboard as db
from riskspark.operators import decide as dc
from riskspark.plans.registry import r6, register

P = A.PREDICTIONS_SQL
COLS = ("transaction_id, user_id, {fp}, {cf}, prediction, decision, threshold, model_version, "
        "created_at, {am}, payment_channel, location, status, is_fraud, "
        "array_to_string(risk_flags, '|') AS risk_flags").format(
    fp=r6("fraud_probability", "fraud_probability"), cf=r6("confidence", "confidence"),
    am=r6("amount", "amount"))


def _flat(df):
    from pyspark.sql import functions as F

    return df.withColumn("risk_flags", F.concat_ws("|", "risk_flags"))


def _pred(spark, sf):
    return A.predictions(spark, sf)


@register("o80_dashboard_summary", f"""
SELECT count(*) AS total_transactions, count(*) FILTER (WHERE prediction) AS fraudulent,
       count(*) FILTER (WHERE decision = 'REVIEW') AS review,
       count(*) FILTER (WHERE decision = 'ALLOW') AS allowed,
       coalesce(((20000 * count(*) FILTER (WHERE prediction) + count(*)) // (2 * count(*))) / 100.0, 0)
         AS fraud_rate
FROM ({P}) p""")
def o80(spark, sf):
    return db.summary(_pred(spark, sf))


@register("o81_hourly_trend", f"""
SELECT date_trunc('hour', created_at) AS hour_start, count(*) AS count,
       strftime(date_trunc('hour', created_at), '%H:00') AS hour
FROM ({P}) p GROUP BY 1""")
def o81(spark, sf):
    return db.hourly_trend(_pred(spark, sf))


@register("o82_predictions_newest_first", f"SELECT {COLS} FROM ({P}) p ORDER BY created_at DESC")
def o82(spark, sf):
    return _flat(db.newest_first(_pred(spark, sf)))


@register("o83_prediction_by_id", f"SELECT {COLS} FROM ({P}) p WHERE transaction_id = '4242'")
def o83(spark, sf):
    return _flat(db.by_transaction_id(A.predictions(spark, sf, row_id=4242), "4242"))


@register("o84_recent_20", f"""
SELECT {COLS} FROM ({P}) p ORDER BY created_at DESC, transaction_id LIMIT 20""")
def o84(spark, sf):
    return _flat(db.recent(_pred(spark, sf), 20))


@register("o84_pending_20", f"""
SELECT {COLS} FROM ({P}) p WHERE status = 'PENDING' ORDER BY created_at DESC, transaction_id LIMIT 20""")
def o84b(spark, sf):
    return _flat(db.recent(_pred(spark, sf), 20, status="PENDING"))


@register("o85_decision_distribution", f"""
WITH c AS (SELECT decision, count(*) AS count FROM ({P}) p
           WHERE decision IN ('ALLOW', 'REVIEW', 'BLOCK') GROUP BY decision)
SELECT decision, count,
       ((2000 * count + (SELECT sum(count) FROM c)) // (2 * (SELECT sum(count) FROM c))) / 10.0 AS percent
FROM c""")
def o85(spark, sf):
    return db.decision_distribution(_pred(spark, sf))


@register("o86_risk_queue", f"SELECT {COLS} FROM ({P}) p WHERE decision IN ('REVIEW', 'BLOCK')")
def o86(spark, sf):
    return _flat(db.risk_queue(_pred(spark, sf)))


@register("o86_risk_queue_counts", f"""
SELECT count(*) FILTER (WHERE decision IN ('REVIEW', 'BLOCK')) AS all_risk,
       count(*) FILTER (WHERE decision = 'REVIEW') AS review,
       count(*) FILTER (WHERE decision = 'BLOCK') AS block FROM ({P}) p""")
def o86b(spark, sf):
    return db.risk_queue_counts(_pred(spark, sf))


@register("o87_search", f"""
SELECT {COLS} FROM ({P}) p WHERE decision = 'REVIEW' AND (
  contains(lower(transaction_id), 'outl') OR contains(lower(user_id), 'outl')
  OR len(list_filter(risk_flags, lambda f: contains(lower(f), 'outl'))) > 0)""")
def o87(spark, sf):
    return _flat(db.search(_pred(spark, sf), "OUTL", "REVIEW"))


@register("o88_sorted_page", f"""
SELECT {COLS} FROM ({P}) p
ORDER BY fraud_probability DESC, created_at DESC, transaction_id LIMIT 10 OFFSET 20""")
def o88(spark, sf):
    return _flat(db.sorted_page(_pred(spark, sf), "fraud_probability", ascending=False, page=3))


@register("o88_page_count", f"SELECT CAST(greatest(1, ceil(count(*) / 10)) AS BIGINT) AS pages FROM ({P}) p")
def o88b(spark, sf):
    return db.page_count(_pred(spark, sf))


@register("o89_review_queue_scan", f"""
SELECT transaction_id, {r6('fraud_probability', 'fraud_probability')}, 'PENDING' AS status, created_at
FROM ({P}) p WHERE decision = 'REVIEW' ORDER BY created_at DESC""")
def o89(spark, sf):
    review, _ = dc.route(_pred(spark, sf))
    return db.review_queue_scan(review)
