"""Registered queries for scoring, decisions and routing (O-50..O-60)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions.calendar import ntz_lit

from riskspark import adapters as A
from riskspark.operators import baseline as bl
from riskspark.operators import decide as dc
from riskspark.plans.q_features import FEATURE_ROW_SQL, feature_rows_query
from riskspark.plans.q_online import CUT, T
from riskspark.plans.registry import r6, register

E = A.EVENTS_TXN_SQL
P = A.PREDICTIONS_SQL
MAP_SQL = ("CASE payment_channel WHEN 'CARD' THEN 'Credit Card' WHEN 'NET_BANKING' THEN 'Wire' "
           "WHEN 'UPI' THEN 'ACH' WHEN 'WALLET' THEN 'Cash' ELSE payment_channel END")


@register("o50_channel_encoding", f"""WITH {T}, {CUT},
lab AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM
          (SELECT DISTINCT {MAP_SQL} AS label FROM t, cut WHERE t.ts < cut.c AND payment_channel <> 'login'))
SELECT row_id, CAST(coalesce(lab.code, 0) AS BIGINT) AS payment_channel_code
FROM t LEFT JOIN lab ON {MAP_SQL} = lab.label""")
def o50(spark, sf):
    t = A.events_txn(spark, sf)
    cut = bl.snapshot_cutoff(t)
    train = t.filter((F.col("ts") < ntz_lit(cut)) & (F.col("payment_channel") != "login"))
    return dc.encode_labels(t, dc.fit_labels(train)).select("row_id", "payment_channel_code")


def _raw(spark, sf):
    return A.events_txn(spark, sf).withColumn("raw_probability", A.raw_score())


RAW = f"SELECT *, {A.RAW_SCORE_SQL} AS raw_probability FROM ({E}) t"


@register("o52_score_outputs", f"""
SELECT row_id, round(raw_probability, 4) AS fraud_probability,
       round(greatest(raw_probability, 1 - raw_probability), 4) AS confidence,
       raw_probability >= 0.5 AS prediction, CAST(0.5 AS DOUBLE) AS threshold FROM ({RAW}) r""")
def o52(spark, sf):
    return dc.score_outputs(_raw(spark, sf)).select(
        "row_id", "fraud_probability", "confidence", "prediction", "threshold")


DEC = """CASE WHEN round(raw_probability, 4) >= 0.7 THEN 'BLOCK'
              WHEN round(raw_probability, 4) >= 0.3 THEN 'REVIEW' ELSE 'ALLOW' END"""


@register("o53_decision", f"""
SELECT row_id, round(raw_probability, 4) AS fraud_probability, {DEC} AS decision FROM ({RAW}) r""")
def o53(spark, sf):
    return dc.decide(dc.score_outputs(_raw(spark, sf))).select("row_id", "fraud_probability", "decision")


@register("o54_final_fraud_flag", f"""
SELECT row_id, (raw_probability >= 0.5) OR ({DEC} = 'BLOCK') AS is_fraud_final FROM ({RAW}) r""")
def o54(spark, sf):
    d = dc.decide(dc.score_outputs(_raw(spark, sf)))
    return d.select("row_id", "is_fraud_final")


@register("o55_reason_codes", f"""WITH f AS ({FEATURE_ROW_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  coalesce(nullif(concat_ws('|',
    CASE WHEN amount > 50000 THEN 'HIGH_TRANSACTION_AMOUNT' END,
    CASE WHEN velocity_score > 0.8 THEN 'HIGH_TRANSACTION_VELOCITY' END,
    CASE WHEN spending_deviation_score > 0.8 THEN 'UNUSUAL_SPENDING_PATTERN' END,
    CASE WHEN is_first_transaction = 1 THEN 'FIRST_TRANSACTION' END,
    CASE WHEN is_new_receiver = 1 THEN 'NEW_RECEIVER' END,
    CASE WHEN is_new_bank = 1 THEN 'NEW_BANK' END,
    CASE WHEN is_cross_bank_transfer = 1 THEN 'CROSS_BANK_TRANSFER' END,
    CASE WHEN is_cross_currency_transfer = 1 THEN 'CROSS_CURRENCY_TRANSFER' END,
    CASE WHEN is_new_payment_format = 1 THEN 'NEW_PAYMENT_FORMAT' END,
    CASE WHEN hour >= 0 AND hour <= 5 THEN 'ODD_TRANSACTION_HOUR' END), ''),
    'NO_SIGNIFICANT_RISK_SIGNALS') AS reason_codes
FROM f""")
def o55(spark, sf):
    f = dc.with_reason_codes(feature_rows_query(spark, sf))
    return f.select(*A.SHIP_TIE, F.concat_ws("|", "reason_codes").alias("reason_codes"))


@register("o56_prediction_records", f"""
SELECT transaction_id, user_id, {r6('fraud_probability', 'fraud_probability')},
       {r6('confidence', 'confidence')}, prediction OR decision = 'BLOCK' AS prediction, decision,
       CAST(0.5 AS DOUBLE) AS threshold,
       '2.0.0' AS model_version, array_to_string(risk_flags, '|') AS risk_flags, created_at FROM ({P}) p""")
def o56(spark, sf):
    r = dc.prediction_records(A.predictions(spark, sf))
    return r.withColumn("risk_flags", F.concat_ws("|", "risk_flags"))


@register("o56_anomaly_records", f"""
SELECT transaction_id, {r6('fraud_probability', 'anomaly_score')}, decision AS anomaly_type,
       'gbt' AS model_name, '2.0.0' AS model_version, '' AS explanation,
       created_at AS detected_at FROM ({P}) p""")
def o56b(spark, sf):
    return dc.anomaly_records(A.predictions(spark, sf))


@register("o57_review_queue", f"""
SELECT transaction_id, {r6('fraud_probability', 'fraud_probability')}, 'PENDING' AS status, created_at
FROM ({P}) p WHERE decision = 'REVIEW'""")
def o57(spark, sf):
    return dc.route(A.predictions(spark, sf))[0]


@register("o57_alerts", f"""
SELECT transaction_id, {r6('fraud_probability', 'fraud_probability')}, 'HIGH_RISK' AS alert_type, created_at
FROM ({P}) p WHERE decision = 'BLOCK'""")
def o57b(spark, sf):
    return dc.route(A.predictions(spark, sf))[1]


@register("o58_retry_route", f"""
SELECT row_id, error_kind, CAST(retry_count AS BIGINT) AS retry_count,
  CASE WHEN error_kind IS NULL THEN 'PROCESSED' WHEN error_kind = 'PERMANENT' THEN 'DROPPED'
       WHEN retry_count < 3 THEN 'RETRY' ELSE 'DLQ' END AS route,
  CAST(CASE WHEN error_kind = 'RETRYABLE' AND retry_count < 3 THEN retry_count + 1
       ELSE retry_count END AS BIGINT) AS next_retry_count
FROM ({A.FAILED_EVENTS_SQL}) f""")
def o58(spark, sf):
    return dc.retry_route(A.failed_events(spark, sf))


@register("o60_model_assignment", f"""
SELECT transaction_id, CASE WHEN CAST('0x' || substr(md5(transaction_id), 1, 8) AS BIGINT) % 100 < 90
       THEN 'model_v2' ELSE 'model_v3' END AS model_id FROM ({P}) p""")
def o60(spark, sf):
    p = A.predictions(spark, sf)
    return dc.assign_model(p, "transaction_id", {"model_v2": 90, "model_v3": 10},
                           "model_v2").select("transaction_id", "model_id")
