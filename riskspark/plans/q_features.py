"""Registered queries for the past-only feature operators (O-10..O-26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.functions.calendar import seconds_between
from riskspark.operators import features as feat
from riskspark.plans.prior import prior_scan
from riskspark.plans.registry import r6, register

E = A.EVENTS_TXN_SQL
S = A.SHIP_TXN_SQL
EV_ORDER = "ts, row_id"
SH_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey"
SH_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _prior_sql(base: str, order: str, firsts: tuple[str, ...] = ()) -> str:
    """DuckDB twin of ``prior_scan``: plain windows over the whole account."""
    rn = "".join(
        f",\n    row_number() OVER (PARTITION BY account, {x} ORDER BY {order}) AS rn_{x}"
        for x in firsts)
    return f"""
WITH t AS ({base}),
s AS (
  SELECT t.*,
    count(*) OVER wp AS prior_n,
    lag(ts) OVER w AS prev_ts,
    count(amount) OVER wp AS pnv,
    sum(CAST(amount AS DECIMAL(18,2))) OVER wp AS psum,
    avg(amount) OVER wp AS pmean,
    stddev_samp(amount) OVER wp AS psd{rn}
  FROM t
  WINDOW w AS (PARTITION BY account ORDER BY {order}),
         wp AS (PARTITION BY account ORDER BY {order}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


TSLT_SQL = "coalesce(greatest(0.0, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6), 0.0)"
Z_SQL = "CASE WHEN pnv < 2 THEN 0.0 ELSE (amount - pmean) / greatest(psd, 1.0) END"
CAL_SQL = ("hour(ts) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, "
           "month(ts) AS month, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend")


@register("o10_velocity_prior", _prior_sql(E, EV_ORDER) + """
SELECT row_id, account, prior_n AS velocity_score FROM s""")
def o10(spark, sf):
    return feat.velocity_prior(A.events_txn(spark, sf), A.EVENTS_TIE).select(
        "row_id", "account", "velocity_score")


@register("o11_is_first_transaction", _prior_sql(E, EV_ORDER) + """
SELECT row_id, CAST(prior_n = 0 AS BIGINT) AS is_first_transaction FROM s""")
def o11(spark, sf):
    return feat.velocity_prior(A.events_txn(spark, sf), A.EVENTS_TIE).select(
        "row_id", "is_first_transaction")


@register("o12_time_since_last", _prior_sql(E, EV_ORDER) + f"""
SELECT row_id, {r6(TSLT_SQL, 'time_since_last_transaction')} FROM s""")
def o12(spark, sf):
    return feat.time_since_last(A.events_txn(spark, sf), A.EVENTS_TIE).select(
        "row_id", "time_since_last_transaction")


@register("o13_running_mean_std", _prior_sql(E, EV_ORDER) + f"""
SELECT row_id, {r6('coalesce(CAST(psum AS DOUBLE) / pnv, 0.0)', 'prior_mean')},
       {r6('CASE WHEN pnv < 2 THEN 1.0 ELSE greatest(psd, 1.0) END', 'prior_std')} FROM s""")
def o13(spark, sf):
    txn = A.events_txn(spark, sf).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return feat.running_amount_stats(txn, A.EVENTS_TIE).select(
        "row_id", "prior_mean", "prior_std")


@register("o14_spending_zscore", _prior_sql(E, EV_ORDER) + f"""
SELECT row_id, {r6(Z_SQL, 'spending_deviation_score')} FROM s""")
def o14(spark, sf):
    return feat.spending_zscore(A.events_txn(spark, sf), A.EVENTS_TIE).select(
        "row_id", "spending_deviation_score")


@register("o15_is_new_receiver", _prior_sql(E, EV_ORDER, ("receiver",)) + """
SELECT row_id, CAST(rn_receiver = 1 AS BIGINT) AS is_new_receiver FROM s""")
def o15(spark, sf):
    return feat.first_seen(A.events_txn(spark, sf), A.EVENTS_TIE,
                           {"is_new_receiver": "receiver"}).select("row_id", "is_new_receiver")


@register("o16_is_new_bank", _prior_sql(S, SH_ORDER, ("to_bank",)) + f"""
SELECT {SH_KEYS}, CAST(rn_to_bank = 1 AS BIGINT) AS is_new_bank FROM s""")
def o16(spark, sf):
    return feat.first_seen(A.ship_txn(spark, sf), A.SHIP_TIE,
                           {"is_new_bank": "to_bank"}).select(*A.SHIP_TIE, "is_new_bank")


@register("o17_is_new_payment_format", _prior_sql(E, EV_ORDER, ("payment_channel",)) + """
SELECT row_id, CAST(rn_payment_channel = 1 AS BIGINT) AS is_new_payment_format FROM s""")
def o17(spark, sf):
    return feat.first_seen(A.events_txn(spark, sf), A.EVENTS_TIE,
                           {"is_new_payment_format": "payment_channel"}).select(
        "row_id", "is_new_payment_format")


@register("o18_cross_flags", f"""
SELECT {SH_KEYS}, CAST(from_bank <> to_bank AS BIGINT) AS is_cross_bank_transfer,
       CAST(payment_currency <> receiving_currency AS BIGINT) AS is_cross_currency_transfer
FROM ({S}) t""")
def o18(spark, sf):
    return feat.cross_flags(A.ship_txn(spark, sf)).select(
        *A.SHIP_TIE, "is_cross_bank_transfer", "is_cross_currency_transfer")


@register("o19_calendar", f"SELECT row_id, {CAL_SQL} FROM ({E}) t")
def o19(spark, sf):
    return feat.calendar_features(A.events_txn(spark, sf)).select(
        "row_id", "hour", "day_of_week", "month", "is_weekend")


def _feature_row_sql(fmt) -> str:
    return _prior_sql(S, SH_ORDER, ("receiver", "to_bank", "payment_channel")) + f"""
SELECT {SH_KEYS}, {fmt('amount', 'amount')}, payment_channel,
       {fmt(TSLT_SQL, 'time_since_last_transaction')},
       prior_n AS velocity_score,
       {fmt(Z_SQL, 'spending_deviation_score')},
       CAST(prior_n = 0 AS BIGINT) AS is_first_transaction,
       {CAL_SQL},
       CAST(is_fraud AS BIGINT) AS is_fraud,
       CAST(from_bank <> to_bank AS BIGINT) AS is_cross_bank_transfer,
       CAST(payment_currency <> receiving_currency AS BIGINT) AS is_cross_currency_transfer,
       CAST(rn_receiver = 1 AS BIGINT) AS is_new_receiver,
       CAST(rn_to_bank = 1 AS BIGINT) AS is_new_bank,
       CAST(rn_payment_channel = 1 AS BIGINT) AS is_new_payment_format
FROM s"""


FEATURE_ROW_SQL = _feature_row_sql(r6)
# unrounded twin, for queries that aggregate feature rows further
FEATURE_ROW_RAW_SQL = _feature_row_sql(lambda e, a: f"CAST({e} AS DOUBLE) AS {a}")


def feature_rows_query(spark, sf, **kw):
    return feat.feature_rows(A.ship_txn(spark, sf), A.SHIP_TIE, keep=A.SHIP_TIE, **kw)


register("o20_feature_rows", FEATURE_ROW_SQL)(feature_rows_query)


@register("o21_is_new_currency", _prior_sql(S, SH_ORDER, ("payment_currency",)) + f"""
SELECT {SH_KEYS}, CAST(rn_payment_currency = 1 AS BIGINT) AS is_new_currency FROM s""")
def o21(spark, sf):
    return feat.first_seen(A.ship_txn(spark, sf), A.SHIP_TIE,
                           {"is_new_currency": "payment_currency"}).select(
        *A.SHIP_TIE, "is_new_currency")


@register("o22_full_history", _prior_sql(E, EV_ORDER) + f""",
h AS (SELECT account, avg(amount) AS havg, stddev_samp(amount) AS hsd FROM t GROUP BY account)
SELECT row_id, prior_n + 1 AS velocity_full_history,
       {r6('coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1e6, 0.0)', 'time_since_last_full_history')},
       {r6('''coalesce(CASE WHEN amount - havg = 0 AND coalesce(hsd, 1.0) = 0 THEN 0.0
                ELSE (amount - havg) / coalesce(hsd, 1.0) END, 0.0)''',
           'spending_deviation_full_history')}
FROM s JOIN h USING (account)""")
def o22(spark, sf):
    return feat.full_history_features(A.events_txn(spark, sf), A.EVENTS_TIE).select(
        "row_id", "velocity_full_history", "time_since_last_full_history",
        "spending_deviation_full_history")


@register("o23_missing_history", _prior_sql(E, EV_ORDER) + f"""
SELECT row_id, CAST(prev_ts IS NULL AS BIGINT) AS is_first_transaction,
       {r6('coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1e6, -1.0)', 'time_since_last_transaction')}
FROM s""")
def o23(spark, sf):
    s = prior_scan(A.events_txn(spark, sf), "account", ["ts", *A.EVENTS_TIE])
    s = s.withColumn("time_since_last_transaction", seconds_between(F.col("_prev_t"), F.col("ts")))
    return feat.missing_history_encoding(s).select(
        "row_id", "is_first_transaction", "time_since_last_transaction")


@register("o24_training_projection", f"""
SELECT {SH_KEYS}, round(amount, 6) AS amount, payment_channel AS transaction_type,
       CAST(to_bank AS VARCHAR) AS merchant_category,
       CAST(receiving_currency AS VARCHAR) AS location,
       CAST(from_bank AS VARCHAR) AS device_used, payment_channel, {CAL_SQL},
       CAST(is_fraud AS BIGINT) AS target
FROM ({S}) t""")
def o24(spark, sf):
    return feat.training_projection(A.ship_txn(spark, sf), keep=A.SHIP_TIE)


@register("o25_drop_columns", """
SELECT account, ts, round(amount, 6) AS amount, payment_channel, merchant,
       CAST(is_fraud AS BIGINT) AS is_fraud
FROM (""" + A.LEGACY_TXN_SQL + """) t""")
def o25(spark, sf):
    return feat.drop_columns(A.legacy_txn(spark, sf))


@register("o26_parse_timestamps", """
SELECT row_id,
       coalesce(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S'),
                try_strptime(ts_text, '%Y/%m/%d %H:%M')) AS parsed_ts,
       CAST(coalesce(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S'),
                     try_strptime(ts_text, '%Y/%m/%d %H:%M')) IS NULL AS BIGINT) AS parse_failed
FROM (""" + A.RAW_TS_SQL + """) t""")
def o26(spark, sf):
    from riskspark.functions.calendar import parse_timestamp
    parsed = parse_timestamp("ts_text", ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm"))
    return A.raw_ts_text(spark, sf).select(
        "row_id", parsed.alias("parsed_ts"),
        parsed.isNull().cast("bigint").alias("parse_failed"))
