"""Registered dataset queries: validation, splits, profiling
(O-03, O-110..O-116, O-140..O-150)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.functions.rules import feature_range_rules
from riskspark.operators import features as feat
from riskspark.operators import profile as pf
from riskspark.operators import splits as sp
from riskspark.operators import validate as va
from riskspark.plans.q_features import FEATURE_ROW_RAW_SQL, feature_rows_query
from riskspark.plans.registry import r6, register

E = A.EVENTS_TXN_SQL
FR = f"fr AS ({FEATURE_ROW_RAW_SQL})"
NUMERIC = ("amount", "time_since_last_transaction", "velocity_score", "spending_deviation_score",
           "hour", "is_new_receiver")


def _features(spark, sf):
    return feature_rows_query(spark, sf)


@register("o03_request_validation", f"""
SELECT row_id, {r6('amount', 'amount')}, payment_channel, concat_ws('|',
  CASE WHEN amount IS NULL THEN 'MISSING_AMOUNT' END,
  CASE WHEN amount < 0.01 THEN 'AMOUNT_BELOW_MIN' END,
  CASE WHEN amount > 100000000.0 THEN 'AMOUNT_ABOVE_MAX' END,
  CASE WHEN payment_channel IS NULL THEN 'MISSING_CHANNEL' END,
  CASE WHEN NOT (payment_channel IN ('CARD', 'UPI', 'NET_BANKING', 'WALLET')) THEN 'UNSUPPORTED_CHANNEL' END)
  AS rejection_codes
FROM ({A.REQUESTS_SQL}) r
WHERE amount IS NULL OR amount < 0.01 OR amount > 100000000.0 OR payment_channel IS NULL
   OR NOT (payment_channel IN ('CARD', 'UPI', 'NET_BANKING', 'WALLET'))""")
def o03(spark, sf):
    _, rejected = va.validate_requests(A.requests(spark, sf))
    return rejected.withColumn("rejection_codes", F.concat_ws("|", "rejection_codes"))


#: The 70/15/15 split by class in md5 order: 0.30 off, then half of it.
SPLIT_SQL = f"""sp AS (
SELECT *, CASE WHEN pos < n - rest THEN 'train' WHEN pos < n - CAST(ceil(0.5::DOUBLE * rest) AS BIGINT) THEN 'valid'
               ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42|' || row_id), row_id) - 1 AS pos,
             count(*) OVER (PARTITION BY is_fraud) AS n,
             CAST(ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY is_fraud)) AS BIGINT) AS rest FROM ({E}) t) q)"""


@register("o110_stratified_split", f"WITH {SPLIT_SQL} SELECT row_id, is_fraud, split FROM sp")
def o110(spark, sf):
    t = A.events_txn(spark, sf)
    return sp.stratified_split(t, "is_fraud", ["row_id"]).select("row_id", "is_fraud", "split")


@register("o111_chronological_split", f"""
WITH p AS (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) - 1 AS pos, count(*) OVER () AS n FROM ({E}) t)
SELECT row_id, CASE WHEN pos < floor(n * 0.7) THEN 'train'
                    WHEN pos < floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS split FROM p""")
def o111(spark, sf):
    return sp.chronological_split(A.events_txn(spark, sf), ["ts", "row_id"]).select("row_id", "split")


@register("o112_stratified_sample", f"""
WITH c AS (SELECT is_fraud, count(*) AS n, 1000 * count(*)::DOUBLE / sum(count(*)) OVER () AS exact FROM ({E}) t GROUP BY is_fraud),
q AS (SELECT is_fraud, floor(exact) + CAST(row_number() OVER (ORDER BY exact - floor(exact) DESC, is_fraud)
             <= 1000 - sum(floor(exact)) OVER () AS BIGINT) AS quota FROM c),
p AS (SELECT row_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42|' || row_id), row_id) AS pos
      FROM ({E}) t)
SELECT row_id, p.is_fraud FROM p JOIN q ON p.is_fraud = q.is_fraud WHERE pos <= quota""")
def o112(spark, sf):
    t = A.events_txn(spark, sf)
    return sp.stratified_sample(t, "is_fraud", ["row_id"], 1000).select("row_id", "is_fraud")


EXPECTED = (*feat.FEATURE_COLUMNS, "transaction_id")


@register("o113_column_report", f"""WITH {FR}, n AS (SELECT count(*) AS n FROM fr),
z AS (UNPIVOT (SELECT {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in feat.FEATURE_COLUMNS)} FROM fr)
      ON {', '.join(feat.FEATURE_COLUMNS)} INTO NAME col VALUE nulls)
SELECT col AS column, CASE {' '.join(f"WHEN col = '{c}' THEN '{t}'" for c, t in
  [('amount', 'double'), ('payment_channel', 'string'), ('time_since_last_transaction', 'double'),
   ('spending_deviation_score', 'double'), ('velocity_score', 'bigint')])} ELSE 'int' END AS dtype,
  true AS present, true AS expected, nulls AS null_count, {r6('nulls * 100.0 / n', 'null_pct')} FROM z, n
UNION ALL SELECT 'transaction_id', NULL, false, true, NULL, NULL""")
def o113(spark, sf):
    return va.column_report(_features(spark, sf).select(*feat.FEATURE_COLUMNS), EXPECTED)


@register("o113_file_validation", f"""WITH {FR},
g AS (SELECT is_fraud, count(*) AS c FROM fr GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c) FILTER (WHERE is_fraud = 1) AS BIGINT) AS positives,
       CAST(sum(c) FILTER (WHERE is_fraud = 0) AS BIGINT) AS negatives,
       {r6('sum(c) FILTER (WHERE is_fraud = 1) / sum(c)', 'positive_ratio')},
       CAST(sum(c - 1) AS BIGINT) AS duplicates, {r6('sum(c - 1) * 100.0 / sum(c)', 'duplicate_pct')}
FROM (SELECT {', '.join(feat.FEATURE_COLUMNS)}, count(*) AS c FROM fr GROUP BY ALL) x""")
def o113b(spark, sf):
    return va.dataset_report(_features(spark, sf).select(*feat.FEATURE_COLUMNS), "is_fraud")


@register("o114_split_integrity", f"""WITH {SPLIT_SQL}
SELECT true AS schemas_equal, count(*) FILTER (WHERE split = 'train') AS train,
       count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'test') AS test,
       count(*) AS total, true AS counts_add_up FROM sp""")
def o114(spark, sf):
    t = A.events_txn(spark, sf)
    s = sp.stratified_split(t, "is_fraud", ["row_id"]).persist()
    parts = {k: s.where(F.col("split") == k).drop("split") for k in ("train", "valid", "test")}
    r = va.schema_integrity(parts, t)
    s.unpersist()
    return spark.createDataFrame(
        [(r["schemas_equal"], r["counts"]["train"], r["counts"]["valid"], r["counts"]["test"],
          r["total"], r["counts_add_up"])],
        "schemas_equal boolean, train long, valid long, test long, total long, counts_add_up boolean")


@register("o115_content_checksum")
def o115(spark, sf):
    return va.content_checksum(_features(spark, sf))


def _rule_sql():
    conds = {
        "BAD_HOUR": "NOT (hour BETWEEN 0 AND 23)", "BAD_DAY_OF_WEEK": "NOT (day_of_week BETWEEN 0 AND 6)",
        "BAD_MONTH": "NOT (month BETWEEN 1 AND 12)",
        "NEGATIVE_TIME_SINCE_LAST": "time_since_last_transaction < 0",
        "NEGATIVE_VELOCITY": "velocity_score < 0",
        "BAD_AMOUNT": "amount IS NULL OR amount < 0 OR isnan(amount) OR abs(amount) = 'inf'::DOUBLE",
    }
    for f in ["is_first_transaction", "is_weekend", "is_cross_bank_transfer", "is_cross_currency_transfer",
              "is_new_receiver", "is_new_bank", "is_new_payment_format"]:
        conds[f"BAD_{f.upper()}"] = f"NOT ({f} IN (0, 1))"
    return " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER (WHERE {v}) AS violations FROM fr"
                              for k, v in conds.items())


RANGE_RULE_SQL = _rule_sql()


@register("o116_range_checks", f"WITH {FR} {RANGE_RULE_SQL}")
def o116(spark, sf):
    return va.range_checks(_features(spark, sf))


@register("o140_column_profile", f"WITH {FR} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS null_pct, "
    f"count(DISTINCT {c}) AS distinct, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
    f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM fr" for c in NUMERIC))
def o140(spark, sf):
    return pf.column_profile(_features(spark, sf), NUMERIC)


@register("o141_duplicate_rows", f"""WITH {FR}
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates, {r6('sum(c - 1) * 100.0 / sum(c)', 'duplicate_pct')}
FROM (SELECT {', '.join(feat.FEATURE_COLUMNS)}, count(*) AS c FROM fr GROUP BY ALL) x""")
def o141(spark, sf):
    return pf.duplicate_rows(_features(spark, sf).select(*feat.FEATURE_COLUMNS))


@register("o142_value_counts", f"""WITH {FR}
SELECT payment_channel, count(*) AS count, {r6('count(*) / sum(count(*)) OVER ()', 'share')}
FROM fr GROUP BY payment_channel""")
def o142(spark, sf):
    return pf.value_counts(_features(spark, sf), "payment_channel")


@register("o143_grouped_describe", f"""WITH {FR}
SELECT is_fraud, count(amount) AS count, {r6('avg(amount)', 'mean')}, {r6('stddev_samp(amount)', 'std')},
       {r6('min(amount)', 'min')}, {r6('max(amount)', 'max')},
       {r6('quantile_cont(amount, 0.25)', 'p25')}, {r6('quantile_cont(amount, 0.5)', 'p50')},
       {r6('quantile_cont(amount, 0.75)', 'p75')} FROM fr GROUP BY is_fraud""")
def o143(spark, sf):
    return pf.grouped_describe(_features(spark, sf), "is_fraud", "amount", list(A.SHIP_TIE))


@register("o144_fraud_by_channel", f"""WITH {FR}
SELECT payment_channel, count(*) AS count, CAST(sum(is_fraud) AS BIGINT) AS fraud, {r6('sum(is_fraud) / count(*)', 'fraud_rate')}
FROM fr GROUP BY payment_channel ORDER BY fraud_rate DESC""")
def o144(spark, sf):
    return pf.fraud_by_channel(_features(spark, sf))


@register("o145_hour_class_pivot", f"""WITH {FR}
SELECT hour, count(*) FILTER (WHERE is_fraud = 0) AS legit, count(*) FILTER (WHERE is_fraud = 1) AS fraud,
       {r6('count(*) FILTER (WHERE is_fraud = 1) / count(*)', 'fraud_rate')} FROM fr GROUP BY hour""")
def o145(spark, sf):
    return pf.hour_class_pivot(_features(spark, sf))


FLAGS = ("is_new_receiver", "is_new_bank", "is_new_payment_format", "is_cross_bank_transfer",
         "is_cross_currency_transfer", "is_first_transaction")


@register("o146_flag_rates", f"WITH {FR} " + " UNION ALL ".join(
    f"SELECT '{f}' AS flag, round(avg({f}) FILTER (WHERE is_fraud = 0), 6) AS class_0, "
    f"round(avg({f}) FILTER (WHERE is_fraud = 1), 6) AS class_1 FROM fr" for f in FLAGS))
def o146(spark, sf):
    return pf.flag_rates(_features(spark, sf), FLAGS)


@register("o147_log_histogram", f"""WITH {FR},
r AS (SELECT min(log10(amount + 1)) AS lo, max(log10(amount + 1)) AS hi FROM fr),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((log10(amount + 1) - lo) * 50.0 / (hi - lo)), 49) END
                  AS INTEGER) AS bin, lo, hi FROM fr, r WHERE amount IS NOT NULL)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS count, {r6('min(lo) + bin * ((min(hi) - min(lo)) / 50)', 'lo')}
FROM b GROUP BY bin""")
def o147(spark, sf):
    return pf.log_histogram(_features(spark, sf), "amount")


def _corr(a, b):
    return f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


@register("o148_correlations", f"WITH {FR} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r6(_corr(a, b), 'corr')} FROM fr" for a, b in PAIRS))
def o148(spark, sf):
    return pf.correlations(_features(spark, sf), NUMERIC)


@register("o148_label_correlations", f"WITH {FR} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(_corr(c, 'is_fraud'), 'corr')} FROM fr" for c in NUMERIC))
def o148b(spark, sf):
    return pf.label_correlations(_features(spark, sf), NUMERIC, "is_fraud")


@register("o149_overview", f"""WITH {FR}
SELECT count(*) AS rows, count(*) FILTER (WHERE is_fraud = 1) AS fraud, count(*) FILTER (WHERE is_fraud = 0) AS legit,
       {r6('count(*) FILTER (WHERE is_fraud = 1) / count(*)', 'fraud_ratio')}, CAST(15 AS BIGINT) AS features FROM fr""")
def o149(spark, sf):
    return pf.overview(_features(spark, sf).select(*feat.FEATURE_COLUMNS), "is_fraud")


@register("o150_split_comparison", f"""WITH {SPLIT_SQL},
ch AS (SELECT is_fraud, row_number() OVER (ORDER BY ts, row_id) - 1 AS pos, count(*) OVER () AS n FROM ({E}) t),
u AS (SELECT 'stratified' AS strategy, split, is_fraud FROM sp
      UNION ALL SELECT 'chronological', CASE WHEN pos < floor(n * 0.7) THEN 'train'
        WHEN pos < floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END, is_fraud FROM ch)
SELECT strategy, split, count(*) AS rows, {r6('avg(is_fraud)', 'fraud_ratio')} FROM u GROUP BY strategy, split""")
def o150(spark, sf):
    t = A.events_txn(spark, sf)
    strat = sp.stratified_split(t, "is_fraud", ["row_id"])
    chrono = sp.chronological_split(t, ["ts", "row_id"])
    parts = {}
    for name, df in (("stratified", strat), ("chronological", chrono)):
        for k in ("train", "valid", "test"):
            parts[(name, k)] = df.where(F.col("split") == k)
    return pf.split_comparison(parts, "is_fraud")
