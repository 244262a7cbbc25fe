"""Registered queries for online history and baselines (O-30..O-46).

O-40..O-46 judge every transaction by the baseline of its account's rows
before it (``operators.running``).  Only the upsert (O-39) has two states of
the baseline table: the one at a cutoff and the one at the end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.functions.calendar import online_calendar, ntz_lit
from riskspark.functions.rules import flag_array, risk_flag_rules
from riskspark.operators import baseline as bl
from riskspark.operators.running import running_baselines
from riskspark.plans.registry import r6, register
from riskspark.session import cut_lineage

E = A.EVENTS_TXN_SQL
T = f"t AS ({E})"
CUT = ("cut AS (SELECT date_trunc('hour', make_timestamp(CAST(epoch_us(min(ts)) + "
       "(epoch_us(max(ts)) - epoch_us(min(ts))) * 0.8 AS BIGINT))) AS c FROM t)")
OLD = "old AS (SELECT t.* FROM t, cut WHERE t.ts < cut.c)"
NEW = "new AS (SELECT t.* FROM t, cut WHERE t.ts >= cut.c)"


def _txn(spark, sf):
    return A.events_txn(spark, sf).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def _split(spark, sf):
    t = _txn(spark, sf)
    cut = bl.snapshot_cutoff(t)
    return t, t.filter(F.col("ts") < ntz_lit(cut)), t.filter(F.col("ts") >= ntz_lit(cut))


def baseline_sql(src: str) -> str:
    """DuckDB twin of ``user_baselines`` over relation ``src``."""
    return f"""
SELECT u.account AS user_id,
  CASE WHEN st.avg_amt IS NULL THEN 0.0 ELSE round(st.avg_amt, 2) END AS average_amount,
  CASE WHEN st.avg_amt IS NULL THEN 0.0 ELSE round(st.sd, 2) END AS transaction_std_dev,
  CASE WHEN st.avg_amt IS NULL THEN 0 ELSE CAST(trunc(coalesce(d.adc, 0)) AS BIGINT) END
    AS average_daily_transactions,
  coalesce(pm.v, '') AS preferred_payment_method, '' AS preferred_merchant_category,
  coalesce(uc.v, '') AS usual_city, u.hs AS active_hour_start, u.he AS active_hour_end,
  u.last_ts AS last_updated
FROM (SELECT account, coalesce(min(hour(ts)), 0) AS hs, coalesce(max(hour(ts)), 23) AS he,
             max(ts) AS last_ts FROM {src} GROUP BY account) u
LEFT JOIN (SELECT account, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount) AS avg_amt,
                  coalesce(stddev_pop(amount), 0) AS sd
           FROM {src} WHERE status = 'PENDING' GROUP BY account) st USING (account)
LEFT JOIN (SELECT account, avg(c) AS adc FROM
             (SELECT account, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS c
              FROM {src} WHERE status = 'PENDING' GROUP BY 1, 2) GROUP BY 1) d USING (account)
LEFT JOIN (SELECT account, v FROM
             (SELECT account, payment_channel AS v,
                     row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, payment_channel) AS rn
              FROM {src} GROUP BY 1, 2) WHERE rn = 1) pm USING (account)
LEFT JOIN (SELECT account, v FROM
             (SELECT account, CAST(location AS VARCHAR) AS v,
                     row_number() OVER (PARTITION BY account ORDER BY count(*) DESC,
                                        CAST(location AS VARCHAR)) AS rn
              FROM {src} WHERE location IS NOT NULL GROUP BY 1, 2) WHERE rn = 1) uc USING (account)
"""


HIST_SQL = """
hist AS (
  SELECT t.*,
    count(*) OVER (PARTITION BY account ORDER BY ts, row_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - count(*) OVER (PARTITION BY account ORDER BY epoch_us(ts)
                     RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000001 PRECEDING) AS velocity_1h,
    row_number() OVER (PARTITION BY account, merchant ORDER BY ts, row_id) > 1 AS merchant_seen,
    row_number() OVER (PARTITION BY account, location ORDER BY ts, row_id) > 1 AS location_seen,
    CASE WHEN row_number() OVER (PARTITION BY account ORDER BY ts, row_id) = 1 THEN 0.0
         ELSE (row_number() OVER (PARTITION BY account, merchant ORDER BY ts, row_id) - 1)
              / (row_number() OVER (PARTITION BY account ORDER BY ts, row_id) - 1) END
      AS merchant_frequency
  FROM t)"""


@register("o30_velocity_1h", f"WITH {T}, {HIST_SQL} SELECT row_id, velocity_1h FROM hist")
def o30(spark, sf):
    return bl.velocity_1h(A.events_txn(spark, sf)).select("row_id", "velocity_1h")


@register("o31_seen_before", f"""WITH {T}, {HIST_SQL}
SELECT row_id, merchant_seen, location_seen FROM hist""")
def o31(spark, sf):
    return bl.seen_before(A.events_txn(spark, sf), {"merchant_seen": "merchant",
                                                    "location_seen": "location"}).select(
        "row_id", "merchant_seen", "location_seen")


@register("o31_exists_lookup", f"""WITH {T}
SELECT row_id, account, merchant,
       EXISTS (SELECT 1 FROM t p WHERE p.account = t.account AND p.merchant = t.merchant
               AND (p.ts < t.ts OR (p.ts = t.ts AND p.row_id < t.row_id))) AS seen
FROM t""")
def o31b(spark, sf):
    t = A.events_txn(spark, sf).select("row_id", "account", "merchant", "ts")
    return bl.exists_lookup(t, t, ["account", "merchant"], as_of=["ts", "row_id"]).drop("ts")


@register("o32_merchant_frequency", f"""WITH {T}, {HIST_SQL}
SELECT row_id, {r6('merchant_frequency', 'merchant_frequency')} FROM hist""")
def o32(spark, sf):
    return bl.merchant_frequency(A.events_txn(spark, sf)).select("row_id", "merchant_frequency")


@register("o33_amount_stats", f"""WITH {T}
SELECT account, {r6('CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount)', 'average_amount')},
       {r6('coalesce(stddev_pop(amount), 0)', 'transaction_std_dev')}
FROM t WHERE status = 'PENDING' GROUP BY account""")
def o33(spark, sf):
    return bl.amount_stats(_txn(spark, sf))


@register("o34_avg_daily_count", f"""WITH {T}
SELECT account, {r6('avg(c)', 'average_daily_count')} FROM
  (SELECT account, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS c
   FROM t WHERE status = 'PENDING' GROUP BY 1, 2) GROUP BY account""")
def o34(spark, sf):
    return bl.avg_daily_count(A.events_txn(spark, sf))


@register("o35_preferred_method", f"""WITH {T}
SELECT account, v AS preferred_payment_method FROM
  (SELECT account, payment_channel AS v,
          row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, payment_channel) AS rn
   FROM t GROUP BY 1, 2) WHERE rn = 1""")
def o35(spark, sf):
    return bl.preferred_method(A.events_txn(spark, sf))


@register("o36_usual_city", f"""WITH {T}
SELECT account, v AS usual_city FROM
  (SELECT account, CAST(location AS VARCHAR) AS v,
          row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, CAST(location AS VARCHAR)) AS rn
   FROM t WHERE location IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def o36(spark, sf):
    t = A.events_txn(spark, sf).withColumn("location", F.col("location").cast("string"))
    return bl.usual_city(t)


@register("o37_active_hours", f"""WITH {T}
SELECT account, coalesce(min(hour(ts)), 0) AS active_hour_start,
       coalesce(max(hour(ts)), 23) AS active_hour_end FROM t GROUP BY account""")
def o37(spark, sf):
    return bl.active_hours(A.events_txn(spark, sf))


@register("o38_user_baselines", f"WITH {T} " + baseline_sql("t"))
def o38(spark, sf):
    return bl.user_baselines(_txn(spark, sf))


@register("o39_upsert_baselines", f"""WITH {T}, {CUT}, {OLD},
ob AS ({baseline_sql('old')}),
nb AS ({baseline_sql('t')} WHERE u.account IN (SELECT account FROM t, cut WHERE t.ts >= cut.c))
SELECT coalesce(nb.user_id, ob.user_id) AS user_id,
  CASE WHEN nb.user_id IS NOT NULL THEN nb.average_amount ELSE ob.average_amount END AS average_amount,
  CASE WHEN nb.user_id IS NOT NULL THEN nb.transaction_std_dev ELSE ob.transaction_std_dev END AS transaction_std_dev,
  CASE WHEN nb.user_id IS NOT NULL THEN nb.average_daily_transactions ELSE ob.average_daily_transactions END
    AS average_daily_transactions,
  CASE WHEN nb.user_id IS NOT NULL THEN nb.preferred_payment_method ELSE ob.preferred_payment_method END
    AS preferred_payment_method,
  '' AS preferred_merchant_category,
  CASE WHEN nb.user_id IS NOT NULL THEN nb.usual_city ELSE ob.usual_city END AS usual_city,
  CASE WHEN nb.user_id IS NOT NULL THEN nb.active_hour_start ELSE ob.active_hour_start END AS active_hour_start,
  CASE WHEN nb.user_id IS NOT NULL THEN nb.active_hour_end ELSE ob.active_hour_end END AS active_hour_end,
  CASE WHEN nb.user_id IS NOT NULL THEN nb.last_updated ELSE ob.last_updated END AS last_updated,
  CASE WHEN nb.user_id IS NOT NULL THEN 'new' ELSE 'old' END AS source
FROM ob FULL OUTER JOIN nb ON ob.user_id = nb.user_id""")
def o39(spark, sf):
    t, old, new = _split(spark, sf)
    active = new.select("account").distinct()
    fresh = bl.user_baselines(t.join(active, "account", "left_semi"))
    # each written first: a task of the upsert holds one row per user, not the sorts of both sides' parts
    return bl.upsert_baselines(cut_lineage(bl.user_baselines(old)), cut_lineage(fresh))


#: Per row the earlier rows of its account, one by one, and the baseline they
#: make: a plain self-join, independent of the prefix states it checks.
RUNNING = f"""WITH {T}, {HIST_SQL.strip()},
past AS (
  SELECT t.row_id AS k, p.*, CAST(CAST(p.amount AS DECIMAL(18,2)) * 100 AS HUGEINT) AS cents
  FROM t JOIN t p ON p.account = t.account AND (p.ts < t.ts OR (p.ts = t.ts AND p.row_id < t.row_id))),
stats AS (
  SELECT k, count(*) FILTER (status = 'PENDING') AS nv, sum(CAST(amount AS DECIMAL(18,2))) FILTER (status = 'PENDING') AS total,
    sum(cents) FILTER (status = 'PENDING') AS s, sum(cents * cents) FILTER (status = 'PENDING') AS s2,
    count(DISTINCT CAST(ts AS DATE)) FILTER (status = 'PENDING') AS days, min(hour(ts)) AS active_hour_start, max(hour(ts)) AS active_hour_end
  FROM past GROUP BY k),
methods AS (SELECT k, payment_channel AS v, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, payment_channel) AS rn
            FROM past GROUP BY k, payment_channel),
cities AS (SELECT k, CAST(location AS VARCHAR) AS v, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, CAST(location AS VARCHAR)) AS rn
           FROM past WHERE location IS NOT NULL GROUP BY k, location),
f AS (
  SELECT h.*, hour(h.ts) AS hour_of_day, s.k IS NOT NULL AS has_baseline,
    CASE WHEN s.k IS NULL THEN NULL WHEN nv = 0 THEN 0.0 ELSE round(CAST(total AS DOUBLE) / nv, 2) END AS average_amount,
    CASE WHEN s.k IS NULL THEN NULL WHEN nv = 0 THEN 0.0
         ELSE round(sqrt(CAST(nv * s.s2 - s.s * s.s AS DOUBLE)) / nv / 100, 2) END AS transaction_std_dev,
    CASE WHEN s.k IS NULL THEN NULL WHEN nv = 0 THEN 0 ELSE nv // days END AS average_daily_transactions,
    CASE WHEN s.k IS NOT NULL THEN coalesce(m.v, '') END AS preferred_payment_method,
    CASE WHEN s.k IS NOT NULL THEN coalesce(c.v, '') END AS usual_city, active_hour_start, active_hour_end
  FROM hist h LEFT JOIN stats s ON s.k = h.row_id LEFT JOIN methods m ON m.k = h.row_id AND m.rn = 1
  LEFT JOIN cities c ON c.k = h.row_id AND c.rn = 1),
g AS (
  SELECT f.*,
    CASE WHEN has_baseline AND average_amount <> 0
         THEN (amount - average_amount) / average_amount ELSE 0.0 END AS amount_deviation,
    CASE WHEN has_baseline AND transaction_std_dev > 0
         THEN (amount - average_amount) / transaction_std_dev ELSE 0.0 END AS amount_z_score,
    has_baseline AND coalesce(payment_channel <> preferred_payment_method, true) AS payment_method_changed,
    has_baseline AND coalesce(CAST(location AS VARCHAR) <> usual_city, true) AS outside_usual_city,
    has_baseline AND (hour_of_day < active_hour_start OR hour_of_day > active_hour_end)
      AS outside_active_hours
  FROM f)"""

FLAGS_SQL = """concat_ws('|',
      CASE WHEN abs(amount_z_score) >= 3 THEN 'AMOUNT_OUTLIER' END,
      CASE WHEN velocity_1h > 10 THEN 'HIGH_VELOCITY' END,
      CASE WHEN NOT merchant_seen THEN 'NEW_MERCHANT' END,
      CASE WHEN NOT location_seen THEN 'NEW_LOCATION' END,
      CASE WHEN payment_method_changed THEN 'PAYMENT_METHOD_CHANGED' END,
      CASE WHEN outside_usual_city THEN 'OUTSIDE_USUAL_CITY' END,
      CASE WHEN outside_active_hours THEN 'OUTSIDE_ACTIVE_HOURS' END)"""


def _running(spark, sf):
    f = running_baselines(_txn(spark, sf)).withColumn("hour_of_day", F.hour("ts"))
    return bl.change_flags(bl.baseline_deviation(f))


@register("o40_baseline_lookup", RUNNING + """
SELECT row_id, has_baseline, CAST(average_amount AS DOUBLE) AS average_amount, CAST(transaction_std_dev AS DOUBLE) AS transaction_std_dev,
  average_daily_transactions, preferred_payment_method, usual_city, active_hour_start, active_hour_end FROM g""")
def o40(spark, sf):
    return _running(spark, sf).select(
        "row_id", F.col("_has_baseline").alias("has_baseline"), "average_amount", "transaction_std_dev", "average_daily_transactions",
        "preferred_payment_method", "usual_city", "active_hour_start", "active_hour_end")


@register("o41_baseline_deviation", RUNNING + f"""
SELECT row_id, {r6('amount_deviation', 'amount_deviation')}, {r6('amount_z_score', 'amount_z_score')} FROM g""")
def o41(spark, sf):
    return _running(spark, sf).select("row_id", "amount_deviation", "amount_z_score")


@register("o42_change_flags", RUNNING + """
SELECT row_id, payment_method_changed, outside_usual_city, outside_active_hours FROM g""")
def o42(spark, sf):
    return _running(spark, sf).select(
        "row_id", "payment_method_changed", "outside_usual_city", "outside_active_hours")


@register("o43_online_calendar", f"""WITH {T}
SELECT row_id, hour(ts) AS hour_of_day, CAST(dayofweek(ts) AS BIGINT) AS day_of_week,
       month(ts) AS month, dayofweek(ts) IN (0, 6) AS is_weekend FROM t""")
def o43(spark, sf):
    return A.events_txn(spark, sf).select("row_id", *online_calendar("ts"))


@register("o44_risk_flags", RUNNING + f"""
SELECT row_id, {FLAGS_SQL} AS risk_flags FROM g""")
def o44(spark, sf):
    f = _running(spark, sf).select(
        "*", (~F.col("merchant_seen")).alias("new_merchant"), F.lit(False).alias("new_device"),
        (~F.col("location_seen")).alias("new_location"))
    return f.select("row_id", F.concat_ws("|", flag_array(risk_flag_rules())).alias("risk_flags"))


ONLINE_SQL = RUNNING + f"""
SELECT row_id, account AS user_id, round(CAST(amount AS DOUBLE), 6) AS amount,
  {r6('amount_deviation', 'amount_deviation')}, {r6('amount_z_score', 'amount_z_score')},
  velocity_1h, hour_of_day, CAST(dayofweek(ts) AS BIGINT) AS day_of_week, month(ts) AS month,
  dayofweek(ts) IN (0, 6) AS is_weekend, outside_active_hours,
  NOT has_baseline AS is_first_transaction, NOT merchant_seen AS new_merchant, false AS new_device,
  NOT location_seen AS new_location, payment_method_changed, outside_usual_city,
  {r6('merchant_frequency', 'merchant_frequency')},
  CAST(0.0 AS DOUBLE) AS device_trust_score, CAST(0.0 AS DOUBLE) AS merchant_trust_score,
  CAST(0.0 AS DOUBLE) AS location_risk_score, CAST(0.0 AS DOUBLE) AS time_since_last_transaction, {FLAGS_SQL} AS risk_flags
FROM g"""


def _online(spark, sf):
    return bl.running_online_features(_txn(spark, sf))


@register("o45_online_features", ONLINE_SQL)
def o45(spark, sf):
    f = _online(spark, sf)
    return f.withColumn("risk_flags", F.concat_ws("|", "risk_flags"))


@register("o46_model_input", RUNNING + f"""
SELECT row_id, round(CAST(amount AS DOUBLE), 6) AS amount, payment_channel,
  CAST(0.0 AS DOUBLE) AS time_since_last_transaction, CAST(velocity_1h AS DOUBLE) AS velocity_score,
  {r6('amount_z_score', 'spending_deviation_score')},
  CAST(NOT has_baseline AS BIGINT) AS is_first_transaction, hour_of_day AS hour,
  CAST(dayofweek(ts) AS BIGINT) AS day_of_week, month(ts) AS month,
  CAST(dayofweek(ts) IN (0, 6) AS BIGINT) AS is_weekend,
  CAST(0 AS BIGINT) AS is_cross_bank_transfer, CAST(0 AS BIGINT) AS is_cross_currency_transfer,
  CAST(NOT merchant_seen AS BIGINT) AS is_new_receiver, CAST(0 AS BIGINT) AS is_new_bank,
  CAST(payment_method_changed AS BIGINT) AS is_new_payment_format
FROM g""")
def o46(spark, sf):
    f = bl.running_online_features(_txn(spark, sf), keep=["payment_channel"])
    return bl.to_model_input(f, keep=["row_id"])
