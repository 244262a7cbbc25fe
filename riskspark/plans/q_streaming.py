"""Registered streaming queries (O-08, O-59, O-70..O-76).

Each call stages its input as time-ordered files in a fresh folder under
the checkpoint directory, runs the stream with ``availableNow`` (several
micro-batches), and returns the sink it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskspark.functions.calendar import ntz_lit

from riskspark import adapters as A
from riskspark.plans.q_features import CAL_SQL, EV_ORDER, TSLT_SQL, Z_SQL, _prior_sql
from riskspark.functions.rules import NO_REASON
from riskspark.plans.q_online import FLAGS_SQL, RUNNING, baseline_sql
from riskspark.plans.q_sources import TOPIC_SQL, topic_places
from riskspark.plans.registry import r6, register, round6
from riskspark.session import cut_lineage, table_dir
from riskspark.sources import files
from riskspark.sources.keyed_table import KeyedTable
from riskspark.streaming import jobs

E = A.EVENTS_TXN_SQL
SLICES = 4
#: Events that fail whenever they are processed (the tables have none).
FAILED = "CAST(transaction_id AS BIGINT) % 17 = 0"
#: Files of a slice, and of a micro-batch.
FILES = 8


def _fresh(spark, name):
    return table_dir(spark, f"stream_{name}_{uuid.uuid4().hex[:12]}")


def _stage(df, path, ts="ts", slices=SLICES):
    """Write ``df`` in ``slices`` steps in time order, ``FILES`` files each,
    so the file source replays them oldest first."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        df.write.mode("append").parquet(path)
        return df.schema
    span = (hi - lo) / slices
    for i in range(slices):
        a, b = lo + span * i, lo + span * (i + 1)
        inside = F.col(ts) >= ntz_lit(a)
        # rows without a time come last
        inside = inside & (F.col(ts) < ntz_lit(b)) if i < slices - 1 else inside | F.col(ts).isNull()
        df.where(inside).repartition(FILES).write.mode("append").parquet(path)
    return df.schema


def _run(stream, base, mode="append"):
    jobs.run_available_now(stream, f"{base}/out", f"{base}/ckpt", mode)
    return stream.sparkSession.read.parquet(f"{base}/out")


EVENT_FEATURE_SQL = _prior_sql(E, EV_ORDER, ("receiver", "to_bank", "payment_channel")) + f"""
SELECT row_id, round(amount, 6) AS amount, payment_channel, {r6(TSLT_SQL, 'time_since_last_transaction')},
       prior_n AS velocity_score, {r6(Z_SQL, 'spending_deviation_score')},
       CAST(prior_n = 0 AS BIGINT) AS is_first_transaction, {CAL_SQL}, CAST(is_fraud AS BIGINT) AS is_fraud,
       CAST(from_bank <> to_bank AS BIGINT) AS is_cross_bank_transfer, CAST(0 AS BIGINT) AS is_cross_currency_transfer,
       CAST(rn_receiver = 1 AS BIGINT) AS is_new_receiver, CAST(rn_to_bank = 1 AS BIGINT) AS is_new_bank,
       CAST(rn_payment_channel = 1 AS BIGINT) AS is_new_payment_format
FROM s"""


def stream_features(spark, sf):
    base = _fresh(spark, "features")
    schema = _stage(A.events_txn(spark, sf), f"{base}/in")
    s = jobs.file_stream(spark, f"{base}/in", schema, max_files=FILES)
    return _run(jobs.account_feature_stream(s), base)


@register("o70_stream_features", EVENT_FEATURE_SQL)
def o70(spark, sf):
    return stream_features(spark, sf)


@register("o74_drift_accumulators", f"""WITH f AS ({EVENT_FEATURE_SQL})
SELECT payment_channel, count(*) AS n, round(sum(amount), 6) AS sum_amount, CAST(sum(velocity_score) AS BIGINT) AS sum_velocity,
       round(sum(spending_deviation_score), 6) AS sum_deviation FROM f GROUP BY payment_channel""")
def o74(spark, sf):
    base = _fresh(spark, "drift")
    schema = _stage(A.events_txn(spark, sf), f"{base}/in")
    feats = jobs.account_feature_stream(jobs.file_stream(spark, f"{base}/in", schema, max_files=FILES))
    # accumulate the features as emitted at 6 places (the twin sums the same values)
    feats = feats.withColumn("spending_deviation_score", round6(F.col("spending_deviation_score")))
    agg = jobs.drift_accumulators(feats)

    def overwrite(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/state_table")

    jobs.run_foreach_batch(agg, overwrite, f"{base}/ckpt", mode="complete")
    return spark.read.parquet(f"{base}/state_table")


def _messages(spark, sf, base):
    """Stage the bus messages by event time; undecodable (truncated)
    messages carry no id and are staged with the earliest slice."""
    from riskspark.plans.q_sources import _event_json

    t = A.transactions(spark, sf).select("transaction_id", "ts")
    first = t.agg(F.min("ts")).first()[0]
    staged = (_event_json(spark, sf, FAILED)
              .withColumn("transaction_id", F.get_json_object("value", "$.transaction_id"))
              .join(t, "transaction_id", "left")
              .select("value", F.coalesce(F.col("ts"), ntz_lit(first)).alias("ts")))
    _stage(cut_lineage(staged), f"{base}/in")  # joined once, not for each slice
    return jobs.file_stream(spark, f"{base}/in", "value string, ts timestamp_ntz", max_files=FILES)


@register("o71_decision_stream", f"""
SELECT 'review_queue' AS sink, transaction_id, {r6('fraud_probability', 'fraud_probability')}
FROM ({A.PREDICTIONS_SQL}) p WHERE decision = 'REVIEW' AND payment_channel <> 'error' AND NOT {FAILED}
UNION ALL SELECT 'alerts', transaction_id, round(fraud_probability, 6)
FROM ({A.PREDICTIONS_SQL}) p WHERE decision = 'BLOCK' AND payment_channel <> 'error' AND NOT {FAILED}
UNION ALL SELECT sink, transaction_id, round(fraud_probability, 6) FROM ({A.PREDICTIONS_SQL}) p,
  (VALUES ('retry_1'), ('retry_2'), ('retry_3'), ('dlq_3')) s(sink) WHERE payment_channel <> 'error' AND {FAILED}""")
def o71(spark, sf):
    base = _fresh(spark, "decisions")
    rounds = jobs.run_with_retries(spark, _messages(spark, sf, base), f"{base}/sinks")
    out = None
    for here in rounds:
        for sink in ("review_queue", "alerts"):
            rows = spark.read.parquet(f"{here}/{sink}").select(F.lit(sink).alias("sink"), "transaction_id",
                                                               "fraud_probability")
            out = rows if out is None else out.unionByName(rows)
        for sink in ("retry", "dlq"):  # the event as it was sent on
            e = F.from_json("value", files.EVENT_SCHEMA)
            rows = (spark.read.schema("key string, value string").json(f"{here}/{sink}").select(e.alias("e"))
                    .select(F.concat(F.lit(f"{sink}_"), F.col("e.retry_count")).alias("sink"),
                            "e.transaction_id", "e.fraud_probability"))
            out = out.unionByName(rows)
    return out


@register("o75_decision_counters", f"""
WITH e AS (SELECT *, {FAILED} AS failed FROM ({A.PREDICTIONS_SQL}) p WHERE payment_channel <> 'error')
SELECT 'decision_' || decision AS counter, count(*) AS count FROM e WHERE NOT failed GROUP BY decision
UNION ALL SELECT 'consumed', count(*) FROM e
UNION ALL SELECT 'retry', count(*) FROM e WHERE failed HAVING count(*) > 0""")
def o75(spark, sf):
    base = _fresh(spark, "counters")
    d, _ = jobs.decision_stream(_messages(spark, sf, base))

    def overwrite(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/counts")

    jobs.run_foreach_batch(jobs.decision_counters(d), overwrite, f"{base}/ckpt", mode="complete")
    return spark.read.parquet(f"{base}/counts")


@register("o76_watermarked_trend", f"""
SELECT date_trunc('hour', created_at) AS hour_start, count(*) AS count FROM ({A.PREDICTIONS_SQL}) p
WHERE payment_channel <> 'error' GROUP BY 1""")
def o76(spark, sf):
    base = _fresh(spark, "trend")
    d, _ = jobs.decision_stream(_messages(spark, sf, base))
    trend = jobs.latest_by_key(jobs.hourly_trend_stream(d), ["hour_start"], f"{base}/out", f"{base}/ckpt")
    return trend.select(F.col("hour_start").cast("timestamp_ntz"), "count")


#: A stored linear model: bias and weights of the model inputs.
LINEAR = (-3.0, {"spending_deviation_score": 0.8, "velocity_score": 0.4, "is_new_receiver": 0.9, "is_new_payment_format": 0.7,
                 "is_first_transaction": 0.5, "is_weekend": 0.3, "amount": 0.004})
LOGIT_SQL = f"{LINEAR[0]} + " + " + ".join(f"{w} * CAST({c} AS DOUBLE)" for c, w in LINEAR[1].items())


def linear_score(x):
    z = F.lit(LINEAR[0])
    for c, w in LINEAR[1].items():
        z = z + F.lit(w) * F.col(c).cast("double")
    return x.withColumn("raw_probability", 1 / (1 + F.exp(-z)))


ENRICHED_SQL = RUNNING + f""",
x AS (SELECT g.*, CAST(velocity_1h AS DOUBLE) AS velocity_score, amount_z_score AS spending_deviation_score,
  CAST(NOT has_baseline AS BIGINT) AS is_first_transaction, CAST(NOT merchant_seen AS BIGINT) AS is_new_receiver,
  CAST(payment_method_changed AS BIGINT) AS is_new_payment_format, CAST(dayofweek(ts) IN (0, 6) AS BIGINT) AS is_weekend FROM g),
p AS (SELECT x.*, 1 / (1 + exp(-({LOGIT_SQL}))) AS raw FROM x),
q AS (SELECT p.*, round(raw, 4) AS fraud_probability, round(greatest(raw, 1 - raw), 4) AS confidence FROM p)
SELECT row_id, account AS user_id, {r6('amount_deviation', 'amount_deviation')}, {r6('amount_z_score', 'amount_z_score')}, velocity_1h,
  outside_active_hours, NOT merchant_seen AS new_merchant, NOT location_seen AS new_location, payment_method_changed, outside_usual_city,
  {r6('merchant_frequency', 'merchant_frequency')}, {FLAGS_SQL} AS risk_flags,
  fraud_probability, confidence,
  CASE WHEN fraud_probability >= 0.7 THEN 'BLOCK' WHEN fraud_probability >= 0.3 THEN 'REVIEW' ELSE 'ALLOW' END AS decision,
  raw >= 0.5 OR fraud_probability >= 0.7 AS prediction,
  coalesce(nullif(concat_ws('|', CASE WHEN amount > 50000 THEN 'HIGH_TRANSACTION_AMOUNT' END,
    CASE WHEN velocity_score > 0.8 THEN 'HIGH_TRANSACTION_VELOCITY' END, CASE WHEN spending_deviation_score > 0.8 THEN 'UNUSUAL_SPENDING_PATTERN' END,
    CASE WHEN is_first_transaction = 1 THEN 'FIRST_TRANSACTION' END, CASE WHEN is_new_receiver = 1 THEN 'NEW_RECEIVER' END,
    CASE WHEN is_new_payment_format = 1 THEN 'NEW_PAYMENT_FORMAT' END, CASE WHEN hour(ts) <= 5 THEN 'ODD_TRANSACTION_HOUR' END), ''), '{NO_REASON}') AS reason_codes,
  CAST(CAST(fraud_probability AS DECIMAL(5,4)) AS VARCHAR) AS anomaly_score
FROM q"""


def enriched(spark, sf, score, base, slices=SLICES):
    """Run the O-72 job over all transactions, oldest first."""
    t = A.events_txn(spark, sf).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    schema = _stage(t, f"{base}/in", slices=slices)
    s = jobs.enrich_stream(jobs.file_stream(spark, f"{base}/in", schema, max_files=FILES))
    jobs.run_foreach_batch(s, jobs.enriched_batch_writer(base, score), f"{base}/ckpt")


@register("o72_enrich_stream", ENRICHED_SQL)
def o72(spark, sf):
    """Features, score, decision, reason codes and stored records of every
    transaction, read back from the sinks."""
    base = _fresh(spark, "enrich")
    enriched(spark, sf, linear_score, base)
    f, d = files.read_committed(spark, base, "features"), files.read_committed(spark, base, "scored")
    p, a = files.read_committed(spark, base, "predictions"), files.read_committed(spark, base, "anomalies")
    rows = (f.join(d.select("row_id", "transaction_id", "confidence", F.concat_ws("|", "reason_codes").alias("reason_codes")), "row_id")
            .join(p.select("transaction_id", "prediction", "decision", "fraud_probability"), "transaction_id")
            .join(a.select("transaction_id", F.col("anomaly_score").cast("string").alias("anomaly_score")), "transaction_id"))
    return rows.select("row_id", "user_id", "amount_deviation", "amount_z_score", "velocity_1h", "outside_active_hours", "new_merchant", "new_location",
                       "payment_method_changed", "outside_usual_city", "merchant_frequency", F.concat_ws("|", "risk_flags").alias("risk_flags"),
                       "fraud_probability", "confidence", "decision", "prediction", "reason_codes", "anomaly_score")


@register("o39_upsert_stream", f"WITH t AS ({E}) " + baseline_sql("t"))
def o39_stream(spark, sf):
    """The baseline table after the stream has upserted micro-batch by micro-batch."""
    base = _fresh(spark, "upsert")
    t = A.events_txn(spark, sf).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    schema = _stage(t, f"{base}/in")
    jobs.run_foreach_batch(jobs.file_stream(spark, f"{base}/in", schema, max_files=FILES), jobs.baseline_upsert_writer(base), f"{base}/ckpt")
    return KeyedTable(spark, f"{base}/baselines", "user_id").read().drop("bucket")


def _anchored_sql(key_expr: str, seconds: int, limit: int, out: str) -> str:
    """DuckDB twin: positions, next-anchor index, recursive anchor chain."""
    us = seconds * 1_000_000
    first = ", CAST(a.row_id AS VARCHAR) AS result" if limit == 1 else ""
    return f"""WITH RECURSIVE t AS (SELECT row_id, {key_expr} AS k, ts FROM ({E}) e),
r AS (SELECT k, row_id, ts, row_number() OVER (PARTITION BY k ORDER BY ts, row_id) - 1 AS p,
             count(*) OVER (PARTITION BY k) AS size FROM t),
nx AS (SELECT a.k, a.p, count(b.row_id) AS n, a.size FROM r a LEFT JOIN r b
         ON a.k = b.k AND b.ts < a.ts + to_microseconds({us}) GROUP BY a.k, a.p, a.size),
chain(k, p) AS (SELECT k, p FROM r WHERE p = 0
                UNION ALL SELECT c.k, nx.n FROM chain c JOIN nx ON nx.k = c.k AND nx.p = c.p WHERE nx.n < nx.size),
w AS (SELECT r.k, r.row_id, r.p, max(c.p) AS ap FROM r JOIN chain c ON c.k = r.k AND c.p <= r.p
      GROUP BY r.k, r.row_id, r.p)
SELECT w.row_id, w.k AS {out}, a.ts AS window_start, w.p - w.ap + 1 AS count_in_window,
       w.p - w.ap + 1 <= {limit} AS allowed{first}
FROM w JOIN r a ON a.k = w.k AND a.p = w.ap"""


def _with_start(out):
    """The window's start as a wall-clock time, as in the batch form."""
    at = F.timestamp_micros("window_start_us").cast("timestamp_ntz")
    return out.select(*[at.alias("window_start") if c == "window_start_us" else F.col(c) for c in out.columns])


@register("o73_rate_limit", _anchored_sql("account", 60, 100, "account"))
def o73(spark, sf):
    """Reference constants: at most 100 requests per key per 60 s window."""
    base = _fresh(spark, "ratelimit")
    r = A.events_txn(spark, sf).select("row_id", "account", "ts")
    schema = _stage(r, f"{base}/in")
    s = jobs.file_stream(spark, f"{base}/in", schema, max_files=FILES)
    return _with_start(_run(jobs.anchored_window_stream(s, "account", "ts", 60, 100, ["row_id", "account"],
                                                        ["row_id"], delay="1 minute"), base))


@register("o59_idempotency", _anchored_sql("CAST(account AS VARCHAR) || ':' || merchant", 86400, 1,
                                           "idempotency_key"))
def o59(spark, sf):
    """First call per idempotency key wins for 24 h (key: user + merchant);
    later calls get the first one's result."""
    base = _fresh(spark, "idem")
    r = A.events_txn(spark, sf).select(
        "row_id", F.concat_ws(":", "account", "merchant").alias("idempotency_key"), "ts")
    schema = _stage(r, f"{base}/in")
    s = jobs.file_stream(spark, f"{base}/in", schema, max_files=FILES)
    out = _run(jobs.anchored_window_stream(s, "idempotency_key", "ts", 86400, 1, ["row_id", "idempotency_key"], ["row_id"],
                                           result="row_id", delay="1 minute"), base)
    return _with_start(out)


@register("o08_topic_source")
def o08(spark, sf):
    base = _fresh(spark, "topic")
    files.publish(A.predictions(spark, sf).drop("risk_flags"), "user_id", "transactions.raw", f"{base}/bus",
                  order=["created_at", "transaction_id"])
    s = files.read_topic_stream(spark, "transactions.raw", f"{base}/bus", starting="earliest", max_files=FILES)
    return _run(s, base)


@register("o08_topic_offsets", TOPIC_SQL)
def o08_offsets(spark, sf):
    return topic_places(o08(spark, sf))


@register("o73_rate_limit_batch", _anchored_sql("account", 60, 100, "account"))
def o73b(spark, sf):
    """Batch form, reference constants: 100 requests per key per 60 s."""
    from riskspark.operators.windows import anchored_windows

    r = A.events_txn(spark, sf).select("row_id", "account", "ts")
    return anchored_windows(r, "account", "ts", ["row_id"], 60, 100).select(
        "row_id", "account", "window_start", "count_in_window", "allowed")


@register("o59_idempotency_batch", _anchored_sql("CAST(account AS VARCHAR) || ':' || merchant", 86400, 1,
                                                 "idempotency_key"))
def o59b(spark, sf):
    """Batch form: first call per (user, merchant) key wins for 24 h."""
    from riskspark.operators.windows import anchored_windows

    r = A.events_txn(spark, sf).select(
        "row_id", F.concat_ws(":", "account", "merchant").alias("idempotency_key"), "ts")
    return anchored_windows(r, "idempotency_key", "ts", ["row_id"], 86400, 1, result=True).select(
        "row_id", "idempotency_key", "window_start", "count_in_window", "allowed", "result")
