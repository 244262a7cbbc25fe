"""Registered monitoring, drift and promotion queries (O-90..O-102).

Training period = rows before the snapshot cutoff, live period = after.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskspark.functions.calendar import ntz_lit

from riskspark import adapters as A
from riskspark.operators import baseline as bl
from riskspark.operators import evaluate as ev
from riskspark.operators import monitor as mo
from riskspark.plans.q_evaluate import GRID
from riskspark.plans.registry import r6, register
from riskspark.session import cut_lineage, table_dir
from riskspark.sources import files

P = A.PREDICTIONS_SQL
TX = A.TRANSACTIONS_SQL
CUTP = ("cut AS (SELECT date_trunc('hour', make_timestamp(CAST(epoch_us(min(ts)) + "
        f"(epoch_us(max(ts)) - epoch_us(min(ts))) * 0.8 AS BIGINT))) AS c FROM ({A.EVENTS_TXN_SQL}) t)")
TRAIN = f"tr AS (SELECT p.* FROM ({P}) p, cut WHERE p.created_at < cut.c)"
LIVE = f"lv AS (SELECT p.* FROM ({P}) p, cut WHERE p.created_at >= cut.c)"


def _periods(spark, sf):
    p = A.predictions(spark, sf)
    cut = bl.snapshot_cutoff(A.events_txn(spark, sf))
    return p, p.where(F.col("created_at") < ntz_lit(cut)), p.where(F.col("created_at") >= ntz_lit(cut))


LIVE_STATS_SQL = f"""SELECT avg(t.amount) AS mean_amount, avg(p.fraud_probability) AS mean_fraud_probability,
       avg(p.confidence) AS mean_confidence, avg(CAST(p.prediction AS INTEGER)) AS fraud_rate,
       count(*) AS samples"""


@register("o90_live_stats", f"""{LIVE_STATS_SQL.replace('SELECT ', 'SELECT ', 1)}
FROM ({P}) p JOIN ({TX}) t ON p.transaction_id = t.transaction_id""")
def o90(spark, sf):
    return mo.live_stats(A.predictions(spark, sf), A.transactions(spark, sf))


TRAIN_STATS_SQL = """SELECT avg(amount) AS mean_amount, avg(fraud_probability) AS mean_fraud_probability,
       avg(greatest(fraud_probability, 1 - fraud_probability)) AS mean_confidence,
       avg(CAST(prediction AS INTEGER)) AS fraud_rate FROM tr"""


@register("o91_drift_report", f"""WITH {CUTP}, {TRAIN}, {LIVE},
ts AS ({TRAIN_STATS_SQL}),
ls AS ({LIVE_STATS_SQL} FROM lv p JOIN ({TX}) t ON p.transaction_id = t.transaction_id),
tt AS (UNPIVOT ts ON mean_amount, mean_fraud_probability, mean_confidence, fraud_rate
       INTO NAME metric VALUE training),
ll AS (UNPIVOT (SELECT mean_amount, mean_fraud_probability, mean_confidence, fraud_rate FROM ls)
       ON mean_amount, mean_fraud_probability, mean_confidence, fraud_rate INTO NAME metric VALUE live),
j AS (SELECT metric, training, live,
             CASE WHEN training = 0 THEN 0.0 ELSE abs(live - training) / training END AS d
      FROM tt JOIN ll USING (metric) WHERE live IS NOT NULL)
SELECT metric, {r6('training', 'training')}, {r6('live', 'live')}, {r6('round(d, 4)', 'drift')},
       CASE WHEN d >= 0.2 THEN 'DRIFT' ELSE 'OK' END AS status,
       max(d >= 0.2) OVER () AS drift_detected FROM j""")
def o91(spark, sf):
    _, train, live = _periods(spark, sf)
    return mo.drift_report(mo.training_stats(train), mo.live_stats(live, A.transactions(spark, sf)))


@register("o92_drift_score", f"""WITH {CUTP}, {TRAIN}, {LIVE},
tm AS (SELECT avg(amount) AS t FROM tr),
s AS (SELECT count(*) AS samples, round(avg(amount), 2) AS average_amount FROM lv),
x AS (SELECT samples, average_amount,
             CASE WHEN samples = 0 THEN 0.0 WHEN t = 0 OR t IS NULL THEN 0.0
                  ELSE round(abs(average_amount - t) / abs(t), 4) END AS drift_score FROM s, tm)
SELECT samples, {r6('average_amount', 'average_amount')}, {r6('drift_score', 'drift_score')},
       CASE WHEN samples = 0 THEN 'NONE' WHEN drift_score < 0.10 THEN 'LOW'
            WHEN drift_score < 0.25 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
       samples > 0 AND drift_score >= 0.25 AS drift_detected FROM x""")
def o92(spark, sf):
    _, train, live = _periods(spark, sf)
    t = train.agg(F.avg("amount")).first()[0]
    return mo.drift_score(live, t)


@register("o93_log_stats", f"""SELECT count(*) AS total_predictions,
       count(*) FILTER (WHERE prediction) AS fraud_predictions,
       {r6('round(count(*) FILTER (WHERE prediction) / count(*), 4)', 'fraud_rate')},
       {r6('round(avg(confidence), 4)', 'average_confidence')},
       {r6('round(avg(fraud_probability), 4)', 'average_probability')} FROM ({P}) p""")
def o93(spark, sf):
    path = table_dir(spark, f"log_stats_{uuid.uuid4().hex[:12]}")
    p = A.predictions(spark, sf)
    files.prediction_log_frame(p, ["transaction_id", "user_id", "amount", "payment_channel"]) \
        .write.mode("overwrite").json(path)
    return mo.log_stats(files.read_prediction_log(spark, path))


@register("o94_channel_distribution", f"""
SELECT payment_channel, count(*) AS count, {r6('round(count(*) / sum(count(*)) OVER (), 4)', 'share')}
FROM ({P}) p GROUP BY payment_channel""")
def o94(spark, sf):
    return mo.channel_distribution(A.predictions(spark, sf))


@register("o95_retrain_gate", f"""WITH {CUTP}, {TRAIN}, {LIVE},
ts AS ({TRAIN_STATS_SQL}),
ls AS ({LIVE_STATS_SQL} FROM lv p JOIN ({TX}) t ON p.transaction_id = t.transaction_id),
tt AS (UNPIVOT ts ON mean_amount, mean_fraud_probability, mean_confidence, fraud_rate
       INTO NAME metric VALUE training),
ll AS (UNPIVOT (SELECT mean_amount, mean_fraud_probability, mean_confidence, fraud_rate FROM ls)
       ON mean_amount, mean_fraud_probability, mean_confidence, fraud_rate INTO NAME metric VALUE live)
SELECT coalesce(max(CASE WHEN training = 0 THEN 0.0 ELSE abs(live - training) / training END >= 0.2), false)
       AS should_retrain FROM tt JOIN ll USING (metric) WHERE live IS NOT NULL""")
def o95(spark, sf):
    _, train, live = _periods(spark, sf)
    rep = mo.drift_report(mo.training_stats(train), mo.live_stats(live, A.transactions(spark, sf)))
    return mo.retrain_gate(rep)


@register("o96_retrain_dataset", f"""
SELECT {r6('t.amount', 'amount')}, t.payment_method, t.location, t.status, p.prediction
FROM ({P}) p JOIN ({TX}) t ON p.transaction_id = t.transaction_id""")
def o96(spark, sf):
    return mo.retrain_dataset(A.predictions(spark, sf), A.transactions(spark, sf))


@register("o97_training_stats", f"""WITH {CUTP}, {TRAIN} {TRAIN_STATS_SQL}""")
def o97(spark, sf):
    return mo.training_stats(_periods(spark, sf)[1])


def _f1_at(threshold: float) -> str:
    return f"""(SELECT CASE WHEN count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE score >= {threshold}) = 0
                  THEN 0.0 ELSE 2.0 * count(*) FILTER (WHERE label = 1 AND score >= {threshold})
                  / (count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE score >= {threshold})) END
                FROM ({A.EVAL_SCORED_SQL}) s)"""


def _grid_best_sql() -> str:
    vals = ", ".join(f"(CAST('{t!r}' AS DOUBLE), {i})" for i, t in enumerate(GRID))
    return f"""(SELECT max(f1) FROM (
      SELECT 2.0 * count(*) FILTER (WHERE s.label = 1 AND s.score >= g.t)
             / (count(*) FILTER (WHERE s.label = 1) + count(*) FILTER (WHERE s.score >= g.t)) AS f1
      FROM (VALUES {vals}) g(t, i), ({A.EVAL_SCORED_SQL}) s GROUP BY g.i))"""


@register("o98_promotion", f"""WITH reg AS (
  SELECT 'threshold_0.5' AS model_id, 'ACTIVE' AS status, {_f1_at(0.5)} AS f1_score, false AS cand
  UNION ALL SELECT 'threshold_0.9', 'INACTIVE', {_f1_at(0.9)}, false
  UNION ALL SELECT 'best_grid', 'CANDIDATE', {_grid_best_sql()}, true),
d AS (SELECT *, NOT (max(CASE WHEN cand THEN f1_score END) OVER ()
                     <= coalesce(max(CASE WHEN status = 'ACTIVE' AND NOT cand THEN f1_score END) OVER (), 0.0)
                     AND coalesce(max(CASE WHEN status = 'ACTIVE' AND NOT cand THEN f1_score END) OVER (), 0.0) > 0)
                AS promoted FROM reg)
SELECT model_id, CASE WHEN promoted THEN CASE WHEN cand THEN 'ACTIVE' ELSE 'INACTIVE' END ELSE status END AS status,
       {r6('f1_score', 'f1_score')},
       CAST(CASE WHEN promoted AND cand THEN 100 WHEN promoted THEN 0 END AS BIGINT) AS traffic, promoted
FROM d WHERE promoted OR NOT cand""")
def o98(spark, sf):
    s = A.eval_scored(spark, sf)

    def f1_at(t, model, status):
        cm = ev.confusion(s.withColumn("pred", (F.col("score") >= t).cast("int")))
        return ev.classification_metrics(cm).select(
            F.lit(model).alias("model_id"), F.lit(status).alias("status"), F.col("f1").alias("f1_score"))

    registry = f1_at(0.5, "threshold_0.5", "ACTIVE").unionByName(f1_at(0.9, "threshold_0.9", "INACTIVE"))
    cand = ev.threshold_grid(s, GRID).agg(F.max("f1").alias("f1_score")).select(
        F.lit("best_grid").alias("model_id"), "f1_score")
    return mo.promote(registry, cand)


@register("o99_latency_summary", """WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS n FROM v)
SELECT max(n) AS count, round(avg(x), 6) AS avg_ms,
  round((max(CASE WHEN k = (n - 1) // 2 THEN x END) + max(CASE WHEN k = n // 2 THEN x END)) / 2, 6) AS median_ms,
  round(min(x), 6) AS min_ms, round(max(x), 6) AS max_ms, round(stddev_samp(x), 6) AS stdev_ms,
  round(max(CASE WHEN k = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) THEN x END), 6) AS p50_ms,
  round(max(CASE WHEN k = least(CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT), n - 1) THEN x END), 6) AS p90_ms,
  round(max(CASE WHEN k = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1) THEN x END), 6) AS p95_ms,
  round(max(CASE WHEN k = least(CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT), n - 1) THEN x END), 6) AS p99_ms,
  round(max(CASE WHEN k = least(CAST(floor(n * CAST(0.999 AS DOUBLE)) AS BIGINT), n - 1) THEN x END), 6) AS p999_ms
FROM s""")
def o99(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("value").alias("latency_ms"))
    return mo.latency_summary(e)


def _hist_sql():
    arms = " UNION ALL ".join(
        f"SELECT method, path, '{b}' AS le, count(*) FILTER (WHERE duration_s <= {b}) AS bucket_count, "
        f"sum(duration_s) AS sum, count(*) AS count FROM r GROUP BY method, path"
        for b in mo.DEFAULT_BUCKETS)
    arms += (" UNION ALL SELECT method, path, '+Inf', count(*), sum(duration_s), count(*) "
             "FROM r GROUP BY method, path")
    return f"WITH r AS ({A.REQUEST_LOG_SQL}) SELECT method, path, le, bucket_count, round(sum, 6) AS sum, count FROM ({arms}) h"


@register("o100_latency_histogram", _hist_sql())
def o100(spark, sf):
    return mo.latency_histogram(A.request_log(spark, sf), by=["method", "path"])


@register("o100_request_counts", f"""
SELECT method, path, status, count(*) AS requests_total FROM ({A.REQUEST_LOG_SQL}) r GROUP BY 1, 2, 3""")
def o100b(spark, sf):
    return mo.request_counts(A.request_log(spark, sf))


@register("o101_psi", f"""WITH {CUTP}, {TRAIN}, {LIVE},
rg AS (SELECT min(amount) AS lo, max(amount) AS hi, (max(amount) - min(amount)) / 10 AS w FROM tr),
e AS (SELECT CASE WHEN w = 0 THEN 0 ELSE least(greatest(floor((amount - lo) / w), 0), 9) END AS bin,
             count(*) AS n FROM tr, rg GROUP BY 1),
a AS (SELECT CASE WHEN w = 0 THEN 0 ELSE least(greatest(floor((amount - lo) / w), 0), 9) END AS bin,
             count(*) AS n FROM lv, rg GROUP BY 1),
j AS (SELECT greatest(coalesce(e.n / (SELECT sum(n) FROM e), 0), 1e-6) AS es,
             greatest(coalesce(a.n / (SELECT sum(n) FROM a), 0), 1e-6) AS as_
      FROM e FULL OUTER JOIN a ON e.bin = a.bin)
SELECT {r6('sum((as_ - es) * ln(as_ / es))', 'psi')} FROM j""")
def o101(spark, sf):
    _, train, live = _periods(spark, sf)
    return mo.psi(train, live, "amount")


_EDGES = ", ".join(f"quantile_disc(CAST(amount AS DOUBLE), {i / 10}) AS q{i}" for i in range(1, 10))
_QBIN = " + ".join(f"CAST(CAST(amount AS DOUBLE) > q{i} AS INTEGER)" for i in range(1, 10))


@register("o101_psi_quantiles", f"""WITH {CUTP}, {TRAIN}, {LIVE}, q AS (SELECT {_EDGES} FROM tr),
e AS (SELECT {_QBIN} AS bin, count(*) AS n FROM tr, q GROUP BY 1),
a AS (SELECT {_QBIN} AS bin, count(*) AS n FROM lv, q GROUP BY 1),
j AS (SELECT greatest(coalesce(e.n / (SELECT sum(n) FROM e), 0), 1e-6) AS es,
             greatest(coalesce(a.n / (SELECT sum(n) FROM a), 0), 1e-6) AS as_
      FROM e FULL OUTER JOIN a ON e.bin = a.bin)
SELECT {r6('sum((as_ - es) * ln(as_ / es))', 'psi')}, true AS sketch_agrees FROM j""")
def o101q(spark, sf):
    """Exact decile bins, and whether the index read from the stored hourly
    sketches is within 0.01 of it."""
    _, train, live = _periods(spark, sf)
    train, live = (cut_lineage(d.select("amount", "created_at")) for d in (train, live))
    exact = mo.psi_by_edges(train, live, "amount", mo.quantile_edges(train, "amount"))
    sketched = mo.psi_of_sketches(*(cut_lineage(mo.hourly_sketches(d, "amount", "created_at")) for d in (train, live)))
    return (exact.withColumn("_one", F.lit(1)).join(sketched.select(F.col("psi").alias("_s"), F.lit(1).alias("_one")), "_one")
            .select("psi", (F.abs(F.col("psi") - F.col("_s")) <= 0.01).alias("sketch_agrees")))


@register("o101_chi_square", f"""WITH {CUTP},
x AS (SELECT CASE WHEN p.created_at < cut.c THEN 'train' ELSE 'live' END AS period, p.payment_channel
      FROM ({P}) p, cut),
t AS (SELECT period, payment_channel, count(*) AS o FROM x GROUP BY 1, 2),
g AS (SELECT period, sum(o) AS gt FROM t GROUP BY 1),
c AS (SELECT payment_channel, sum(o) AS ct FROM t GROUP BY 1),
n AS (SELECT sum(o) AS n FROM t),
e AS (SELECT t.o, CAST(g.gt AS DOUBLE) * c.ct / n.n AS e FROM t JOIN g USING (period)
      JOIN c USING (payment_channel), n)
SELECT {r6('sum((o - e) * (o - e) / e - e) + (SELECT n FROM n)', 'chi_square')},
       ((SELECT count(*) FROM g) - 1) * ((SELECT count(*) FROM c) - 1) AS dof FROM e""")
def o101b(spark, sf):
    p, _, _ = _periods(spark, sf)
    cut = bl.snapshot_cutoff(A.events_txn(spark, sf))
    x = p.withColumn("period", F.when(F.col("created_at") < ntz_lit(cut), "train").otherwise("live"))
    return mo.chi_square(x, "period", "payment_channel")


@register("o102_ks_statistic", f"""WITH {CUTP}, {TRAIN}, {LIVE},
v AS (SELECT amount AS v, 1 AS ca, 0 AS cb FROM tr UNION ALL SELECT amount, 0, 1 FROM lv),
d AS (SELECT v, sum(ca) AS ca, sum(cb) AS cb FROM v GROUP BY v),
c AS (SELECT sum(ca) OVER (ORDER BY v) / sum(ca) OVER () AS fa,
             sum(cb) OVER (ORDER BY v) / sum(cb) OVER () AS fb FROM d)
SELECT {r6('max(abs(fa - fb))', 'ks_statistic')} FROM c""")
def o102(spark, sf):
    _, train, live = _periods(spark, sf)
    return mo.ks_statistic(train, live, "amount")
