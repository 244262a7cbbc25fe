"""Monitoring, drift and promotion (O-90..O-102).

Statistics are aggregates (partial aggregation, one output row); metric
tables are unpivoted with ``stack`` and joined on the metric name (tables of
a handful of rows).  Order statistics use exact ranks from distributed
running totals over distinct values, never a sort on one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.numeric import round_half_away as rnd
from riskspark.plans.scan import running_totals

DRIFT_THRESHOLD = 0.20
# Prometheus default histogram buckets (seconds).
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
MONITORED = ("mean_amount", "mean_fraud_probability", "mean_confidence", "fraud_rate")


def live_stats(predictions: DataFrame, transactions: DataFrame, key: str = "transaction_id") -> DataFrame:
    """O-90: averages over predictions joined to their transactions."""
    j = predictions.select(key, "fraud_probability", "confidence", "prediction").join(
        transactions.select(key, "amount"), key)
    return j.agg(F.avg("amount").alias("mean_amount"),
                 F.avg("fraud_probability").alias("mean_fraud_probability"),
                 F.avg("confidence").alias("mean_confidence"),
                 F.avg(F.col("prediction").cast("int")).alias("fraud_rate"),
                 F.count(F.lit(1)).alias("samples"))


def require_rows(stats: DataFrame) -> DataFrame:
    """O-90 error case: raise when no production statistics exist."""
    if not stats.first()["samples"]:
        raise RuntimeError("No production statistics available.")
    return stats


def training_stats(scored: DataFrame, amount: str = "amount", p: str = "fraud_probability",
                   pred: str = "prediction") -> DataFrame:
    """O-97: mean amount, mean p, mean max(p, 1-p), predicted fraud rate."""
    return scored.agg(F.avg(amount).alias("mean_amount"), F.avg(p).alias("mean_fraud_probability"),
                      F.avg(F.greatest(F.col(p), 1 - F.col(p))).alias("mean_confidence"),
                      F.avg(F.col(pred).cast("int")).alias("fraud_rate"))


def unpivot(stats: DataFrame, metrics: Sequence[str], value: str) -> DataFrame:
    """One-row metric table -> (metric, value) rows."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return stats.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, {value})")


def drift_report(training: DataFrame, live: DataFrame, metrics: Sequence[str] = MONITORED,
                 threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """O-91: per metric abs(live - train) / train (0 when train = 0, signed
    divisor), rounded to 4, DRIFT at >= threshold; null live values skipped;
    ``drift_detected`` is true on every row when any metric drifts."""
    t = unpivot(training, metrics, "training")
    lv = unpivot(live, metrics, "live").where(F.col("live").isNotNull())
    j = t.join(lv, "metric")  # a few rows
    d = F.when(F.col("training") == 0, F.lit(0.0)).otherwise(
        F.abs(F.col("live") - F.col("training")) / F.col("training"))
    r = j.withColumn("_d", d).withColumn("drift", rnd(F.col("_d"), 4)).withColumn(
        "status", F.when(F.col("_d") >= threshold, "DRIFT").otherwise("OK"))
    return r.withColumn("drift_detected", F.max(F.col("_d") >= threshold).over(Window.partitionBy())).drop("_d")


def drift_score(live: DataFrame, training_mean_amount: Column | float, amount: str = "amount") -> DataFrame:
    """O-92: relative change of the live mean amount (rounded to 2) against
    the training mean (abs divisor), rounded to 4; LOW < .10 <= MEDIUM < .25
    <= HIGH; NONE without rows."""
    t = training_mean_amount if isinstance(training_mean_amount, Column) else F.lit(training_mean_amount)
    s = live.agg(F.count(F.lit(1)).alias("samples"), rnd(F.avg(amount), 2).alias("average_amount"))
    score = F.when((t == 0) | t.isNull(), F.lit(0.0)).otherwise(
        rnd(F.abs(F.col("average_amount") - t) / F.abs(t), 4))
    s = s.withColumn("drift_score", F.when(F.col("samples") == 0, F.lit(0.0)).otherwise(score))
    sev = (F.when(F.col("samples") == 0, "NONE").when(F.col("drift_score") < 0.10, "LOW")
           .when(F.col("drift_score") < 0.25, "MEDIUM").otherwise("HIGH"))
    return s.withColumn("severity", sev).withColumn(
        "drift_detected", (F.col("samples") > 0) & (F.col("drift_score") >= 0.25))


def log_stats(log: DataFrame) -> DataFrame:
    """O-93: statistics from the JSON prediction log (nested fields)."""
    p = "prediction"
    agg = log.agg(F.count(F.lit(1)).alias("total_predictions"),
                  F.count_if(F.col(f"{p}.prediction")).alias("fraud_predictions"),
                  F.avg(f"{p}.confidence").alias("_c"), F.avg(f"{p}.fraud_probability").alias("_p"))
    n = F.col("total_predictions")
    return agg.select(
        "total_predictions", "fraud_predictions",
        F.when(n > 0, rnd(F.col("fraud_predictions") / n, 4)).otherwise(0.0).alias("fraud_rate"),
        F.when(n > 0, rnd(F.col("_c"), 4)).otherwise(0.0).alias("average_confidence"),
        F.when(n > 0, rnd(F.col("_p"), 4)).otherwise(0.0).alias("average_probability"))


def channel_distribution(df: DataFrame, channel: str = "payment_channel") -> DataFrame:
    """O-94: share of each payment channel (4 places)."""
    total = df.count()  # one scalar; shares need no window over the groups
    c = df.groupBy(channel).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("share", rnd(F.col("count") / F.lit(float(total)), 4))


def retrain_gate(report: DataFrame) -> DataFrame:
    """O-95: retrain when any metric drifted; no statistics -> false."""
    return report.agg(F.coalesce(F.max(F.col("status") == "DRIFT"), F.lit(False)).alias("should_retrain"))


def retrain_dataset(predictions: DataFrame, transactions: DataFrame,
                    key: str = "transaction_id") -> DataFrame:
    """O-96: predictions joined to transactions -> training columns."""
    return predictions.select(key, "prediction").join(
        transactions.select(key, "amount", "payment_method", "location", "status"), key).select(
        "amount", "payment_method", "location", "status", "prediction")


def promote(registry: DataFrame, candidate: DataFrame) -> DataFrame:
    """O-98: champion/challenger.  The candidate is promoted iff its F1 beats
    the active model's, or the active F1 is 0 / missing; then every other
    model is INACTIVE, the candidate ACTIVE with 100 % traffic.  Otherwise
    the registry is unchanged.  (Registry tables have a handful of rows.)"""
    reg = registry.select("model_id", "status", "f1_score", F.lit(False).alias("_cand"))
    cand = candidate.select("model_id", F.lit("CANDIDATE").alias("status"), "f1_score",
                            F.lit(True).alias("_cand"))
    allm = reg.unionByName(cand)
    every = Window.partitionBy()
    cur = F.max(F.when((F.col("status") == "ACTIVE") & ~F.col("_cand"), F.col("f1_score"))).over(every)
    new = F.max(F.when(F.col("_cand"), F.col("f1_score"))).over(every)
    allm = allm.withColumn("_promoted", ~((new <= F.coalesce(cur, F.lit(0.0))) & (F.coalesce(cur, F.lit(0.0)) > 0)))
    out = allm.where(F.col("_promoted") | ~F.col("_cand"))
    status = F.when(F.col("_promoted"), F.when(F.col("_cand"), "ACTIVE").otherwise("INACTIVE")).otherwise(
        F.col("status"))
    return out.select("model_id", status.alias("status"), "f1_score",
                      F.when(F.col("_promoted") & F.col("_cand"), F.lit(100))
                      .when(F.col("_promoted"), F.lit(0)).otherwise(F.lit(None)).alias("traffic"),
                      F.col("_promoted").alias("promoted"))


def index_quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> DataFrame:
    """Values at 0-based sorted index ``min(int(n * q), n - 1)`` (no
    interpolation), exact: distinct values with counts, running totals,
    then the first value whose cumulative count exceeds the index."""
    d = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = running_totals(d, "v", ["c"], grand=True)
    n = F.col("tot_c")
    aggs = []
    for q in qs:
        k = F.least(F.floor(n.cast("double") * F.lit(q)), n - 1)
        aggs.append(F.min(F.when(F.col("cum_c") > k, F.col("v"))).alias(f"p{q}"))
    return r.agg(*aggs)


def latency_summary(df: DataFrame, col: str = "latency_ms") -> DataFrame:
    """O-99: count, avg, median, min, max, sample stdev and p50/p90/p95/p99/
    p99.9 taken at index ``min(int(n * q), n - 1)`` of the sorted values.

    Moments are one aggregate (fetched as scalars); order statistics come
    from running totals over the distinct values.
    """
    qs = {0.5: "p50_ms", 0.9: "p90_ms", 0.95: "p95_ms", 0.99: "p99_ms", 0.999: "p999_ms"}
    m = df.agg(F.count(col).alias("n"), F.avg(col).alias("avg"), F.min(col).alias("lo"),
               F.max(col).alias("hi"), F.stddev_samp(col).alias("sd")).first()
    d = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = running_totals(d, "v", ["c"])
    n = m["n"]
    pick = lambda k: F.min(F.when(F.col("cum_c") > k, F.col("v")))
    aggs = [((pick((n - 1) // 2) + pick(n // 2)) / 2).alias("median_ms")]
    aggs += [pick(min(int(n * q), n - 1)).alias(name) for q, name in qs.items()]
    return r.agg(*aggs).select(
        F.lit(n).cast("long").alias("count"), F.lit(m["avg"]).cast("double").alias("avg_ms"),
        F.lit(m["lo"]).cast("double").alias("min_ms"), F.lit(m["hi"]).cast("double").alias("max_ms"),
        F.lit(m["sd"] if n > 1 else 0.0).cast("double").alias("stdev_ms"), "*")


def latency_histogram(df: DataFrame, col: str = "duration_s", by: Sequence[str] = (),
                      buckets: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    """O-100: cumulative ``le`` bucket counts (+Inf included), sum, count,
    per label set: one conditional aggregate per bound."""
    aggs = [F.count_if(F.col(col) <= b).alias(f"le_{b}") for b in buckets]
    aggs += [F.count(F.lit(1)).alias("le_inf"), F.sum(col).alias("sum"), F.count(F.lit(1)).alias("count")]
    agg = df.groupBy(*by).agg(*aggs)
    pairs = ", ".join([f"'{b}', `le_{b}`" for b in buckets] + ["'+Inf', le_inf"])
    return agg.selectExpr(*[f"`{c}`" for c in by], f"stack({len(buckets) + 1}, {pairs}) AS (le, bucket_count)",
                          "sum", "count")


def request_counts(df: DataFrame, labels: Sequence[str] = ("method", "path", "status")) -> DataFrame:
    """O-100: request counter per label set."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("requests_total"))


def psi(expected: DataFrame, actual: DataFrame, col: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """O-101: population stability index over equal-width bins of the
    expected sample's [min, max] (values outside go to the edge bins);
    shares are floored at ``eps``."""
    lo, hi = expected.agg(F.min(col), F.max(col)).first()  # two scalars
    width = (hi - lo) / bins if hi is not None and hi != lo else 0.0

    def binned(df, tag):
        b = (F.lit(0) if width == 0 else
             F.least(F.greatest(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(bins - 1)))
        c = df.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias(tag))
        return c.withColumn(f"{tag}_share", F.col(tag) / F.sum(tag).over(Window.partitionBy()))  # <= bins rows

    j = binned(expected, "e").join(binned(actual, "a"), "bin", "full_outer").na.fill(0)
    es = F.greatest(F.col("e_share"), F.lit(eps))
    as_ = F.greatest(F.col("a_share"), F.lit(eps))
    return j.agg(F.sum((as_ - es) * F.log(as_ / es)).alias("psi"))


def _psi_of_shares(e, a, eps: float):
    es, as_ = F.greatest(e, F.lit(eps)), F.greatest(a, F.lit(eps))
    return (as_ - es) * F.log(as_ / es)


def quantile_edges(df: DataFrame, col: str, bins: int = 10) -> list[float]:
    """Exact inner quantiles (smallest value with i/bins of the rows at or
    below it), from running totals over the distinct values."""
    v = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = running_totals(v, "v", ["c"], grand=True)
    row = r.agg(*[F.min(F.when(F.col("cum_c") * bins >= F.col("tot_c") * i, F.col("v"))).alias(f"q{i}")
                  for i in range(1, bins)]).first()
    return sorted({q for q in row if q is not None})


def psi_by_edges(expected: DataFrame, actual: DataFrame, col: str, edges: Sequence[float],
                 eps: float = 1e-6) -> DataFrame:
    """O-101: stability index over the bins (.., e1], (e1, e2], .. (null values
    take no part; an empty sample has share ``eps`` in every bin)."""
    v = F.col(col).cast("double")
    bin_ = sum([(v > F.lit(e)).cast("int") for e in edges], F.lit(0))
    both = (expected.where(v.isNotNull()).select(bin_.alias("bin"), F.lit(1).alias("e"), F.lit(0).alias("a"))
            .unionByName(actual.where(v.isNotNull()).select(bin_.alias("bin"), F.lit(0).alias("e"), F.lit(1).alias("a"))))
    c = both.groupBy("bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    whole = Window.partitionBy()  # <= len(edges) + 1 rows
    shares = c.select(F.coalesce(F.try_divide(F.col("e"), F.sum("e").over(whole)), F.lit(0.0)).alias("e"),
                      F.coalesce(F.try_divide(F.col("a"), F.sum("a").over(whole)), F.lit(0.0)).alias("a"))
    return shares.agg(F.sum(_psi_of_shares(F.col("e"), F.col("a"), eps)).alias("psi"))


def hourly_sketches(df: DataFrame, col: str, ts: str, k: int = 800) -> DataFrame:
    """(hour, n, sketch): a mergeable quantile sketch per hour (rank error about
    0.4 % at k = 800).  Written once, it answers for any window of hours."""
    v = F.col(col).cast("double")
    return (df.where(v.isNotNull()).groupBy(F.date_trunc("hour", ts).alias("hour"))
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch")))


def psi_of_sketches(expected: DataFrame, actual: DataFrame, bins: int = 10, eps: float = 1e-6,
                    k: int = 800) -> DataFrame:
    """O-101 from stored sketches: bins are the quantiles of the merged
    ``expected`` hours, shares the ranks of the merged hours; no data row is
    read again.  ``psi`` is null when a side has no sketch."""
    e = expected.agg(F.kll_merge_agg_double("sketch", k).alias("es"))
    a = actual.agg(F.kll_merge_agg_double("sketch", k).alias("as"))
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    some = [F.kll_sketch_get_n_double(s) > 0 for s in ("es", "as")]
    edges = sorted(set(e.select(F.when(some[0], F.kll_sketch_get_quantile_double("es", probs))).first()[0] or []))  # bins - 1 numbers
    if not edges:
        return e.select(F.lit(None).cast("double").alias("psi"))
    at = F.array(*[F.lit(float(v)) for v in edges])  # Spark takes literal ranks only
    both = (e.select(F.kll_sketch_get_rank_double("es", at).alias("_es"), F.lit(1).alias("_one"))
            .join(a.select(F.when(some[1], F.kll_sketch_get_rank_double("as", at)).alias("_as"), F.lit(1).alias("_one")), "_one"))
    total = F.lit(0.0)
    for i in range(len(edges) + 1):
        share = [(F.lit(1.0) if i == len(edges) else F.col(s)[i]) - (F.col(s)[i - 1] if i else F.lit(0.0))
                 for s in ("_es", "_as")]
        total = total + _psi_of_shares(*share, eps)
    return both.select(total.alias("psi"))  # one row


def chi_square(df: DataFrame, group: str, category: str) -> DataFrame:
    """O-101: Pearson chi-square of the group x category contingency table.

    Cells never observed contribute their expected count E, and the sum of
    E over all cells is n, so only observed cells are visited:
    chi2 = sum_obs((O - E)^2 / E - E) + n.
    """
    t = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("o"))
    gt = t.groupBy(group).agg(F.sum("o").alias("gt"))
    ct = t.groupBy(category).agg(F.sum("o").alias("ct"))
    n = df.count()
    x = t.join(gt, group).join(ct, category)
    e = F.col("gt") * F.col("ct") / F.lit(float(n))
    return x.agg((F.sum((F.col("o") - e) * (F.col("o") - e) / e - e) + F.lit(float(n))).alias("chi_square"),
                 ((F.countDistinct(group) - 1) * (F.countDistinct(category) - 1)).alias("dof"))


def ks_statistic(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """O-102: two-sample Kolmogorov-Smirnov D = max |F_a(x) - F_b(x)| over
    all observed values, from running totals of both samples' counts."""
    u = (a.select(F.col(col).alias("v"), F.lit(1).alias("ca"), F.lit(0).alias("cb"))
         .unionByName(b.select(F.col(col).alias("v"), F.lit(0).alias("ca"), F.lit(1).alias("cb"))))
    d = u.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    r = running_totals(d, "v", ["ca", "cb"], grand=True)
    diff = F.abs(F.col("cum_ca") / F.col("tot_ca") - F.col("cum_cb") / F.col("tot_cb"))
    return r.agg(F.max(diff).alias("ks_statistic"))
