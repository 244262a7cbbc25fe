"""Scoring outputs, decisions and routing (O-50, O-52..O-58, O-60).

All of these are row-local expressions (no shuffle) except the label
encoding, which joins a table of distinct labels whose size is checked
before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import broadcast_if_small
from riskspark.functions.rules import (BLOCK_THRESHOLD, REVIEW_THRESHOLD, channel_mapped,
                                       decision, reason_codes)

MAX_LABELS = 100_000  # label tables above this are joined without a broadcast hint
MAX_RETRIES = 3


def fit_labels(train: DataFrame, col: str = "payment_channel", mapped: bool = True) -> DataFrame:
    """O-121/O-50: alphabetical label codes 0..k-1 of the distinct values.

    The distinct step is a pre-aggregated ``groupBy``; codes are exact
    positions in label order (balanced range partitions, no one-task window,
    whatever the number of distinct labels).
    """
    from riskspark.plans.rank import positions

    v = channel_mapped(col) if mapped else F.col(col)
    d = train.select(v.alias("label")).where(F.col("label").isNotNull()).distinct()
    return positions(d, ["label"], out="code", sizes=False)


def encode_labels(df: DataFrame, labels: DataFrame, col: str = "payment_channel",
                  out: str = "payment_channel_code", mapped: bool = True) -> DataFrame:
    """O-50: map a request channel to the training name, then to its code;
    unseen values -> 0."""
    lab = broadcast_if_small(labels, MAX_LABELS)
    key = channel_mapped(col) if mapped else F.col(col)
    j = df.withColumn("_label", key).join(lab.withColumnRenamed("label", "_label"), "_label", "left")
    return j.withColumn(out, F.coalesce(F.col("code"), F.lit(0)).cast("int")).drop("_label", "code")


def score_outputs(df: DataFrame, p: str = "raw_probability", threshold: float = 0.5) -> DataFrame:
    """O-52: rounded probability and confidence; label on the unrounded p."""
    raw = F.col(p)
    return (df.withColumn("fraud_probability", F.round(raw, 4))
            .withColumn("confidence", F.round(F.greatest(raw, 1 - raw), 4))
            .withColumn("prediction", raw >= threshold)
            .withColumn("threshold", F.lit(threshold)))


def decide(df: DataFrame, p: str = "fraud_probability", review: float = REVIEW_THRESHOLD,
           block: float = BLOCK_THRESHOLD) -> DataFrame:
    """O-53/O-54: decision on the (rounded) probability and the final fraud
    flag ``prediction OR decision = BLOCK``."""
    d = df.withColumn("decision", decision(F.col(p), review, block))
    if "prediction" in df.columns:
        d = d.withColumn("is_fraud_final", F.col("prediction") | (F.col("decision") == "BLOCK"))
    return d


def with_reason_codes(features: DataFrame, out: str = "reason_codes") -> DataFrame:
    """O-55: ordered reason codes over a feature row (default code if none)."""
    return features.withColumn(out, reason_codes())


def prediction_records(df: DataFrame, model_version: str = "2.0.0") -> DataFrame:
    """O-56 (first sink): the prediction row with the final flag (label or
    BLOCK); empty flags stored as []."""
    flags = F.col("risk_flags") if "risk_flags" in df.columns else F.array().cast("array<string>")
    return df.select(
        "transaction_id", "user_id", "fraud_probability", "confidence",
        (F.col("prediction") | (F.col("decision") == "BLOCK")).alias("prediction"), "decision",
        "threshold", F.lit(model_version).alias("model_version"),
        F.coalesce(flags, F.array().cast("array<string>")).alias("risk_flags"),
        "created_at")


def anomaly_records(df: DataFrame, model_name: str = "gbt", model_version: str = "2.0.0") -> DataFrame:
    """O-56 (second sink): anomaly log row with the score as DECIMAL(5,4)."""
    return df.select(
        "transaction_id",
        F.col("fraud_probability").cast("decimal(5,4)").alias("anomaly_score"),
        F.col("decision").alias("anomaly_type"),
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.lit("").alias("explanation"),
        F.col("created_at").alias("detected_at"))


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-57: REVIEW -> review queue, BLOCK -> HIGH_RISK alert, ALLOW -> none."""
    p = F.col("fraud_probability").cast("decimal(6,5)")
    review = df.filter(F.col("decision") == "REVIEW").select(
        "transaction_id", p.alias("fraud_probability"), F.lit("PENDING").alias("status"),
        "created_at")
    alerts = df.filter(F.col("decision") == "BLOCK").select(
        "transaction_id", p.alias("fraud_probability"), F.lit("HIGH_RISK").alias("alert_type"),
        "created_at")
    return review, alerts


def retry_route(df: DataFrame, error: str = "error_kind", count: str = "retry_count",
                max_retries: int = MAX_RETRIES) -> DataFrame:
    """O-58: failed events -> RETRY (count + 1) while count < max, then DLQ;
    permanent errors are DROPPED; events without error are PROCESSED."""
    e, c = F.col(error), F.col(count)
    r = (F.when(e.isNull(), "PROCESSED").when(e == "PERMANENT", "DROPPED")
         .when(c < max_retries, "RETRY").otherwise("DLQ"))
    return (df.withColumn("route", r)
            .withColumn("next_retry_count", F.when(r == "RETRY", c + 1).otherwise(c)))


def assign_model(df: DataFrame, key: str, split: dict[str, int], default: str) -> DataFrame:
    """O-60: stable weighted model assignment by hashing the key into 0..99
    against cumulative weights; the default model when the split is empty."""
    if not split:
        return df.withColumn("model_id", F.lit(default))
    total = sum(split.values())
    digest = F.md5(F.col(key).cast("string").cast("binary"))  # any SQL engine can repeat it
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(total)
    expr: Column | None = None
    acc = 0
    for model, w in split.items():
        acc += w
        expr = (F.when(bucket < acc, F.lit(model)) if expr is None
                else expr.when(bucket < acc, F.lit(model)))
    return df.withColumn("model_id", expr.otherwise(F.lit(default)))

