"""Per-account behavioural features computed strictly from the past (O-10..O-26).

Every feature of a row depends only on rows of the same account that come
before it in ``(ts, tie...)`` order.  All of them come from one
``prior_scan`` (one shuffle on the account, balanced for hot accounts),
so the 16-column feature row is a single pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.calendar import batch_calendar, parse_timestamp, seconds_between
from riskspark.plans.prior import DEFAULT_CHUNK_ROWS, prior_scan

# The 16 columns of the feature dataset, in emitted order.
FEATURE_COLUMNS = (
    "amount", "payment_channel", "time_since_last_transaction", "velocity_score",
    "spending_deviation_score", "is_first_transaction", "hour", "day_of_week", "month",
    "is_weekend", "is_fraud", "is_cross_bank_transfer", "is_cross_currency_transfer",
    "is_new_receiver", "is_new_bank", "is_new_payment_format",
)
# Identifier / leaky columns of the legacy dataset (O-25).
LEGACY_DROP_COLUMNS = ("transaction_id", "sender_account", "receiver_account",
                       "ip_address", "device_hash", "fraud_type")


def _scan(txn: DataFrame, tie: Sequence[str], value: str | None = None,
          firsts: Sequence[str] = (), account: str = "account", ts: str = "ts",
          chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    return prior_scan(txn, account, [ts, *tie], value=value, firsts=firsts, chunk_rows=chunk_rows)


def velocity_prior(txn: DataFrame, tie: Sequence[str], **kw) -> DataFrame:
    """O-10/O-11: prior row count and first-transaction flag."""
    s = _scan(txn, tie, **kw)
    return (s.withColumn("velocity_score", F.col("_prior_n").cast("bigint"))
            .withColumn("is_first_transaction", (F.col("_prior_n") == 0).cast("int"))
            .drop("_prior_n", "_prev_t"))


def _tslt(ts: str = "ts") -> Column:
    # First row (no previous), null timestamps and out-of-order rows -> 0.
    return F.coalesce(F.greatest(F.lit(0.0), seconds_between(F.col("_prev_t"), F.col(ts))),
                      F.lit(0.0))


def time_since_last(txn: DataFrame, tie: Sequence[str], ts: str = "ts", **kw) -> DataFrame:
    """O-12: seconds since the account's previous transaction (>= 0)."""
    s = _scan(txn, tie, ts=ts, **kw)
    return s.withColumn("time_since_last_transaction", _tslt(ts)).drop("_prior_n", "_prev_t")


def _std(nv: Column, m2: Column) -> Column:
    # Sample std of earlier amounts; 1.0 below two values, floored at 1.0.
    return F.when(nv < 2, F.lit(1.0)).otherwise(
        F.greatest(F.sqrt(F.greatest(m2 / (nv - 1), F.lit(0.0))), F.lit(1.0)))


def _z(amount: str = "amount") -> Column:
    nv = F.col("_prior_nv")
    return F.when(nv < 2, F.lit(0.0)).otherwise(
        (F.col(amount) - F.col("_prior_mean")) / _std(nv, F.col("_prior_m2")))


def running_amount_stats(txn: DataFrame, tie: Sequence[str], amount: str = "amount",
                         **kw) -> DataFrame:
    """O-13: running mean and sample std (floor 1.0) of earlier amounts.

    The mean is the prior sum over the prior count; pass a decimal amount
    (money) to get an exactly summed mean.
    """
    s = _scan(txn, tie, value=amount, **kw)
    mean = F.col("_prior_sum").cast("double") / F.col("_prior_nv")
    return (s.withColumn("prior_mean", F.coalesce(mean, F.lit(0.0)))
            .withColumn("prior_std", _std(F.col("_prior_nv"), F.col("_prior_m2")))
            .drop("_prior_n", "_prev_t", "_prior_nv", "_prior_sum", "_prior_mean", "_prior_m2"))


def spending_zscore(txn: DataFrame, tie: Sequence[str], amount: str = "amount",
                    **kw) -> DataFrame:
    """O-14: (amount - prior mean) / prior std; 0 below two earlier rows."""
    s = _scan(txn, tie, value=amount, **kw)
    return (s.withColumn("spending_deviation_score", _z(amount))
            .drop("_prior_n", "_prev_t", "_prior_nv", "_prior_sum", "_prior_mean", "_prior_m2"))


def first_seen(txn: DataFrame, tie: Sequence[str], cols: dict[str, str], **kw) -> DataFrame:
    """O-15/O-16/O-17/O-21/O-31: ``{output: column}`` -> 1 when the account
    has never used that value before this row."""
    s = _scan(txn, tie, firsts=list(dict.fromkeys(cols.values())), **kw)
    for out, c in cols.items():
        s = s.withColumn(out, F.col(f"_first_{c}").cast("int"))
    return s.drop("_prior_n", "_prev_t", *[f"_first_{c}" for c in set(cols.values())])


def cross_flags(txn: DataFrame) -> DataFrame:
    """O-18: cross-bank and cross-currency transfer flags (no shuffle)."""
    cur = (F.col("payment_currency") != F.col("receiving_currency")).cast("int") \
        if "payment_currency" in txn.columns else F.lit(0)
    return (txn.withColumn("is_cross_bank_transfer", (F.col("from_bank") != F.col("to_bank")).cast("int"))
            .withColumn("is_cross_currency_transfer", cur))


def calendar_features(txn: DataFrame, ts: str = "ts") -> DataFrame:
    """O-19: hour, day_of_week (Mon=0), month, is_weekend."""
    return txn.select("*", *batch_calendar(ts))


def feature_rows(txn: DataFrame, tie: Sequence[str], keep: Sequence[str] = (),
                 with_currency: bool = False, **kw) -> DataFrame:
    """O-20: the full 16-column feature row, one pass over the data.

    ``keep`` adds identifier columns (e.g. the tie columns) to the output;
    ``with_currency`` also emits ``is_new_currency`` (O-21).
    """
    firsts = ["receiver", "to_bank", "payment_channel"]
    if with_currency:
        firsts.append("payment_currency")
    s = _scan(txn, tie, value="amount", firsts=firsts, **kw)
    has_cur = "payment_currency" in txn.columns
    cols = [
        *[F.col(k) for k in keep],
        F.col("amount"),
        F.col("payment_channel"),
        _tslt().alias("time_since_last_transaction"),
        F.col("_prior_n").cast("bigint").alias("velocity_score"),
        _z().alias("spending_deviation_score"),
        (F.col("_prior_n") == 0).cast("int").alias("is_first_transaction"),
        *batch_calendar("ts"),
        F.col("is_fraud").cast("int").alias("is_fraud"),
        (F.col("from_bank") != F.col("to_bank")).cast("int").alias("is_cross_bank_transfer"),
        ((F.col("payment_currency") != F.col("receiving_currency")).cast("int")
         if has_cur else F.lit(0)).alias("is_cross_currency_transfer"),
        F.col("_first_receiver").cast("int").alias("is_new_receiver"),
        F.col("_first_to_bank").cast("int").alias("is_new_bank"),
        F.col("_first_payment_channel").cast("int").alias("is_new_payment_format"),
    ]
    if with_currency:
        cols.append(F.col("_first_payment_currency").cast("int").alias("is_new_currency"))
    return s.select(*cols)


def full_history_features(txn: DataFrame, tie: Sequence[str], account: str = "account",
                          ts: str = "ts", amount: str = "amount", **kw) -> DataFrame:
    """O-22: the leaky whole-history variants, named ``*_full_history``.

    Count and gap come from the same past-only scan (inclusive count,
    unclamped gap, 0 for the first row).  The z-score uses the mean and
    sample std of the *whole* account history (std null -> 1, 0/0 -> 0):
    a pre-aggregated per-account table joined back (AQE splits a skewed
    account on the large side).
    """
    s = _scan(txn, tie, account=account, ts=ts, **kw)
    stats = txn.groupBy(account).agg(F.avg(amount).alias("_avg"),
                                     F.stddev_samp(amount).alias("_sd"))
    s = s.join(stats, account)
    diff = F.col(amount) - F.col("_avg")
    sd = F.coalesce(F.col("_sd"), F.lit(1.0))
    z = F.when((diff == 0) & (sd == 0), F.lit(0.0)).otherwise(diff / sd)
    return (s.withColumn("velocity_full_history", (F.col("_prior_n") + 1).cast("bigint"))
            .withColumn("time_since_last_full_history",
                        F.coalesce(seconds_between(F.col("_prev_t"), F.col(ts)), F.lit(0.0)))
            .withColumn("spending_deviation_full_history", F.coalesce(z, F.lit(0.0)))
            .drop("_prior_n", "_prev_t", "_avg", "_sd"))


def missing_history_encoding(df: DataFrame, tslt: str = "time_since_last_transaction") -> DataFrame:
    """O-23: ``is_first_transaction`` = gap is null; null gaps become -1."""
    return (df.withColumn("is_first_transaction", F.col(tslt).isNull().cast("int"))
            .withColumn(tslt, F.coalesce(F.col(tslt), F.lit(-1.0))))


def training_projection(raw: DataFrame, amount: str = "amount", fmt: str = "payment_channel",
                        to_bank: str = "to_bank", recv_cur: str = "receiving_currency",
                        from_bank: str = "from_bank", ts: str = "ts",
                        label: str = "is_fraud", keep: Sequence[str] = ()) -> DataFrame:
    """O-24: raw transfer -> simple training frame (renames, string casts,
    one source column reused for two outputs)."""
    return raw.select(
        *[F.col(k) for k in keep],
        F.col(amount).alias("amount"),
        F.col(fmt).alias("transaction_type"),
        F.col(to_bank).cast("string").alias("merchant_category"),
        F.col(recv_cur).cast("string").alias("location"),
        F.col(from_bank).cast("string").alias("device_used"),
        F.col(fmt).alias("payment_channel"),
        *batch_calendar(ts),
        F.col(label).alias("target"),
    )


def drop_columns(df: DataFrame, cols: Sequence[str] = LEGACY_DROP_COLUMNS,
                 strict: bool = True) -> DataFrame:
    """O-25: drop identifier/leaky columns; missing ones are an error when strict."""
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*cols)


def parse_timestamps(df: DataFrame, col: str, out: str = "parsed_ts",
                     formats: Sequence[str] | None = None) -> DataFrame:
    """O-26: mixed-format timestamp strings -> timestamp (failures -> null)."""
    return df.withColumn(out, parse_timestamp(col, formats) if formats else parse_timestamp(col))
