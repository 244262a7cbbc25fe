"""Online history and user-baseline operators (O-30..O-46).

The reference issues 7 + 6 point queries per transaction; here each
history question is one keyed aggregate or one past-only window over all
transactions.  Baseline aggregates are ``groupBy(user)`` with map-side
partial aggregation, so a user holding a large share of the rows costs a
combiner row per task, not one huge task.  Modes use ``min`` over a
``struct(-count, value)`` (also partial-aggregated) rather than a window
over all of a user's rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.calendar import online_calendar, seconds_between
from riskspark.functions.numeric import exact_mean, round_half_away
from riskspark.functions.rules import flag_array, risk_flag_rules
from riskspark.plans.prior import CHUNK, DEFAULT_CHUNK_ROWS, chunked, prior_scan


def velocity_1h(txn: DataFrame, user: str = "account", ts: str = "ts",
                tie: Sequence[str] = ("row_id",), chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """O-30: earlier rows of the user with ``ts >= this ts - 1 hour``.

    = rows before this one minus rows strictly older than one hour, both
    window counts of the account (one exchange).  Accounts above
    ``chunk_rows`` rows take ``hour_probes`` instead.
    """
    cold, hot = chunked(txn, user, [ts, *tie], chunk_rows)
    out = older_than_hour(cold, user, ts, "_older")
    w = Window.partitionBy(user, CHUNK).orderBy(ts, *tie)
    out = out.withColumn("velocity_1h", (F.row_number().over(w) - 1 - F.col("_older")).cast("bigint")).drop("_older", CHUNK)
    if hot is None:
        return out
    return out.unionByName(hot.drop(CHUNK).join(hour_probes(hot, user, ts, tie, chunk_rows), list(tie)))


def older_than_hour(txn: DataFrame, user: str, ts: str, out: str) -> DataFrame:
    """Rows of the user (and chunk) more than an hour before each row."""
    frame = (f"count(1) OVER (PARTITION BY `{user}`, {CHUNK} ORDER BY `{ts}` RANGE BETWEEN UNBOUNDED PRECEDING "
             "AND INTERVAL '01:00:00.000001' HOUR TO SECOND PRECEDING)")
    return txn.withColumn(out, F.expr(frame))


def hour_probes(txn: DataFrame, user: str, ts: str, tie: Sequence[str], chunk_rows: int) -> DataFrame:
    """(tie, velocity_1h) without a per-user window: every row also emits a
    probe at ``ts - 1 h - 1 us`` ordered after real rows of equal time; one
    skew-safe ``prior_scan`` over rows and probes counts the real rows before
    each (probes carry a null value, so they are not counted), and the
    difference is taken on the row key (uniform keys, no skew).
    """
    order_cols = [ts, "_kind", *tie]
    # each row and its probe from one generator (no union of literal branches)
    pair = F.explode(F.array(
        F.struct(F.col(ts).alias("t"), F.lit(0).alias("k")),
        F.struct((F.col(ts) - F.expr("INTERVAL 3600000001 MICROSECONDS")).alias("t"), F.lit(1).alias("k"))))
    both = (txn.select(user, *tie, pair.alias("_p"))
            .select(user, *tie, F.col("_p.t").alias(ts), F.col("_p.k").alias("_kind"))
            .withColumn("_one", F.when(F.col("_kind") == 0, F.lit(1))))
    s = prior_scan(both, user, order_cols, value="_one", chunk_rows=chunk_rows)
    # both counts of a row in one aggregation: rows count up, probes down
    sign = F.when(F.col("_kind") == 0, F.col("_prior_nv")).otherwise(-F.col("_prior_nv"))
    return s.groupBy(*tie).agg(F.sum(sign).cast("bigint").alias("velocity_1h"))


def seen_before(txn: DataFrame, cols: dict[str, str], user: str = "account", ts: str = "ts",
                tie: Sequence[str] = ("row_id",), chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """O-31 row-wise: ``{out: col}`` -> true when an earlier row of the user
    had the same value (EXISTS over the past)."""
    s = prior_scan(txn, user, [ts, *tie], firsts=list(dict.fromkeys(cols.values())), chunk_rows=chunk_rows)
    for out, c in cols.items():
        s = s.withColumn(out, ~F.col(f"_first_{c}"))
    return s.drop("_prior_n", "_prev_t", *[f"_first_{c}" for c in set(cols.values())])


def exists_lookup(probes: DataFrame, history: DataFrame, keys: Sequence[str],
                  out: str = "seen", as_of: Sequence[str] = ()) -> DataFrame:
    """O-31 ad hoc: flag probes whose ``keys`` exist in ``history``
    (EXISTS as a column); with ``as_of`` (time, ties) only rows of the
    history that stand before the probe count.  The history side is reduced
    to one row per key, its first (map-side), before one left join;
    ``existing`` / ``missing`` give the semi- and anti-join forms."""
    at = F.struct(*[F.col(c) for c in as_of]) if as_of else F.lit(True)
    first = history.groupBy(*keys).agg(F.min(at).alias("_first"))
    found = F.col("_first").isNotNull()
    return (probes.join(first, list(keys), "left").withColumn(out, F.coalesce(found & (F.col("_first") < at), F.lit(False)) if as_of else found)
            .drop("_first"))


def existing(probes: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probes with a match in ``history`` (left semi join, EXISTS)."""
    return probes.join(history.select(*keys), list(keys), "left_semi")


def missing(probes: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probes without a match in ``history`` (left anti join, NOT EXISTS)."""
    return probes.join(history.select(*keys), list(keys), "left_anti")


def merchant_frequency(txn: DataFrame, user: str = "account", merchant: str = "merchant",
                       ts: str = "ts", tie: Sequence[str] = ("row_id",),
                       chunk_rows: int = DEFAULT_CHUNK_ROWS, seen: dict[str, str] | None = None,
                       keep_prev: bool = False) -> DataFrame:
    """O-32: earlier rows with this merchant / earlier rows (0 if none).

    Two skew-safe prefix counts: per user and per (user, merchant) (a hot
    pair is chunked like a hot user).  ``seen`` ({out: column}) adds O-31
    seen-before flags from the same per-user scan (no extra shuffle);
    ``keep_prev`` keeps the user's previous timestamp as ``_prev_ts``.
    """
    order = [ts, *tie]
    seen = seen or {}
    firsts = list(dict.fromkeys(seen.values()))
    a = prior_scan(txn, user, order, firsts=firsts, chunk_rows=chunk_rows)
    for out, c in seen.items():
        a = a.withColumn(out, ~F.col(f"_first_{c}"))
    a = a.withColumnRenamed("_prev_t", "_prev_ts") if keep_prev else a.drop("_prev_t")
    a = (a.drop(*[f"_first_{c}" for c in firsts]).withColumnRenamed("_prior_n", "_pu")
         .withColumn("_um", F.struct(F.col(user).alias("u"), F.col(merchant).alias("m"))))
    b = prior_scan(a, "_um", order, chunk_rows=chunk_rows).withColumnRenamed("_prior_n", "_pm").drop("_prev_t", "_um")
    freq = F.when(F.col("_pu") == 0, F.lit(0.0)).otherwise(F.col("_pm") / F.col("_pu"))
    return b.withColumn("merchant_frequency", freq).drop("_pu", "_pm")


def _mode(txn: DataFrame, user: str, col: str, out: str, rows: Column | None = None) -> DataFrame:
    """Most frequent value per user; ties -> smallest value (deterministic).
    ``rows`` counts the rows behind a pre-aggregated one."""
    counts = txn.groupBy(user, col).agg((F.count(F.lit(1)) if rows is None else rows).alias("_n"))
    best = counts.groupBy(user).agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col(col).alias("v"))).alias("_b"))
    return best.select(user, F.col("_b.v").alias(out))


def amount_stats(txn: DataFrame, user: str = "account", amount: str = "amount",
                 status: str | None = "status", only: str | None = "PENDING") -> DataFrame:
    """O-33: avg amount and population std (null -> 0) over the user's rows
    (only ``PENDING`` ones by default)."""
    src = txn.filter(F.col(status) == only) if status and only else txn
    return src.groupBy(user).agg(
        exact_mean(amount).alias("average_amount"),
        F.coalesce(F.stddev_pop(amount), F.lit(0.0)).alias("transaction_std_dev"))


def avg_daily_count(txn: DataFrame, user: str = "account", ts: str = "ts",
                    status: str | None = "status", only: str | None = "PENDING") -> DataFrame:
    """O-34: average of per-day counts over days with rows (two-level agg)."""
    src = txn.filter(F.col(status) == only) if status and only else txn
    daily = src.groupBy(user, F.to_date(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    return daily.groupBy(user).agg(F.avg(F.col("_c").cast("double")).alias("average_daily_count"))


def preferred_method(txn: DataFrame, user: str = "account", method: str = "payment_channel") -> DataFrame:
    """O-35: most used payment method per user."""
    return _mode(txn, user, method, "preferred_payment_method")


def usual_city(txn: DataFrame, user: str = "account", location: str = "location") -> DataFrame:
    """O-36: most frequent non-null location per user."""
    return _mode(txn.filter(F.col(location).isNotNull()), user, location, "usual_city")


def active_hours(txn: DataFrame, user: str = "account", ts: str = "ts") -> DataFrame:
    """O-37: earliest and latest hour of day; 0 / 23 when unknown."""
    return txn.groupBy(user).agg(
        F.coalesce(F.min(F.hour(ts)), F.lit(0)).alias("active_hour_start"),
        F.coalesce(F.max(F.hour(ts)), F.lit(23)).alias("active_hour_end"))


def user_baselines(txn: DataFrame, user: str = "account", amount: str = "amount",
                   ts: str = "ts", method: str = "payment_channel", location: str = "location",
                   status: str = "status", only: str = "PENDING",
                   stamp: Column | None = None) -> DataFrame:
    """O-38: one baseline row per user.

    Users without ``PENDING`` rows get zero statistics; average and std are
    stored at 2 decimals, the daily average is truncated to an integer, the
    merchant category is always ''.  Every part is a per-user aggregate, so
    the joins below are between tables of one row per user.
    """
    counted = F.when(F.col(status) == only, F.col(amount))
    users = txn.groupBy(user).agg(
        F.coalesce(F.min(F.hour(ts)), F.lit(0)).alias("active_hour_start"),
        F.coalesce(F.max(F.hour(ts)), F.lit(23)).alias("active_hour_end"),
        F.max(ts).alias("_last_ts"),
        F.when(F.count(counted) > 0, exact_mean(counted)).alias("average_amount"),
        F.coalesce(F.stddev_pop(counted), F.lit(0.0)).alias("transaction_std_dev"))
    # one small table for the daily average and both modes: a row for each
    # day, method and place of a user
    cells = txn.groupBy(user, F.to_date(ts).alias("_day"), F.col(method).alias("_method"),
                        F.col(location).cast("string").alias("_place")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col(status) == only).alias("_counted"))
    days = (cells.where("_counted > 0").groupBy(user, "_day").agg(F.sum("_counted").alias("_c"))
            .groupBy(user).agg(F.avg(F.col("_c").cast("double")).alias("average_daily_count")))
    b = (users.join(days, user, "left")
         .join(_mode(cells, user, "_method", "preferred_payment_method", F.sum("_c")), user, "left")
         .join(_mode(cells.where("_place is not null"), user, "_place", "usual_city", F.sum("_c")), user, "left"))
    has = F.col("average_amount").isNotNull()
    return b.select(
        F.col(user).alias("user_id"),
        F.when(has, round_half_away(F.col("average_amount"), 2)).otherwise(0.0)
        .cast("decimal(12,2)").alias("average_amount"),
        F.when(has, round_half_away(F.col("transaction_std_dev"), 2)).otherwise(0.0)
        .cast("decimal(12,2)").alias("transaction_std_dev"),
        F.when(has, F.coalesce(F.col("average_daily_count"), F.lit(0.0))).otherwise(0.0)
        .cast("int").alias("average_daily_transactions"),
        F.coalesce(F.col("preferred_payment_method"), F.lit("")).alias("preferred_payment_method"),
        F.lit("").alias("preferred_merchant_category"),
        F.coalesce(F.col("usual_city"), F.lit("")).alias("usual_city"),
        F.col("active_hour_start").cast("short").alias("active_hour_start"),
        F.col("active_hour_end").cast("short").alias("active_hour_end"),
        (stamp if stamp is not None else F.col("_last_ts")).alias("last_updated"),
    )


def upsert_baselines(old: DataFrame, new: DataFrame, key: str = "user_id") -> DataFrame:
    """O-39: insert-or-replace whole rows by key (new wins), as a full outer
    join; ``source`` tells which side each row came from."""
    cols = [c for c in new.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("_o"))
    n = new.select(key, F.struct(*cols).alias("_n"))
    j = o.join(n, key, "full_outer")
    row = F.when(F.col("_n").isNotNull(), F.col("_n")).otherwise(F.col("_o"))
    return j.select(key, *[row[c].alias(c) for c in cols],
                    F.when(F.col("_n").isNotNull(), "new").otherwise("old").alias("source"))


def lookup_baseline(txn: DataFrame, baselines: DataFrame, user: str = "account",
                    key: str = "user_id") -> DataFrame:
    """O-40: attach the user's baseline; no baseline -> nulls (left join).

    The baseline table has one row per user; the planner (AQE) broadcasts
    it only when its measured size is small.
    """
    b = baselines.withColumnRenamed(key, "_bkey").withColumn("_has_baseline", F.lit(True))
    return (txn.join(b, txn[user] == b["_bkey"], "left").drop("_bkey")
            .withColumn("_has_baseline", F.coalesce(F.col("_has_baseline"), F.lit(False))))


def baseline_deviation(df: DataFrame, amount: str = "amount") -> DataFrame:
    """O-41: (x-avg)/avg (0 if avg=0) and (x-avg)/sd (0 if sd<=0 or none)."""
    avg = F.col("average_amount").cast("double")
    sd = F.col("transaction_std_dev").cast("double")
    x = F.col(amount)
    return (df.withColumn("amount_deviation",
                          F.when(F.col("_has_baseline") & (avg != 0), (x - avg) / avg).otherwise(0.0))
            .withColumn("amount_z_score",
                        F.when(F.col("_has_baseline") & (sd > 0), (x - avg) / sd).otherwise(0.0)))


def change_flags(df: DataFrame, method: str = "payment_channel", location: str = "location",
                 hour: str = "hour_of_day") -> DataFrame:
    """O-42: payment method / city / active-hours changes vs the baseline
    (false when the user has no baseline)."""
    hb = F.col("_has_baseline")
    return (df.withColumn("payment_method_changed",
                          hb & F.coalesce(F.col(method) != F.col("preferred_payment_method"), F.lit(True)))
            .withColumn("outside_usual_city",
                        hb & F.coalesce(F.col(location).cast("string") != F.col("usual_city"), F.lit(True)))
            .withColumn("outside_active_hours",
                        hb & ((F.col(hour) < F.col("active_hour_start"))
                              | (F.col(hour) > F.col("active_hour_end")))))


def online_features(txn: DataFrame, baselines: DataFrame, history: DataFrame | None = None,
                    user: str = "account", ts: str = "ts", tie: Sequence[str] = ("row_id",),
                    device: str | None = None, with_gap: bool = False) -> DataFrame:
    """O-45: the online feature vector, using only pre-transaction state.

    ``baselines`` is the snapshot taken before these transactions;
    ``history`` (default: ``txn`` itself) supplies the past-only counters
    (velocity_1h, merchant/device/location seen before, merchant frequency).
    The reference always sends a 0 gap online; ``with_gap`` fills
    ``time_since_last_transaction`` with the O-12 value instead.
    """
    hist = history if history is not None else txn
    seen = {"new_merchant": "merchant", "new_location": "location"}
    if device:
        seen["new_device"] = device
    h = velocity_1h(hist, user, ts, tie)
    h = merchant_frequency(h, user, "merchant", ts, tie, seen={f"_{k}": v for k, v in seen.items()},
                           keep_prev=with_gap)
    gap = (F.coalesce(F.greatest(F.lit(0.0), seconds_between(F.col("_prev_ts"), F.col(ts))), F.lit(0.0))
           if with_gap else F.lit(0.0))
    h = h.withColumn("_gap", gap)
    for k in seen:
        h = h.withColumn(k, ~F.col(f"_{k}")).drop(f"_{k}")
    if not device:
        h = h.withColumn("new_device", F.lit(False))
    if history is not None:
        h = h.join(txn.select(*tie), list(tie), "left_semi")
    return _vector(lookup_baseline(h.select("*", *online_calendar(ts)), baselines, user), user, tie)


def running_online_features(txn: DataFrame, user: str = "account", ts: str = "ts", tie: Sequence[str] = ("row_id",),
                            with_gap: bool = False, keep: Sequence[str] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """O-45 for every transaction, each against the baseline and the history
    of its account's rows before it (no snapshot, no cutoff)."""
    from riskspark.operators.running import running_baselines

    return running_vector(running_baselines(txn, user, ts=ts, tie=tie, chunk_rows=chunk_rows), user, ts, tie, with_gap, keep)


def running_vector(f: DataFrame, user: str, ts: str, tie: Sequence[str], with_gap: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """O-45 from rows that carry their running baseline (batch or stream)."""
    f = f.select("*", *online_calendar(ts))
    gap = F.coalesce(F.greatest(F.lit(0.0), seconds_between(F.col("_prev_ts"), F.col(ts))), F.lit(0.0)) if with_gap else F.lit(0.0)
    return _vector(f.withColumns({"_gap": gap, "new_merchant": ~F.col("merchant_seen"), "new_location": ~F.col("location_seen"),
                                  "new_device": F.lit(False)}), user, tie, keep)


def _vector(f: DataFrame, user: str, tie: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    f = change_flags(baseline_deviation(f))
    f = f.withColumn("risk_flags", flag_array(risk_flag_rules()))
    return f.select(
        *tie, *keep, F.col(user).alias("user_id"), "amount", "amount_deviation", "amount_z_score",
        "velocity_1h", "hour_of_day", "day_of_week", "month", "is_weekend",
        "outside_active_hours", (~F.col("_has_baseline")).alias("is_first_transaction"),
        "new_merchant", "new_device", "new_location", "payment_method_changed",
        "outside_usual_city", "merchant_frequency",
        F.lit(0.0).alias("device_trust_score"), F.lit(0.0).alias("merchant_trust_score"),
        F.lit(0.0).alias("location_risk_score"), F.col("_gap").alias("time_since_last_transaction"),
        "risk_flags")


def to_model_input(online: DataFrame, channel: str = "payment_channel",
                   keep: Sequence[str] = ()) -> DataFrame:
    """O-46: online vector -> the 15 model inputs (month repaired to 1..12,
    velocity := velocity_1h, deviation := z, receiver := new merchant,
    format := payment changed, bank/currency := 0)."""
    m = F.col("month")
    return online.select(
        *[F.col(k) for k in keep],
        F.col("amount"), F.col(channel).alias("payment_channel"),
        F.col("time_since_last_transaction"),
        F.col("velocity_1h").cast("double").alias("velocity_score"),
        F.col("amount_z_score").alias("spending_deviation_score"),
        F.col("is_first_transaction").cast("int").alias("is_first_transaction"),
        F.col("hour_of_day").alias("hour"), F.col("day_of_week"),
        F.when((m < 1) | (m > 12) | m.isNull(), F.lit(1)).otherwise(m).alias("month"),
        F.col("is_weekend").cast("int").alias("is_weekend"),
        F.lit(0).alias("is_cross_bank_transfer"), F.lit(0).alias("is_cross_currency_transfer"),
        F.col("new_merchant").cast("int").alias("is_new_receiver"),
        F.lit(0).alias("is_new_bank"),
        F.col("payment_method_changed").cast("int").alias("is_new_payment_format"),
    )


def snapshot_cutoff(txn: DataFrame, ts: str = "ts", frac: float = 0.8) -> datetime:
    """A cutoff at ``frac`` of the time span, truncated to the hour (one
    scalar aggregate, fetched to the driver)."""
    lo, hi = txn.agg(F.min(ts), F.max(ts)).first()
    cut = lo + timedelta(microseconds=int((hi - lo) / timedelta(microseconds=1) * frac))
    return cut.replace(minute=0, second=0, microsecond=0)
