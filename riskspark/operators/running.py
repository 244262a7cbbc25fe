"""Baselines as of every transaction (O-38, O-40..O-46 without a snapshot).

Each row is judged by the rows of its account before it and never by itself.
All parts of a baseline are prefix states that merge: counts, exact decimal
sums of the amount and its square, least and greatest hour, days begun, and the
running mode. The mode needs no map of counts: the row that brings a value to
its n-th use carries ``(-n, value)``, and the least such pair so far names the
most used value (the smallest of equal ones).

``running_scan`` computes them in one exchange by account. Accounts with more
than ``chunk_rows`` rows are cut into time-ordered chunks (``plans.prior``);
chunk summaries, a row per chunk, carry the state over, so no task holds a
whole hot account.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.numeric import round_half_away
from riskspark.operators.baseline import hour_probes, older_than_hour
from riskspark.plans.prior import CHUNK, DEFAULT_CHUNK_ROWS, chunked
from riskspark.session import cut_lineage

_MERGE = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a + b, a, b),
          "min": F.least, "max": F.greatest}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
#: Chunk summaries of a kind merge by this.
_OVER = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def running_scan(df: DataFrame, key: str, order: Sequence[str], same: Sequence[str] = (),
                 derive: Callable[[DataFrame], DataFrame] | None = None, aggs: Mapping[str, tuple[str, str]] | None = None,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Per row, over the earlier rows of its ``key``: ``_same_<x>`` (rows with
    the same ``x``) for each of ``same``; after ``derive`` (which may use them),
    each of ``aggs`` ({out: (sum|count|min|max, column)}, null without rows);
    ``_recent`` (rows of the last hour; ``order[0]`` is the time)."""
    order, aggs = list(order), dict(aggs or {})
    cold, hot = chunked(df, key, order, chunk_rows)

    def local(part: DataFrame) -> DataFrame:
        for x in same:
            w = Window.partitionBy(key, CHUNK, x).orderBy(*order)
            part = part.withColumn(f"_same_{x}", F.row_number().over(w) - 1)
        return part

    def prefix(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(key, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return part.select("*", *[_AGG[kind](c).over(w).alias(out) for out, (kind, c) in aggs.items()])

    derive = derive or (lambda d: d)
    out = prefix(derive(local(cold)))
    out = older_than_hour(out, key, order[0], "_older")
    if hot is None:
        return _recent(out, key, order).drop(CHUNK, "_older")
    part = local(hot)
    for x in same:  # earlier chunks' rows with the same value
        uses = hot.groupBy(F.col(key).alias("__key"), F.col(x).alias("__value"), F.col(CHUNK).alias("__chunk")).agg(F.count(F.lit(1)).alias("__rows"))
        before = Window.partitionBy("__key", "__value").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        uses = uses.select("__key", "__value", "__chunk", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
        part = (part.join(uses, part[key].eqNullSafe(uses["__key"]) & part[x].eqNullSafe(uses["__value"]) & (part[CHUNK] == uses["__chunk"]))
                .withColumn(f"_same_{x}", (F.col(f"_same_{x}") + F.col("__before")).cast("int")).drop("__key", "__value", "__chunk", "__before"))
    part = cut_lineage(derive(part))
    summary = part.groupBy(F.col(key).alias("__key"), F.col(CHUNK).alias("__chunk")).agg(*[_AGG[kind](c).alias(out) for out, (kind, c) in aggs.items()])
    before = Window.partitionBy("__key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    carried = summary.select("__key", "__chunk", *[_OVER[kind](out).over(before).alias(f"__before_{out}") for out, (kind, _) in aggs.items()])
    local_part = prefix(part)
    merged = local_part.join(F.broadcast(carried), local_part[key].eqNullSafe(carried["__key"]) & (local_part[CHUNK] == carried["__chunk"]))
    for name, (kind, _) in aggs.items():
        merged = merged.withColumn(name, _MERGE[kind](F.col(f"__before_{name}"), F.col(name)).cast(out.schema[name].dataType))
    merged = merged.drop("__key", "__chunk", *[f"__before_{name}" for name in aggs])
    older = hour_probes(part, key, order[0], order[1:], chunk_rows)
    merged = merged.join(older.withColumnRenamed("velocity_1h", "_recent"), order[1:])
    return _recent(out, key, order).drop("_older").unionByName(merged).drop(CHUNK)


def _recent(out: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key, CHUNK).orderBy(*order)
    return out.withColumn("_recent", (F.row_number().over(w) - 1 - F.col("_older")).cast("bigint"))


def running_baselines(txn: DataFrame, user: str = "account", amount: str = "amount", ts: str = "ts", tie: Sequence[str] = ("row_id",),
                      method: str = "payment_channel", location: str = "location", merchant: str = "merchant",
                      status: str = "status", only: str = "PENDING", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``txn`` with the baseline of the rows before each (O-38's columns,
    ``_has_baseline``) and its history: ``velocity_1h``, ``merchant_seen``,
    ``location_seen``, ``merchant_frequency``, ``_prev_ts``."""
    counted = F.col(status) == only
    cents = (F.col(amount).cast("decimal(18,2)") * 100).cast("decimal(20,0)")
    rows = txn.withColumns({
        "_paid": F.when(counted, F.col(amount).cast("decimal(18,2)")), "_cents2": F.when(counted, (cents * cents).cast("decimal(38,0)")),
        "_day": F.when(counted, F.to_date(ts)), "_city": F.col(location).cast("string"), "_hour": F.hour(ts), "_one": F.lit(1)})

    def pairs(d: DataFrame) -> DataFrame:
        use = lambda x: F.struct((-F.col(f"_same_{x}") - 1).alias("k"), F.col(x).alias("v"))
        return d.withColumns({"_m": use(method), "_c": F.when(F.col("_city").isNotNull(), use("_city")),
                              "_begun": F.when(F.col("_day").isNotNull() & (F.col("_same__day") == 0), 1)})

    same = list(dict.fromkeys([method, "_city", merchant, "_day"]))
    s = running_scan(rows, user, [ts, *tie], same, pairs, {
        "_n": ("count", "_one"), "_nv": ("count", "_paid"), "_sum": ("sum", "_paid"), "_sum2": ("sum", "_cents2"), "_days": ("count", "_begun"),
        "_from": ("min", "_hour"), "_to": ("max", "_hour"), "_prev_ts": ("max", ts), "_mode": ("min", "_m"), "_place": ("min", "_c")}, chunk_rows)
    return finished(s.withColumns({"_method": F.col("_mode.v"), "_place": F.col("_place.v"), "_uses": F.col(f"_same_{merchant}"),
                                   "merchant_seen": F.col(f"_same_{merchant}") > 0, "location_seen": F.col("_same__city") > 0})).drop(
        "_paid", "_cents2", "_day", "_city", "_hour", "_one", "_m", "_c", "_begun", "_mode", *[f"_same_{x}" for x in same])


def finished(s: DataFrame) -> DataFrame:
    """The baseline's columns from its prefix state: ``_n`` rows, ``_nv`` paid
    ones with ``_sum`` and ``_sum2`` (squares, in cents), ``_days`` begun,
    ``_from`` and ``_to`` hours, ``_method`` and ``_place`` modes, ``_uses`` of
    the merchant, ``_recent`` rows. Batch and stream end here alike."""
    n, nv = F.coalesce(F.col("_n"), F.lit(0)), F.coalesce(F.col("_nv"), F.lit(0))
    total = (F.col("_sum") * 100).cast("decimal(38,0)")
    # exact up to the root: n * sum of squares - square of the sum
    spread = (F.col("_sum2") * nv.cast("decimal(19,0)")).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    sd = F.sqrt(spread.cast("double")) / nv / 100
    has, paid = n > 0, nv > 0
    money = lambda c: F.when(has, F.when(paid, round_half_away(c, 2)).otherwise(0.0)).cast("decimal(12,2)")
    s = s.withColumns({
        "_has_baseline": has, "average_amount": money(F.col("_sum").cast("double") / nv), "transaction_std_dev": money(sd),
        "average_daily_transactions": F.when(has, F.when(paid, F.floor(nv / F.col("_days"))).otherwise(0)).cast("int"),
        "preferred_payment_method": F.when(has, F.coalesce(F.col("_method"), F.lit(""))),
        "preferred_merchant_category": F.when(has, F.lit("")), "usual_city": F.when(has, F.coalesce(F.col("_place"), F.lit(""))),
        "active_hour_start": F.when(has, F.coalesce(F.col("_from"), F.lit(0))).cast("short"),
        "active_hour_end": F.when(has, F.coalesce(F.col("_to"), F.lit(23))).cast("short"),
        "velocity_1h": F.col("_recent"), "merchant_frequency": F.when(has, F.col("_uses") / n).otherwise(0.0)})
    return s.drop("_n", "_nv", "_sum", "_sum2", "_days", "_from", "_to", "_method", "_place", "_uses", "_recent")
