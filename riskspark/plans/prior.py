"""Past-only per-key scans that stay balanced when one key is huge.

A plain ``Window.partitionBy(account)`` puts every row of an account into
one task.  When a single account holds a large share of all rows (a bot, a
clearing account) that task holds that share of the data.  ``prior_scan``
splits such accounts:

1. Rows per key are counted with a pre-aggregated ``groupBy`` (one small
   row per key).  Keys above ``chunk_rows`` rows are *hot*; at most
   ``max_hot_keys`` of them exist (the threshold is raised if needed), so
   the hot-key table has a proven size bound and is broadcast.
2. Cold keys keep one window partition each (chunk 0).  Rows of hot keys
   are range-partitioned on the full, unique sort key ``(key, order...)``
   into ``ceil(hot_rows / chunk_rows)`` balanced ranges; the range id is
   the chunk.  Chunks of a key are consecutive in event order.  The tagged
   hot rows are materialised with a reliable checkpoint, because sampled
   range bounds may differ between two evaluations of the same plan.
3. One window over ``(key, chunk)`` computes chunk-local prefix values.
   A per-chunk summary (count, mean, M2, last timestamp) has at most
   ``chunks + hot keys`` rows; its exclusive prefix over chunks is a window
   on that small table, merged into the local values with Chan's parallel
   variance formula, so mean and variance stay numerically stable.
4. "First occurrence of (key, x)" is chunk-local ``row_number() = 1``; for
   hot chunks it is confirmed against ``min(chunk)`` per ``(key, x)``
   (a pre-aggregated table) joined only to the candidate rows.

The result equals the single-window answer exactly and no task ever holds
more than about ``chunk_rows`` rows of one key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import cut_lineage

CHUNK = "_chunk"
DEFAULT_CHUNK_ROWS = 2_000_000
DEFAULT_MAX_HOT_KEYS = 200_000


def _asc(cols: Sequence[str]):
    return [F.col(c).asc_nulls_last() for c in cols]


def hot_keys(df: DataFrame, key: str, chunk_rows: int = DEFAULT_CHUNK_ROWS,
             max_hot_keys: int = DEFAULT_MAX_HOT_KEYS) -> tuple[DataFrame | None, int]:
    """Return (broadcastable table of hot keys or None, number of chunks)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    stats = counts.agg(
        F.sum("_n").alias("total"),
        F.count_if(F.col("_n") > chunk_rows).alias("hot"),
    ).first()
    if not stats or not stats["hot"]:
        return None, 0
    threshold = chunk_rows
    if stats["hot"] > max_hot_keys:
        # At most max_hot_keys keys can exceed total / max_hot_keys rows.
        threshold = max(chunk_rows, math.ceil(stats["total"] / max_hot_keys))
    hot = counts.filter(F.col("_n") > threshold)
    rows = hot.collect()  # bounded: <= max_hot_keys small rows
    if not rows:
        return None, 0
    hot_rows = sum(r["_n"] for r in rows)
    spark = df.sparkSession
    table = spark.createDataFrame([(r[key],) for r in rows], schema=counts.select(key).schema)
    return table, max(1, math.ceil(hot_rows / chunk_rows))


def chunked(df: DataFrame, key: str, order: Sequence[str], chunk_rows: int = DEFAULT_CHUNK_ROWS,
            max_hot_keys: int = DEFAULT_MAX_HOT_KEYS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of cold keys with ``CHUNK`` 0, rows of hot keys with the chunk
    they are in, None without hot keys)."""
    hot, chunks = hot_keys(df, key, chunk_rows, max_hot_keys)
    if hot is None:
        return df.withColumn(CHUNK, F.lit(0)), None
    hb = F.broadcast(hot.withColumnRenamed(key, "_hk"))
    same = F.col(key).eqNullSafe(F.col("_hk"))  # a null key may be hot as well
    cold = df.join(hb, same, "left_anti").withColumn(CHUNK, F.lit(0))
    # materialised: the sampled range bounds (hence chunk ids) must be
    # identical for the rows, the chunk summaries and the first-seen fixes
    return cold, cut_lineage(df.join(hb, same, "left_semi")
                             .repartitionByRange(chunks, *_asc([key, *order]))
                             .withColumn(CHUNK, F.spark_partition_id() + 1))


def prior_scan(df: DataFrame, key: str, order: Sequence[str], value: str | None = None,
               firsts: Sequence[str] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS,
               max_hot_keys: int = DEFAULT_MAX_HOT_KEYS) -> DataFrame:
    """Add past-only columns per ``key`` in ``order`` (first column = time).

    Adds ``_prior_n`` (rows before), ``_prev_t`` (time of the previous row),
    with ``value``: ``_prior_nv``, ``_prior_mean``, ``_prior_m2`` (over
    earlier non-null values), and ``_first_<x>`` for each ``x`` in
    ``firsts`` (true on the first row of each ``(key, x)``).
    """
    order = list(order)
    t = order[0]
    cold, hot_part = chunked(df, key, order, chunk_rows, max_hot_keys)
    base = cold if hot_part is None else cold.unionByName(hot_part)

    w = Window.partitionBy(key, CHUNK).orderBy(*_asc(order))
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumn("_ln", F.row_number().over(w) - 1).withColumn("_lprev", F.lag(t).over(w))
    if value:
        out = (out.withColumn("_lsum", F.sum(value).over(prior))
               .withColumn("_lnv", F.count(value).over(prior))
               .withColumn("_lmean", F.avg(value).over(prior))
               .withColumn("_lm2", F.var_pop(value).over(prior) * F.col("_lnv")))
    for x in firsts:
        wx = Window.partitionBy(key, CHUNK, x).orderBy(*_asc(order))
        out = out.withColumn(f"_lf_{x}", F.row_number().over(wx) == 1)

    if hot_part is None:
        out = out.withColumn("_prior_n", F.col("_ln")).withColumn("_prev_t", F.col("_lprev"))
        if value:
            out = (out.withColumn("_prior_nv", F.col("_lnv"))
                   .withColumn("_prior_sum", F.col("_lsum"))
                   .withColumn("_prior_mean", F.col("_lmean"))
                   .withColumn("_prior_m2", F.coalesce(F.col("_lm2"), F.lit(0.0))))
        for x in firsts:
            out = out.withColumn(f"_first_{x}", F.col(f"_lf_{x}"))
        return out.drop(CHUNK, "_ln", "_lprev", "_lsum", "_lnv", "_lmean", "_lm2",
                        *[f"_lf_{x}" for x in firsts])

    # Per-chunk summaries of hot keys: <= chunks + hot keys rows.
    aggs = [F.count(F.lit(1)).alias("_cn"), F.max(t).alias("_clast")]
    if value:
        aggs += [F.sum(value).alias("_csum"), F.count(value).alias("_cnv"), F.avg(value).alias("_cmean"),
                 (F.var_pop(value) * F.count(value)).alias("_cm2")]
    summ = hot_part.groupBy(key, CHUNK).agg(*aggs)
    wc = Window.partitionBy(key).orderBy(CHUNK)
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    offs = summ.select(key, CHUNK,
                       F.sum("_cn").over(before).alias("_on"),
                       F.max("_clast").over(before).alias("_olast"),
                       *([F.sum("_csum").over(before).alias("_osum"),
                          F.col("_cnv"), F.col("_cmean"), F.col("_cm2"),
                          F.first("_cmean", ignorenulls=True).over(
                              wc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                          ).alias("_k")] if value else []))
    if value:
        # Shifted sums over earlier chunks (shift = the key's first chunk mean).
        d = F.col("_cmean") - F.col("_k")
        offs = (offs.withColumn("_s0", F.sum("_cnv").over(before))
                .withColumn("_s1", F.sum(F.col("_cnv") * d).over(before))
                .withColumn("_s2", F.sum(F.col("_cm2") + F.col("_cnv") * d * d).over(before))
                .select(key, CHUNK, "_on", "_olast", "_osum",
                        F.col("_s0").alias("_onv"),
                        (F.col("_k") + F.col("_s1") / F.col("_s0")).alias("_omean"),
                        F.greatest(F.lit(0.0), F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_s0")
                                   ).alias("_om2")))
    offs = offs.withColumnsRenamed({key: "_ok", CHUNK: "_oc"})
    out = out.join(F.broadcast(offs), F.col(key).eqNullSafe(F.col("_ok")) & (F.col(CHUNK) == F.col("_oc")),
                   "left").drop("_ok", "_oc")
    out = (out.withColumn("_prior_n", F.col("_ln") + F.coalesce(F.col("_on"), F.lit(0)))
           .withColumn("_prev_t", F.coalesce(F.col("_lprev"), F.col("_olast"))))
    if value:
        na = F.coalesce(F.col("_onv"), F.lit(0))
        nb = F.col("_lnv")
        n = na + nb
        delta = F.col("_lmean") - F.col("_omean")
        out = (out.withColumn("_prior_nv", n)
               .withColumn("_prior_sum", F.when(nb == 0, F.col("_osum")).when(na == 0, F.col("_lsum"))
                           .otherwise(F.col("_osum") + F.col("_lsum")))
               .withColumn("_prior_mean",
                           F.when(na == 0, F.col("_lmean")).when(nb == 0, F.col("_omean"))
                           .otherwise(F.col("_omean") + delta * nb / n))
               .withColumn("_prior_m2",
                           F.when(na == 0, F.coalesce(F.col("_lm2"), F.lit(0.0)))
                           .when(nb == 0, F.col("_om2"))
                           .otherwise(F.col("_om2") + F.col("_lm2") + delta * delta * na * nb / n)))

    if firsts:
        lf_any = F.lit(False)
        for x in firsts:
            lf_any = lf_any | F.col(f"_lf_{x}")
        need_fix = (F.col(CHUNK) > 0) & lf_any
        fix = out.filter(need_fix)
        rest = out.filter(~need_fix)
        for x in firsts:
            fc = (hot_part.groupBy(key, x).agg(F.min(CHUNK).alias(f"_fc_{x}"))
                  .withColumnRenamed(key, "_fk").withColumnRenamed(x, "_fx"))
            fix = (fix.join(fc, fix[key].eqNullSafe(fc["_fk"]) & fix[x].eqNullSafe(fc["_fx"]), "left")
                   .drop("_fk", "_fx"))
            rest = rest.withColumn(f"_fc_{x}", F.lit(None).cast("int"))
        out = rest.unionByName(fix)
        for x in firsts:
            out = out.withColumn(
                f"_first_{x}",
                F.col(f"_lf_{x}") & ((F.col(CHUNK) == 0) | (F.col(f"_fc_{x}") == F.col(CHUNK))))
    internal = [CHUNK, "_ln", "_lprev", "_lsum", "_osum", "_lnv", "_lmean", "_lm2", "_on", "_olast", "_onv",
                "_omean", "_om2", *[f"_lf_{x}" for x in firsts], *[f"_fc_{x}" for x in firsts]]
    return out.drop(*internal)
