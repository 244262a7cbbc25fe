"""Exploratory statistics (O-140..O-150): wide aggregates, unpivoted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.plans.rank import positions
from riskspark.session import cut_lineage


def column_profile(df: DataFrame, cols: Sequence[str], exact_distinct: bool = True) -> DataFrame:
    """O-140: per column null count / %, distinct count, min, max.  Exact
    distinct values are counted column by column: a task holds values of one
    column, not a row of all columns for each."""
    if exact_distinct:
        df = cut_lineage(df.select(*cols))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        dist = F.lit(None) if exact_distinct else F.approx_count_distinct(c)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"_z{i}"), dist.alias(f"_d{i}"),
                 F.min(c).cast("double").alias(f"_lo{i}"), F.max(c).cast("double").alias(f"_hi{i}")]
    a = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_z{i}").alias("null_count"),
                     (F.col(f"_z{i}") * 100.0 / F.col("_n")).alias("null_pct"),
                     F.col(f"_d{i}").cast("long").alias("distinct"),
                     F.col(f"_lo{i}").alias("min"), F.col(f"_hi{i}").alias("max"))
            for i, c in enumerate(cols)]
    out = a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if not exact_distinct:
        return out
    found = None
    for c in cols:
        one = (df.select(F.col(c).alias("_v")).where(F.col("_v").isNotNull()).distinct()
               .agg(F.count(F.lit(1)).alias("_found")).select(F.lit(c).alias("column"), "_found"))
        found = one if found is None else found.unionByName(one)
    return (out.join(F.broadcast(found), "column")  # a row per column
            .select("column", "null_count", "null_pct", F.col("_found").alias("distinct"), "min", "max"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """O-141: exact duplicate rows (copies beyond the first) and share."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    a = g.agg(F.sum("_c").alias("rows"), F.sum(F.col("_c") - 1).alias("duplicates"))
    return a.withColumn("duplicate_pct", F.col("duplicates") * 100.0 / F.col("rows"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """O-142: counts and normalised counts of each value."""
    total = df.count()  # one scalar; no window over the (possibly many) values
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("share", F.col("count") / F.lit(float(total)))


def grouped_describe(df: DataFrame, group: str, col: str, tie: Sequence[str],
                     qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """O-143: count, mean, std, min, quartiles (linear interpolation between
    order statistics), max per group.  Quartiles come from exact positions
    (balanced range partitions), not from buffering a group's values."""
    df = df.select(*dict.fromkeys([group, col, *tie]))  # nothing else is sorted and written
    m = df.groupBy(group).agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
                              F.stddev_samp(col).alias("std"), F.min(col).alias("min"),
                              F.max(col).alias("max"))
    p = positions(df.where(F.col(col).isNotNull()), [col, *tie], group=group)
    aggs = []
    for q in qs:
        h = (F.col("_group_n") - 1).cast("double") * F.lit(q)
        lo, hi = F.floor(h), F.ceil(h)
        vlo = F.max(F.when(F.col("_pos") == lo, F.col(col)))
        vhi = F.max(F.when(F.col("_pos") == hi, F.col(col)))
        frac = F.max(h - lo)
        aggs.append((vlo + (vhi - vlo) * frac).alias(f"p{int(q * 100)}"))
    return m.join(p.groupBy(group).agg(*aggs), group, "left")


def fraud_by_channel(df: DataFrame, channel: str = "payment_channel", label: str = "is_fraud") -> DataFrame:
    """O-144: count, fraud count and rate per channel, highest rate first."""
    g = df.groupBy(channel).agg(F.count(F.lit(1)).alias("count"), F.sum(label).alias("fraud"))
    return g.withColumn("fraud_rate", F.col("fraud") / F.col("count")).orderBy(F.col("fraud_rate").desc())


def hour_class_pivot(df: DataFrame, hour: str = "hour", label: str = "is_fraud") -> DataFrame:
    """O-145: hour x class counts (zero filled) and hourly fraud rate."""
    p = df.groupBy(hour).pivot(label, [0, 1]).count().na.fill(0)
    p = p.withColumnRenamed("0", "legit").withColumnRenamed("1", "fraud")
    return p.withColumn("fraud_rate", F.col("fraud") / (F.col("fraud") + F.col("legit")))


def flag_rates(df: DataFrame, flags: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """O-146: mean of each 0/1 flag per class, transposed (flag rows,
    one column per class)."""
    g = df.groupBy(label).agg(*[F.avg(f).alias(f) for f in flags])
    pairs = ", ".join(f"'{f}', `{f}`" for f in flags)
    long = g.selectExpr(f"`{label}`", f"stack({len(flags)}, {pairs}) AS (flag, rate)")
    return long.groupBy("flag").pivot(label, [0, 1]).agg(F.first("rate")).withColumnRenamed(
        "0", "class_0").withColumnRenamed("1", "class_1")


def log_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """O-147: counts over equal-width bins of log10(x + 1) between its min
    and max (last bin closed), one aggregate."""
    v = F.log10(F.col(col) + 1)
    lo, hi = df.agg(F.min(v), F.max(v)).first()  # two scalars
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, count long")
    span = hi - lo
    b = F.lit(0) if span == 0 else F.least(F.floor((v - F.lit(lo)) * F.lit(float(bins)) / F.lit(span)),
                                           F.lit(bins - 1))
    g = df.where(F.col(col).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("lo", F.lit(lo) + F.col("bin") * F.lit(span / bins))


def pearson(a: str, b: str):
    """Sample Pearson correlation; null (not an error) when a side is constant."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-148: Pearson correlation for every pair of columns (one aggregate
    with k(k-1)/2 ``corr`` terms, unpivoted)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    a = df.agg(*[pearson(x, y).alias(f"_c{i}") for i, (x, y) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_c{i}").alias("corr"))
            for i, (x, y) in enumerate(pairs)]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def label_correlations(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """O-148: correlation of each column with the label, strongest first."""
    a = df.agg(*[pearson(c, label).alias(f"_c{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("corr")) for i, c in enumerate(cols)]
    r = a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return r.orderBy(F.abs("corr").desc_nulls_last())


def overview(df: DataFrame, label: str) -> DataFrame:
    """O-149: rows, class counts, ratio and feature count."""
    n_feat = len([c for c in df.columns if c != label])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("fraud"),
                  F.count_if(F.col(label) == 0).alias("legit")).select(
        "*", (F.col("fraud") / F.col("rows")).alias("fraud_ratio"), F.lit(n_feat).alias("features"))


def split_comparison(parts: dict[tuple[str, str], DataFrame], label: str) -> DataFrame:
    """O-150: rows and class ratio per (strategy, split), from a union of
    the split frames tagged with literals."""
    tagged = None
    for (strategy, split), df in parts.items():
        t = df.select(F.col(label).alias("_y")).withColumn("strategy", F.lit(strategy)).withColumn(
            "split", F.lit(split))
        tagged = t if tagged is None else tagged.unionByName(t)
    return tagged.groupBy("strategy", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_y").alias("fraud_ratio"))
