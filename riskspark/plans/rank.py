"""Exact positions in a global order, per group, without one-task windows.

``positions`` range-partitions on ``(group, order...)`` (balanced by
sampling, whatever the skew), sorts inside each partition, and reads the
row's index inside its partition from ``monotonically_increasing_id`` (the
lower 33 bits).  Per (partition, group) counts form a table of at most
``partitions x groups`` rows; their exclusive running sum is the offset
of each partition's first row of the group.

The range bounds come from sampling, and a sample depends on the order in
which rows arrive from upstream shuffles; so the tagged rows are
materialised with a reliable checkpoint (shared ``spark.checkpoint.dir``)
before counts and positions are derived from them.  Both then read the
same rows, task retries and executor loss included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import cut_lineage

LOW_BITS = 1 << 33


def positions(df: DataFrame, order: Sequence[Column | str], group: str | None = None,
              parts: int | None = None, out: str = "_pos", sizes: bool = True) -> DataFrame:
    """Add ``out`` = 0-based position inside ``group`` (or the whole table)
    in ``order``; with ``sizes`` also ``_group_n`` (rows of the group)."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = ([F.col(group)] if group else []) + o
    g = [group] if group else []
    r = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_loc", F.monotonically_increasing_id() - F.col("_pid").cast("long") * LOW_BITS))
    r = cut_lineage(r)
    counts = r.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_c"), F.min("_loc").alias("_first"))
    wg = Window.partitionBy(*g) if g else Window.partitionBy()
    offs = counts.select(
        "_pid", *g, "_first",
        F.coalesce(F.sum("_c").over(wg.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        *([F.sum("_c").over(wg).alias("_group_n")] if sizes else []))  # <= parts x groups rows
    if group:  # null groups count too; Spark decides by size how to join
        offs = offs.withColumnsRenamed({"_pid": "_opid", group: "_og"})
        j = r.join(offs, (F.col("_pid") == F.col("_opid")) & F.col(group).eqNullSafe(F.col("_og"))).drop("_opid", "_og")
    else:
        j = r.join(F.broadcast(offs), "_pid")  # one row per partition
    return j.withColumn(out, F.col("_loc") - F.col("_first") + F.col("_off")).drop(
        "_pid", "_loc", "_first", "_off")
