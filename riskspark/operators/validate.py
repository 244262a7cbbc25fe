"""Request and dataset validation (O-03, O-113..O-116)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.rules import feature_range_rules, flag_array, validation_rules


def validate_requests(df: DataFrame, rules=None, out: str = "rejection_codes") -> tuple[DataFrame, DataFrame]:
    """O-03: (valid rows, rejected rows with their ordered reason codes)."""
    coded = df.withColumn(out, flag_array(rules or validation_rules()))
    return coded.where(F.size(out) == 0).drop(out), coded.where(F.size(out) > 0)


def column_report(df: DataFrame, expected: Sequence[str] | None = None) -> DataFrame:
    """O-113: one row per column (present or expected): dtype, present,
    expected, null count and percentage - one wide aggregate, unpivoted."""
    cols = df.columns
    names = list(dict.fromkeys([*cols, *(expected or [])]))
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}") for i, c in enumerate(cols)]
    a = df.agg(*aggs)
    types = dict(df.dtypes)
    rows = []
    for c in names:
        present = c in cols
        nulls = F.col(f"_null_{cols.index(c)}") if present else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(types.get(c)).alias("dtype"),
                             F.lit(present).alias("present"),
                             F.lit(expected is None or c in expected).alias("expected"),
                             nulls.alias("null_count"),
                             (nulls * 100.0 / F.col("_n")).alias("null_pct")))
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def dataset_report(df: DataFrame, label: str) -> DataFrame:
    """O-113: rows, class counts and ratio, exact duplicate rows and share.

    Duplicates are found with a ``groupBy`` over all columns (partial
    aggregation collapses copies map-side before the shuffle)."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    a = g.agg(F.sum("_c").alias("rows"), F.sum(F.col("_c") - 1).alias("duplicates"),
              F.sum(F.when(F.col(label) == 1, F.col("_c")).otherwise(0)).alias("positives"),
              F.sum(F.when(F.col(label) == 0, F.col("_c")).otherwise(0)).alias("negatives"))
    return a.select("rows", "positives", "negatives",
                    (F.col("positives") / F.col("rows")).alias("positive_ratio"),
                    F.coalesce(F.col("duplicates"), F.lit(0)).alias("duplicates"),
                    (F.coalesce(F.col("duplicates"), F.lit(0)) * 100.0 / F.col("rows")).alias("duplicate_pct"))


def schema_integrity(parts: dict[str, DataFrame], total: DataFrame | None = None) -> dict:
    """O-114: same schema in every split and row counts that add up."""
    schemas = {k: v.schema.simpleString() for k, v in parts.items()}
    counts = {k: v.count() for k, v in parts.items()}
    out = {"schemas_equal": len(set(schemas.values())) == 1, "counts": counts}
    if total is not None:
        out["total"] = total.count()
        out["counts_add_up"] = sum(counts.values()) == out["total"]
    return out


def content_checksum(df: DataFrame) -> DataFrame:
    """O-115: order-insensitive fingerprint: row count and the sum (as a
    wide decimal, so no overflow) of a 64-bit hash of every row."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("checksum"))


def range_checks(df: DataFrame, rules=None) -> DataFrame:
    """O-116: violations per rule (one conditional aggregate per rule)."""
    rules = rules or feature_range_rules()
    a = df.agg(*[F.count_if(pred).alias(f"_r{i}") for i, (_, pred) in enumerate(rules)])
    pairs = ", ".join(f"'{code}', _r{i}" for i, (code, _) in enumerate(rules))
    return a.selectExpr(f"stack({len(rules)}, {pairs}) AS (check_name, violations)")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType,
                                       T.ShortType, T.DecimalType))]
