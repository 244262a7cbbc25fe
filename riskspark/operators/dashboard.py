"""Dashboard and risk-queue queries over prediction records (O-80..O-89).

Global summaries are single aggregates (partial aggregation per task);
top-N and pages use ``orderBy().limit()`` / ``offset()`` which Spark plans
as a per-partition bounded heap (TakeOrderedAndProject), never a global
window on one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 10


def _pct(part: str, total: str, digits: int) -> Column:
    """round(100 * part / total, digits), half up, in exact integer
    arithmetic (as numeric rounding does); null when total = 0."""
    scale = 10 ** digits
    k = F.expr(f"({200 * scale} * {part} + {total}) div (2 * {total})")
    return F.when(F.col(total) != 0, k.cast("decimal(20,0)") / F.lit(scale))


def summary(pred: DataFrame) -> DataFrame:
    """O-80: totals by outcome and fraud rate (percent, 2 places, 0 if empty)."""
    agg = pred.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("prediction")).alias("fraudulent"),
        F.count_if(F.col("decision") == "REVIEW").alias("review"),
        F.count_if(F.col("decision") == "ALLOW").alias("allowed"))
    return agg.withColumn("fraud_rate", F.coalesce(_pct("fraudulent", "total_transactions", 2),
                                                   F.lit(0).cast("decimal(22,2)")))


def hourly_trend(pred: DataFrame, ts: str = "created_at") -> DataFrame:
    """O-81: predictions per truncated hour, labelled ``HH:00`` (labels repeat
    across days), in order of ``hour_start``."""
    h = F.date_trunc("hour", F.col(ts)).cast(dict(pred.dtypes)[ts])  # keep ntz wall-clock hours
    return (pred.groupBy(h.alias("hour_start")).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("hour", F.date_format("hour_start", "HH:00")).orderBy("hour_start"))


def newest_first(pred: DataFrame, ts: str = "created_at", tie: str = "transaction_id") -> DataFrame:
    """O-82: all predictions, newest first (a global range-partitioned sort)."""
    return pred.orderBy(F.col(ts).desc(), F.col(tie).asc())


def by_transaction_id(pred: DataFrame, transaction_id: str) -> DataFrame:
    """O-83: point lookup (predicate pushed to the scan where possible)."""
    return pred.filter(F.col("transaction_id") == transaction_id)


def recent(pred: DataFrame, n: int = 20, ts: str = "created_at", tie: str = "transaction_id",
           status: str | None = None) -> DataFrame:
    """O-84: newest ``n`` rows, optionally only one status (pending N)."""
    src = pred.filter(F.col("status") == status) if status else pred
    return src.orderBy(F.col(ts).desc(), F.col(tie).asc()).limit(n)


def decision_distribution(pred: DataFrame) -> DataFrame:
    """O-85: count per decision and share of all decided rows (1 place)."""
    counts = pred.filter(F.col("decision").isin("ALLOW", "REVIEW", "BLOCK")).groupBy("decision").agg(
        F.count(F.lit(1)).alias("count"))
    # the grouped table has at most three rows: its total is a tiny window
    c = counts.withColumn("_total", F.sum("count").over(Window.partitionBy()))
    return c.withColumn("percent", F.coalesce(_pct("count", "_total", 1), F.lit(0))).drop("_total")


def risk_queue(pred: DataFrame, decision: str | None = None) -> DataFrame:
    """O-86: REVIEW and BLOCK rows, optionally one of them."""
    q = pred.filter(F.col("decision").isin("REVIEW", "BLOCK"))
    return q.filter(F.col("decision") == decision) if decision else q


def risk_queue_counts(pred: DataFrame) -> DataFrame:
    """O-86 tab counts: all risk, review, block (one aggregate)."""
    d = F.col("decision")
    return pred.agg(F.count_if(d.isin("REVIEW", "BLOCK")).alias("all_risk"),
                    F.count_if(d == "REVIEW").alias("review"),
                    F.count_if(d == "BLOCK").alias("block"))


def search(pred: DataFrame, term: str | None = None, decision: str | None = None,
           flags: str = "risk_flags") -> DataFrame:
    """O-87: case-insensitive contains over id, user and any flag, plus an
    optional decision filter."""
    out = pred.filter(F.col("decision") == decision) if decision and decision != "ALL" else pred
    if term:
        t = F.lit(term.lower())
        hit = (F.lower("transaction_id").contains(t) | F.lower("user_id").contains(t)
               | F.exists(F.coalesce(F.col(flags), F.array().cast("array<string>")),
                          lambda f: F.lower(f).contains(t)))
        out = out.filter(hit)
    return out


def sorted_page(pred: DataFrame, field: str = "fraud_probability", ascending: bool = False,
                page: int = 1, size: int = PAGE_SIZE, ts: str = "created_at") -> DataFrame:
    """O-88: sort by probability/id/user (strings case-insensitive), ties keep
    the newest-first order, then take one page."""
    key = F.lower(F.col(field)) if dict(pred.dtypes)[field] == "string" else F.col(field)
    key = key.asc() if ascending else key.desc()
    ordered = pred.orderBy(key, F.col(ts).desc(), F.col("transaction_id").asc())
    return ordered.offset((page - 1) * size).limit(size)


def page_count(pred: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """O-88: number of pages, at least 1."""
    return pred.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("long").alias("pages"))


def review_queue_scan(queue: DataFrame, status: str = "PENDING") -> DataFrame:
    """O-89: open items of the manual review queue, newest first."""
    return queue.filter(F.col("status") == status).orderBy(F.col("created_at").desc(),
                                                            F.col("transaction_id"))
