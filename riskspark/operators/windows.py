"""Anchored fixed windows in batch (O-73 rate limit, O-59 idempotency).

A window opens at the first row of a key, lasts ``length``, and the next
window opens at the first row at or after its end.  The anchors are the
orbit of the key's first row under ``nxt(r)`` = first row with
``t >= t_r + length``: a chain, computed without putting a key on one task.

1. Exact positions of the rows per key (``plans.rank.positions``), and of
   the rows together with one probe per row at ``t_r + length`` (probes sort
   before real rows of the same time).  The real rows before a probe give
   ``nxt(r)``'s position: ``q_probe(r) - p(r)``.
2. Pointer doubling: the anchor set starts as {0} per key and grows with
   ``nxt^(2^i)`` of itself while the jump table is squared, both by joins on
   (key, position), which are unique keys (no skew).  Rounds = log2 of the
   longest chain; each round is checkpointed (cut lineage).
3. Each row's window = the last anchor at or before it: anchors are
   numbered per key, rows count the anchors before them (a skew-safe prefix
   sum), and one equi-join attaches the anchor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.plans.prior import DEFAULT_CHUNK_ROWS, prior_scan
from riskspark.plans.rank import positions
from riskspark.session import cut_lineage


def anchored_windows(df: DataFrame, key: str, ts: str, tie: Sequence[str], seconds: int, limit: int,
                     max_rounds: int = 64, chunk_rows: int = DEFAULT_CHUNK_ROWS, result: bool = False) -> DataFrame:
    """Add ``window_start`` (timestamp of the window's first row),
    ``count_in_window`` and ``allowed = count_in_window <= limit``; with
    ``result`` also the first tie column of the row that opened the window."""
    tie = list(tie)
    # a struct around the key lets null keys join, sort and group like others
    named, key, given = key, "_wkey", df
    df = df.withColumn(key, F.struct(F.col(named)))
    length = F.expr(f"INTERVAL {int(seconds) * 1_000_000} MICROSECONDS")
    real = positions(df.select(key, ts, *tie), [ts, *tie], group=key)        # _pos, _group_n
    pair = F.explode(F.array(F.struct(F.col(ts).alias("t"), F.lit(1).alias("k")),
                             F.struct((F.col(ts) + length).alias("t"), F.lit(0).alias("k"))))
    both = (df.select(key, *tie, pair.alias("_p"))
            .select(key, *tie, F.col("_p.t").alias("_t"), F.col("_p.k").alias("_kind")))
    q = positions(both, ["_t", "_kind", *tie], group=key, out="_q", sizes=False)
    probes = q.where(F.col("_kind") == 0).select(key, *tie, "_q")
    jump = (real.join(probes, [key, *tie])
            .select(key, F.col("_pos").alias("p"), (F.col("_q") - F.col("_pos")).alias("n"),
                    F.col("_group_n").alias("size")))
    anchors = cut_lineage(real.where(F.col("_pos") == 0).select(key, F.col("_pos").alias("p")))
    jump = cut_lineage(jump.where(F.col("n") < F.col("size")).drop("size"))
    n_anchors = anchors.count()
    for _ in range(max_rounds):
        step = (anchors.join(jump, [key, "p"])
                .select(key, F.col("n").alias("p")))
        anchors = cut_lineage(anchors.unionByName(step).distinct())
        grown = anchors.count()
        if grown == n_anchors:  # no chain reached a new anchor: every orbit is complete
            break
        n_anchors = grown
        # square the jump table: n <- n(n)
        j2 = jump.select(key, F.col("p").alias("n"), F.col("n").alias("n2"))
        # chains that have ended are of no more use: no hot (key, null)
        jump = cut_lineage(jump.join(j2, [key, "n"]).where(F.col("n2").isNotNull())
                           .select(key, "p", F.col("n2").alias("n")))
    else:
        raise RuntimeError("anchored_windows: chain longer than 2^max_rounds")

    # window of each row = last anchor at or before it
    flagged = (real.join(anchors.withColumnRenamed("p", "_pos").withColumn("_a", F.lit(1)), [key, "_pos"], "left")
               .withColumn("_a", F.coalesce(F.col("_a"), F.lit(0))))
    s = prior_scan(flagged, key, [ts, *tie], value="_a", chunk_rows=chunk_rows)
    s = s.withColumn("_w", F.coalesce(F.col("_prior_sum"), F.lit(0)) + F.col("_a"))
    numbered = positions(flagged.where(F.col("_a") == 1).select(key, F.col(ts).alias("_ats"),
                                                                   F.col("_pos").alias("_apos"), *tie),
                         ["_ats", *tie], group=key, out="_ord", sizes=False)
    starts = numbered.select(key, (F.col("_ord") + 1).alias("_w"), "_ats", "_apos", F.col(tie[0]).cast("string").alias("result"))
    out = s.join(starts, [key, "_w"])
    count = F.col("_pos") - F.col("_apos") + 1
    res = out.select(key, *tie, F.col("_ats").alias("window_start"), count.alias("count_in_window"),
                     (count <= limit).alias("allowed"), "result")
    return df.join(res, [key, *tie]).select(*given.columns, "window_start", "count_in_window", "allowed", *(["result"] if result else []))
