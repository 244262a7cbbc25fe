"""O-125 and O-101: repeatable forest with an exact cut, drift by quantile bins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import monitor as mo
from riskspark.operators import train as tr
from riskspark.plans.scan import kth_largest


def points(spark, n=500, parts=4):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.normal()), i % 5) for i in range(n)]
    rows += [(n + i, 9.0 + i, -9.0, 0) for i in range(5)] + [(n + 9, None, float("nan"), None)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, anomaly_input int").repartition(parts)


def test_kth_largest_is_exact(spark):
    v = [3.0, 1.0, 3.0, 2.0, -5.0, 1e9, 3.0, None]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    known = sorted((x for x in v if x is not None), reverse=True)
    for k in range(1, 8):
        want = known[k - 1]
        assert kth_largest(df, "v", k, bins=3) == (want, k - known.index(want))
    assert kth_largest(df, "v", 8) is None and kth_largest(df.where("false"), "v", 1) is None


def test_forest_is_repeatable_and_cut_is_exact(spark):
    one = tr.isolation_forest(points(spark), ["a", "b"], n_trees=40, psi=64, key=["row_id"]).collect()
    two = tr.isolation_forest(points(spark, parts=1).orderBy(F.col("a").desc()), ["a", "b"], n_trees=40, psi=64,
                              key=["row_id"]).collect()
    left, right = ({r.row_id: (r.anomaly_score, r.is_anomaly) for r in rows} for rows in (one, two))
    assert left == right and len(left) == 506
    assert sum(f for _, f in left.values()) == math.ceil(0.036 * 506)
    flagged = min(s for s, f in left.values() if f)
    assert all(s <= flagged for s, f in left.values() if not f)
    assert all(left[i][1] == 1 for i in range(500, 505))


def test_trees_take_the_smallest_draws(spark):
    base = points(spark).select(F.xxhash64("row_id").alias("_id"), F.array(F.lit(1.0)).alias("_x"))
    ids = np.array([r[0] for r in base.select("_id").collect()], dtype=np.int64)
    got = tr._tree_samples(base, len(ids), 7, 32, 42).collect()
    for t in range(7):
        want = sorted((tr._tree_draws(ids, t, 42) >> np.uint64(1)).tolist())[:32]
        assert sorted(r.draw for r in got if r.tree == t)[:32] == want


def test_ties_repeated_rows_and_empty(spark):
    same = spark.createDataFrame([(1, 2.0)] * 50, "row_id long, a double")
    out = tr.isolation_forest(same, ["a"], n_trees=5, psi=8, key=["row_id"])
    assert out.where("is_anomaly = 1").count() == math.ceil(0.036 * 50) and out.count() == 50
    empty = tr.isolation_forest(same.where("false"), ["a"])
    assert empty.count() == 0 and empty.columns == ["row_id", "a", "anomaly_score", "is_anomaly"]


def psi_by_hand(e, a, edges):
    es, as_ = (np.bincount(np.searchsorted(edges, x, side="left"), minlength=len(edges) + 1) / len(x) for x in (e, a))
    es, as_ = np.maximum(es, 1e-6), np.maximum(as_, 1e-6)
    return float(np.sum((as_ - es) * np.log(as_ / es)))


@pytest.mark.parametrize("shift", [0.0, 0.7])
def test_psi_by_quantiles(spark, shift):
    rng = np.random.default_rng(8)
    e, a = rng.lognormal(size=4000), rng.lognormal(mean=shift, size=3000)
    e[0] = 1e12  # one outlier empties equal-width bins, not these
    hours = lambda x: spark.createDataFrame([(float(v), i % 48) for i, v in enumerate(x)], "v double, h int").withColumn(
        "ts", F.timestamp_seconds(F.col("h") * 3600))
    de, da = hours(e), hours(a)
    edges = mo.quantile_edges(de, "v")
    assert edges == sorted(np.sort(e)[[math.ceil(len(e) * i / 10) - 1 for i in range(1, 10)]])
    want = psi_by_hand(e, a, edges)
    assert mo.psi_by_edges(de, da, "v", edges).first()[0] == pytest.approx(want)
    sk, sa = mo.hourly_sketches(de, "v", "ts"), mo.hourly_sketches(da, "v", "ts")
    assert sk.count() == 48
    assert mo.psi_of_sketches(sk, sa).first()[0] == pytest.approx(want, abs=0.02)


def test_psi_edges_of_nulls_and_constants(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert mo.quantile_edges(df, "v") == [1.0]
    assert mo.psi_by_edges(df, df, "v", [1.0]).first()[0] == pytest.approx(0.0)
    assert mo.quantile_edges(df.where("false"), "v") == []
    gone = mo.hourly_sketches(df.where("false").withColumn("ts", F.current_timestamp()), "v", "ts")
    assert mo.psi_of_sketches(gone, gone).first()[0] is None
