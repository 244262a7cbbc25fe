"""Golden cases and property tests for decision, baseline, evaluation,
split, rank and monitoring operators (brute force on small fixtures)."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.functions.calendar import online_calendar
from riskspark.functions.rules import decision
from riskspark.operators import baseline as bl
from riskspark.operators import evaluate as ev
from riskspark.operators import monitor as mo
from riskspark.operators import splits as sp
from riskspark.operators import validate as va
from riskspark.plans.rank import positions
from riskspark.plans.scan import running_totals
from tests.conftest import SF001


def test_g10_decision_boundaries(spark):
    cases = {0.0: "ALLOW", 0.10: "ALLOW", 0.29: "ALLOW", 0.30: "REVIEW", 0.31: "REVIEW", 0.50: "REVIEW",
             0.69: "REVIEW", 0.70: "BLOCK", 0.71: "BLOCK", 0.90: "BLOCK", 0.9842: "BLOCK", 0.9843: "BLOCK",
             0.9844: "BLOCK", 1.0: "BLOCK"}
    df = spark.createDataFrame([(p,) for p in cases], "p double")
    got = {r.p: r.d for r in df.select("p", decision(F.col("p")).alias("d")).collect()}
    assert got == cases


def test_g9_online_calendar(spark):
    ts = ["2026-01-01 00:00:00", "2026-02-28 23:59:59", "2026-07-04 12:00:00", "2026-12-31 23:59:59"]
    df = spark.createDataFrame([(t,) for t in ts], "t string").withColumn("ts", F.to_timestamp("t"))
    r = [(x.month, x.hour_of_day, x.is_weekend) for x in df.select(*online_calendar("ts")).collect()]
    assert r == [(1, 0, False), (2, 23, True), (7, 12, True), (12, 23, False)]


def test_g8_baseline_deviation(spark):
    df = spark.createDataFrame([(500.0, 100.0, 50.0, True)],
                               "amount double, average_amount double, transaction_std_dev double, _has_baseline boolean")
    r = bl.baseline_deviation(df).first()
    assert (r.amount_deviation, r.amount_z_score) == (4.0, 8.0)
    none = bl.baseline_deviation(df.withColumn("_has_baseline", F.lit(False))).first()
    assert (none.amount_deviation, none.amount_z_score) == (0.0, 0.0)


def test_g14_audit_trace_stats(spark):
    from riskspark.operators import features as feat

    t = spark.createDataFrame(
        [(1, "A", "2019-09-01 00:00:00", 367.69, "r", 1, 1, "ACH", 0),
         (2, "A", "2019-09-01 00:05:00", 3890.96, "r", 1, 1, "ACH", 0),
         (3, "A", "2019-09-01 00:10:00", 10.0, "r", 1, 1, "ACH", 0)],
        "row_id long, account string, ts string, amount double, receiver string, to_bank long, "
        "from_bank long, payment_channel string, is_fraud int").withColumn("ts", F.to_timestamp("ts"))
    r = {x.row_id: x for x in feat.running_amount_stats(t, ["row_id"]).collect()}
    assert r[3].prior_mean == pytest.approx(2129.325, abs=1e-6)
    assert r[3].prior_std == pytest.approx(2491.3281, abs=1e-4)


def test_g12_request_validation(spark):
    df = spark.createDataFrame([(1, 10.0, "CARD"), (2, 10.0, "BITCOIN"), (3, None, "UPI"), (4, 0.001, "UPI")],
                               "id int, amount double, payment_channel string")
    ok, bad = va.validate_requests(df)
    assert [r.id for r in ok.collect()] == [1]
    codes = {r.id: list(r.rejection_codes) for r in bad.collect()}
    assert codes == {2: ["UNSUPPORTED_CHANNEL"], 3: ["MISSING_AMOUNT"], 4: ["AMOUNT_BELOW_MIN"]}


def test_g13_confusion_metrics(spark):
    cm = spark.createDataFrame([(1798781, 267, 895, 417)], "tn long, fp long, fn long, tp long")
    r = ev.classification_metrics(cm).first()
    assert (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) == (0.6096, 0.3178, 0.4178)


@pytest.mark.parametrize("new_f1, promoted", [(0.30, False), (0.50, True)])
def test_g11_promotion(spark, new_f1, promoted):
    reg = spark.createDataFrame([("v2", "ACTIVE", 0.3994), ("v3", "INACTIVE", 0.89)],
                                "model_id string, status string, f1_score double")
    cand = spark.createDataFrame([("new", new_f1)], "model_id string, f1_score double")
    out = {r.model_id: r for r in mo.promote(reg, cand).collect()}
    assert ("new" in out) == promoted
    if promoted:
        assert out["new"].status == "ACTIVE" and out["new"].traffic == 100
        assert out["v2"].status == "INACTIVE"
    else:
        assert out["v2"].status == "ACTIVE"


def _brute_auc(score, label):
    pos = score[label == 1]
    neg = score[label == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _brute_ap(score, label):
    order = np.argsort(-score, kind="mergesort")
    s, y = score[order], label[order]
    ap, P, prev_r = 0.0, y.sum(), 0.0
    for t in np.unique(s)[::-1]:
        tp = y[s >= t].sum()
        fp = (s >= t).sum() - tp
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auc_and_ap_match_brute_force(spark):
    rng = np.random.default_rng(7)
    label = rng.integers(0, 2, 400)
    score = np.round(rng.random(400) * 0.6 + label * 0.3, 2)  # many ties
    df = spark.createDataFrame(pd.DataFrame({"score": score, "label": label}))
    assert ev.roc_auc(df).first()[0] == pytest.approx(_brute_auc(score, label), abs=1e-12)
    assert ev.average_precision(df).first()[0] == pytest.approx(_brute_ap(score, label), abs=1e-12)


def test_running_totals_and_positions_match_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.permutation(500), "g": rng.integers(0, 3, 500), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    rt = running_totals(df, "k", ["v"], parts=7).toPandas().sort_values("k")
    assert (rt["cum_v"].to_numpy() == pdf.sort_values("k")["v"].cumsum().to_numpy()).all()
    pos = positions(df, ["k"], group="g", parts=5).toPandas()
    exp = pdf.assign(p=pdf.groupby("g")["k"].rank(method="first").astype(int) - 1)
    m = pos.merge(exp, on=["k", "g"])
    assert (m["_pos"] == m["p"]).all() and (m["_group_n"] == m.groupby("g")["k"].transform("size")).all()


def test_stratified_split_quotas_deterministic(spark):
    t = A.events_txn(spark, SF001)
    a = sp.stratified_split(t, "is_fraud", ["row_id"]).select("row_id", "is_fraud", "split").toPandas()
    b = sp.stratified_split(t, "is_fraud", ["row_id"]).select("row_id", "split").toPandas()
    assert a.sort_values("row_id")["split"].tolist() == b.sort_values("row_id")["split"].tolist()
    for _, g in a.groupby("is_fraud"):
        n = len(g)
        temp = math.ceil(0.30 * n)
        counts = g["split"].value_counts()
        assert counts.get("train", 0) == n - temp
        assert counts.get("test", 0) == math.ceil(0.5 * temp)
        assert counts.get("valid", 0) == temp - math.ceil(0.5 * temp)


def test_stratified_sample_exact_size(spark):
    t = A.events_txn(spark, SF001)
    s = sp.stratified_sample(t, "is_fraud", ["row_id"], 101)
    assert s.count() == 101 and s.select("row_id").distinct().count() == 101


def test_latency_percentiles_by_index(spark):
    vals = [float(v) for v in np.random.default_rng(1).integers(1, 500, 333)]
    df = spark.createDataFrame([(v,) for v in vals], "latency_ms double")
    r = mo.latency_summary(df).first()
    s = sorted(vals)
    n = len(s)
    assert r.p90_ms == s[int(n * 0.90)] and r.p999_ms == s[min(int(n * 0.999), n - 1)]
    assert r.median_ms == pytest.approx(float(np.median(s)))


def test_ks_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50, 300), rng.integers(10, 60, 200)
    da = spark.createDataFrame([(float(x),) for x in a], "x double")
    db = spark.createDataFrame([(float(x),) for x in b], "x double")
    grid = np.union1d(a, b)
    d = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert mo.ks_statistic(da, db, "x").first()[0] == pytest.approx(d)


def _anchored_brute(ts, length, limit):
    out, start, count = [], None, 0
    for t in ts:
        if start is None or t >= start + length:
            start, count = t, 0
        count += 1
        out.append((start, count, count <= limit))
    return out


def test_anchored_window_processor_matches_brute_force():
    from riskspark.streaming.state import AnchoredWindowProcessor

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    rng = np.random.default_rng(11)
    us = np.sort(rng.integers(0, 600_000_000, 300)).astype("int64")
    p = AnchoredWindowProcessor("ts", 60_000_000, 3, ["i"])
    p.init(Handle())
    got = []
    for chunk in np.array_split(np.arange(len(us)), 4):  # state carried over micro-batches
        pdf = pd.DataFrame({"i": chunk, "ts": pd.to_datetime(us[chunk], unit="us")})
        got.append(next(p.handleInputRows(("k",), iter([pdf]), None)))
    g = pd.concat(got)
    exp = _anchored_brute(list(us), 60_000_000, 3)
    assert list(zip(g.window_start_us, g.count_in_window, g.allowed)) == exp


def test_range_rule_twin_has_same_codes(spark):
    from riskspark.functions.rules import feature_range_rules
    from riskspark.plans.q_datasets import RANGE_RULE_SQL

    codes = [c for c, _ in feature_range_rules()]
    assert [part.split("'")[1] for part in RANGE_RULE_SQL.split(" UNION ALL ")] == codes


def test_exists_semi_anti_agree(spark):
    t = A.events_txn(spark, SF001)
    cut = t.agg(F.expr("percentile_disc(0.7) WITHIN GROUP (ORDER BY row_id)")).first()[0]
    old, new = t.where(F.col("row_id") < cut), t.where(F.col("row_id") >= cut)
    flagged = bl.exists_lookup(new.select("row_id", "account", "merchant"), old, ["account", "merchant"])
    yes = {r.row_id for r in bl.existing(new, old, ["account", "merchant"]).collect()}
    no = {r.row_id for r in bl.missing(new, old, ["account", "merchant"]).collect()}
    got = {r.row_id: r.seen for r in flagged.collect()}
    assert yes | no == set(got) and not (yes & no)
    assert all(got[i] for i in yes) and not any(got[i] for i in no)


@pytest.mark.parametrize("chunk_rows", [10 ** 9, 7])
def test_batch_anchored_windows_match_brute_force(spark, chunk_rows):
    from datetime import datetime, timedelta

    from riskspark.operators.windows import anchored_windows

    rng = np.random.default_rng(21)
    base = datetime(2024, 1, 1)
    rows = [(i, f"K{int(rng.integers(0, 3))}", base + timedelta(seconds=int(rng.integers(0, 900))))
            for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, k string, ts timestamp_ntz")
    got = {r.row_id: (r.window_start, r.count_in_window, r.allowed)
           for r in anchored_windows(df, "k", "ts", ["row_id"], 60, 3, chunk_rows=chunk_rows).collect()}
    for key in {r[1] for r in rows}:
        mine = sorted([r for r in rows if r[1] == key], key=lambda r: (r[2], r[0]))
        exp = _anchored_brute([r[2] for r in mine], timedelta(seconds=60), 3)
        for r, (start, count, ok) in zip(mine, exp):
            assert got[r[0]] == (start, count, ok), (key, r)


def test_online_gap_option(spark):
    from riskspark.operators import features as feat

    t = A.events_txn(spark, SF001)
    cut = bl.snapshot_cutoff(t)
    from riskspark.functions.calendar import ntz_lit

    old, new = t.where(F.col("ts") < ntz_lit(cut)), t.where(F.col("ts") >= ntz_lit(cut))
    base = bl.user_baselines(old)
    off = bl.online_features(new, base, history=t).select("row_id", "time_since_last_transaction")
    on = bl.online_features(new, base, history=t, with_gap=True).select("row_id", "time_since_last_transaction")
    assert {r[1] for r in off.collect()} == {0.0}
    gaps = {r.row_id: r.time_since_last_transaction for r in feat.time_since_last(t, A.EVENTS_TIE).collect()}
    for r in on.collect():
        assert r.time_since_last_transaction == pytest.approx(gaps[r.row_id])
