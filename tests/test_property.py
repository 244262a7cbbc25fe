"""Randomised property test: the Spark feature row equals a direct
row-by-row evaluation of the running-state semantics (count, Welford mean
and M2, last timestamp, known-value sets), on the plain and the chunked
(hot-account) paths."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import features as feat


def brute(rows):
    state = {}
    out = {}
    for r in sorted(rows, key=lambda r: (r["account"], r["ts"], r["row_id"])):
        s = state.setdefault(r["account"], dict(n=0, mean=0.0, m2=0.0, last=None, rec=set(), bank=set(), fmt=set()))
        n = s["n"]
        std = 1.0 if n < 2 else max(math.sqrt(max(0.0, s["m2"] / (n - 1))), 1.0)
        out[r["row_id"]] = dict(
            velocity_score=n, is_first_transaction=int(n == 0),
            time_since_last_transaction=0.0 if s["last"] is None else max(0.0, (r["ts"] - s["last"]).total_seconds()),
            spending_deviation_score=0.0 if n < 2 else (r["amount"] - s["mean"]) / std,
            is_new_receiver=int(r["receiver"] not in s["rec"]), is_new_bank=int(r["to_bank"] not in s["bank"]),
            is_new_payment_format=int(r["payment_channel"] not in s["fmt"]))
        s["n"] += 1
        d = r["amount"] - s["mean"]
        s["mean"] += d / s["n"]
        s["m2"] += d * (r["amount"] - s["mean"])
        s["last"] = r["ts"]
        s["rec"].add(r["receiver"]); s["bank"].add(r["to_bank"]); s["fmt"].add(r["payment_channel"])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_feature_rows_match_running_state(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    base = datetime(2024, 1, 1)
    rows = [dict(row_id=i, account=f"A{int(rng.integers(0, 4 if seed != 3 else 1))}",
                 ts=base + timedelta(seconds=int(rng.integers(0, 5000))),  # same-second ties happen
                 amount=float(np.round(rng.gamma(2.0, 50.0), 2)), receiver=f"R{int(rng.integers(0, 12))}",
                 to_bank=int(rng.integers(0, 4)), from_bank=int(rng.integers(0, 4)),
                 payment_channel=str(rng.choice(["ACH", "Wire", "Cash"])), is_fraud=int(rng.integers(0, 2)))
            for i in range(n)]
    exp = brute(rows)
    df = spark.createDataFrame(rows)
    for chunk_rows in (10 ** 9, 37, 5):
        got = {r.row_id: r for r in feat.feature_rows(df, ["row_id"], keep=["row_id"], chunk_rows=chunk_rows).collect()}
        assert set(got) == set(exp)
        for k, e in exp.items():
            g = got[k]
            for c, v in e.items():
                if isinstance(v, float):
                    assert g[c] == pytest.approx(v, rel=1e-9, abs=1e-9), (chunk_rows, k, c)
                else:
                    assert g[c] == v, (chunk_rows, k, c)
