"""Per-transaction baselines: hot accounts cut into chunks give the same rows
as cold ones, and both equal a row-by-row recomputation."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from riskspark.operators import baseline as bl
from riskspark.operators.running import running_baselines

SCHEMA = ("row_id long, account long, ts timestamp_ntz, amount decimal(18,2), payment_channel string, merchant string, "
          "location string, status string")
OUT = ["row_id", "_has_baseline", "average_amount", "transaction_std_dev", "average_daily_transactions", "preferred_payment_method",
       "usual_city", "active_hour_start", "active_hour_end", "velocity_1h", "merchant_seen", "location_seen", "merchant_frequency", "_prev_ts"]


@pytest.fixture(scope="module")
def rows():
    from decimal import Decimal

    rng = random.Random(4)
    out = []
    for i in range(300):
        account = rng.choice([1, 1, 1, 2, 3, None])
        at = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(0, 9000, 20))
        out.append((i, account, at, Decimal(rng.randrange(-500, 5000)) / 100, rng.choice(["card", "wire", "cash"]),
                    rng.choice(["m1", "m2", "m3"]), rng.choice(["a", "b", None]), rng.choice(["PENDING", "PENDING", "DONE"])))
    return out


def by_hand(rows):
    out = {}
    for r in rows:
        past = sorted((p for p in rows if p[1] == r[1] and (p[2], p[0]) < (r[2], r[0])), key=lambda p: (p[2], p[0]))
        paid = [p for p in past if p[7] == "PENDING"]
        top = lambda values: min((-n, v) for v, n in Counter(values).items())[1] if values else ""
        days = {p[2].date() for p in paid}
        mean = sum(p[3] for p in paid) / len(paid) if paid else None
        var = float(sum((p[3] - mean) ** 2 for p in paid) / len(paid)) if paid else 0.0
        out[r[0]] = (bool(past), mean, var ** 0.5, len(paid) // len(days) if paid else 0, top([p[4] for p in past]),
                     top([p[6] for p in past if p[6]]), min((p[2].hour for p in past), default=None), max((p[2].hour for p in past), default=None),
                     sum(p[2] >= r[2] - timedelta(hours=1) for p in past), any(p[5] == r[5] for p in past), any(p[6] == r[6] for p in past),
                     sum(p[5] == r[5] for p in past) / len(past) if past else 0.0, past[-1][2] if past else None)
    return out


@pytest.mark.parametrize("chunk_rows", [2_000_000, 7])
def test_running_baselines(spark, rows, chunk_rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["row_id"]: tuple(r)[1:] for r in running_baselines(df, chunk_rows=chunk_rows).select(*OUT).collect()}
    want = by_hand(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        if rows[k][1] is None:
            continue  # rows without an account share one key here
        assert g[0] == w[0] and g[7:] == (*w[7:11], pytest.approx(w[11]), w[12])
        if w[0]:
            assert float(g[1]) == pytest.approx(float(w[1] or 0), abs=0.00501) and float(g[2]) == pytest.approx(w[2], abs=0.00501)
            assert (g[3], g[4], g[5], g[6]) == (w[3], w[4], w[5], w[6])
        else:
            assert g[1:7] == (None,) * 6


def test_a_row_does_not_see_itself_but_the_next_does(spark, rows):
    first, second = (0, 9, datetime(2024, 1, 1), 10, "card", "m", "a", "PENDING"), (1, 9, datetime(2024, 1, 1), 30, "wire", "m", "a", "PENDING")
    got = bl.running_online_features(spark.createDataFrame([first, second], SCHEMA.replace("decimal(18,2)", "int")).withColumn(
        "amount", bl.F.col("amount").cast("decimal(18,2)"))).orderBy("row_id").collect()
    assert got[0]["is_first_transaction"] and got[0]["new_merchant"] and got[0]["amount_deviation"] == 0
    assert not got[1]["is_first_transaction"] and not got[1]["new_merchant"] and got[1]["amount_deviation"] == 2.0
    assert got[1]["payment_method_changed"] and got[1]["velocity_1h"] == 1 and got[1]["merchant_frequency"] == 1.0


def test_velocity_of_hot_accounts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    cold = {r["row_id"]: r["velocity_1h"] for r in bl.velocity_1h(df).collect()}
    assert cold == {r["row_id"]: r["velocity_1h"] for r in bl.velocity_1h(df, chunk_rows=7).collect()}


def test_exists_as_of(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4)], "k int, x string, t int")
    got = {r["k"]: r["seen"] for r in bl.exists_lookup(df, df, ["x"], as_of=["t", "k"]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}
    assert all(r["seen"] for r in bl.exists_lookup(df.where("x is not null"), df, ["x"]).collect())
