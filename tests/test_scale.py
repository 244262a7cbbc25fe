"""Steps that keep their cost in proportion to the input, on rows of their own."""

import hashlib
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import profile as pf
from riskspark.operators import splits as sp
from riskspark.operators import train as tr
from riskspark.plans import q_online, q_streaming as q, q_train, rank
from riskspark.streaming import jobs
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_many_keys_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 3)
    t0 = datetime(2026, 1, 1)
    rows = [(i, None if i % 41 == 0 else f"k{i % 40}", t0 + timedelta(seconds=7 * i)) for i in range(400)]
    rows.append((None, "k1", t0 + timedelta(seconds=3000)))
    base = q._fresh(spark, "buckets")
    schema = q._stage(spark.createDataFrame(rows, "row_id long, k string, ts timestamp_ntz"), f"{base}/in")
    s = jobs.anchored_window_stream(jobs.file_stream(spark, f"{base}/in", schema, max_files=q.FILES), "k", "ts", 600, 1,
                                    ["row_id", "k"], ["row_id"], result="row_id", delay="1 minute")
    run = (s.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/out")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 3  # a value and a timer a bucket, not a key
    got = {r["row_id"]: (r["window_start_us"], r["count_in_window"], r["allowed"], r["result"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert len(got) == len(rows)
    for key in {r[1] for r in rows}:
        start = None
        for i, _, at in sorted((r for r in rows if r[1] == key), key=lambda r: r[2]):
            if start is None or at >= start + timedelta(seconds=600):
                start, n, first = at, 0, i
            n += 1
            assert got[i] == ((start - datetime(1970, 1, 1)) // timedelta(microseconds=1), n, n == 1, None if first is None else str(first))


def test_feature_state_is_an_entry_an_account(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    t0 = datetime(2026, 1, 1)
    rows = [(i, i % 9, t0 + timedelta(minutes=i), float(i), "c", "m", None if i == 100 else i % 4, 1, 1, 0) for i in range(180)]
    t = spark.createDataFrame(rows, "row_id long, account long, ts timestamp_ntz, amount double, payment_channel string, merchant string, "
                                    "receiver long, to_bank long, from_bank long, is_fraud int")
    base = q._fresh(spark, "entries")
    schema = q._stage(t, f"{base}/in")
    s = jobs.account_feature_stream(jobs.file_stream(spark, f"{base}/in", schema, max_files=q.FILES))
    run = (s.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/out")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 9
    new, seen = {r["row_id"] for r in spark.read.parquet(f"{base}/out").where("is_new_receiver = 1").collect()}, set()
    want = {r[0] for r in rows if (r[1], r[6]) not in seen and not seen.add((r[1], r[6]))}
    assert new == want  # a null makes no other receiver new again


def test_enriched_state_is_an_entry_an_account(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    base = q._fresh(spark, "vectors")
    rows = [(i, i % 7, datetime(2026, 1, 1) + timedelta(minutes=i), i, "c", f"m{i % 5}", i % 3, "PENDING") for i in range(140)]
    t = spark.createDataFrame(rows, "row_id long, account long, ts timestamp_ntz, amount int, payment_channel string, merchant string, "
                                    "location long, status string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    schema = q._stage(t, f"{base}/in")
    s = jobs.enrich_stream(jobs.file_stream(spark, f"{base}/in", schema, max_files=q.FILES))
    run = (s.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/out")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 7
    assert spark.read.parquet(f"{base}/out").count() == 140


def test_column_profile_counts_column_by_column(spark):
    df = spark.createDataFrame([(1, 0.5, None), (1, None, "b"), (2, 0.5, "b"), (None, -0.0, "c"), (2, 0.0, "c")], "a long, b double, c string")
    got = pf.column_profile(df.select("a", "b"), ["a", "b"])
    assert "Expand" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [("a", 1, 20.0, 2, 1.0, 2.0), ("b", 1, 20.0, 2, 0.0, 0.5)]


def test_grouped_describe_writes_its_columns_only(spark, monkeypatch):
    written, plain = [], rank.cut_lineage
    monkeypatch.setattr(rank, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    df = spark.createDataFrame([(i, i % 2, float(i), "wide" * 9) for i in range(9)], "k long, g int, v double, other string")
    got = {r["g"]: r for r in pf.grouped_describe(df, "g", "v", ["k"]).collect()}
    assert set(written[0]) <= {"g", "v", "k", "_pid", "_loc"}
    assert (got[0]["p25"], got[0]["p50"], got[1]["p75"]) == (2.0, 4.0, 5.5)


def test_messages_are_joined_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(q, "_stage", lambda df, path: staged.append(df) or df.write.parquet(path))
    q._messages(spark, SF001, q._fresh(spark, "messages"))
    assert "Join" not in plan(staged[0]) and staged[0].count() == q.A.events_txn(spark, SF001).count()


def test_features_are_built_once_for_preprocessing_and_search(spark, monkeypatch):
    fitted = []

    class Stop(Exception):
        pass

    def stop(self, data):
        fitted.append(data)
        raise Stop

    monkeypatch.setattr(tr.Pipeline, "fit", stop)
    monkeypatch.setattr(tr.CrossValidator, "fit", stop)
    for query in (q_train.o120, q_train.o124):
        with pytest.raises(Stop):
            query(spark, SF001)
    assert all("Window" not in plan(d) and "Join" not in plan(d) for d in fitted) and len(fitted) == 2


def test_both_sides_of_the_upsert_are_written_first(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(q_online.bl, "upsert_baselines", lambda old, new: sides.extend([old, new]) or old)
    q_online.o39(spark, SF001)
    assert all("Join" not in plan(s) and "Aggregate" not in plan(s) for s in sides) and len(sides) == 2


def test_path_lengths_of_walkable_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    feat, split, left, right, size = tr._grow(x, rng, 6)
    below = tr._leaf_lengths(size)
    want = []
    for row in x:
        at, depth = 0, 0
        while feat[at] >= 0:
            at, depth = (left if row[feat[at]] < split[at] else right)[at], depth + 1
        want.append(depth + below[at])
    got = tr._path_lengths(np.ascontiguousarray(x.T), tr._walkable(feat, split, left, right, below))
    assert got.tolist() == want


def test_labelled_rows_are_written_once_and_not_sorted(spark):
    d = q_train._labelled(spark, SF001)
    assert not any(step in plan(d) for step in ("Window", "Join", "Repartition", "Sort"))
    n = {r[0]: r[1] for r in d.groupBy("split").count().collect()}
    assert set(n) == {"train", "valid", "test"} and abs(n["train"] / sum(n.values()) - 0.7) < 0.01


def test_split_by_counted_cuts_equals_the_sorted_one(spark, monkeypatch):
    rows = [(i % 97 if i % 5 else i, "c" if i % 11 == 0 else None if i % 3 == 0 else "b", i) for i in range(400)]
    rows += [(7, "one", i) for i in range(40)]  # a class of equal keys: only ranks can cut it
    df = spark.createDataFrame(rows, "k long, label string, n int").repartition(3)
    for digits in (1, 3):
        monkeypatch.setattr(sp, "DIGITS", digits)
        for sizes in ((0.30, 0.50), (0.20,)):
            got = sp.stratified_split(df, "label", ["k"], sizes, ("a", "b", "c")[:len(sizes) + 1]).collect()
            assert sorted(r["n"] for r in got) == sorted(r[2] for r in rows)
            for label in ("c", "b", None, "one"):
                mine = sorted((hashlib.md5(f"42|{r['k']}".encode()).hexdigest(), r["split"]) for r in got if r["label"] == label)
                want, left = [], len(mine)
                for name, ts in zip("abc", [*sizes, 0]):
                    part = left - math.ceil(ts * left)
                    want += [name] * part
                    left -= part
                # splits follow the order of hashes; equal hashes may be cut anywhere
                assert sorted(s for _, s in mine) == want and [s for _, s in mine] == want
