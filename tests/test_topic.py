"""O-07 / O-08: partitions by key, offsets over calls, starting points, restarts."""

import pytest

from riskspark.sources import files
from riskspark.streaming import jobs


def batch(spark, lo, hi):
    return spark.createDataFrame([(None if i % 11 == 0 else f"u{i % 5}", i, f"text {i}") for i in range(lo, hi)],
                                 "user string, seq long, body string").repartition(3)


def consume(spark, base, **kw):
    s = files.read_topic_stream(spark, "t", f"{base}/bus", **kw)
    name = kw.get("group", "g")
    jobs.run_available_now(s, f"{base}/out-{name}", f"{base}/ckpt-{name}")
    return spark.read.schema("key string, value string, partition int, offset long").parquet(f"{base}/out-{name}").collect()


def send(spark, base, lo, hi):
    files.publish(batch(spark, lo, hi), "user", "t", f"{base}/bus", order=["seq"])


def test_partitions_offsets_and_key_order(spark, tmp_path):
    send(spark, tmp_path, 0, 40)
    send(spark, tmp_path, 40, 70)
    got = consume(spark, tmp_path, starting="earliest", group="all")
    assert len(got) == 70
    by_part, by_key = {}, {}
    for r in sorted(got, key=lambda r: r.offset):
        by_part.setdefault(r.partition, []).append(r.offset)
        by_key.setdefault(r.key, []).append((r.partition, int(r.value.split('"seq":')[1].split(",")[0])))
    assert all(o == list(range(len(o))) for o in by_part.values())
    for seen in by_key.values():
        assert len({p for p, _ in seen}) == 1
        assert [q for _, q in seen] == sorted(q for _, q in seen)
    assert {p for p, _ in by_key[None]} == {0}


def test_latest_skips_and_restart_resumes(spark, tmp_path):
    send(spark, tmp_path, 0, 30)
    assert consume(spark, tmp_path, group="late") == []
    send(spark, tmp_path, 30, 45)       # the consumer is down
    first = consume(spark, tmp_path, group="late")
    assert len(first) == 15 and all(int(r.value.split("text ")[1][:-2]) >= 30 for r in first)
    send(spark, tmp_path, 45, 50)
    assert len(consume(spark, tmp_path, group="late")) == 20
    assert len(consume(spark, tmp_path, group="late")) == 20
    assert len(consume(spark, tmp_path, starting="earliest", group="early")) == 50


def test_repeated_rows_empty_batches_and_bad_start(spark, tmp_path):
    send(spark, tmp_path, 0, 0)
    same = spark.createDataFrame([("a", 1)] * 6, "user string, offset long")
    files.publish(same, "user", "t", f"{tmp_path}/bus", order=["offset"])
    got = consume(spark, tmp_path, starting="earliest", group="x")
    assert sorted(r.offset for r in got) == list(range(6))
    with pytest.raises(ValueError):
        files.read_topic_stream(spark, "t", f"{tmp_path}/bus", starting="newest")
