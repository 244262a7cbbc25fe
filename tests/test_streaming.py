"""Stream equals batch: the stateful processor reproduces the windowed
features over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.operators import features as feat
from riskspark.plans import q_streaming
from tests.conftest import SF001


def test_stream_features_equal_batch(spark):
    stream = q_streaming.stream_features(spark, SF001)
    batch = feat.feature_rows(A.events_txn(spark, SF001), A.EVENTS_TIE, keep=["row_id"])
    s = {r.row_id: r for r in stream.collect()}
    b = {r.row_id: r for r in batch.collect()}
    assert s.keys() == b.keys()
    for k, x in b.items():
        y = s[k]
        for c in ("velocity_score", "is_first_transaction", "is_new_receiver", "is_new_bank",
                  "is_new_payment_format", "hour", "day_of_week", "month", "is_weekend"):
            assert x[c] == y[c], (k, c)
        for c in ("time_since_last_transaction", "spending_deviation_score"):
            assert x[c] == pytest.approx(y[c], rel=1e-9, abs=1e-9), (k, c)


def test_watermark_drops_late_rows(spark):
    out = q_streaming.o76(spark, SF001)
    assert out.count() > 0
    assert out.agg(F.sum("count")).first()[0] <= A.events_txn(spark, SF001).count()
