"""Structured Streaming jobs (O-08, O-70..O-76).

Streams read files (or Kafka, see ``sources.files.read_topic_stream``),
keep state in the RocksDB state store under the checkpoint location, and
write through idempotent sinks: file sinks are exactly-once by design and
``foreachBatch`` writers overwrite the folder of their batch id, so a
replayed batch after a failure rewrites the same output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.rules import decision
from riskspark.operators import baseline as bl
from riskspark.operators import decide as dc
from riskspark.sources import files
from riskspark.sources.keyed_table import KeyedTable
from riskspark.operators.running import finished
from riskspark.streaming.state import RUNNING_OUT, AccountFeatureProcessor, AnchoredWindowProcessor, RunningBaselineProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FEATURE_OUT = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("amount", T.DoubleType()),
    T.StructField("payment_channel", T.StringType()),
    T.StructField("time_since_last_transaction", T.DoubleType()),
    T.StructField("velocity_score", T.LongType()), T.StructField("spending_deviation_score", T.DoubleType()),
    T.StructField("is_first_transaction", T.IntegerType()), T.StructField("hour", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()), T.StructField("is_fraud", T.IntegerType()),
    T.StructField("is_cross_bank_transfer", T.IntegerType()),
    T.StructField("is_cross_currency_transfer", T.IntegerType()), T.StructField("is_new_receiver", T.IntegerType()),
    T.StructField("is_new_bank", T.IntegerType()), T.StructField("is_new_payment_format", T.IntegerType()),
])


def configure_state_store(spark: SparkSession) -> None:
    """RocksDB state store (required by transformWithState); keyed state
    lives in the checkpoint location, which is what makes restarts exact."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None,
                fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def run_available_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet") -> None:
    """Process everything available, then stop (exactly-once file sink)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .option("path", path).trigger(availableNow=True).start())
    q.awaitTermination()


def run_foreach_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
                      mode: str = "append") -> None:
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(fn).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_by_key(df: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Run an aggregate in update mode into a table of versions (a folder a
    batch, rewritten when the batch is replayed) and return the last version
    of each key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    run_foreach_batch(df, write, checkpoint, mode="update")
    rows = df.sparkSession.read.parquet(f"{path}/*")
    others = [c for c in df.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others]))


#: Hash values that the keys of a stateful step are grouped by: a call for
#: each bucket of a micro-batch, not for each key.
BUCKETS = 1024


def bucketed(stream: DataFrame, key: str) -> DataFrame:
    """``stream`` with its key as text (null, which is a key too: empty) and
    the bucket of the key."""
    text = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))
    # (the state processors lose names that begin with an underscore)
    return stream.withColumn("key_text", text).withColumn("state_bucket", F.pmod(F.xxhash64("key_text"), F.lit(BUCKETS)).cast("int"))


def account_feature_stream(stream: DataFrame, key: str = "account") -> DataFrame:
    """O-70: streaming past-only features; same definition as the batch
    ``feature_rows`` (tested equal on the driver tables)."""
    configure_state_store(stream.sparkSession)
    processor = AccountFeatureProcessor()
    s = bucketed(stream, key).withColumns({f"{c}_text": F.col(c).cast("string") for c in processor.seen_cols})
    return s.groupBy("state_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=FEATURE_OUT,
        outputMode="Append", timeMode="None")


def anchored_window_stream(stream: DataFrame, key: str, ts: str, seconds: int, limit: int,
                           keep: Sequence[str], tie: Sequence[str] = (), result: str | None = None,
                           delay: str | None = None) -> DataFrame:
    """O-73 (limit 100 per 60 s) / O-59 (limit 1 per 24 h) in a stream.

    ``result`` names the column whose value the first call of a window hands
    to all later ones. With ``delay`` the state of a key ends with its window
    once the watermark, ``delay`` behind the newest row, has passed it; rows
    older than the watermark are dropped. ``ts`` is a TIMESTAMP_NTZ."""
    configure_state_store(stream.sparkSession)
    # whole numbers travel as text: beside a null pandas has none
    texts = {c: f"{c}_text" for c in keep if isinstance(stream.schema[c].dataType, T.IntegralType)}
    out = T.StructType([*[T.StructField(texts[c], T.StringType()) if c in texts else stream.schema[c] for c in keep],
                        T.StructField("window_start_us", T.LongType()),
                        T.StructField("count_in_window", T.LongType()),
                        T.StructField("allowed", T.BooleanType()),
                        *([T.StructField("result", T.StringType())] if result else [])])
    if delay:  # wall-clock micros, so that windows and timers don't depend on the session's time zone
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")
        stream = stream.withColumn("wall_us", micros).withColumn("wall_at", F.timestamp_micros("wall_us")).withWatermark("wall_at", delay)
        ts = "wall_us"
    s = bucketed(stream, key).withColumns({t: F.col(c).cast("string") for c, t in texts.items()})
    if result:
        s = s.withColumn("result_text", F.col(result).cast("string"))
    s = s.groupBy("state_bucket").transformWithStateInPandas(
        statefulProcessor=AnchoredWindowProcessor(ts, seconds * 1_000_000, limit, [texts.get(c, c) for c in keep], tie,
                                                  "result_text" if result else None, bool(delay), "key_text"),
        outputStructType=out, outputMode="Append", timeMode="EventTime" if delay else "None")
    return s.select(*[F.col(texts[c]).cast(stream.schema[c].dataType).alias(c) if c in texts else F.col(c) for c in keep],
                    *[c for c in s.columns[len(keep):]])


def decision_batch_writer(base: str) -> Callable[[DataFrame, int], None]:
    """O-71 sink: per micro-batch, route decisions and failures; every output
    folder is keyed by the batch id and overwritten, so replays are exact."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            routed = dc.retry_route(batch)
            review, alerts = dc.route(routed.where(F.col("route") == "PROCESSED"))
            review.write.mode("overwrite").parquet(f"{base}/review_queue/batch={batch_id}")
            alerts.write.mode("overwrite").parquet(f"{base}/alerts/batch={batch_id}")
            for r in ("RETRY", "DLQ"):  # the whole event, with its own count moved on
                event = F.col("event").withField("retry_count", F.col("next_retry_count"))
                (routed.where(F.col("route") == r)
                 .select(F.col("transaction_id").alias("key"), F.to_json(event).alias("value"))
                 .write.mode("overwrite").json(f"{base}/{r.lower()}/batch={batch_id}"))
        finally:
            batch.unpersist()

    return write


def decision_stream(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-71: bus messages -> decoded events -> decision on the carried
    probability, with error kind, retry count and the event itself.  Messages
    that don't decode, or whose time can't be read, are quarantined."""
    good, bad = files.decode_events(messages)
    good = good.select("*", F.struct(*good.columns).alias("event"),
                       F.try_to_timestamp(F.col("timestamp")).alias("created_at"))
    no_time = F.col("timestamp").isNotNull() & F.col("created_at").isNull()
    bad = bad.unionByName(good.where(no_time).select(F.to_json("event").alias("raw_value"),
                                                     F.lit("BAD_TIMESTAMP").alias("reason")))
    d = good.where(~no_time).select(
        "transaction_id", "user_id", "amount", "payment_method", "status",
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.round("fraud_probability", 4).alias("fraud_probability"),
        decision(F.col("fraud_probability")).alias("decision"),
        "created_at", "event",
        F.when(F.col("status") == "FAILED", "RETRYABLE").alias("error_kind"))
    return d, bad


def enrich_stream(stream: DataFrame, user: str = "account", ts: str = "ts", tie: Sequence[str] = ("row_id",),
                  keep: Sequence[str] = ()) -> DataFrame:
    """O-72, first half: every transaction with its O-45 vector, made from
    keyed state that holds what came before it (no self-view). The same
    expressions finish the batch form."""
    configure_state_store(stream.sparkSession)
    columns = list(dict.fromkeys([user, *tie, ts, "amount", "payment_channel", "merchant", "location", "status", *keep]))
    out = T.StructType([*[stream.schema[c] for c in columns], *RUNNING_OUT])
    # the state's keys are text: rows without an account are one key of their own
    s = bucketed(stream.select(*columns), user).withColumns(
        {f"{kind}_text": F.col(c).cast("string") for kind, c in (("merchant", "merchant"), ("method", "payment_channel"), ("place", "location"))})
    s = s.groupBy("state_bucket").transformWithStateInPandas(
        statefulProcessor=RunningBaselineProcessor(ts, tie, columns), outputStructType=out, outputMode="Append", timeMode="None")
    s = s.withColumns({"_sum": (F.col("_sum").cast("decimal(38,0)") / F.lit(100)).cast("decimal(28,2)"), "_sum2": F.col("_sum2").cast("decimal(38,0)"),
                       "_prev_ts": F.timestamp_micros("_prev_us").cast(stream.schema[ts].dataType)}).drop("_prev_us")
    return bl.running_vector(finished(s), user, ts, tie, keep=[*dict.fromkeys(["payment_channel", ts, *keep])])


def scored(features: DataFrame, score: Callable[[DataFrame], DataFrame], ts: str = "ts", tie: Sequence[str] = ("row_id",)) -> DataFrame:
    """O-72, second half, row by row: model input (O-46), ``score`` (adds
    ``raw_probability``, O-51), outputs and decision (O-52..O-54) and reason
    codes (O-55)."""
    x = bl.to_model_input(features, keep=[*tie, "user_id", ts, "risk_flags"])
    d = dc.decide(dc.score_outputs(score(x)))
    return dc.with_reason_codes(d).withColumns({"transaction_id": F.col(tie[0]).cast("string"), "created_at": F.col(ts),
                                                "user_id": F.col("user_id").cast("string")})


def enriched_batch_writer(base: str, score: Callable[[DataFrame], DataFrame], ts: str = "ts",
                          tie: Sequence[str] = ("row_id",)) -> Callable[[DataFrame, int], None]:
    """O-72 sinks of a micro-batch: the feature CSV (O-05), the scored rows,
    and the prediction and anomaly records (O-56), each in the folder of its
    batch. The batch counts once its commit is written, after all sinks: a
    batch that fails between two sinks shows in none, and its replay
    overwrites what it had left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            d = scored(batch, score, ts, tie).persist()
            sinks = {"features": batch.drop(ts, "payment_channel"), "scored": d.drop("risk_flags", ts),
                     "predictions": dc.prediction_records(d), "anomalies": dc.anomaly_records(d)}
            for name, rows in sinks.items():
                rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")
            csv = batch.withColumn("transaction_id", F.col(tie[0])).withColumn("user_id", F.col("user_id").cast("string"))
            files.feature_csv_frame(csv).write.mode("overwrite").option("header", True).csv(f"{base}/features_csv/batch={batch_id}")
            files.commit_batch(batch.sparkSession, base, batch_id, list(sinks))
            d.unpersist()
        finally:
            batch.unpersist()

    return write


def baseline_upsert_writer(base: str, user: str = "account", buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """O-39 in a stream: a micro-batch adds its rows to the history, kept in
    the same buckets as the baselines, recomputes the baselines of the users it
    has (reading only their buckets) and upserts them. Each step overwrites
    the folder of its batch, and the table takes a batch id once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        baselines = KeyedTable(spark, f"{base}/baselines", "user_id", buckets)
        if baselines.applied(batch_id):
            return
        rows = batch.withColumn("bucket", baselines.bucket(user)).persist()
        try:
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/history/batch={batch_id}")
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # <= buckets rows
            if not touched:
                return
            past = (spark.read.schema(rows.schema.add("batch", "long")).parquet(f"{base}/history")
                    .where(F.col("bucket").isin(touched) & (F.col("batch") <= batch_id)))
            users = rows.select(F.col(user).alias("_u")).distinct()
            theirs = past.join(users, F.col(user).eqNullSafe(F.col("_u")), "left_semi")
            baselines.merge(bl.user_baselines(theirs, user), batch_id)
        finally:
            rows.unpersist()

    return write


def drift_accumulators(stream: DataFrame) -> DataFrame:
    """O-74: running n, sums and channel counts (global streaming aggregate)."""
    return stream.groupBy("payment_channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("sum_amount"),
        F.sum("velocity_score").alias("sum_velocity"),
        F.sum("spending_deviation_score").alias("sum_deviation"))


def decision_counters(stream: DataFrame) -> DataFrame:
    """O-75: one count for each decision made, and for the events consumed,
    sent to retry and sent to the dead-letter queue."""
    r = dc.retry_route(stream)
    names = F.array_compact(F.array(
        F.lit("consumed"),
        F.when(F.col("route") == "PROCESSED", F.concat(F.lit("decision_"), F.col("decision"))),
        F.when(F.col("route") == "RETRY", "retry"), F.when(F.col("route") == "DLQ", "dlq")))
    return r.select(F.explode(names).alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("count"))


def retry_messages(spark: SparkSession, base: str) -> DataFrame | None:
    """The retry topic of a round as a stream, None when nothing was sent."""
    folder = f"{base}/retry"
    if spark.read.schema("key string, value string").json(folder).isEmpty():
        return None
    return spark.readStream.schema("key string, value string").json(f"{folder}/*")


def run_with_retries(spark: SparkSession, messages: DataFrame, base: str) -> list[str]:
    """O-71 with its second loop: route the messages, then read the retry
    topic back round after round until no event is left below the limit.
    Returns the folder of each round."""
    rounds: list[str] = []
    while messages is not None:
        here = f"{base}/round={len(rounds)}"
        rounds.append(here)
        d, _ = decision_stream(messages)
        run_foreach_batch(d, decision_batch_writer(here), f"{here}-ckpt")
        messages = retry_messages(spark, here)
    return rounds


def hourly_trend_stream(stream: DataFrame, ts: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """O-76 / O-81: tumbling hourly counts with a watermark: rows later than
    ``delay`` behind the max event time are dropped (documented policy).  Run
    in update mode through ``latest_by_key``, so hours that the watermark has
    not closed yet are in the table too."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("w.start").alias("hour_start"), "count"))
