"""Sources and sinks (O-01..O-09).

Readers take explicit schemas (no inference on the hot path); writers use
Spark's distributed file sinks.  Message-bus sources and sinks use the
Kafka format when its connector is on the classpath and fall back to a
folder of JSON files with the same record layout.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.plans.rank import positions

# The raw transfer CSV layout (the second "Account" column is
# the receiver; the schema is positional, so the duplicate header is harmless).
RAW_TRANSFER_SCHEMA = T.StructType([
    T.StructField("Timestamp", T.StringType()),
    T.StructField("From Bank", T.LongType()),
    T.StructField("Account", T.StringType()),
    T.StructField("To Bank", T.LongType()),
    T.StructField("Account.1", T.StringType()),
    T.StructField("Amount Received", T.DoubleType()),
    T.StructField("Receiving Currency", T.StringType()),
    T.StructField("Amount Paid", T.DoubleType()),
    T.StructField("Payment Currency", T.StringType()),
    T.StructField("Payment Format", T.StringType()),
    T.StructField("Is Laundering", T.IntegerType()),
])

# The transaction event published on the bus.
EVENT_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("payment_identifier", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("receiver_account", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
])

# Header of the feature-vector CSV export (20 columns).
FEATURE_CSV_COLUMNS = (
    ("TransactionID", "transaction_id"), ("UserID", "user_id"), ("Amount", "amount"),
    ("AmountDeviation", "amount_deviation"), ("AmountZScore", "amount_z_score"),
    ("TransactionVelocity1H", "velocity_1h"), ("HourOfDay", "hour_of_day"),
    ("DayOfWeek", "day_of_week"), ("IsWeekend", "is_weekend"),
    ("OutsideActiveHours", "outside_active_hours"), ("NewMerchant", "new_merchant"),
    ("NewDevice", "new_device"), ("NewLocation", "new_location"),
    ("PaymentMethodChanged", "payment_method_changed"), ("MerchantFrequency", "merchant_frequency"),
    ("DeviceTrustScore", "device_trust_score"), ("MerchantTrustScore", "merchant_trust_score"),
    ("LocationRiskScore", "location_risk_score"),
    ("TimeSinceLastTransaction", "time_since_last_transaction"), ("RiskFlags", "risk_flags"),
)

PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("transaction", T.MapType(T.StringType(), T.StringType())),
    T.StructField("prediction", T.StructType([
        T.StructField("fraud_probability", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("prediction", T.BooleanType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
    ])),
])


def read_raw_transfers(spark: SparkSession, paths: str | Sequence[str],
                       schema: T.StructType = RAW_TRANSFER_SCHEMA, header: bool = True) -> DataFrame:
    """O-01: scan one or many raw CSV files with a fixed schema; keep the
    source file so the per-file order can be reconstructed."""
    df = (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
          .csv(list(paths) if not isinstance(paths, str) else paths))
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def decode_events(raw: DataFrame, value: str = "value",
                  schema: T.StructType = EVENT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """O-02: JSON -> typed event; rows that do not decode (or lack the id)
    go to a quarantine frame instead of failing the job."""
    parsed = raw.withColumn("_e", F.from_json(F.col(value), schema, {"mode": "PERMISSIVE"}))
    ok = F.col("_e").isNotNull() & F.col("_e.transaction_id").isNotNull()
    good = parsed.where(ok).select("_e.*")
    bad = parsed.where(~ok).select(F.col(value).alias("raw_value"),
                                   F.lit("UNDECODABLE").alias("reason"))
    return good, bad


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """O-04: dataset writer (row groups streamed by the Parquet writer)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """O-04: dataset reader; selecting columns prunes the Parquet scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def feature_csv_frame(online: DataFrame) -> DataFrame:
    """O-05: the 20 exported columns (flags joined by '|', booleans as
    true/false)."""
    cols = []
    for header, c in FEATURE_CSV_COLUMNS:
        col = F.col(c)
        if c == "risk_flags":
            col = F.concat_ws("|", F.coalesce(col, F.array().cast("array<string>")))
        cols.append(col.cast("string").alias(header))
    return online.select(*cols)


def export_feature_csv(online: DataFrame, path: str) -> None:
    """O-05: append to a CSV folder with a header in every part file."""
    feature_csv_frame(online).write.mode("append").option("header", True).csv(path)


def fan_out(df: DataFrame, writers: Sequence[Callable[[DataFrame], None]]) -> None:
    """O-06: the same rows to many sinks; the input is persisted once so
    each writer reads the cached rows instead of recomputing the plan."""
    df = df.persist()
    try:
        for w in writers:
            w(df)
    finally:
        df.unpersist()


def to_messages(df: DataFrame, key: str) -> DataFrame:
    """O-07: (key, value) records: the key column and the row as JSON."""
    cols = [c for c in df.columns]
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*cols)).alias("value"))


def kafka_available(spark: SparkSession) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(  # type: ignore[union-attr]
            "org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:
        return False


def require_kafka(spark: SparkSession) -> None:
    """A named broker is never replaced by files without a word."""
    if not kafka_available(spark):
        raise RuntimeError("a broker is named, but the Kafka connector is not on Spark's class path")


TOPIC_PARTITIONS = 8
_MESSAGE = "key string, value string, offset long"


def topic_partition(key: str, partitions: int = TOPIC_PARTITIONS) -> Column:
    """Partition of a message: a hash of its key (null keys: partition 0)."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(h, F.lit(partitions)), F.lit(0)).cast("int")


def end_offsets(spark: SparkSession, topic: str, target: str) -> dict[int, int]:
    """partition -> the offset that its next message gets (<= partitions rows)."""
    path = f"{target}/{topic}"
    if not _exists(spark, path):
        return {}
    rows = (spark.read.schema(f"{_MESSAGE}, partition int").json(path).groupBy("partition")
            .agg((F.max("offset") + 1).alias("end")).collect())
    return {r["partition"]: r["end"] for r in rows if r["end"] is not None}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def publish(df: DataFrame, key: str, topic: str, target: str, bootstrap: str | None = None,
            order: Sequence[str] = (), partitions: int = TOPIC_PARTITIONS) -> None:
    """O-07 batch: publish keyed JSON; Kafka (hash-partitioned
    by key on the broker side) when a broker is named, else JSON files under
    ``target``/topic/partition=p.  There a message's partition follows from its
    key and its offset continues those of earlier calls, in ``order`` (then by
    key and value), so the messages of a key keep their order.  One writer at a
    time per topic."""
    spark = df.sparkSession
    if bootstrap:
        require_kafka(spark)
        (to_messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("kafka.acks", "all").option("topic", topic).save())
        return
    sorts = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    msgs = df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*df.columns)).alias("value"), *sorts)
    ends = end_offsets(spark, topic, target)
    first = F.lit(0).cast("long")
    for p, end in ends.items():
        first = F.when(F.col("partition") == p, F.lit(end)).otherwise(first)
    placed = positions(msgs.withColumn("partition", topic_partition("key", partitions)),
                       [*[f"_o{i}" for i in range(len(sorts))], "key", "value"], group="partition", sizes=False)
    (placed.select("key", "value", (F.col("_pos") + first).alias("offset"), "partition")
     .write.mode("append").partitionBy("partition").json(f"{target}/{topic}"))


def read_topic_stream(spark: SparkSession, topic: str, source: str, bootstrap: str | None = None,
                      starting: str = "latest", max_files: int | None = None,
                      group: str | None = None) -> DataFrame:
    """O-08: streaming records from a topic, (key, value) from a broker, or
    (key, value, partition, offset) from a folder that ``publish`` writes.

    ``latest`` skips messages that the topic holds now; with a ``group`` its
    first start is kept beside the topic, so a restarted consumer goes on where
    its checkpoint stands and does not skip what came while it was down."""
    if starting not in ("earliest", "latest"):
        raise ValueError(f"starting must be earliest or latest, not {starting!r}")
    if bootstrap:
        require_kafka(spark)
        return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
                .option("subscribe", topic).option("startingOffsets", starting).load()
                .select(F.col("key").cast("string"), F.col("value").cast("string")))
    start = _start_offsets(spark, topic, source, starting, group)
    r = spark.readStream.schema(f"{_MESSAGE}, partition int")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    rows = r.json(f"{source}/{topic}")
    for p, end in start.items():
        rows = rows.where((F.col("partition") != p) | (F.col("offset") >= end))
    return rows.select("key", "value", "partition", "offset")


def _start_offsets(spark, topic, source, starting, group) -> dict[int, int]:
    kept = f"{source}/_groups/{topic}/{group}"
    if group and _exists(spark, f"{kept}/_SUCCESS"):
        return {r["partition"]: r["start"]
                for r in spark.read.schema("partition int, start long").parquet(kept).collect()}  # <= partitions rows
    start = end_offsets(spark, topic, source) if starting == "latest" else {}
    if group:
        (spark.createDataFrame(sorted(start.items()), "partition int, start long").coalesce(1)
         .write.mode("overwrite").parquet(kept))
    return start


def commit_batch(spark: SparkSession, base: str, batch_id: int, sinks: Sequence[str]) -> None:
    """O-06: mark a batch of several sinks as written as a whole. Its commit is
    one row in a folder of its own, renamed into place by Spark's committer."""
    (spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.array(*[F.lit(s) for s in sinks]).alias("sinks"))
     .coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/at={batch_id}"))


def read_committed(spark: SparkSession, base: str, sink: str) -> DataFrame:
    """O-06: the rows of a sink's committed batches, and of no others."""
    done = spark.read.parquet(f"{base}/commits").where(F.array_contains("sinks", sink)).select(F.col("batch_id").alias("_done"))
    rows = spark.read.parquet(f"{base}/{sink}")
    return rows.join(done, F.col("batch").cast("bigint") == F.col("_done"), "left_semi").drop("batch")


def prediction_log_frame(predictions: DataFrame, txn_cols: Sequence[str]) -> DataFrame:
    """O-09: ``{timestamp, transaction{}, prediction{}}`` records."""
    return predictions.select(
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.create_map(*[x for c in txn_cols for x in (F.lit(c), F.col(c).cast("string"))]).alias("transaction"),
        F.struct("fraud_probability", "confidence", "prediction", "threshold", "model_version")
        .alias("prediction"))


def append_prediction_log(predictions: DataFrame, path: str, txn_cols: Sequence[str]) -> None:
    """O-09: append JSON lines to the prediction log folder."""
    prediction_log_frame(predictions, txn_cols).write.mode("append").json(path)


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """O-09: scan the prediction log with its schema."""
    return spark.read.schema(PREDICTION_LOG_SCHEMA).json(path)
