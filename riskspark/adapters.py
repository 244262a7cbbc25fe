"""Views of the driver tables in the transaction shape the operators use.

``events_txn`` and ``ship_txn`` map the generated tables onto a transfer
row (account, receiver, timestamp, amount, banks, currencies, channel,
label).  Each Spark view has a DuckDB twin (``*_SQL``) with the same
columns, so every query built on a view can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tie-break columns that make the per-account event order total.
EVENTS_TIE = ("row_id",)
SHIP_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer per ``events`` row (streams, hours, sessions)."""
    e = table(spark, sf_dir, "events")
    receiver = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("account"),
        F.col("ts"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("payment_channel"),
        F.col("event_type").alias("merchant"),
        receiver.alias("receiver"),
        (receiver % 7).alias("location"),
        (receiver % 10).alias("to_bank"),
        (F.col("user_id") % 10).alias("from_bank"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"),
        F.lit("PENDING").alias("status"),
    )


EVENTS_TXN_SQL = """
SELECT event_id AS row_id, user_id AS account, ts, value AS amount,
       event_type AS payment_channel, event_type AS merchant,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS receiver,
       CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS location,
       CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS to_bank,
       user_id % 10 AS from_bank,
       CAST(event_type = 'error' AS BIGINT) AS is_fraud,
       'PENDING' AS status
FROM events
"""


def ship_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer per ``lineitem`` row: customer pays supplier.

    Banks are nations and currencies are regions.  ``nation`` is a small
    fixed dimension: it is broadcast after a row-count check; the other
    joins are left to the planner (AQE turns them into broadcasts only when
    the measured side is small).
    """
    from riskspark.session import broadcast_if_small

    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", "l_shipdate", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = broadcast_if_small(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), 10_000)
    cn = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("payment_currency"))
    sn = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("receiving_currency"))
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, F.col("o_custkey") == c.c_custkey)
         .join(s, F.col("l_suppkey") == s.s_suppkey)
         .join(cn, "c_nationkey")
         .join(sn, "s_nationkey"))
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("o_custkey").alias("account"),
        F.col("l_suppkey").alias("receiver"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("amount"),
        F.col("c_nationkey").alias("from_bank"),
        F.col("s_nationkey").alias("to_bank"),
        "payment_currency", "receiving_currency",
        F.col("o_orderpriority").alias("payment_channel"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
    )


SHIP_TXN_SQL = """
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, l.l_partkey, l.l_suppkey,
       o.o_custkey AS account, l.l_suppkey AS receiver, l.l_shipdate AS ts,
       l.l_extendedprice AS amount, c.c_nationkey AS from_bank,
       s.s_nationkey AS to_bank, cn.n_regionkey AS payment_currency,
       sn.n_regionkey AS receiving_currency, o.o_orderpriority AS payment_channel,
       CAST(l.l_returnflag = 'R' AS BIGINT) AS is_fraud
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey
"""


# Deterministic stand-in score on a 4-decimal grid (test data only: the
# driver tables carry no model output).
def stand_in_score(row_id: str = "row_id"):
    return F.round(F.pmod(F.col(row_id) * 37, F.lit(1000)) / 1000.0, 4)


STAND_IN_SCORE_SQL = "round(((row_id * 37) % 1000) / 1000.0, 4)"


def scored_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events_txn`` plus a stand-in fraud probability."""
    return events_txn(spark, sf_dir).withColumn("fraud_probability", stand_in_score())


SCORED_TXN_SQL = f"""
SELECT *, {STAND_IN_SCORE_SQL} AS fraud_probability
FROM ({EVENTS_TXN_SQL}) t
"""


def predictions(spark: SparkSession, sf_dir: str, threshold: float = 0.5, row_id: int | None = None) -> DataFrame:
    """Prediction records (F6 shape) derived from ``scored_txn``; ``row_id``
    looks one up by its stored key, which the scan can skip row groups by."""
    from riskspark.functions.rules import decision

    s = scored_txn(spark, sf_dir)
    if row_id is not None:
        s = s.where(F.col("row_id") == row_id)
    p = F.col("fraud_probability")
    return s.select(
        F.col("row_id").cast("string").alias("transaction_id"),
        F.col("account").cast("string").alias("user_id"),
        p,
        F.round(F.greatest(p, 1 - p), 4).alias("confidence"),
        (p >= threshold).alias("prediction"),
        decision(p).alias("decision"),
        F.lit(threshold).alias("threshold"),
        F.lit("v2").alias("model_version"),
        F.col("ts").alias("created_at"),
        F.col("amount"), F.col("payment_channel"), F.col("location"),
        F.col("status"), F.col("is_fraud"),
        F.array_compact(F.array(
            F.when(F.col("amount") >= 50, F.lit("AMOUNT_OUTLIER")),
            F.when(F.col("location") == 0, F.lit("NEW_LOCATION")))).alias("risk_flags"),
    )


PREDICTIONS_SQL = f"""
SELECT CAST(row_id AS VARCHAR) AS transaction_id, CAST(account AS VARCHAR) AS user_id,
       fraud_probability,
       round(greatest(fraud_probability, 1 - fraud_probability), 4) AS confidence,
       fraud_probability >= 0.5 AS prediction,
       CASE WHEN fraud_probability >= 0.7 THEN 'BLOCK'
            WHEN fraud_probability >= 0.3 THEN 'REVIEW' ELSE 'ALLOW' END AS decision,
       CAST(0.5 AS DOUBLE) AS threshold, 'v2' AS model_version, ts AS created_at,
       amount, payment_channel, location, status, is_fraud,
       list_filter([CASE WHEN amount >= 50 THEN 'AMOUNT_OUTLIER' END,
                    CASE WHEN location = 0 THEN 'NEW_LOCATION' END], lambda x: x IS NOT NULL) AS risk_flags
FROM ({SCORED_TXN_SQL}) s
"""


def legacy_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy-shaped rows (identifier columns included) for O-25."""
    t = events_txn(spark, sf_dir)
    return t.select(
        F.col("row_id").cast("string").alias("transaction_id"),
        F.col("account"), F.col("ts"), F.col("amount"), F.col("payment_channel"),
        F.col("merchant"),
        F.col("account").cast("string").alias("sender_account"),
        F.col("receiver").cast("string").alias("receiver_account"),
        F.concat(F.lit("10.0."), F.col("from_bank"), F.lit("."), F.col("to_bank")).alias("ip_address"),
        F.sha2(F.col("account").cast("string"), 256).alias("device_hash"),
        F.when(F.col("is_fraud") == 1, "ERROR").alias("fraud_type"),
        F.col("is_fraud"),
    )


LEGACY_TXN_SQL = f"""
SELECT CAST(row_id AS VARCHAR) AS transaction_id, account, ts, amount, payment_channel,
       merchant, CAST(account AS VARCHAR) AS sender_account,
       CAST(receiver AS VARCHAR) AS receiver_account,
       '10.0.' || from_bank || '.' || to_bank AS ip_address,
       sha256(CAST(account AS VARCHAR)) AS device_hash,
       CASE WHEN is_fraud = 1 THEN 'ERROR' END AS fraud_type, is_fraud
FROM ({EVENTS_TXN_SQL}) e
"""


def raw_ts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps as text in two formats plus unparsable rows (O-26 input).

    Rows alternate between ``yyyy-MM-dd HH:mm:ss`` and ``yyyy/MM/dd HH:mm``
    and every user's junk events carry the literal ``'n/a'``.
    """
    e = table(spark, sf_dir, "events")
    text = (F.when(F.col("event_type") == "error", F.lit("n/a"))
            .when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm")))
    return e.select(F.col("event_id").alias("row_id"), text.alias("ts_text"))


RAW_TS_SQL = """
SELECT event_id AS row_id,
       CASE WHEN event_type = 'error' THEN 'n/a'
            WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(ts, '%Y/%m/%d %H:%M') END AS ts_text
FROM events
"""


def raw_score(row_id: str = "row_id"):
    """Unrounded stand-in probability (no exact 4-decimal ties)."""
    return F.pmod(F.col(row_id) * 7919, F.lit(100003)) / 100003.0


RAW_SCORE_SQL = "((row_id * 7919) % 100003) / 100003.0"


def failed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumer events with a processing outcome (O-58 input): error events
    fail; every fourth of them permanently; retry counts cycle 0..4."""
    t = events_txn(spark, sf_dir)
    kind = F.when(F.col("payment_channel") == "error",
                  F.when(F.pmod(F.col("row_id"), F.lit(4)) == 0, "PERMANENT").otherwise("RETRYABLE"))
    return t.select("row_id", kind.alias("error_kind"),
                    F.pmod(F.col("row_id"), F.lit(5)).cast("int").alias("retry_count"))


FAILED_EVENTS_SQL = f"""
SELECT row_id,
       CASE WHEN payment_channel = 'error' THEN
            CASE WHEN row_id % 4 = 0 THEN 'PERMANENT' ELSE 'RETRYABLE' END END AS error_kind,
       CAST(row_id % 5 AS INTEGER) AS retry_count
FROM ({EVENTS_TXN_SQL}) t
"""


def eval_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores for evaluation: label = fraud flag, score on a
    4-decimal grid built from integers (correlated with the label, many
    ties) so both engines compute the same doubles."""
    t = events_txn(spark, sf_dir)
    si = F.col("is_fraud") * 3500 + F.pmod(F.col("row_id") * 37, F.lit(1000)) * 6
    return t.select("row_id", F.col("is_fraud").alias("label"), (si / 10000.0).alias("score"))


EVAL_SCORED_SQL = f"""
SELECT row_id, is_fraud AS label, (is_fraud * 3500 + ((row_id * 37) % 1000) * 6) / 10000.0 AS score
FROM ({EVENTS_TXN_SQL}) t
"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored transactions keyed by transaction id (joins with predictions)."""
    t = events_txn(spark, sf_dir)
    return t.select(F.col("row_id").cast("string").alias("transaction_id"),
                    F.col("account").cast("string").alias("user_id"), "ts", "amount",
                    F.col("payment_channel").alias("payment_method"), "merchant",
                    F.col("location").cast("string").alias("location"), "status")


TRANSACTIONS_SQL = f"""
SELECT CAST(row_id AS VARCHAR) AS transaction_id, CAST(account AS VARCHAR) AS user_id, ts, amount,
       payment_channel AS payment_method, merchant, CAST(location AS VARCHAR) AS location, status
FROM ({EVENTS_TXN_SQL}) t
"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gateway requests derived from events (O-100 input)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("event_type").isin("purchase", "error"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("value") / 100.0).alias("duration_s"))


REQUEST_LOG_SQL = """
SELECT CASE WHEN event_type IN ('purchase', 'error') THEN 'POST' ELSE 'GET' END AS method,
       '/api/' || event_type AS path,
       CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
       value / 100.0 AS duration_s
FROM events
"""


# Fixed mapping from event types to request channels ('error' maps to an
# unsupported channel so validation has rejects).
REQUEST_CHANNELS = {"click": "CARD", "view": "UPI", "purchase": "NET_BANKING", "signup": "WALLET",
                    "error": "CRYPTO"}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests (F3 shape) derived from events."""
    e = table(spark, sf_dir, "events")
    m = F.create_map(*[F.lit(x) for kv in REQUEST_CHANNELS.items() for x in kv])
    return e.select(F.col("event_id").alias("row_id"), (F.col("value") - 0.02).alias("amount"),
                    m[F.col("event_type")].alias("payment_channel"))


REQUESTS_SQL = """
SELECT event_id AS row_id, value - 0.02 AS amount,
       CASE event_type WHEN 'click' THEN 'CARD' WHEN 'view' THEN 'UPI' WHEN 'purchase' THEN 'NET_BANKING'
                       WHEN 'signup' THEN 'WALLET' WHEN 'error' THEN 'CRYPTO' END AS payment_channel
FROM events
"""
