"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # keyed streaming state: RocksDB store; the Python state client talks
    # to the JVM over a unix domain socket instead of a loopback TCP port
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.python.unix.domain.socket.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "riskspark",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is used as is; only
    when it is unset (local tests) a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = tempfile.mkdtemp(prefix="riskspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder.

    A reliable checkpoint survives executor loss (unlike a local
    checkpoint), and later stages read it instead of recomputing the plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ck = df.checkpoint(eager=True)
    # fresh attribute ids: the checkpointed relation keeps the ids of the
    # plan it came from, which may also appear in other branches
    from pyspark.sql import functions as F

    return ck.select(*[F.col(f"`{c}`").alias(c) for c in ck.columns])


def table_dir(spark: SparkSession, name: str) -> str:
    """A folder for a written intermediate table under the checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a fresh folder of the checkpoint dir: smaller than
    a checkpoint of rows.  The shuffles behind it are no longer needed; a
    collection in the driver lets Spark's cleaner delete their files now."""
    spark = df.sparkSession
    path = table_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    schema = df.schema
    del df
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after checking the row count (one small action);
    larger tables are left to the planner's own size checks."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Make ``riskspark`` importable by Python workers (pandas UDFs,
    ``mapInPandas``, streaming state processors) with ``addPyFile``.

    The package is zipped once per SparkContext into the checkpoint folder
    when that is a local path (else into a driver-side build folder); Spark
    then serves the archive to every executor, and driver-side Python
    runners get it through the context's PYTHONPATH.
    """
    sc = spark.sparkContext
    if getattr(sc, "_riskspark_shipped", False):
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else base
    target = local if local.startswith("/") else tempfile.mkdtemp(prefix="riskspark-pkg-")
    os.makedirs(target, exist_ok=True)
    path = os.path.join(target, "riskspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    # Python processes started by the JVM on the driver (the streaming
    # state pre-init runner) take PYTHONPATH from the context environment
    prev = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (path, prev) if p)
    sc._riskspark_shipped = True
