"""A keyed table that batches upsert into (O-39 in a stream).

Rows are dealt to a fixed number of buckets by a hash of the key. A batch
rewrites only the buckets it has rows for: their current rows are read, the
batch's rows replace those with the same key, and the result goes to a folder
of that batch (copy on write). A manifest, one row per bucket with the batch
that wrote it last, is written after the data and makes the batch count;
readers follow the newest manifest, so a batch that failed half-way shows
nowhere, and a batch id that has a manifest is never applied again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """``path`` is a folder that all executors share; ``buckets`` is fixed for
    the life of the table (a bucket should fit a few tasks)."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict[int, int] | None:
        """bucket -> the batch that wrote it last; None before the first."""
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return None
        done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder)
                if fs.exists(self._jvm().org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        if not done:
            return None
        rows = self.spark.read.schema("bucket int, wrote long").parquet(f"{self.path}/manifest/at={max(done)}").collect()  # <= buckets rows
        return {r["bucket"]: r["wrote"] for r in rows}

    def applied(self, batch_id: int) -> bool:
        fs, done = self._fs(f"{self.path}/manifest/at={batch_id}/_SUCCESS")
        return fs.exists(done)

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None for an empty table."""
        found = self.manifest() or {}
        paths = [f"{self.path}/data/wrote={w}/bucket={b}" for b, w in sorted(found.items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, rows: DataFrame, batch_id: int) -> list[int]:
        """Upsert ``rows`` (one per key) as batch ``batch_id`` and return the
        buckets it rewrote; a batch that is in already changes nothing."""
        if self.applied(batch_id):
            return []
        new = rows.withColumn("bucket", self.bucket()).persist()
        try:
            touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # <= buckets rows
            before = self.manifest() or {}
            old = self.read(touched)
            merged = new
            if old is not None:
                kept = old.join(new.select(F.col(self.key).alias("_k")), F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")
                merged = kept.withColumn("bucket", self.bucket()).unionByName(new)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/wrote={batch_id}")
            state = {**before, **{b: batch_id for b in touched}}
            (self.spark.createDataFrame(sorted(state.items()), "bucket int, wrote long").coalesce(1)
             .write.mode("overwrite").parquet(f"{self.path}/manifest/at={batch_id}"))
            return touched
        finally:
            new.unpersist()

    def _jvm(self):
        return self.spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self._jvm().org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p
