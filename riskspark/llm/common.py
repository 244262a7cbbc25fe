"""Small helpers shared by the text operators: tables, folders, words, hashes."""

from __future__ import annotations

import os
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from riskspark.session import ensure_checkpoint_dir, ship_package

#: Words are runs of anything but these ASCII white-space characters
#: (exactly what ``bytes.split()`` splits on).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; ships the package to Python workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder (a new one per call,
    so repeated runs never read each other's files)."""
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local" and not (
            spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        raise ValueError("set spark.checkpoint.dir to a shared folder on a cluster")
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost
    executors, and gives both sides of a later join their own exchange."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so
    (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mounted(path: str) -> str:
    """The path workers can open or map; only mounted folders qualify."""
    plain = path[len("file:"):] if path.startswith("file:") else path
    if not plain.startswith("/"):
        raise ValueError(f"{path}: the model files are memory-mapped, so "
                         "spark.checkpoint.dir must be a folder that every worker mounts")
    return "/" + plain.lstrip("/")


def atomic_save(path: str, array: np.ndarray) -> None:
    """Write a .npy so that retried and speculative tasks can repeat it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


#: Bytes that one worker's memory of words may take, and what an entry takes
#: besides the word itself (its slot in the dict, its object, its value).
REMEMBERED, ENTRY = 32 << 20, 140


class Bounded(dict):
    """A memory of at most ``REMEMBERED`` bytes; a full one starts anew."""

    held = 0

    def keep(self, key, value, size: int):
        self.held += size + ENTRY
        if self.held > REMEMBERED:
            self.clear()
            self.held = size + ENTRY
        self[key] = value
        return value


class WordHash(Bounded):
    """word (bytes) -> 64-bit hash, remembering the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        return self.keep(word, xxhash.xxh3_64_intdigest(word), len(word))


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def hashed_words(texts, seen: WordHash, lower: bool = False):
    """Words of all ``texts`` as one hash array, and where each text starts
    (``len(texts) + 1`` offsets). ``lower`` lower-cases A-Z only."""
    starts, parts = [0], []
    for t in texts:
        b = encode(t)
        words = (b.lower() if lower else b).split()
        parts.append(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)))
        starts.append(starts[-1] + len(words))
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return flat, np.asarray(starts, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def grams(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``n`` neighbours of ``h``; log2(n) doubling steps."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    b = np.uint64(base | 1)
    out, have, step = None, 0, np.asarray(h, np.uint64)
    size, power, bit = 1, b, n
    with np.errstate(over="ignore"):
        while bit:
            if bit & 1:
                if out is None:
                    out, have = step, size
                else:  # out covers `have` symbols, step the `size` after them
                    m = len(h) - have - size + 1
                    out, have = out[:m] * power + step[have:have + m], have + size
            bit >>= 1
            if bit:
                m = len(step) - size
                step = step[:m] * power + step[size:size + m]
                power, size = power * power, size * 2
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    if len(x) < w:
        return x[:0]
    size, m = 1, x
    while size * 2 <= w:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    rest = w - size
    return np.minimum(m[:len(x) - w + 1], m[rest:rest + len(x) - w + 1])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed longs."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
