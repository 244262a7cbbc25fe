"""Substring dedup: words covered by a run of ``window`` words that also
starts in a document with a smaller id.

1. Every window has a key, the smallest hash of its inner ``window // 2``-word
   grams; equal windows have equal keys and neighbouring windows mostly share
   one. A count-min sketch of the keys of each document (merged partition
   sketches) overestimates in how many documents a key, and so a window,
   occurs; windows whose key is not estimated repeated are done.
2. The others are grouped exactly by hash: first whole runs of windows that
   share a key (so that copies collapse before any shuffle of windows), then
   the windows of the distinct runs. Runs and windows are told apart by 128
   bits (64 of the key, 64 of their own).

Hot groups: copies collapse by map-side ``min(doc_id)``; joins on hot runs or
windows stand on two exchanges each, which AQE splits.

Defined results: a null or empty text has no words; a null id is neither
smaller nor larger than any, so nothing is removed from its row and it makes
no other row lose words; rows that share an id are judged one by one and none
is smaller than the other; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import sketch
from riskspark.llm.common import WordHash, encode, grams, hashed_words, signed, sliding_min, table, written

#: Longest run of windows that is looked at as one.
RUN = 32


def windows_of(texts, window: int, seen: WordHash):
    """(text, start in it, key, window hash) of every window of the texts."""
    flat, starts = hashed_words(texts, seen)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = grams(flat, window)
    keys = sliding_min(grams(flat, window // 2, 0xD6E8FEB86659FD93), window - window // 2 + 1)
    n = len(whole)
    ok = owner[:n] == owner[window - 1:window - 1 + n]
    own = owner[:n][ok]
    return own, np.flatnonzero(ok) - starts[own], keys[:n][ok], whole[ok]


def _chunks(b: pd.DataFrame, rows: int = 256):
    """Batches of few texts, so that hash arrays stay small."""
    for at in range(0, len(b), rows):
        yield b.iloc[at:at + rows].reset_index(drop=True)


def run_rows(b: pd.DataFrame, window: int, repeated, seen: WordHash) -> pd.DataFrame:
    """The runs of a batch whose key is estimated repeated."""
    own, at, keys, whole = windows_of(b["text"], window, seen)
    maybe = repeated(keys)
    own, at, keys, whole = own[maybe], at[maybe], keys[maybe], whole[maybe]
    n = len(own)
    if not n:
        return pd.DataFrame({"key": [], "run": [], "id": [], "th": [], "start": [], "blob": []})
    new = np.ones(n, bool)
    new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    cuts = np.flatnonzero(since % RUN == 0)
    ends = np.append(cuts[1:], n)
    with np.errstate(over="ignore"):  # order matters: weigh each window by its place
        weights = (2 * (since % RUN).astype(np.uint64) + np.uint64(3)) ** np.uint64(9)
        run = np.add.reduceat(whole * weights, cuts) * np.uint64(RUN + 1) + (ends - cuts).astype(np.uint64)
    raw = whole.astype("<u8").tobytes()
    return pd.DataFrame({
        "key": signed(keys[cuts]), "run": signed(run), "id": b["id"].to_numpy()[own[cuts]],
        "th": b["th"].to_numpy()[own[cuts]], "start": at[cuts],
        "blob": [raw[8 * s:8 * e] for s, e in zip(cuts.tolist(), ends.tolist())]})


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   bits: int = sketch.BITS) -> DataFrame:
    """id, n_words, n_removed, kept (text of the kept words, one blank
    between), kept_sha256; one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))  # tells rows that share an id apart

    def keys_of(b: pd.DataFrame) -> np.ndarray:
        seen, out = keys_of.__dict__.setdefault("seen", WordHash()), []
        for part in _chunks(b):
            own, _, keys, _ = windows_of(part["text"], window, seen)
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
            own, keys = own[new], keys[new]
            order = np.lexsort((keys, own))  # once for each document
            own, keys = own[order], keys[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
            out.append(keys[new])
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    known = rows.where("id is not null and text is not null")
    seen_twice = sketch.repeated(known.select("text"), keys_of, bits)

    def runs_of(batches: Iterator[pd.DataFrame]):
        seen = WordHash()
        for b in batches:
            for part in _chunks(b):
                out = run_rows(part, window, seen_twice.value, seen)
                if len(out):
                    yield out

    runs = written(known.mapInPandas(
        runs_of, "key long, run long, id long, th long, start int, blob binary"), "runs")
    # distinct runs: the first document of each, and its windows
    firsts = written(runs.groupBy("key", "run").agg(F.min("id").alias("first"), F.count("*").alias("n"),
                                                    F.min("blob").alias("blob")), "first-runs")

    def windows(batches: Iterator[pd.DataFrame]):
        for b in batches:
            n = b["blob"].str.len().to_numpy() // 8
            total = int(n.sum())
            yield pd.DataFrame({
                "key": np.repeat(b["key"].to_numpy(), n), "run": np.repeat(b["run"].to_numpy(), n),
                "first": np.repeat(b["first"].to_numpy(), n),
                "at": np.arange(total) - np.repeat(np.cumsum(n) - n, n),
                "hash": np.frombuffer(b"".join(b["blob"]), "<i8")})

    spread = firsts.mapInPandas(windows, "key long, run long, first long, at int, hash long")
    earliest = written(spread.groupBy("key", "hash").agg(F.min("first").alias("least"), F.max("first").alias("most"))
                       .where("least < most").drop("most"), "windows")
    earlier = (spread.join(earliest, ["key", "hash"]).where("least < first")
               .groupBy("key", "run").agg(F.collect_list("at").alias("ats")))  # at most RUN of a run
    judged = written(firsts.where("n > 1").select("key", "run", "first")
                     .join(earlier, ["key", "run"], "full_outer"), "judged-runs")
    # a run that an earlier document has goes whole, else the windows found
    hits = (runs.select("key", "run", "id", "th", "start", (F.length("blob") / 8).cast("int").alias("n"))
            .join(judged, ["key", "run"])
            .select("id", "th", "start", F.when(F.col("first") < F.col("id"),
                                                F.sequence(F.lit(0), F.col("n") - 1))
                    .otherwise(F.col("ats")).alias("ats"))
            .where("ats is not null")
            .groupBy("id", "th").agg(F.collect_list(F.struct("start", "ats")).alias("hits")))  # of one document

    def cut(batches: Iterator[pd.DataFrame]):
        for b in batches:
            out = []
            for text, hit in zip(b["text"], b["hits"]):
                words = encode(text).split()
                n = len(words)
                if hit is not None and len(hit):
                    at = np.concatenate([h["start"] + np.asarray(h["ats"], np.int64) for h in hit])
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            yield pd.concat([b[["id"]].reset_index(drop=True), pd.DataFrame(
                out, columns=["n_words", "n_removed", "kept", "kept_sha256"])], axis=1)

    whole = rows.join(hits, ["id", "th"], "left").select("id", "text", "hits")
    return whole.mapInPandas(cut, "id long, n_words long, n_removed long, kept string, kept_sha256 string"
                             ).withColumnRenamed("id", id_col)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
