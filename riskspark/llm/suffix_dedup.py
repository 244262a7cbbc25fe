"""Suffix-array dedup: bytes covered by a ``window``-byte string that starts
anywhere else too.

1. Anchors: of the hashes of every ``inner``-byte string in a window the
   smallest is the window's anchor, so equal windows have the same anchor at
   the same place. A count-min sketch of all anchor places tells which
   anchors may occur twice; windows with another anchor are unique.
2. Runs: the windows around one anchor place. Equal runs collapse before any
   shuffle of text; those that occur twice are repeated as a whole.
3. The other runs of an anchor that several different runs share go, with
   those, through the column-wise construction of the collection's
   Burrows-Wheeler transform and common prefixes (``bwt.shared``). The anchor
   is the same string in all of them, so it stands as one symbol: a run is
   the bytes before it, the anchor, the bytes after it, and a repeated window
   is a common prefix of ``window - inner + 1`` symbols. Every window holds
   the anchor, so the construction starts from the sorted anchors with the
   bytes after them and goes on with the bytes before.
4. Rows of an anchor that tasks have met more than ``wide`` times collapse to
   distinct runs first. An anchor with more than ``wide`` distinct runs (a hot
   phrase) would make one collection too large for a task, so it is split by
   the bytes next to it: of a window's other symbols at least half stand
   before the anchor or half behind it, and windows that are equal agree in
   them. Those bytes join the anchor's symbol, the windows get shorter by as
   many symbols, equal pieces become one (the windows of all are repeated, and
   one stands for them against other pieces), and parts that are still too
   large are split again, down to windows of one symbol, all pieces of which
   are equal.

The temporary files of step 3 are deleted as soon as a collection is done;
collections hold at most ``collection`` runs and those of one more anchor.

Defined results: null and empty texts have no bytes; rows are judged as they
are given, so equal rows repeat each other, whether or not they share an id;
rows with a null id count and are cut like others; other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import bwt, sketch
from riskspark.llm.common import encode, grams, mix, signed, sliding_min, table, written

WINDOW, INNER = 400, 300
NONE = np.uint64(2 ** 64 - 1)


def anchors(texts: list[bytes], window: int, inner: int):
    """Bytes of all texts, their offsets, the hash of each inner string (NONE
    across texts), each window's anchor (0: no window) and the anchor places."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    span = window - inner + 1
    g = grams(flat.astype(np.uint64) + np.uint64(1), inner)
    n = len(g)
    g[owner[:n] != owner[inner - 1:inner - 1 + n]] = NONE
    m = sliding_min(g, span)
    m = np.where(owner[:len(m)] == owner[window - 1:window - 1 + len(m)], m, 0) if len(m) else m
    if not len(m):
        return flat, starts, owner, g, m, np.empty(0, np.int64)
    pad = np.zeros(span - 1, np.uint64)
    highest = ~sliding_min(~np.concatenate([pad, m, pad]), span)
    return flat, starts, owner, g, m, np.flatnonzero((highest == g) & (g != NONE) & (highest > 0))


def runs_at(g: np.ndarray, m: np.ndarray, places: np.ndarray, span: int):
    """First and last window around each anchor place."""
    new = np.ones(len(m), bool)
    new[1:] = m[1:] != m[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m)) - 1
    used = m[first] > 0
    first, last = first[used], last[used]
    _, ids = np.unique(np.concatenate([m[first], g[places]]), return_inverse=True)
    ids = ids.astype(np.int64) << 36
    run_key, place_key = ids[:len(first)] | first, ids[len(first):] | places
    order = np.argsort(run_key)
    at = order[np.searchsorted(run_key[order], place_key, side="right") - 1]
    return np.maximum(first[at], places - span + 1), np.minimum(last[at], places)


def _texts(b: pd.DataFrame, limit: int = 1_000_000):
    """Pieces of a batch with about ``limit`` bytes."""
    held, size = [], 0
    for i, t in enumerate(b["text"]):
        held.append(i)
        size += 0 if t is None else len(t)
        if size >= limit:
            yield b.iloc[held]
            held, size = [], 0
    if held:
        yield b.iloc[held]


def run_rows(part: pd.DataFrame, window: int, inner: int, repeated, met: dict) -> pd.DataFrame | None:
    """Where the runs of a batch are; ``met`` gets each run's bytes once and
    how often the task has met it."""
    flat, starts, owner, g, m, places = anchors([encode(t) for t in part["text"]], window, inner)
    places = places[repeated(g[places])] if len(places) else places
    if not len(places):
        return None
    s, e = runs_at(g, m, places, window - inner + 1)
    with np.errstate(over="ignore"):  # first and last inner string cover the run
        run = mix(g[s] * np.uint64(0x9E3779B97F4A7C15) + mix(g[e + window - inner]) + ((places - s) << 20 | (e - s)).astype(np.uint64))
    key, run = signed(g[places]), signed(run)
    left, n = places - s, e - s + 1
    raw = flat.tobytes()
    for k, r, a, p, z, size in zip(key.tolist(), run.tolist(), s.tolist(), places.tolist(), (e + window).tolist(), n.tolist()):
        there = met.get((k, r))
        if there is None:
            met[k, r] = [1, p - a, size, raw[a:p] + raw[p + inner:z]]
        else:
            there[0] += 1
    own = owner[places]
    return pd.DataFrame({"key": key, "run": run, "doc": part["doc"].to_numpy()[own], "start": s - starts[own], "n": n})


def kinds_met(met: dict) -> pd.DataFrame:
    """The runs a task has met, as rows without a document."""
    return pd.DataFrame([(k, r, size, left, times, body) for (k, r), (times, left, size, body) in met.items()],
                        columns=["key", "run", "n", "left", "times", "body"])


def collections_of(batches: Iterator[pd.DataFrame], size: int):
    """Rows sorted by part, cut between parts into pieces of about ``size``."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= size:
            rows = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(rows["part"].to_numpy(), rows["part"].iloc[-1]))
            if cut:
                yield rows.iloc[:cut]
            held = [rows.iloc[cut:]]
    if held:
        rows = pd.concat(held, ignore_index=True)
        if len(rows):
            yield rows


def repeated_windows(rows: pd.DataFrame, span: int) -> list[np.ndarray]:
    """Which windows of each run occur at another place of the collection."""
    heads, tails = [], []
    for body, left, part in zip(rows["body"], rows["left"].tolist(), rows["part"].tolist()):
        heads.append(np.frombuffer(body, np.uint8, left).astype(np.uint16) + np.uint16(1))
        tails.append((part, body[left:]))
    return bwt.shared(heads, span, tails)


#: A run, or its windows ``at`` .. ``at + n - 1``, in a collection ``part``.
PART = "part long, key long, run long, left int, n int, at int, times long, body binary"


def construct(span: int, size: int, whole: bool = True):
    """The windows that are repeated in collections of whole parts. Runs met
    several times are given as a whole, unless they have been given before."""
    def build(batches: Iterator[pd.DataFrame]):
        for rows in collections_of(batches, size):
            rows = rows.groupby(["part", "run"], sort=False).agg(
                key=("key", "first"), left=("left", "first"), n=("n", "first"), at=("at", "first"), times=("times", "sum"),
                body=("body", "first")).reset_index()
            of_part = rows.groupby("part")["times"]
            mixed = (of_part.transform("size") > 1) & (of_part.transform("min") == 1)
            if whole:
                again = rows[rows["times"] > 1]
                yield pd.DataFrame({"key": again["key"], "run": again["run"], "ats": None})
            rows = rows[mixed]
            if len(rows):
                ats = repeated_windows(rows, span)
                once = [i for i, t in enumerate(rows["times"]) if t == 1 and len(ats[i])]
                if once:  # an empty column of lists would have no type
                    yield pd.DataFrame({"key": rows["key"].to_numpy()[once], "run": rows["run"].to_numpy()[once],
                                        "ats": [ats[i] + rows["at"].iloc[i] for i in once]})

    return build


def halves(span: int, most_met: int = 200_000):
    """Splits parts by the ``span // 2`` bytes before the anchor's symbol, for
    windows that hold them, and by those behind it for the others. A task
    gives equal pieces once, as one met several times, and the windows of
    those it has met before as found."""
    half = span // 2

    def pieces(b: pd.DataFrame):
        for part, key, run, left, n, at, times, body in b.itertuples(index=False):
            low = left - n + 1  # bytes before the symbol in the last window
            if left >= half:
                least = max(half, low)
                symbol = xxhash.xxh3_64_intdigest(body[left - half:left], part & (2 ** 64 - 1))
                yield (symbol, left - half, left - least + 1, body[:left - half] + body[left:left + span - 1 - least]), key, run, at, times
            if low < half:
                most = min(left, half - 1)
                symbol = xxhash.xxh3_64_intdigest(body[left:left + half], ~part & (2 ** 64 - 1))
                yield (symbol, most, most - low + 1, body[left - most:left] + body[left + half:]), key, run, at + left - most, times

    def told(met: dict) -> pd.DataFrame:
        frame = pd.DataFrame([(p, key, run, left, n, at, times, body) for (p, left, n, body), (key, run, at, times) in met.items()],
                             columns=["part", "key", "run", "left", "n", "at", "times", "body"])
        frame["part"] = signed(frame["part"].to_numpy(np.uint64))
        met.clear()
        return frame

    def split(batches: Iterator[pd.DataFrame]):
        met: dict = {}
        for b in batches:
            found = []
            for piece, key, run, at, times in pieces(b):
                there = met.get(piece)
                if there is None:
                    met[piece] = [key, run, at, times]
                    continue
                found += [(k, r, a, piece[2]) for k, r, a, t in (there, (key, run, at, times)) if t == 1]
                there[3] += times
            if found:
                yield pd.DataFrame(found, columns=["key", "run", "at", "n"]).reindex(
                    columns=["part", "key", "run", "left", "n", "at", "times", "body"]).astype({"part": "Int64", "left": "Int64", "times": "Int64"})
            if len(met) > most_met:  # bounds the task's memory
                yield told(met)
        if met:
            yield told(met)

    return split


def split_hot(parts: DataFrame, span: int, wide: int, size: int) -> DataFrame:
    """Repeated windows of distinct runs in parts of any size."""
    found = [parts.where("times > 1").select("key", "run", F.lit(None).cast("array<int>").alias("ats"))]
    ats = F.expr("sequence(at, at + n - 1)").alias("ats")
    while True:
        runs = parts.groupBy("part").agg(F.count(F.lit(1)).alias("runs"), F.min("times").alias("least"))
        judged = written(runs.where("runs > 1 and least = 1").drop("least"), "parts")  # others have nothing to find
        open_parts = parts.join(judged, "part")
        small = open_parts.where(F.col("runs") <= wide).drop("runs").repartition("part").sortWithinPartitions("part")
        found.append(written(small.mapInPandas(construct(span, size, whole=False), "key long, run long, ats array<int>"), "judged"))
        if judged.where(F.col("runs") > wide).isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        hot = open_parts.where(F.col("runs") > wide).drop("runs").select(*parts.columns)
        split = written(hot.mapInPandas(halves(span), PART), "halves")
        found.append(split.where("part is null").select("key", "run", ats))
        # equal pieces of several tasks: a task tells a piece once, so a list has about an entry a task
        one = F.struct("key", "run", "at")
        equal = written(split.where("part is not null").groupBy("part", "left", "n", "body").agg(
            F.first(one).alias("one"), F.sum("times").alias("times"), F.collect_list(F.when(F.col("times") == 1, one)).alias("once")), "pieces")
        found.append(equal.where("times > 1").select(F.explode("once").alias("one"), "n").select("one.*", "n").select("key", "run", ats))
        parts, span = equal.select("part", "one.key", "one.run", "left", "n", "one.at", "times", "body"), span - span // 2


def remove_repeats(docs: DataFrame, window: int = WINDOW, inner: int = INNER, id_col: str = "doc_id",
                   text_col: str = "text", bits: int = sketch.BITS, wide: int = 2000,
                   collection: int = 6000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256."""
    span = window - inner + 1
    # equal rows have equal texts and so equal cuts: a row is told by its text
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = rows.where(F.octet_length("text") >= window).select(F.xxhash64("id", "text").alias("doc"), "text")

    def keys_of(b: pd.DataFrame) -> np.ndarray:
        out = [np.empty(0, np.uint64)]
        for part in _texts(b):
            _, _, _, g, _, places = anchors([encode(t) for t in part["text"]], window, inner)
            out.append(g[places])
        return np.concatenate(out)

    seen_twice = sketch.repeated(known.select("text"), keys_of, bits)

    schema = "key long, run long, doc long, start int, n int, left int, times long, body binary"

    def whole_rows(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reindex(columns=["key", "run", "doc", "start", "n", "left", "times", "body"])
        return rows.astype({c: "Int64" for c in ("doc", "start", "left", "times")})

    def runs_of(batches: Iterator[pd.DataFrame]):
        met: dict = {}
        for b in batches:
            for part in _texts(b):
                out = run_rows(part, window, inner, seen_twice.value, met)
                if out is not None:
                    yield whole_rows(out)
                if len(met) > 200_000:  # bounds the task's memory
                    yield whole_rows(kinds_met(met))
                    met.clear()
        if met:
            yield whole_rows(kinds_met(met))

    runs = written(known.mapInPandas(runs_of, schema), "runs")
    kinds = runs.where("doc is null").select(F.col("key").alias("part"), "key", "run", "left", "n", F.lit(0).alias("at"), "times", "body")
    # anchors with so many rows of runs that they can't be one collection
    hot = written(kinds.groupBy("part").agg(F.count("*").alias("rows")).where(F.col("rows") > wide).select("part"), "hot-anchors")
    built = (kinds.join(hot, "part", "left_anti").repartition("part").sortWithinPartitions("part")
             .mapInPandas(construct(span, collection), "key long, run long, ats array<int>"))
    distinct = kinds.join(hot, "part", "left_semi").groupBy("part", "key", "run").agg(
        F.first("left").alias("left"), F.first("n").alias("n"), F.first("at").alias("at"), F.sum("times").alias("times"), F.first("body").alias("body"))
    judged = written(built.unionByName(split_hot(written(distinct, "distinct"), span, wide, collection)), "judged")
    hits = (runs.where("doc is not null").select("key", "run", "doc", "start", "n").join(judged, ["key", "run"])
            .groupBy("doc").agg(F.collect_list(F.struct("start", "n", "ats")).alias("hits")))  # of one document

    def cut(batches: Iterator[pd.DataFrame]):
        for b in batches:
            out = []
            for text, hit in zip(b["text"], b["hits"]):
                raw = encode(text)
                removed, spans, kept = 0, 0, raw
                if hit is not None and len(hit):
                    edge = np.zeros(len(raw) + 1, np.int64)
                    for h in hit:
                        if h["ats"] is None:  # the whole run
                            edge[h["start"]] += 1
                            edge[h["start"] + h["n"] - 1 + window] -= 1
                        else:
                            at = h["start"] + np.asarray(h["ats"], np.int64)
                            edge[at] += 1
                            edge[at + window] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int((gone & ~np.append(False, gone[:-1])).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
            yield pd.concat([b[["id"]].reset_index(drop=True), pd.DataFrame(
                out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])], axis=1)

    id_type = rows.schema["id"].dataType.simpleString()
    whole = rows.withColumn("doc", F.xxhash64("id", "text")).join(hits, "doc", "left").select("id", "text", "hits")
    return whole.mapInPandas(cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, "
                                  "kept_sha256 string").withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
