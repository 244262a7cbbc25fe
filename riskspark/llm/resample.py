"""Quality classifier by importance resampling.

Two generative bag-of-n-grams models share hashed buckets: one of the target
text (labelled documents that are good) and one of the raw text (labelled
documents of all kinds, a labelled sample of the corpus). The importance of a text is the ratio of its probabilities under the two, taken
over its least target-like stretch of ``span`` words, so that one bad passage
in a long text weighs as much as in a short one. Longer texts have more
stretches, so their least falls; by how much is fitted to the good labelled
texts and taken off (a line in the logarithm of the number of stretches). The sample is the top k of
log importance / ``temperature`` + Gumbel noise (a hash of the row, so runs
repeat), with k the number of documents whose stretch lies above the level
that divides the labelled documents best.

N-grams: words, their first four and six letters, word shapes (runs of
capitals, small letters, digits and other signs), and pairs of words and of
shapes. The target model is shrunk
to the raw one: p_t = p_r * (c + a) / (E + a), with c the count in the target
text and E the count expected there from the raw model.

Both models are fitted to at most ``max_labels`` labelled rows, those with the
smallest hash of their id; every document is scored. Raw counts over all
documents make n-grams that only unlabelled documents have look unlike the
target (most clean unlabelled documents and their copies were dropped), so
n-grams outside the labelled sample are neutral. The text of a labelled
document is left out of the counts when it is scored itself.

Defined results: null and empty texts have no n-grams, log importance 0 and
so are judged like neutral text; rows with a null id are kept or dropped like
any other; without labels of both kinds every document is kept; equal keys at
the limit are kept together; other columns are kept, whatever their names
(a new column whose name is taken gets underscores in front).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import encode, free, mix, table, written

BITS, SPAN, PRIOR, TEMPERATURE, MAX_LABELS = 20, 5, 0.5, 0.1, 20_000
#: Letters of the word starts; parts of which pairs count too (0 words, 1 shapes).
STEMS, PAIRS = (4, 6), (0, 1)
_SHAPES = ((re.compile(rb"[A-Z][A-Z]+"), b"AA"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))


def shape(word: bytes) -> bytes:
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return word[:12]


class Words(dict):
    """word -> its row in the tables of part hashes. A task begins anew when
    they hold more than ``limit`` words, and only between batches of texts."""

    def __init__(self, limit: int = 60_000):
        super().__init__()
        self.limit, self.hashes = limit, [array("Q") for _ in range(2 + len(STEMS))]

    def begin(self):
        if len(self) > self.limit:
            self.clear()
            for h in self.hashes:
                del h[:]

    def __missing__(self, word: bytes) -> int:
        letters = word.decode("utf-8", "surrogatepass").lower()
        parts = (word, shape(word), *(letters[:n].encode("utf-8", "surrogatepass") for n in STEMS))
        for h, part in zip(self.hashes, parts):
            h.append(xxhash.xxh3_64_intdigest(part))
        at = self[word] = len(self)
        return at


class Grams:
    """Buckets of the n-grams that start at each word of the texts."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, Words()

    def __call__(self, texts):
        self.words.begin()
        seen, at, starts = self.words, [], [0]
        for t in texts:
            w = encode(t).split()
            at.append(np.fromiter(map(seen.__getitem__, w), np.int32, len(w)))
            starts.append(starts[-1] + len(w))
        at = np.concatenate(at) if at else np.empty(0, np.int32)
        starts = np.asarray(starts)
        last = np.zeros(len(at), bool)  # no pair starts at a text's last word
        last[starts[1:][np.diff(starts) > 0] - 1] = True
        step, out = np.uint64(64 - self.bits), []
        for salt, part in enumerate(seen.hashes):
            known = np.array(part, np.uint64)
            out.append((mix(known + np.uint64(salt)) >> step).astype(np.int32)[at] if len(at) else at)
            if salt in PAIRS and len(at):
                h = known[at]
                pair = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.append(h[1:], h[:1]) + np.uint64(salt + 8)) >> step
                out.append(np.where(last, -1, pair.astype(np.int32)))
        return out, starts


def pieces(b: pd.DataFrame, letters: int = 1_000_000):
    """Parts of a batch with about so many characters of text."""
    held, size = [], 0
    for i, t in enumerate(b["text"]):
        held.append(i)
        size += 0 if t is None else len(t)
        if size >= letters:
            yield b.iloc[held]
            held, size = [], 0
    if held:
        yield b.iloc[held]


def counts(docs: DataFrame, bits: int) -> np.ndarray:
    """How often each bucket occurs in the raw text and in the target text
    (where ``good``): 2 x 2**bits numbers, summed in Spark."""

    def count(batches: Iterator[pd.DataFrame]):
        grams, raw, good = Grams(bits), np.zeros(2 ** bits, np.int64), np.zeros(2 ** bits, np.int64)
        for b in batches:
            for part in pieces(b):
                lists, starts = grams(part["text"])
                is_good = np.repeat(part["good"].to_numpy(bool), np.diff(starts))
                for x in lists:
                    np.add.at(raw, x[x >= 0], 1)
                    np.add.at(good, x[(x >= 0) & is_good], 1)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "good": good[at]})

    found = (docs.select("text", "good").mapInPandas(count, "bucket int, raw long, good long")
             .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))).toArrow()
    out = np.zeros((2, 2 ** bits), np.float32)  # at most 2**bits rows of numbers
    out[0, found["bucket"].to_numpy()], out[1, found["bucket"].to_numpy()] = found["raw"].to_numpy(), found["good"].to_numpy()
    return out


def log_ratio(raw: np.ndarray, good: np.ndarray, prior: float) -> np.ndarray:
    """log p_target / p_raw of each bucket."""
    expected = raw * (good.sum() / max(raw.sum(), 1.0))
    return np.log((good + prior) / (expected + prior))


def importances(texts, good, grams: Grams, raw: np.ndarray, target: np.ndarray, weights: np.ndarray,
                span: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Log importance of each text, that of its least target-like stretch, and
    its number of words. ``good`` is None for a text without label."""
    lists, starts = grams(texts)
    share = target.sum() / max(raw.sum(), 1.0)
    each = np.zeros(starts[-1], np.float64)
    for x in lists:
        each += np.where(x >= 0, weights[np.maximum(x, 0)], 0.0)
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if a < b and good[i] is not None:  # without the text itself
            x = np.concatenate([y[a:b] for y in lists])
            used, back, n = np.unique(x, return_inverse=True, return_counts=True)
            n[used < 0] = 0
            w = np.log((target[used] - n * bool(good[i]) + prior) / ((raw[used] - n) * share + prior))
            w[used < 0] = 0.0
            each[a:b] = w[back].reshape(len(lists), -1).sum(axis=0)
    return least_stretch(each, starts, span), np.diff(starts)


def least_stretch(each: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Least sum of ``span`` neighbours in each text (of all, if fewer)."""
    out, size = np.zeros(len(starts) - 1), np.diff(starts)
    total = np.append(0.0, np.cumsum(each))
    short = size < span
    out[short] = (total[starts[1:]] - total[starts[:-1]])[short]
    if (~short).any():
        sums = total[span:] - total[:-span]
        a, b = starts[:-1][~short], starts[1:][~short] - span + 1
        ends = np.append(sums, np.inf)  # an end may be the array's own
        out[~short] = np.minimum.reduceat(ends, np.stack([a, b], 1).ravel())[::2]
    return out


def length_slope(score: np.ndarray, long: np.ndarray, good: np.ndarray) -> float:
    """How much the least stretch of good texts falls with ``long``, the
    logarithm of their number of stretches (least squares)."""
    x, y = long[good], score[good]
    x = x - x.mean() if len(x) else x
    return min(0.0, float(x @ y) / float(x @ x)) if len(x) and float(x @ x) > 0 else 0.0


def kth_largest(keys: DataFrame, k: int, col: str = "key", bins: int = 1024) -> float:
    """The k-th largest value, by counting in ever narrower bins."""
    low, high, above = *keys.agg(F.min(col), F.max(col)).first(), 0
    while high > low:
        width = (high - low) / bins
        if low + width <= low:
            break
        inside = keys.where((F.col(col) >= low) & (F.col(col) <= high))
        place = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1))
        found = sorted(inside.groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(col).alias("a"), F.max(col).alias("b")).collect(), key=lambda r: -r["bin"])
        for r in found:
            if above + r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return low


def best_level(score: np.ndarray, good: np.ndarray, tolerance: float = 1.0) -> float:
    """The level with the fewest errors; a lost good document counts
    ``tolerance`` times."""
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order].astype(float)
    errors = np.append(0, np.cumsum(g)) * tolerance + (1 - g).sum() - np.append(0, np.cumsum(1 - g))
    errors[1:-1][s[1:] == s[:-1]] = np.inf  # equal scores stay on one side
    at = int(np.argmin(errors))
    if at == 0:
        return -np.inf
    return (s[at - 1] + s[at]) / 2 if at < len(s) else np.inf


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", bits: int = BITS, span: int = SPAN,
           prior: float = PRIOR, max_labels: int = MAX_LABELS):
    """(docs with ``__log_importance``, level that divides the labels, None
    without labels of both kinds)."""
    spark = docs.sparkSession
    SCORE, LONG, ID, GOOD = (free(docs, c) for c in ("__log_importance", "__long", "__label_id", "__good"))
    used = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
            .groupBy(F.col(id_col).cast("bigint").alias(ID))
            .agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias(GOOD))
            .orderBy(F.xxhash64(ID), ID).limit(max_labels))  # at most max_labels rows
    marked = docs.join(F.broadcast(used), docs[id_col].cast("bigint") == used[ID], "left")
    raw, good = counts(marked.where(F.col(GOOD).isNotNull()).select("text", F.col(GOOD).alias("good")), bits)
    models = spark.sparkContext.broadcast((raw, good, log_ratio(raw, good, prior)))  # 3 * 2**bits numbers
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema) + f", {SCORE} double, {LONG} double"

    def score(batches: Iterator[pd.DataFrame]):
        grams = Grams(bits)
        for b in batches:
            for part in pieces(b):
                label = [None if pd.isna(g) else bool(g) for g in part[GOOD]]
                found, words = importances(part["text"], label, grams, *models.value, span, prior)
                yield part.assign(**{SCORE: found, LONG: np.log(np.maximum(words - span + 1, 1))})

    rows = written(marked.mapInPandas(score, schema), "importance")
    # one score a label: of repeated ids the least
    seen = rows.where(F.col(GOOD).isNotNull()).groupBy(ID).agg(
        F.min(F.struct(F.col(SCORE).alias("score"), F.col(LONG).alias("long"))).alias("least"), F.min(GOOD).alias("good")).select("least.*", "good").toArrow()
    score, long, good = seen["score"].to_numpy(), seen["long"].to_numpy(), seen["good"].to_numpy(zero_copy_only=False).astype(bool)
    slope = length_slope(score, long, good)
    level = best_level(score - slope * long, good) if 0 < good.sum() < len(good) else None
    return rows.withColumn(SCORE, F.col(SCORE) - F.lit(slope) * F.col(LONG)).drop(ID, GOOD, LONG), level


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", temperature: float = TEMPERATURE,
             seed: int = 42, **model) -> DataFrame:
    """The sampled rows of ``docs`` with __log_importance and __key."""
    rows, level = scored(docs, labels, id_col, **model)
    score, key = free(docs, "__log_importance"), free(docs, "__key")
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col("text"), F.lit(seed)), 12).cast("double") + 0.5) / 2.0 ** 52
    rows = rows.withColumn(key, F.col(score) / temperature - F.log(-F.log(u)))
    if level is None:
        return rows
    k = rows.where(F.col(score) >= level).count()
    if not k:
        return rows.limit(0)
    return rows.where(F.col(key) >= kth_largest(rows.select(key), k, key))


def op5_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", F.col("__log_importance").alias("log_importance"), F.col("__key").alias("key"))
