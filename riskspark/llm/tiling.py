"""Benchmark decontamination by greedy string tiling.

Seeds, runs of ``least`` words, are joined between documents and benchmark
items; each pair that shares enough of them is tiled: the longest common runs
of yet unmarked words are found by running Karp-Rabin hashes of falling
length and marked on both sides, longest first, until none of ``least`` words
is left. A document is contaminated by an item when the tiles cover at least
``coverage`` of the item's words, wherever and in whatever order they stand.

A bit map of the items' seeds (fixed size) keeps documents without any shared
seed, and their texts, out of the join. A pair with c shared seeds can't
cover more than ``c * least`` words, so pairs below the threshold by that
bound are not tiled. Hot seeds are counted per document and item in the
aggregation, and the join on seeds is one that AQE can split.

Words are runs of letters, digits, marks and other signs that are neither
punctuation nor blanks, in any script, A-Z in lower case; in unspaced scripts
(Chinese, Japanese, Thai, Lao, Khmer, Burmese) every character is a word.
With ``short``, an item of fewer than ``least`` words has its whole sequence as
only seed, and a document contains it when all its words stand there in a run.
Defined results: null and empty texts contain no item; items without any word
match nothing, nor do those of fewer than ``least`` without ``short``; equal rows
are found alike; rows with a null id are found too; other columns are
dropped by ``contaminated`` and kept by ``clean``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import WordHash, encode, free, grams, signed, table, written

LEAST, COVERAGE, BITS = 5, 0.5, 26
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Scripts without blanks between words: Thai, Lao, Burmese, Khmer, kana, CJK.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3031, 0x3035), (0x3041, 0x30FF),
             (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


class Signs(dict):
    """code point -> what stands for it in ``str.translate``: a blank for
    punctuation, blanks and invisible signs beyond ASCII, itself apart in an
    unspaced script."""

    def __missing__(self, code: int):
        sign = chr(code)
        if code < 128:
            new = code
        elif unicodedata.category(sign)[0] in "PZC" and not 0xD800 <= code <= 0xDFFF:
            new = None if unicodedata.category(sign) == "Cf" and code != 0x200B else " "
        else:
            new = f" {sign} " if any(a <= code <= b for a, b in _UNSPACED) else code
        self[code] = new
        return new


_SIGNS = Signs()


def split_words(text: str | None) -> list[bytes]:
    """The words of a text; ASCII texts need no look at their signs."""
    if text and not text.isascii() and any(_SIGNS[c] != c for c in map(ord, set(text))):
        text = text.translate(_SIGNS)
    return encode(text).translate(_WORDS).split()


def words_of(texts, seen: WordHash):
    """Hashes of the words of all texts, and where each text starts."""
    parts, starts = [], [0]
    for t in texts:
        w = split_words(t)
        parts.append(np.fromiter(map(seen.__getitem__, w), np.uint64, len(w)))
        starts.append(starts[-1] + len(w))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.asarray(starts, np.int64)


def seeds_of(texts, least: int, seen: WordHash):
    """(text, place in it, seed) of every run of ``least`` words."""
    flat, starts = words_of(texts, seen)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    g = grams(flat, least)
    ok = owner[:len(g)] == owner[least - 1:least - 1 + len(g)]
    own = owner[:len(g)][ok]
    return own, np.flatnonzero(ok) - starts[own], g[ok]


def item_seeds_of(texts, least: int, seen: WordHash, short: bool):
    """(text, seed, its words) of each item: the runs of ``least`` words, with
    ``short`` the whole sequence of an item that has fewer."""
    flat, starts = words_of(texts, seen)
    own, seed, size = [], [], []
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        n = min(least, b - a) if short else least
        if 0 < n <= b - a:
            g = grams(flat[a:b], n)
            own.append(np.full(len(g), i))
            seed.append(g)
            size.append(np.full(len(g), n))
    if not own:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(own), np.concatenate(seed), np.concatenate(size)


def scan(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, size: int):
    """Longest common runs of at least ``size`` unmarked words that start at
    each pair of places with equal Karp-Rabin hashes: (length, in a, in b)."""
    def places(x, free):
        h = grams(x, size)
        run = np.append(0, np.cumsum(free))
        return h, (run[size:] - run[:-size] == size) if len(h) else np.zeros(0, bool)

    ha, ok_a = places(a, free_a)
    hb, ok_b = places(b, free_b)
    at_a = np.flatnonzero(ok_a & np.isin(ha, hb))
    at_b = np.flatnonzero(ok_b & np.isin(hb, ha[at_a]))
    where: dict[int, list[int]] = {}
    for j in at_b.tolist():
        where.setdefault(int(hb[j]), []).append(j)
    found = []
    for i in at_a.tolist():
        for j in where.get(int(ha[i]), ()):
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of the run that starts earlier
            n, most = size, min(len(a) - i, len(b) - j)
            while n < most and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            found.append((n, i, j))
    return found


def tiles(a: np.ndarray, b: np.ndarray, least: int, start: int = 32):
    """Greedy tiling of word hashes ``a`` (item) and ``b`` (document):
    [(length, place in a, place in b)], no word in two tiles."""
    free_a, free_b, out, size = np.ones(len(a), bool), np.ones(len(b), bool), [], max(least, min(start, len(a)))
    while True:
        found = scan(a, b, free_a, free_b, size)
        longest = max(found, default=(0,))[0]
        if longest > 2 * size and longest > start:
            size = longest  # first the runs as long as that
            found = [f for f in found if f[0] >= size]
        again = False
        for n, i, j in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if free_a[i:i + n].all() and free_b[j:j + n].all():
                free_a[i:i + n] = free_b[j:j + n] = False
                out.append((n, i, j))
            else:
                again = True  # what is left of it may still be long enough
        if again and scan(a, b, free_a, free_b, size):
            continue
        if size <= least:
            return out
        size = max(least, size // 2)


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE,
                 id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, short: bool = False) -> DataFrame:
    """One row for each document and item that its text contains: id, th
    (hash of the text), item_id, item_words, covered, coverage, tiles."""
    spark = docs.sparkSession

    def item_seeds(batches: Iterator[pd.DataFrame]):
        seen = WordHash()
        for b in batches:
            own, seed, size = item_seeds_of(b["text"], least, seen, short)
            yield pd.DataFrame({"item": b["item"].to_numpy()[own], "it": b["it"].to_numpy()[own], "seed": signed(seed), "size": size})

    rows = (items.where("item_id is not null and text is not null")
            .select(F.col("item_id").cast("bigint").alias("item"), "text").withColumn("it", F.xxhash64("text")).distinct())
    seeds = rows.mapInPandas(item_seeds, "item long, it long, seed long, size int").groupBy("seed", "item", "it", "size").agg(
        F.count("*").alias("times"))
    seeds = written(seeds, "seeds")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # least numbers at most
    there = np.zeros(2 ** bits // 8, np.uint8)  # a fixed size, whatever the benchmark's
    for r in seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("cell")).distinct().toLocalIterator():
        there[r["cell"] >> 3] |= 1 << (r["cell"] & 7)
    sent = spark.sparkContext.broadcast(there)

    def doc_seeds(batches: Iterator[pd.DataFrame]):
        seen = WordHash()
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k:k + 512]
                found = []
                for size in sizes:  # least, and those of shorter items
                    own, _, seed = seeds_of(part["text"], size, seen)
                    cell = seed >> np.uint64(64 - bits)
                    hit = (sent.value[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    found.append((own[hit], signed(seed[hit])))
                own, seed = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))
                order = np.argsort(own, kind="stable")
                own, seed = own[order], seed[order]
                if len(own):
                    some, first = np.unique(own, return_index=True)
                    yield part.iloc[some].assign(seeds=[np.unique(s) for s in np.split(seed, first[1:])])

    texts = (docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"),
                                                            F.col(text_col).alias("text")))
    hits = written(texts.mapInPandas(doc_seeds, "id long, text string, seeds array<long>")
                   .withColumn("th", F.xxhash64("text")).dropDuplicates(["id", "th"]), "hits")
    # words that tiles can cover at most: least words for each shared seed
    bound = (hits.select("id", "th", F.explode("seeds").alias("seed")).join(seeds, "seed")
             .groupBy("id", "th", "item", "it").agg((F.sum(F.col("times") * F.col("size"))).alias("bound")))

    def lengths(batches: Iterator[pd.DataFrame]):
        seen = WordHash()
        for b in batches:
            _, starts = words_of(b["text"], seen)
            yield pd.DataFrame({"item": b["item"], "it": b["it"], "item_text": b["text"], "item_words": np.diff(starts)})

    sized = rows.mapInPandas(lengths, "item long, it long, item_text string, item_words int")
    pairs = (bound.join(sized, ["item", "it"]).where(F.col("bound") >= coverage * F.col("item_words"))
             .select(F.col("id").alias("pid"), F.col("th").alias("pth"), "item", "item_text", "item_words"))
    both = (hits.drop("seeds").join(pairs, F.col("id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth")))
            .drop("pid", "pth"))

    def tile(batches: Iterator[pd.DataFrame]):
        seen = WordHash()
        for b in batches:
            out = []
            for id_, th, text, item, item_text, n in zip(b["id"], b["th"], b["text"], b["item"], b["item_text"], b["item_words"]):
                (a, _), (d, _) = words_of([item_text], seen), words_of([text], seen)
                t = tiles(a, d, min(least, n))
                covered = sum(x[0] for x in t)
                if covered >= (coverage * n if n >= least else n):
                    out.append((id_, th, item, n, covered, covered / n, len(t)))
            yield pd.DataFrame(out, columns=["id", "th", "item_id", "item_words", "covered", "coverage", "tiles"]).astype(
                {"id": "Int64", "th": "int64"})

    return both.mapInPandas(tile, "id long, th long, item_id long, item_words long, covered long, coverage double, "
                                  "tiles long").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    ID, TH = free(docs, "__id"), free(docs, "__th")
    bad = (contaminated(docs, items, id_col=id_col, text_col=text_col, **how)
           .select(F.col(id_col).alias(ID), F.col("th").alias(TH)).distinct())
    return docs.join(bad, docs[id_col].cast("bigint").eqNullSafe(bad[ID]) & (F.xxhash64(docs[text_col]) == bad[TH]), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True).drop("th")
