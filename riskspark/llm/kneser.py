"""Interpolated modified Kneser-Ney model: counted in Spark, stored as sorted
hash arrays in the shared folder, memory-mapped by the workers that score.

Bigrams of 64-bit word hashes are counted per task, sent as packed tables of a
slot and summed by slot in Spark (the leading bits of the bigram's key, so each slot is a range of keys) and
written as one sorted key array and one count array a slot. Of the words, the
slots hold what the model needs: how often each was seen, after how many
different words, and as a context the total and the number of followers seen
once, twice, and more often. A context that many bigrams share is spread over
16 slots. Files are written under a temporary name and renamed, so a task
that is run again leaves the same files.

p(w | v) = (c(vw) - D(c(vw))) / c(v) + g(v) * p(w)
p(w)     = (t(w) - D'(t(w))) / T + g' / (V + 1)

with t(w) the number of different words before w and T their sum. Discounts
D (for counts 1, 2, 3+) come from the counts of counts. A text starts after a
start mark and ends with one end mark, which is a token.

Defined results: a null or empty text is the end mark alone; a null id is not
held out; with no training rows every token has probability 1 / (V + 1) = 1;
other columns are dropped. The checkpoint folder must be one that workers
mount, since the arrays are mapped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import WordHash, atomic_save, hashed_words, mix, mounted, signed, table, work_dir

START, STOP = np.uint64(0x5354415254), np.uint64(0x53544F50)
#: Tokens aimed at in a slot; the number of slots follows the input.
SLOT_TOKENS = 2_000_000
WORD_FIELDS = ("tokens", "types", "total", "one", "two", "more")


def with_ends(flat: np.ndarray, starts: np.ndarray):
    """Tokens with an end after each text, the word before each, and offsets."""
    n = len(starts) - 1
    ends = starts[1:] + np.arange(n)
    tokens = np.empty(len(flat) + n, np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end], tokens[~is_end] = STOP, flat
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    offsets = np.append(0, ends + 1)
    before[offsets[:-1]] = START
    return tokens, before, offsets


def pair_keys(before: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    """Sorting by this key sorts by slot: its leading bits come from the
    context and four bits of the follower, the others from both."""
    low = np.uint64(64 - bits)
    lead = mix(before + (tokens & np.uint64(15)) * np.uint64(0x9E3779B97F4A7C15)) >> low
    rest = mix(before * np.uint64(0xD6E8FEB86659FD93) ^ mix(tokens))
    return (lead << low) | (rest >> np.uint64(bits)) if bits else rest


def slots_for(texts: DataFrame) -> int:
    """Bits of the slot number, from the number of characters."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(2, (int(chars / 6) // SLOT_TOKENS).bit_length())


def add_up(keys: tuple[np.ndarray, ...], weights: tuple[np.ndarray, ...]):
    """Distinct key tuples (sorted) and the sum of each weight."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), tuple(np.add.reduceat(w[order], at) if len(at) else w[:0] for w in weights)


def small(a: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def planes(a: np.ndarray) -> bytes:
    """32-bit numbers, the lowest bytes first: the others are mostly zero."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def pack(before: np.ndarray, tokens: np.ndarray, c: np.ndarray) -> tuple[int, bytes]:
    """Bigrams with their counts, each word once (far fewer words than bigrams)."""
    words, ids = np.unique(np.concatenate([before, tokens]), return_inverse=True)
    raw = words.astype("<u8").tobytes() + planes(ids[:len(c)]) + planes(ids[len(c):]) + planes(c)
    return len(words), zstandard.compress(raw, 3)


def unpack(n_words: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    words = np.frombuffer(raw, "<u8", n_words)
    rest = np.frombuffer(raw, np.uint8, offset=8 * n_words).reshape(3, 4, -1).astype(np.int64)
    first, second, c = (x[0] | x[1] << 8 | x[2] << 16 | x[3] << 24 for x in rest)
    return words[first], words[second], c


def train(docs: DataFrame, flush: int = 6_000_000) -> dict:
    """Count ``docs`` (column text) and write the model. Returns the folder
    and the handful of numbers that workers need besides it."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    folder, bits = mounted(work_dir(spark, "kneser")), slots_for(texts)
    shift = 64 - bits

    def count(batches: Iterator[pd.DataFrame]):
        seen, held, n = WordHash(), [], 0

        def out():
            before, tokens = (np.concatenate(x) for x in zip(*held))
            slot = (pair_keys(before, tokens, bits) >> np.uint64(shift)).astype(np.int32)
            (slot, before, tokens), (c,) = add_up((slot, before, tokens), (np.ones(len(slot), np.int64),))
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            cuts = [slice(a, z) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(slot)])]
            packed = [pack(before[k], tokens[k], c[k]) for k in cuts]
            yield pd.DataFrame({"slot": slot[first], "words": [n for n, _ in packed], "blob": [x for _, x in packed]})

        for b in batches:
            for at in range(0, len(b), 512):
                tokens, before, _ = with_ends(*hashed_words(b["text"].iloc[at:at + 512], seen, lower=True))
                held.append((before, tokens))
                n += len(tokens)
                if n >= flush:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    def write_pairs(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Write one slot; pass on what its bigrams tell of the words."""
        before, tokens, c = (np.concatenate(x) for x in zip(*map(unpack, rows["words"], rows["blob"])))
        keys = pair_keys(before, tokens, bits)
        (keys, before, tokens), (c,) = add_up((keys, before, tokens), (c,))
        atomic_save(f"{folder}/pairs/{key[0]}.keys.npy", keys)
        atomic_save(f"{folder}/pairs/{key[0]}.counts.npy", small(c))
        one = np.ones(len(c), np.int64)
        (after,), (types, total) = add_up((tokens,), (one, c))
        (ctx,), (ctx_total, n1, n2, n3) = add_up((before,), (c, *(x.astype(np.int64) for x in (c == 1, c == 2, c > 2))))
        zero = np.zeros(len(ctx), np.int64)
        return pd.concat([
            pd.DataFrame({"word": signed(after), "tokens": total, "types": types, "total": 0, "one": 0, "two": 0,
                          "more": 0, "c3": 0, "c4": 0}),
            pd.DataFrame({"word": signed(ctx), "tokens": zero, "types": zero, "total": ctx_total, "one": n1, "two": n2,
                          "more": n3, "c3": add_up((before,), ((c == 3).astype(np.int64),))[1][0],
                          "c4": add_up((before,), ((c == 4).astype(np.int64),))[1][0]})])

    def write_words(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(h=rows["word"].to_numpy().view(np.uint64)).sort_values("h")
        atomic_save(f"{folder}/words/{key[0]}.keys.npy", rows["h"].to_numpy())
        for f in WORD_FIELDS:
            atomic_save(f"{folder}/words/{key[0]}.{f}.npy", small(rows[f].to_numpy()))
        t = rows["types"].to_numpy()
        return pd.DataFrame([{"n": rows["tokens"].sum(), "v": int((t > 0).sum()), "types": t.sum(),
                              "b1": rows["one"].sum(), "b2": rows["two"].sum(), "b3": rows["c3"].sum(),
                              "b4": rows["c4"].sum(), **{f"t{i}": int((t == i).sum()) for i in (1, 2, 3, 4)}}])

    fields = (*WORD_FIELDS, "c3", "c4")
    pairs = texts.mapInPandas(count, "slot int, words int, blob binary")
    partial = pairs.groupBy("slot").applyInPandas(write_pairs, "word long, " + ", ".join(f"{f} long" for f in fields))
    words = partial.groupBy("word").agg(*[F.sum(f).alias(f) for f in fields])
    word_slot = F.shiftrightunsigned("word", shift).cast("int") if bits else F.lit(0)
    sums = ("n", "v", "types", "b1", "b2", "b3", "b4", "t1", "t2", "t3", "t4")
    total = (words.withColumn("slot", word_slot).groupBy("slot")
             .applyInPandas(write_words, ", ".join(f"{s} long" for s in sums))
             .agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums]).first().asDict())
    return {"folder": folder, "bits": bits, **total,
            "pair_discounts": discounts(*(total[f"b{i}"] for i in (1, 2, 3, 4))),
            "type_discounts": discounts(*(total[f"t{i}"] for i in (1, 2, 3, 4)))}


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where counts of counts are missing
    (tiny inputs) half a count."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


class Model:
    """The mapped arrays; nothing is read before it is looked up."""

    def __init__(self, meta: dict):
        self.meta, self.open = meta, {}

    def array(self, name: str):
        if name not in self.open:
            try:
                self.open[name] = np.load(f"{self.meta['folder']}/{name}.npy", mmap_mode="r")
            except FileNotFoundError:  # a slot without keys is not written
                self.open[name] = None
        return self.open[name]

    def find(self, kind: str, keys: np.ndarray, fields) -> list[np.ndarray]:
        """Values of each field for sorted distinct keys (0: unknown)."""
        bits = self.meta["bits"]
        out = [np.zeros(len(keys), np.int64) for _ in fields]
        slots = (keys >> np.uint64(64 - bits)).astype(np.int64)
        used, first = np.unique(slots, return_index=True)
        for slot, a, b in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
            there = self.array(f"{kind}/{slot}.keys")
            if there is not None:
                at = np.minimum(np.searchsorted(there, keys[a:b]), len(there) - 1)
                hit = there[at] == keys[a:b]
                for o, f in zip(out, fields):
                    o[a:b][hit] = self.array(f"{kind}/{slot}.{f}")[at[hit]]
        return out

    def lookup(self, kind: str, keys: np.ndarray, fields) -> list[np.ndarray]:
        distinct, back = np.unique(keys, return_inverse=True)
        return [x[back] for x in self.find(kind, distinct, fields)]

    def score(self, texts, seen: WordHash) -> pd.DataFrame:
        m = self.meta
        tokens, before, offsets = with_ends(*hashed_words(texts, seen, lower=True))
        c, t = self.lookup("words", tokens, ("tokens", "types"))
        total, one, two, more = self.lookup("words", before, ("total", "one", "two", "more"))
        pair, = self.lookup("pairs", pair_keys(before, tokens, m["bits"]), ("counts",))
        base = np.log10((c + 0.1) / (m["n"] + 0.1 * (m["v"] + 1)))
        d, dt = np.array([0, *m["pair_discounts"]]), np.array([0, *m["type_discounts"]])
        types = max(m["types"], 1)
        left = (dt[1] * m["t1"] + dt[2] * m["t2"] + dt[3] * (m["v"] - m["t1"] - m["t2"])) / types if m["types"] else 1.0
        p = (t - dt[np.minimum(t, 3)]) / types + left / (m["v"] + 1)
        known = total > 0
        held = np.maximum(total, 1)
        p = np.where(known, (pair - d[np.minimum(pair, 3)]) / held + (d[1] * one + d[2] * two + d[3] * more) / held * p, p)
        per = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every text has a token
        return pd.DataFrame({"n_tokens": np.diff(offsets), "n_known": per((c > 0).astype(np.int64)),
                             "base_score": per(base), "score": per(np.log10(p))})


def score(docs: DataFrame, meta: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep``, n_tokens, n_known, train_tokens, base_score, score
    and perplexity of every text."""
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)

    def run(batches: Iterator[pd.DataFrame]):
        model, seen = Model(meta), WordHash()
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at:at + 1024].reset_index(drop=True)
                if len(part):
                    out = model.score(part["text"], seen)
                    out["train_tokens"], out["perplexity"] = meta["n"], 10 ** (-out["score"] / out["n_tokens"])
                    yield pd.concat([part[keep], out], axis=1)

    return rows.mapInPandas(run, schema + ", n_tokens long, n_known long, train_tokens long, "
                                          "base_score double, score double, perplexity double")


def held_out(id_col: str = "doc_id"):
    """Every tenth document by the checksum of its id (a null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op2_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return score(docs, train(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
