"""Nulls, empty tables, repeated rows and clashing columns in every operator
and stage, and the pipeline against its stages done by hand."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from riskspark.llm import bpe, kneser, ngram_join, pii, queries, resample, substrings, suffix_dedup, tiling, winnow

LABELS = "doc_id long, quality int, toxic int"


def operators(frame):
    labels = frame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (8, 0, 1), (10, 1, 0)], LABELS)
    items = frame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    return {
        "substrings": lambda d: substrings.remove_repeats(d),
        "kneser": lambda d: kneser.score(d, kneser.train(d), ["doc_id"]),
        "winnow": lambda d: winnow.fingerprints_with_neighbours(d),
        "clean": lambda d: tiling.clean(d, items),
        "resample": lambda d: resample.resample(d, labels),
        "bpe": lambda d: bpe.encode_documents(d),
        "pii": lambda d: pii.find(d, pii.fit(d)),
        "redact": lambda d: pii.redact(d, pii.fit(d)),
        "jaccard": lambda d: ngram_join.jaccard_components(d),
        "one_of_each": lambda d: ngram_join.one_of_each(d),
        "suffix": lambda d: suffix_dedup.remove_repeats(d),
    }


NAMES = ["substrings", "kneser", "winnow", "clean", "resample", "bpe", "pii", "redact", "jaccard", "one_of_each", "suffix"]
WHOLE = {"substrings", "kneser", "winnow", "bpe", "pii", "redact", "jaccard", "suffix"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(frame, awkward, name):
    rows = operators(frame)[name](awkward).collect()
    assert len(rows) == awkward.count() if name in WHOLE else 0 < len(rows) <= awkward.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(frame, awkward, name):
    assert operators(frame)[name](awkward.limit(0)).count() == 0


def test_defined_results(frame, awkward):
    texts = lambda df, *c: sorted((tuple(r) for r in df.select("doc_id", *c).collect()), key=str)
    got = texts(ngram_join.jaccard_components(awkward), "n_shingles", "component_id")
    assert (2, 0, 2) in got and (3, 0, 3) in got and (None, 1, None) in got and got.count((1, 4, 1)) == 2
    assert [r for r in got if r[0] in (5, 6)] == [(5, r[1], 5) for r in got if r[0] == 5] + [(6, r[1], 5) for r in got if r[0] == 6]
    cleaned = tiling.clean(awkward, frame([(1, "one two three four five six")], "item_id long, text string"))
    assert cleaned.columns == awkward.columns and cleaned.where("doc_id = 1").count() == 0 and cleaned.count() == awkward.count() - 2
    once = ngram_join.one_of_each(awkward)
    assert once.columns == awkward.columns and once.where("doc_id = 1").count() == 1 and once.where("doc_id is null").count() == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert (2, 0, empty) in texts(bpe.encode_documents(awkward), "n_tokens", "ids_sha256")


def test_every_operator_has_one_query():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_equals_its_stages_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == cols
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    # near copies by hand
    shingles = {}
    for k, t in rows.items():
        w = t.encode().lower().split()
        shingles[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    up = {k: k for k in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(shingles[a] & shingles[b])
            if both and 100 * both >= 80 * len(shingles[a] | shingles[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    rows = {k: t for k, t in rows.items() if top(k) == k}
    # benchmark items by hand: tiles over all pairs
    from riskspark.llm.common import WordHash

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = WordHash()

    def leaked(t):
        d = tiling.words_of([t], seen)[0]
        return any(sum(x[0] for x in tiling.tiles(a, d, 5)) >= 0.5 * len(a) for a in (tiling.words_of([i], seen)[0] for i in items) if len(a) >= 5)

    rows = {k: t for k, t in rows.items() if not leaked(t)}
    assert set(got) == set(rows)
    # documents without a digit or an @ go through unchanged
    mine = bpe.WordBpe(bpe.default_path())
    plain = [k for k, t in rows.items() if not pii._TRIGGER.search(t)]
    assert len(plain) > 20
    for k in plain:
        assert got[k]["ids_sha256"] == hashlib.sha256(mine.encode(rows[k])).hexdigest()
        assert np.asarray(got[k]["ids"], "<u4").tobytes() == mine.encode(rows[k])
