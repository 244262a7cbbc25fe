"""Each text operator against a brute-force version, and its edge cases."""

import collections
import hashlib
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest

from riskspark.llm import (bpe, bwt, common, components, kneser, ngram_join, resample, sketch, substrings,
                           suffix_dedup, tiling, urls, winnow)

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def words(t):
    return WORD.findall((t or "").encode())


# helpers ------------------------------------------------------------------

def test_grams_and_sliding_min():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
    h[100:150] = h[:50]
    for n in (1, 2, 3, 5, 7, 50):
        g = common.grams(h, n)
        assert len(g) == 201 - n
        assert len(set(g.tolist())) == len({tuple(h[i:i + n].tolist()) for i in range(201 - n)})
        assert common.sliding_min(h, n).tolist() == [min(h[i:i + n].tolist()) for i in range(201 - n)]
    assert len(common.grams(h[:3], 4)) == 0


def test_sketch_packs_and_never_misses(spark, frame):
    rng = np.random.default_rng(2)
    c = np.sort(rng.integers(0, 10_000, 500).astype(np.uint64))
    assert sketch.unpack(sketch.pack(c)).tolist() == c.tolist()
    df = frame([(i, str(i % 700)) for i in range(1000)]).repartition(5)
    yes = sketch.repeated(df, lambda b: common.mix(b["text"].astype("int64").to_numpy().astype(np.uint64)), bits=16, ranges=8, flush=100).value
    keys = common.mix(np.arange(700).astype(np.uint64))
    answer = yes(keys)
    assert answer[:300].all() and answer[300:].mean() < 0.05


def test_components(frame):
    links = frame([(1, 2), (2, 3), (9, 8), (3, 10), (5, 5)] + [(i, i + 1) for i in range(20, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 8: 8, 9: 8, **{i: 20 for i in range(20, 61)}}


# 1 substring dedup --------------------------------------------------------

def brute_substrings(rows, window):
    first = {}
    for k, t in sorted(r for r in rows if r[0] is not None):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), k)
    out = []
    for k, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if k is not None and first[tuple(w[i:i + window])] < k:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def got_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("bits", [28, 12])  # a tiny sketch only costs time
def test_substrings_match_brute_force(docs, texts, bits):
    got = got_rows(substrings.remove_repeats(docs, bits=bits), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(texts, 50) and sum(r[2] for r in got) > 0


def test_substrings_small_windows_and_hot_copies(frame):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") for _ in range(60)]
    rows = [(i, " ".join(base[:50] + [rng.choice("abcdefgh") for _ in range(10)])) for i in range(40)]
    rows += [(100 + i, "a a a a a a a a a a a a") for i in range(5)] + [(7, "x y"), (None, " ".join(base))]
    got = got_rows(substrings.remove_repeats(frame(rows), window=6), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows, 6)


# 2 language model ---------------------------------------------------------

def test_kneser_base_score_and_distribution(spark, docs, texts, tmp_path):
    got = {r["doc_id"]: r for r in kneser.op2_kneser_ney(spark, "/root/testdata/sf0.001").collect()}
    tokens = {k: [*(w.lower() for w in words(t)), None] for k, t in texts}
    count = collections.Counter(x for k, w in tokens.items() if zlib.crc32(str(k).encode()) % 10 for x in w)
    n, v = sum(count.values()), len(count)
    for k, w in tokens.items():
        r = got[k]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            zlib.crc32(str(k).encode()) % 10 == 0, len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_kneser_matches_brute_force_and_sums_to_one(frame):
    rng = random.Random(5)
    vocab = ["the", "of", "cat", "Dog", "tree", "run"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    meta = kneser.train(frame(rows))
    pairs, end = collections.Counter(), "</s>"
    for _, t in rows:
        w = ["<s>", *t.lower().split(), end]
        pairs.update(zip(w, w[1:]))
    types = collections.Counter(b for _, b in pairs)
    total, followers = collections.Counter(), collections.defaultdict(list)
    for (a, _), c in pairs.items():
        total[a] += c
        followers[a].append(c)
    cc, tt = collections.Counter(pairs.values()), collections.Counter(types.values())
    d = [0, *kneser.discounts(*(cc[i] for i in (1, 2, 3, 4)))]
    dt = [0, *kneser.discounts(*(tt[i] for i in (1, 2, 3, 4)))]
    all_types, v = sum(types.values()), len(types)

    def uni(w):
        left = sum(dt[min(c, 3)] for c in types.values()) / all_types
        return (types[w] - dt[min(types[w], 3)]) / all_types + left / (v + 1)

    def p(w, a):
        c = pairs[(a, w)]
        return (c - d[min(c, 3)]) / total[a] + sum(d[min(x, 3)] for x in followers[a]) / total[a] * uni(w)

    assert sum(p(w, "the") for w in types) + p("unseen", "the") == pytest.approx(1)
    got = kneser.score(frame([(1, "The cat zzz"), (2, None)]), meta, ["doc_id"]).orderBy("doc_id").collect()
    # after an unknown word the unigram model is used
    want = [math.log10(p("the", "<s>")) + math.log10(p("cat", "the")) + math.log10(p("zzz", "cat")) + math.log10(uni(end)),
            math.log10(p(end, "<s>"))]
    assert [r["score"] for r in got] == pytest.approx(want, rel=1e-9)


# 3 winnowing --------------------------------------------------------------

def test_winnow_edits_and_likeness(docs, texts):
    got = {r["doc_id"]: r for r in winnow.fingerprints_with_neighbours(docs, buckets=7).collect()}
    rows = sorted(texts)
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    same = collections.defaultdict(set)
    for k, t in rows:
        same[t].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.5 > 0.05 > np.mean([r["near_next"] for r in got.values()])


def test_winnow_positions_ties_and_match_guarantee(frame):
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w)), (2, " ".join(["zz"] * 5 + w[10:17] + ["qq"] * 5)), (3, "same " * 12), (4, None), (5, "two words")]
    df = winnow.fingerprint(frame(rows), "text", "fp", k=4, w=4)
    packed = {r["doc_id"]: r["fp"] for r in df.collect()}
    place = lambda x: (1 << winnow.POS) - 1 - (x & ((1 << winnow.POS) - 1))
    hashes = {k: {x >> winnow.POS for x in v} for k, v in packed.items()}
    assert hashes[1] & hashes[2]  # seven shared words
    assert [place(x) for x in packed[3]] == [3, 4, 5, 6, 7, 8]  # rightmost of each window of equal hashes
    assert packed[4] == [] and len(packed[5]) == 1
    plan = winnow.fingerprints_with_neighbours(frame(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1


# 4 decontamination --------------------------------------------------------

def test_tiles_cover_reordered_passages():
    rng = np.random.default_rng(4)
    a = rng.integers(1, 2 ** 62, 30).astype(np.uint64)
    b = np.concatenate([a[20:30], rng.integers(1, 2 ** 62, 9).astype(np.uint64), a[:20]])
    assert sorted(tiling.tiles(a, b, 5)) == [(10, 20, 0), (20, 0, 19)]
    assert tiling.tiles(a, a[::-1].copy(), 5) == []
    x = np.full(12, 7, np.uint64)
    assert sum(t[0] for t in tiling.tiles(x, np.full(30, 7, np.uint64), 5)) in (10, 11, 12)
    assert tiling.tiles(a[:4], a, 5) == []


def test_contaminated_and_clean(frame):
    item = " ".join(f"q{i}" for i in range(20))
    parts = item.split()
    items = frame([(1, item), (2, "too short"), (3, None), (1, item)], "item_id long, text string")
    rows = [(1, "before " + item.upper() + ", after"), (2, " ".join(parts[10:] + ["x"] * 3 + parts[:10])),
            (3, " ".join(parts[:7])), (4, "too short"), (5, None), (6, "clean text without it"), (6, item), (None, item)]
    docs = frame(rows)
    found = got_rows(tiling.contaminated(docs, items), "doc_id", "item_id", "covered", "tiles")
    assert found == sorted([(1, 1, 20, 1), (2, 1, 20, 2), (6, 1, 20, 1), (None, 1, 20, 1)], key=str)
    kept = got_rows(tiling.clean(docs, items), "doc_id", "text")
    assert kept == sorted([rows[2], rows[3], rows[4], rows[5]], key=str)


def test_planted_items_are_found(spark):
    sf = "/root/testdata/sf0.001"
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(r["doc_id"], k) for r in spark.read.parquet(DOCS).collect() for k, t in items.items() if t in r["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in tiling.op4_decontaminate(spark, sf).collect()}
    assert want <= got


def test_short_items_and_other_scripts(frame):
    zh, th = "春眠不觉晓，处处闻啼鸟。夜来风雨声，花落知多少。", "สวัสดีชาวโลกวันนี้อากาศดีมาก"
    items = frame([(1, "Blue whale song"), (2, zh), (3, th), (4, "He said \u201cgo home now\u201d and left \u2014 at once"), (5, "?!")],
                  "item_id long, text string")
    rows = [(1, "a blue whale song, heard"), (2, "blue song whale"), (3, "他说" + zh.replace("，", "") + "完"), (4, "x " + th),
            (5, 'he said "go home now" and left\u00a0- at\u00a0once'), (6, "no ?! match"), (7, "晓春鸟啼"), (8, "blue whale")]
    found = got_rows(tiling.contaminated(frame(rows), items, short=True), "doc_id", "item_id")
    assert found == [(1, 1), (3, 2), (4, 3), (5, 4)]
    assert [r[0] for r in got_rows(tiling.clean(frame(rows), items, short=True), "doc_id")] == [2, 6, 7, 8]
    assert tiling.split_words("Größe\u00a0l\u2019été") == ["größe".encode(), b"l", "été".encode()]


# 5 quality ----------------------------------------------------------------

def test_resampling_drops_what_labels_call_bad(frame):
    rng = random.Random(6)
    good = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(good) for _ in range(rng.randint(15, 60))]
        bad = i % 4 == 0
        if bad:
            w[5:5] = ["awful", "nasty", "awful"]
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or i % 8 == 1:
            labels.append((i, 1, int(bad)))
    kept = {r["doc_id"] for r in resample.resample(frame(rows), frame(labels, "doc_id long, quality int, toxic int")).collect()}
    bad = set(range(0, 400, 4))
    assert len(kept & bad) <= 5 and len(kept - bad) >= 280
    assert resample.resample(frame(rows), frame([], "doc_id long, quality int, toxic int")).count() == 400


def test_kth_largest(frame):
    rng = random.Random(7)
    v = [rng.gauss(0, 100) for _ in range(300)] + [5.0] * 20 + [1e9]
    df = frame([(x,) for x in v], "key double")
    for k in (1, 2, 50, 321):
        assert resample.kth_largest(df, k, bins=8) == sorted(v, reverse=True)[k - 1]


# 6 BPE --------------------------------------------------------------------

def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    lib, mine = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = random.Random(8)
    alphabet = [chr(c) for c in [*range(0x300), *range(0x370, 0x700), *range(0x1E00, 0x2100), 0x1C89, 0xA7CB, 0x1E5D0, *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F610)]]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    odd += ["a<|endoftext|>B<|startoftext|>", "don't WE'LL", "x" * 3000, "ab" * 900, "Σας ΣΑΣ", "İstanbul", "\x1c a\x85b\u3000c"]
    for t in [t for _, t in texts] + odd:
        ids = np.frombuffer(mine.encode(t), "<u4").tolist()
        assert ids == lib.encode(t, add_special_tokens=False).ids, t[:50]
        assert mine.decode(mine.encode(t)) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_are_certain():
    mine = bpe.WordBpe(bpe.default_path())
    for t in list(mine.vocab)[::97]:
        s = mine.symbols(t[:-len(bpe.END)], True) if t.endswith(bpe.END) else list(t)
        assert len(mine.fragments_of(s)) == 1  # no cut inside a token
    assert len(mine.fragments_of(mine.symbols("qqzxjqvq", True))) > 1
    f = mine.symbols("abcdefabcdef" * 5, True)
    assert mine.merge(f) == mine.merge_long(f)


# 8 n-gram Jaccard join ----------------------------------------------------

def brute_components(rows, n, percent):
    sets = {}
    for k, t in rows:
        w = [x.lower() for x in words(t)]
        sets[k] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted(((k, len(sets[k]), top(k)) for k in sets), key=str)


def test_jaccard_components_match_brute_force(docs, texts):
    got = got_rows(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(texts, 3, 90) and sum(r[0] != r[2] for r in got) > 0


@pytest.mark.parametrize("bits,chunk", [(28, 1500), (10, 7)])
def test_jaccard_hot_group_in_chunks(frame, bits, chunk):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):  # near copies around the limit, linked in chains
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"v{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, "A b") for i in range(5)] + [(300, "a b c"), (301, "b a"), (302, ""), (303, None)]
    got = got_rows(ngram_join.jaccard_components(frame(rows), bits=bits, chunk=chunk), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 3, 90)


@pytest.fixture
def crowded(frame, monkeypatch):
    """Texts with six times as many shingles as the sketch has cells, and the
    rows that the tables written for them have."""
    rng, sizes, plain = random.Random(11), {}, ngram_join.written
    monkeypatch.setattr(sketch, "BITS", 12)
    monkeypatch.setattr(sketch, "MOST_BITS", 14)

    def written(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    texts = [[f"w{rng.randrange(10 ** 6)}" for _ in range(150)] for _ in range(160)]
    texts += [t[:k] + ["new"] + t[k + 1:] for t, k in zip(texts[:8], range(10, 90, 10))]
    return [(i, " ".join(t)) for i, t in enumerate(texts)], sizes


def test_more_shingles_than_cells_leave_few_suspects(frame, crowded):
    rows, sizes = crowded
    got = got_rows(ngram_join.jaccard_components(frame(rows)), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 3, 90) and sizes["suspects"] < 60


def test_one_of_each_writes_few_suspects(frame, crowded):
    """As the pipeline's second stage asks for it."""
    rows, sizes = crowded
    kept = {r[0] for r in ngram_join.one_of_each(frame(rows), n=5, percent=80).collect()}
    assert kept == {r[2] for r in brute_components(rows, 5, 80)} and sizes["suspects"] < 80


def test_fitting_a_sketch():
    assert sketch.fitting(0, 0.1) == (28, 1.0) and sketch.fitting(10 ** 8, 0.2) == (28, 1.0)
    assert sketch.fitting(1_400_000_000, 0.1)[0] == 29  # 6 GB
    assert sketch.fitting(10 ** 12, 0.2)[0] == sketch.MOST_BITS
    keys = np.random.default_rng(1).integers(0, 2 ** 64, 20_000, dtype=np.uint64)
    assert sketch.sketched(keys, 1.0).all() and abs(sketch.sketched(keys, 0.25).mean() - 0.25) < 0.02
    two = pickle.loads(pickle.dumps(sketch.Repeated(np.arange(10 ** 7, dtype=np.uint8).reshape(2, -1), 26)))
    assert np.array_equal(two.maps, np.arange(10 ** 7, dtype=np.uint8).reshape(2, -1)) and two.bits == 26


def test_divide_skip_finds_all():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 40, 25).astype(np.uint64)) for _ in range(60)]
    for percent in (50, 70, 90):
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if ngram_join.linked(a, b, percent)}
        assert set(ngram_join.divide_skip(sets, sets, percent, lambda q, i: False)) == want


# 9 suffix dedup -----------------------------------------------------------

def brute_suffix(rows, window):
    seen = collections.Counter()
    raw = [(k, (t or "").encode()) for k, t in rows]
    for _, b in raw:
        seen.update(b[i:i + window] for i in range(len(b) - window + 1))
    out = []
    for k, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((k, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("how", [{}, {"wide": 1}, {"wide": 4}, {"bits": 12, "collection": 50}])
def test_suffix_dedup_matches_brute_force(frame, how):
    rng = random.Random(11)
    x = "".join(rng.choice("ab") for _ in range(400))
    rows = [(1, "a" * 150), (2, "xyz " * 40), (3, None), (4, ""), (5, x[:120]), (6, "q" + x[10:90] + "z"), (7, x[30:70]),
            (8, x[31:70]), (9, x[5:110].replace("abab", "aXb", 3)), (10, x[200:245] + "é" * 30), (11, "é" * 30 + x[200:245]),
            (12, x[250:285] + "pp" + x[250:285]), (12, "another row"), (None, x[300:390]), (13, x[300:390]), (2, "xyz " * 40)]
    rows += [(20 + i, "".join(rng.choice("ab") for _ in range(30)) + x[100:138] + "".join(rng.choice("cd") for _ in range(30))) for i in range(12)]
    got = got_rows(suffix_dedup.remove_repeats(frame(rows), window=40, inner=30, **how), *SUFFIX)
    assert got == brute_suffix(rows, 40)


def test_suffix_parts_without_a_repeat_give_nothing():
    import pandas as pd

    rows = pd.DataFrame({"part": 7, "key": 7, "run": [1, 2], "left": [3, 3], "n": 4, "at": 0, "times": 1, "body": [b"abcdef", b"uvwxyz"]})
    found = list(suffix_dedup.construct(4, 100)(iter([rows])))
    assert sum(map(len, found)) == 0 and all(f["ats"].dtype == object for f in found)


def test_suffix_dedup_on_documents(docs, texts):
    got = got_rows(suffix_dedup.remove_repeats(docs), *SUFFIX)
    assert got == brute_suffix(texts, 400) and sum(r[2] for r in got) > 0


def test_bwt_finds_repeats():
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randint(1, 6)
        strings = [np.array([rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 15))], np.uint16) for _ in range(rng.randint(1, 8))]
        seen = collections.Counter(tuple(s[i:i + n]) for s in strings for i in range(len(s) - n + 1))
        want = [[i for i in range(len(s) - n + 1) if seen[tuple(s[i:i + n])] > 1] for s in strings]
        assert [x.tolist() for x in bwt.shared(strings, n)] == want


def near_copies(window: int, n: int):
    """Copies of one text, each with two of its own bytes at a place of its own."""
    rng = random.Random(13)
    base = "".join(rng.choice("abcd") for _ in range(3 * window))
    out = [base[:window + i] + f"{i:02d}" + base[window + i + 2:] for i in range(0, 2 * n, 2)]
    return [(i, t) for i, t in enumerate([*out, base[20:90], out[3][10:], "x" + base])]


@pytest.mark.parametrize("wide", [1, 3, 2000])
def test_suffix_dedup_of_near_copies(frame, wide):
    rows = near_copies(40, 30)
    got = got_rows(suffix_dedup.remove_repeats(frame(rows), window=40, inner=20, wide=wide), *SUFFIX)
    assert got == brute_suffix(rows, 40)


def test_suffix_pieces_of_near_copies_become_one():
    import pandas as pd

    span, n = 41, 200  # runs that differ in one byte only, at the front or the back
    bodies = [b"a" * 40 + b"b" * 39 + bytes([i]) if i % 2 else bytes([i]) + b"a" * 39 + b"b" * 40 for i in range(n)]
    rows = pd.DataFrame({"part": 7, "key": 7, "run": range(n), "left": 40, "n": span, "at": 0, "times": 1, "body": bodies})
    out = pd.concat(suffix_dedup.halves(span)(iter([rows.iloc[:90], rows.iloc[90:]])))
    pieces, found = out[out["part"].notna()], out[out["part"].isna()]
    assert len(pieces) == n + 2 and sorted(pieces["times"])[-2:] == [n // 2, n // 2]
    assert len(found) == n and set(found["run"]) == set(range(n))


def test_bwt_finds_repeats_with_tails():
    rng = random.Random(14)
    for _ in range(60):
        n, m = rng.randint(1, 7), rng.randint(1, 9)
        heads = [[rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 8))] for _ in range(m)]
        tails = [(rng.randint(-1, 1), bytes(rng.randint(0, rng.choice([0, 1, 2])) for _ in range(rng.randint(0, 8)))) for _ in range(m)]
        whole = [h + [1000 + k] + [c + 1 for c in t] for h, (k, t) in zip(heads, tails)]
        windows = [[tuple(w[i:i + n]) for i in range(min(len(h), len(w) - n) + 1)] for h, w in zip(heads, whole)]
        seen = collections.Counter(w for of_one in windows for w in of_one)
        want = [[i for i, w in enumerate(of_one) if seen[w] > 1] for of_one in windows]
        assert [x.tolist() for x in bwt.shared([np.array(h, np.uint16) for h in heads], n, tails)] == want


# 10 URL filter ------------------------------------------------------------

def brute_rule(host, path):
    best = None
    for v, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (v, h + p)
    return best


def test_url_rules_and_model(spark, frame):
    odd = [None, "", "no scheme", "http://", "HTTP://Blog.Example.ORG/es/1?x=/en/", "http://example.org", "http://example.org/en/1#a",
           "http://notexample.org/es/", "a://b://c/d", "http://x.com/fr/2", "http://x.com?/fr/", "http://com/de/9", "x://ÄB.Com/de/\nq"]
    df = frame(list(enumerate(odd)), "page_id long, url string").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url"))
    w = urls.fit(urls.labelled_urls())
    for r, u in ((r, r["url"]) for r in urls.judge(df.withColumn("host", df["url"]), w).join(df, "page_id").collect() if r["page_id"] >= len(odd)):
        assert (r["host"], r["path"]) == urls.split_url(u)
    got = {r["page_id"]: r for r in urls.judge(frame(list(enumerate(odd)), "page_id long, url string"), w).collect()}
    for i, u in enumerate(odd):
        host, path = urls.split_url(u)
        rule = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[1]), u
        assert got[i]["verdict"] == (rule[0] if rule else "block" if got[i]["score"] > 0 else "allow")


def test_url_model_on_held_out_hosts():
    rows = urls.labelled_urls()
    held = [r for i, r in enumerate(rows) if i // 4 % 5 == 2]
    w = urls.fit([r for r in rows if r not in held])
    hosts, paths = zip(*(urls.split_url(u) for u, _ in held))
    right = [(s > 0) == bool(y) for s, (_, y) in zip(urls.scores(w, hosts, paths), held)]
    assert np.mean(right) >= 0.8
