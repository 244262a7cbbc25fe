"""Personal data: patterns against plain regular expressions, the network's
gradients, and what the whole operator finds."""

import hashlib
import re

import numpy as np

from riskspark.llm import bilstm, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(1)
    odd = ["".join(rng.choice(list("12.@a-+ ()_%5x0"), rng.integers(1, 60))) for _ in range(3000)]
    odd += ["a@b.com_x@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8.9", "300.1.1.1.1", "001.002.003.0004", "4111 1111 1111 1111", "+1 (555) 123-4567 x", "@a.b", "٣٤٥", "1" * 30, "+1+2 345 678 90", "é@x.yz"]
    odd += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in odd:
        assert pii.base_spans(t) == plain(t), t[:80]


def test_gradients():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in bilstm.new_weights(3, 5, 1).items()}
    x, y = rng.integers(0, 97, (4, 7)), rng.integers(0, 5, (4, 7))
    w["t"] = rng.normal(0, 0.5, (5, 5))
    _, g = bilstm.step_gradients(w, x, y)
    for k, v in w.items():
        i = np.unravel_index(np.argmax(np.abs(g[k])), v.shape)
        old = v[i]
        v[i] = old + 1e-3
        high, _ = bilstm.step_gradients(w, x, y)
        v[i] = old - 1e-3
        low, _ = bilstm.step_gradients(w, x, y)
        v[i] = old
        assert abs((high - low) / 2e-3 - g[k][i]) < 0.02 * max(1, abs(g[k][i])), k


def made_up(n, seed):
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))

    def card():
        while True:
            c = "4" + d(15)
            if pii.luhn(c):
                return c

    kinds = [lambda: f"{rng.choice(['ann', 'bob.k', 'info'])}{d(2)}@mail{d(1)}.example.org",
             lambda: ".".join(str(x) for x in rng.integers(1, 255, 4)), card, lambda: f"+1 ({d(3)}) 555-{d(4)}"]
    words = "the tree stood near water and people walked there every day".split()
    out = []
    for i in range(n):
        a = " ".join(rng.choice(words, 10))
        out.append((i, f"{a} {kinds[i % 4]()} {' '.join(rng.choice(words, 10))}."))
    return out


def test_held_out_spans_and_rewritten_ones(frame):
    docs = frame(made_up(400, 3))
    x, y = pii.windows(pii.samples(docs, 400))
    cut = len(x) * 4 // 5
    w = bilstm.train(x[:cut], y[:cut], 9, epochs=10)
    tags = bilstm.viterbi(bilstm.emissions(w, x[cut:]), w["t"])
    assert (tags == y[cut:]).mean() > 0.97
    texts = ["call me at 521-555-6210 any day please", "version 2.0.1 of the tree", "nothing here", None, ""]
    found = pii.spans_of(w, texts)
    assert all(set(b) <= set(e) for b, e in found) and found[1] == found[2] == found[3] == found[4] == ([], [])
    long = ("the tree stood near water " * 40 + "+1 (521) 555-6210 ") * 5
    base, every = pii.spans_of(w, [long])[0]
    assert len(base) == 5 and set(base) <= set(every)


def test_find_and_redact(frame, awkward):
    docs = frame(made_up(200, 4)).unionByName(awkward.select("doc_id", "text"))
    w = pii.fit(docs)
    got = pii.find(docs, w).collect()
    assert len(got) == docs.count()
    by = {r["text"]: r for r in docs.collect()}
    assert any(t and "@" in t for t in by)
    for r in pii.find(frame([(1, "a.b@example.org 10.0.0.1"), (2, None)]), None).collect():
        want = "email:0:15,ip:16:24" if r["doc_id"] == 1 else ""
        assert (r["spans"], r["base_sha256"], r["n_added"]) == (want, hashlib.sha256(want.encode()).hexdigest(), 0)
    df = frame([(1, "write a.b@example.org now", 25), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert sorted((tuple(r) for r in pii.redact(df, None).collect())) == [(1, "write [email] now", 17), (2, None, None), (3, "clean", 5)]
    assert pii.fit(frame([])) is None


def test_written_at_is_read_without_a_digit(frame, spark):
    w = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    far = "the tree stood near water and people walked there every day "
    for address in ("jane.doe(at)mail.example.org", "jane.doe[at]mail.example.org", "robert.k.alexander.montgomery(at)research.example.org"):
        text = f"{far}write {address} for more, {far}"
        start = text.index(address)
        (base, every), = pii.spans_of(w, [text])
        assert base == [] and (0, start, start + len(address)) in every, (address, every)
        got = pii.redact(frame([(1, text)]), w).first()["text"]
        assert address not in got and "[email]" in got
    assert pii.spans_of(w, ["look (at) this", "format(at)", "nothing here"]) == [([], [])] * 3


def test_stretches_hold_whole_words_around_an_at():
    long = "a" * 60 + "(at)" + "b" * 60 + ".example.org"
    (a, b), = pii.stretches(f"{'x ' * 50}{long} y{' x' * 50}", pii._AT)
    assert a <= 100 and b >= 100 + len(long) and pii.stretches("plain (text) at [all]", pii._AT) == []
    for t in ("1 x@y " * 50, "9" * 30 + "y" * 50 + "@" + "z" * 90 + " 7", "@" * 500, "x[AT]y (at) " * 9):
        for trigger in (pii._TRIGGER, pii._AT):
            parts = pii.stretches(t, trigger)
            assert all(a < b <= len(t) for a, b in parts) and all(p[1] < q[0] for p, q in zip(parts, parts[1:]))
            assert all(any(a <= m.start() and m.end() <= b for a, b in parts) for m in trigger.finditer(t))
