"""Personal data: patterns, and a character-level BiLSTM-CRF that adds spans.

The patterns (email, ip, card, phone) give the base spans. A small network is
trained in numpy on labelled spans: windows around base spans of at most
``max_windows`` places of the documents (those with the smallest hash), some
of them rewritten the way people write such data (a phone without its plus, a
card in groups, an address with a port), and windows around numbers that are
not personal (versions, keys, years, amounts). All text around a digit, an
``@`` is then read in overlapping windows, around an ``@`` to the ends of the
words there; where windows overlap their scores are averaged, with more weight
for the middle of a window, and one Viterbi pass over each whole stretch
decides, so spans are whole wherever windows cut them. A second network of the
same kind, trained on addresses of many shapes, reads the same way around a
written at (``(at)``, ``[at]``, any case). A text without any of these holds no
span.

Spans of the network that touch a base span, or hold fewer digits than the
kind needs, are not added; base spans always stay.

Defined results: null and empty texts hold nothing; positions count code
points, the end is exclusive; equal texts get equal spans; without any
labelled span (tiny inputs) the network adds nothing; other columns are
dropped by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import bilstm
from riskspark.llm.common import table

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE, REACH = 64, 32, 24
MAX_WINDOWS, AT_ROWS = 1200, 400
#: Characters that are scored at once at most (but for a longer stretch).
CELLS = 2 ** 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_AT = re.compile(r"\(at\)|\[at\]", re.I)
_WRITTEN_AT = re.compile(r"\w\s?(?:\(at\)|\[at\])\s?\w", re.I)
_BLANK = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start. Each scan is linear in the text."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _CHAIN.finditer(text):
        parts, place = m[0].split("."), m.start()
        if len(parts) < 4:
            continue
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((1, place, place + size))
            place += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def written_addresses(text: str) -> list[tuple[int, int]]:
    """Runs that are an address apart from the written at: places where the
    network's spans are widened to the whole of it. Linear in the text."""
    out, end = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (d := _DOMAIN.match(text, m.end())):
            out.append((start, d.end()))
            end = d.end()
    return out


def as_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def stretches(text: str, trigger: re.Pattern = _TRIGGER) -> list[tuple[int, int]]:
    """Parts of a text within REACH of a digit or an at, those around an at
    extended to whole words (an address is longer than REACH at times). Linear
    in the text: no character is passed twice."""
    out: list[list[int]] = []
    for m in trigger.finditer(text):
        a, b = max(m.start() - REACH, 0), min(m.end() + REACH, len(text))
        if not m[0].isdigit():
            low = out[-1][1] if out else 0
            while a > low and not text[a - 1].isspace():
                a -= 1
            blank = _BLANK.search(text, max(b, low))
            b = blank.start() if blank else len(text)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: How the same data is written otherwise: (kind, pattern, replacement).
_REWRITES = ((3, r"^\+(\d{1,3})\s*", r""), (3, r"[() ]+", r"-"), (3, r"^\+", r"00"), (3, r"[ ()-]+", r"."),
             (2, r"(\d{4})(?=\d)", r"\1 "), (2, r"(\d{4})(?=\d)", r"\1-"), (0, r"@", r"(at)"), (1, r"$", r":8080"))
_OTHERS = ("version 2.0.1 of", 'key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "in 1998 and 2024", "costs 1,250.00 now",
           "Version 2.0.", "chapter 12, page 345", "id 48213 of 77120", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
           "on 2023-04-17 at 10:45", "3.14159 and 2.71828", "public license, version 3.", "50% of 1000", "@ the end of 7 days")
#: A written at that is no address.
_NO_ADDRESS = ("look (at) this", "to be [at] home", "(at)", "format(at)", "x(at)y there", "prices [at] $5 each", "a (at) 2 p.m.")


def samples(docs: DataFrame, max_windows: int) -> list[tuple[str, int, int, int]]:
    """(context, kind, start, end) around base spans: at most ``max_windows``,
    those with the smallest hash, two of a text at most."""

    def cut(batches: Iterator[pd.DataFrame]):
        for b in batches:
            out = []
            for text in b["text"]:
                for k, s, e in (base_spans(text) if text and _TRIGGER.search(text) else ())[:2]:
                    a = max(s - 60, 0)
                    if e - s < 60:
                        out.append((text[a:e + 60], k, s - a, e - a))
            yield pd.DataFrame(out, columns=["context", "kind", "s", "e"])

    found = docs.select("text").mapInPandas(cut, "context string, kind int, s int, e int").distinct()
    return [(r["context"], r["kind"], r["s"], r["e"]) for r in
            found.orderBy(F.xxhash64("context", "kind", "s"), "context", "kind", "s").limit(max_windows).collect()]


def window(text: str, marks, rng) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of one window of a text, placed over its first mark."""
    tags = np.zeros(len(text), np.int8)
    for k, s, e in marks:
        tags[s:e], tags[s] = 2 + 2 * k, 1 + 2 * k
    first = marks[0] if marks else (0, len(text) // 2, len(text) // 2)
    at = int(rng.integers(max(first[2] - WIDTH, 0), max(min(first[1], len(text) - WIDTH), 0) + 1)) if len(text) > WIDTH else 0
    x, y = np.full(WIDTH, 96, np.int16), np.zeros(WIDTH, np.int8)
    c = bilstm.classes_of(text[at:at + WIDTH])
    x[:len(c)], y[:len(c)] = c, tags[at:at + WIDTH]
    return x, y


def windows(rows: list[tuple[str, int, int, int]], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Training windows (classes, tags): spans as they are, rewritten ones, and
    numbers that are no personal data, set into the same contexts."""
    rng, xs, ys = np.random.default_rng(seed), [], []

    def add(text: str, marks):
        x, y = window(text, marks, rng)
        xs.append(x)
        ys.append(y)

    for i, (context, kind, s, e) in enumerate(rows):
        add(context, [sp for sp in base_spans(context)])
        before, span, after = context[:s], context[s:e], context[e:]
        options = [r for r in _REWRITES if r[0] == kind]
        _, pattern, by = options[i % len(options)]
        new = re.sub(pattern, by, span).strip("- ") if kind != 1 else span
        add(before + new + after, [(kind, s, s + len(new))])
        other = _OTHERS[i % len(_OTHERS)]
        shuffled = re.sub(r"[0-9]", lambda m: str(rng.integers(10)), other)
        add(before + shuffled + after, [])
    return (np.array(xs), np.array(ys)) if xs else (np.empty((0, WIDTH), np.int16), np.empty((0, WIDTH), np.int8))


def at_windows(rows: list[tuple[str, int, int, int]], seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Training windows for a written at: addresses of many shapes, made of the
    contexts' words, and ats that are no address, set into the same contexts."""
    rng, out = np.random.default_rng(seed), []
    names = sorted({w.lower() for r in rows for w in re.findall(r"[A-Za-z]{2,10}", r[0])})

    def some(most: int) -> str:
        parts = [names[j] for j in rng.integers(0, len(names), rng.integers(1, most + 1))]
        return "".join(p + "._-."[rng.integers(4)] for p in parts)[:-1]

    for i, (context, _, s, e) in enumerate(rows if names else ()):
        number = str(rng.integers(100)) if rng.random() < 0.3 else ""
        end = "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 5)))
        new = some(3) + number + ("(at)", "[at]")[i % 2] + some(2).replace("_", "-") + "." + end
        new = new[-56:].lstrip(".-_")
        new = new.upper() if rng.random() < 0.1 else new
        out.append(window(context[:s] + new + context[e:], [(0, s, s + len(new))], rng))
        out.append(window(context[:s] + _NO_ADDRESS[i % len(_NO_ADDRESS)] + context[e:], [], rng))
    return (np.array([x for x, _ in out]), np.array([y for _, y in out])) if out else (
        np.empty((0, WIDTH), np.int16), np.empty((0, WIDTH), np.int8))


def fit(docs: DataFrame, max_windows: int = MAX_WINDOWS) -> dict | None:
    """Weights of the network (a few thousand numbers), None without spans;
    under "at" those of the one that reads written ats."""
    rows = samples(docs, max_windows)
    x, y = windows(rows)
    if not len(x):
        return None
    w, (x, y) = bilstm.train(x, y, 1 + 2 * len(KINDS)), at_windows((rows * (AT_ROWS // len(rows) + 1))[:AT_ROWS])
    return {**w, "at": bilstm.train(x, y, 3)} if len(x) else w


def read(w: dict, texts: list[str], trigger: re.Pattern = _TRIGGER) -> list[list[tuple[int, int, int]]]:
    """Spans that the network sees in each text: overlapping windows of every
    stretch are scored together, averaged, and each stretch decided as one."""
    parts = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t, trigger)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    weight = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)[:, None]
    trans = w["t"]
    parts.sort(key=lambda p: p[2] - p[1])  # like lengths together
    at = 0
    while at < len(parts):
        n = 256
        while n > 1 and n * (parts[min(at + n, len(parts)) - 1][2] - parts[min(at + n, len(parts)) - 1][1]) > CELLS:
            n //= 2
        some = parts[at:at + n]
        at += n
        longest = some[-1][2] - some[-1][1]
        steps = max(1, -(-(longest - WIDTH) // STRIDE) + 1)
        x = np.full((len(some), STRIDE * (steps - 1) + WIDTH), 96, np.int16)
        for r, (i, a, b) in enumerate(some):
            x[r, :b - a] = bilstm.classes_of(texts[i][a:b])
        e, total = np.zeros((*x.shape, len(trans)), np.float32), np.zeros((x.shape[1], 1), np.float32)
        for k in range(steps):
            here = slice(k * STRIDE, k * STRIDE + WIDTH)
            e[:, here] += bilstm.emissions(w, x[:, here]) * weight
            total[here] += weight
        tags = bilstm.viterbi(e / total, trans)
        for r, (i, a, b) in enumerate(some):
            row, start = tags[r, :b - a], None
            for p in [*np.flatnonzero(row).tolist(), -1]:
                if start is not None and (p < 0 or p != last + 1 or row[p] != 2 + 2 * kind):
                    out[i].append((kind, a + start, a + last + 1))
                    start = None
                if p >= 0 and start is None:
                    start, kind = p, int(row[p] - 1) // 2
                last = p
    return out


def accepted(text: str, base, seen) -> list[tuple[int, int, int]]:
    """The network's spans that are whole: blanks trimmed, apart from the base
    spans, with the digits (or the @, or an at between words) that the kind
    needs. One that touches a written address becomes the whole address."""
    out, whole = [], written_addresses(text) if any(k == 0 for k, _, _ in seen) else []
    for kind, s, e in seen:
        touched = [(a, b) for a, b in whole if kind == 0 and s < b and a < e]
        if touched:
            out += [(0, a, b) for a, b in touched if not any(a < y and x < b for _, x, y in base)]
            continue
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if any(s < b and a < e for _, a, b in base):
            continue
        if s and text[s - 1].isalnum() and text[s].isalnum() or e < len(text) and text[e].isalnum() and text[e - 1:e].isalnum():
            continue  # part of a longer word or number
        digits, span = sum(map(str.isdigit, text[s:e])), text[s:e]
        letters = sum(map(str.isalpha, span))
        if (kind == 0 and ("@" in span or _WRITTEN_AT.search(span)) or kind == 1 and span.count(".") >= 3 and not letters and 4 <= digits <= 17
                or kind == 2 and 13 <= digits <= 19 and not letters or kind == 3 and 9 <= digits <= 15 and not letters):
            out.append((kind, s, e))
    return out


def spans_of(w: dict | None, texts: list[str | None]):
    """(base spans, all spans) of each text."""
    out, seen = [([], []) for _ in texts], {}
    for net, trigger in ((w, _TRIGGER), (w and w.get("at"), _AT)):
        have = [i for i, t in enumerate(texts) if t and trigger.search(t)]
        found = read(net, [texts[i] for i in have], trigger) if net is not None and have else [[] for _ in have]
        for i, more in zip(have, found):
            seen.setdefault(i, []).extend(more)
    for i, more in seen.items():
        base = base_spans(texts[i])
        out[i] = base, sorted({*base, *accepted(texts[i], base, more)})
    return out


def _batches(b: pd.DataFrame, rows: int = 512):
    for at in range(0, len(b), rows):
        yield b.iloc[at:at + rows].reset_index(drop=True)


def find(docs: DataFrame, weights: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, number of base spans of each kind, base_sha256, spans, n_added."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for part in _batches(b):
                found = spans_of(sent.value, part["text"].tolist())
                out = [(*(sum(k == s[0] for s in base) for k in range(len(KINDS))),
                        hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(every), len(every) - len(base))
                       for base, every in found]
                yield pd.concat([part[["id"]], pd.DataFrame(
                    out, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])], axis=1)

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, "
                            + ", ".join(f"n_{k} long" for k in KINDS)
                            + ", base_sha256 string, spans string, n_added long").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, weights: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, if
    there, follows the text."""
    sent, names = docs.sparkSession.sparkContext.broadcast(weights), docs.columns

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for part in _batches(b):
                new = []
                for t, (_, every) in zip(part[text_col], spans_of(sent.value, part[text_col].tolist())):
                    end, pieces = 0, []
                    for k, s, e in sorted(every, key=lambda x: (x[1], -x[2])):
                        if s >= end:
                            pieces += [t[end:s], f"[{KINDS[k]}]"]
                        end = max(end, e)
                    new.append(t if not every else "".join(pieces) + t[end:])
                yield part.assign(**{text_col: new})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInPandas(run, schema)
    if "n_chars" in names:
        size = F.char_length(F.col(text_col)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.coalesce(size, F.col("n_chars"))))
    return out


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
