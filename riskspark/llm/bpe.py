"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never end up inside
one token, so a cut between the two bytes is certain. Every word is cut
there, the fragments are encoded independently and the ids concatenated;
fragments repeat far more often than words, so their encodings are kept.

Ids equal the tokenizer file's own library (added tokens matched in the raw
text, NFC, lower case by character, word pattern, byte alphabet, merges by
rank with word ends); decoding joins the token strings with blanks, as that
file names no decoder. Defined results: a null text is an empty one (no ids,
empty decoding); repeated rows give repeated results; an empty table gives
none; other columns are dropped. Texts are always whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from riskspark.llm.common import Bounded, encode, table

END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in chars)
    chars.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [chars[b] for b in range(256)]


@functools.cache
def _class(name: str) -> str:
    r"""``[\p{name}]`` as of Python's Unicode version: the regex module knows
    letters of later versions that the tokenizer's library does not."""
    later = [c for c in regex.findall(rf"\p{{{name}}}", "".join(map(chr, range(0x80, 0x110000))))
             if unicodedata.category(c)[0] != name]
    ranges: list[list[int]] = []
    for c in map(ord, later):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    out = "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in ranges)
    return rf"[\p{{{name}}}--[{out}]]" if out else rf"[\p{{{name}}}]"


#: White space to Python's str.split(), but not to the word pattern.
_SEPARATORS, _BLANKS = re.compile("[\x1c-\x1f]"), re.compile(r"[^\S\x1c-\x1f]+")

#: All characters up to here are assigned in every Unicode version since 7.
_OLD = re.compile("[^\x00-\u0377]+")


def newer(text: str) -> bool:
    """Whether a text has characters that Python's Unicode version lacks."""
    return any(unicodedata.category(c) == "Cn" for c in set("".join(_OLD.findall(text))))


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        self.pattern = regex.compile("(?V1)" + spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(
            r"[\p{L}]", _class("L")).replace(r"[\p{N}]", _class("N")).replace(
            r"[^\s\p{L}\p{N}]", rf"[^\s{_class('L')}{_class('N')}]"))
        self.library = None
        self.plain = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch  # letters only
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.alphabet = byte_alphabet()
        self.inside = set()
        for t in self.vocab:
            s = self.symbols(t[:-len(END)], True) if t.endswith(END) and t != END else list(t)
            self.inside.update(zip(s, s[1:]))
        self.seen, self.fragments = Bounded(), Bounded()

    @staticmethod
    def symbols(word: str, ends: bool) -> list[str]:
        s = list(word)
        if ends and s:
            s[-1] += END
        return s

    def fragments_of(self, symbols: list[str]) -> list[list[str]]:
        """Cut where the neighbouring pair is inside no token."""
        inside = self.inside
        cuts = [i for i, p in enumerate(zip(symbols, symbols[1:]), 1) if p not in inside]
        if not cuts:
            return [symbols]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]

    def merge(self, fragment: list[str]) -> list[int]:
        """Repeat the best-ranked merge, leftmost first."""
        s, rank, none = list(fragment), self.ranks.get, 1 << 30
        ranks = [rank(p, none) for p in zip(s, s[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            s[i:i + 2] = [s[i] + s[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((s[i - 1], s[i]), none)
            if i < len(ranks):
                ranks[i] = rank((s[i], s[i + 1]), none)
        return [self.vocab[t] for t in s]

    def word(self, word: str) -> bytes:
        """Ids of one word as 32-bit integers."""
        out = []
        s = self.symbols("".join([self.alphabet[b] for b in encode(word)]), True)
        for f in self.fragments_of(s):
            if len(f) == 1:
                out.append(self.vocab[f[0]])
            elif len(f) >= 500:
                out += self.merge_long(f)
            else:
                key = "".join(f)  # an inner fragment ends without the word end
                ids = self.fragments.get(key)
                if ids is None:
                    ids = self.fragments.keep(key, self.merge(f), 2 * len(key) + 24 * len(f))
                out += ids
        return array("I", out).tobytes()

    def token(self, token: str) -> bytes:
        """Ids of what stands between white space, remembered if short."""
        found = self.seen.get(token)
        if found is None:
            found = b"".join(map(self.word, self.split(token)))
            if len(token) < 200:
                self.seen.keep(token, found, 2 * len(token) + len(found))
        return found

    def merge_long(self, fragment: list[str]) -> list[int]:
        """The same merges for a long fragment: a heap over a linked list."""
        import heapq

        s, n = list(fragment), len(fragment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := self.ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.ranks.get((s[k], s[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, s[k], s[after[k]]))
        return [self.vocab[t] for t in s if t is not None]

    def normal(self, text: str) -> str:
        """NFC, lower case by character, white space as blanks."""
        if text.isascii():
            return text.lower()
        if newer(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return self.library.normalizer.normalize_str(text)
        # by character there is no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, token: str) -> list[str]:
        """Words of what stands between white space; characters newer than
        Python's Unicode version are left to the library's own tables."""
        if self.plain(token):
            return [token]
        if token.isascii() or not newer(token):
            return self.pattern.findall(token)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        back = {c: b for b, c in enumerate(self.alphabet)}
        return [bytes(back[c] for c in p).decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(token)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out, token = [], self.token
        for i, piece in enumerate(self.split_added.split(text) if "<|" in text else (text,)):
            if i % 2:
                out.append(array("I", [self.added[piece]]).tobytes())
            elif piece:
                text = self.normal(piece)
                out += map(token, text.split() if not _SEPARATORS.search(text) else _BLANKS.split(text))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and (``keep_ids``) the ids as
    array<int>. Scan-local: no shuffle. ``path`` is the tokenizer file, which
    every worker has."""
    path = path or default_path()
    rows = docs.select(id_col, text_col).toDF("id", "text")
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, "
              "decoded_sha256 string" + (", ids array<int>" if keep_ids else ""))

    def run(batches: Iterator[pd.DataFrame]):
        bpe = WordBpe(path)  # freed with the task, as workers go on to other stages
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at:at + 512]
                ids = [bpe.encode(t) for t in part["text"]]
                out = pd.DataFrame({
                    "id": part["id"], "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(encode(bpe.decode(x))).hexdigest() for x in ids]})
                if keep_ids:
                    out["ids"] = [np.frombuffer(x, "<i4") for x in ids]
                yield out

    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def op6_bpe_encode(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)
