"""URL filters: site rules first, then logistic regression on hashed character
n-grams of host and path, fitted to a small labelled URL table.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the model as an empty string. Repeated
rows are judged alike, an empty table gives an empty result, and other
columns of the input (also ones named like the new ones) are dropped but for
the id. A rule fits its host and every subdomain when the path starts with
the rule's path; the longest rule wins, then the first given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import encode, grams, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"),
         ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: The small labelled table: unwanted and ordinary addresses.
_BLOCK_HOSTS = ("cheap-pills", "casino-win", "free-bets", "adult-x", "spam-farm", "ads-track",
                *(f"{a}-{b}" for i, a in enumerate(("cheap", "free", "best", "win", "hot", "x"))
                  for b in ("pills", "casino", "bets", "adult", "spam", "ads", "loans", "meds")[i % 2::2]),
                *(f"{b}-{a}" for i, a in enumerate(("farm", "track", "win", "x", "online", "click"))
                  for b in ("pills", "casino", "bets", "adult", "spam", "ads", "loans", "meds")[i % 2::2]))
_ALLOW_HOSTS = ("library", "museum", "therin", "tionsh", "university", "weather", "garden", "history",
                "kitchen", "theror", "ththan", "science", "cycling", "archive", "theater", "ththst",
                "notebook", "painting", "thonly", "harbour", "city-library", "old-town", "theren", "therha",
                "tiontion", "ththre", "mountain", "bakery", "theother", "public-garden", "ththwh", "railway",
                "town-museum", "therou", "orchestra", "ththly", "river-valley", "schoolbook", "there", "thther")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 = block); each host as it appears with usual prefixes and paths."""
    shapes = ("https://{}.example.{}/en/{}", "http://www.{}.example.{}/de/{}/",
              "https://blog.{}.example.{}/fr/{}?page=2", "https://m.{}.example.{}/es/{}.html")
    out = []
    for label, hosts in ((1, _BLOCK_HOSTS), (0, _ALLOW_HOSTS)):
        for i, h in enumerate(hosts):
            for j, s in enumerate(shapes):
                out.append((s.format(h, ("com", "net", "org")[(i + j) % 3], 97 * i + 1013 * j + 5), label))
    return out


def parts(url):
    """Columns host and path of a url column."""
    host = F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def split_url(url: str | None) -> tuple[str, str]:
    """The same in Python, for the labelled table."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "#?":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def rule_columns(host, path, rules=RULES):
    """(rule, verdict) columns: null where no rule fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):  # the longest outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(hosts, paths, bits: int, sizes=(3, 4, 5)):
    """(row, bucket) of every character n-gram of ``^host/path$`` bytes."""
    flat, ends = [], []
    for h, p in zip(hosts, paths):
        b = b"^" + encode(h) + b"\x00" + encode(p) + b"$"
        flat.append(b)
        ends.append(len(b))
    owner = np.repeat(np.arange(len(ends)), ends)
    codes = np.frombuffer(b"".join(flat), np.uint8).astype(np.uint64) + np.uint64(1)
    rows, buckets = [], []
    for n in sizes:
        g = grams(codes, n)
        inside = owner[:len(g)] == owner[n - 1:n - 1 + len(g)]
        rows.append(owner[:len(g)][inside])
        buckets.append((g[inside] >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def scores(weights: np.ndarray, hosts, paths) -> np.ndarray:
    """Log odds of block; each n-gram counts by its share of the url."""
    bits = (len(weights) - 1).bit_length() - 1
    rows, buckets = features(hosts, paths, bits)
    n = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
    return weights[-1] + np.bincount(rows, weights[buckets], minlength=len(hosts)) / np.sqrt(n)


def fit(labelled: list[tuple[str, int]], bits: int = 14, steps: int = 400, rate: float = 1.0,
        decay: float = 1e-4) -> np.ndarray:
    """2**bits weights and the intercept, by full-batch gradient descent."""
    hosts, paths = zip(*(split_url(u) for u, _ in labelled))
    y = np.array([label for _, label in labelled], float)
    rows, buckets = features(hosts, paths, bits)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    w = np.zeros(2 ** bits + 1)
    for _ in range(steps):
        z = w[-1] + np.bincount(rows, w[buckets], minlength=len(y)) * scale
        err = 1 / (1 + np.exp(-z)) - y
        w[:-1] -= rate * (np.bincount(buckets, (err * scale)[rows], minlength=2 ** bits) / len(y) * 8 + decay * w[:-1])
        w[-1] -= rate * err.mean()
    return w


def judge(pages: DataFrame, weights: np.ndarray, rules=RULES, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score (log odds of block)."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    schema = f"{rows.schema.fields[0].simpleString().replace(':', ' ')}, host string, path string, score double"
    sent = pages.sparkSession.sparkContext.broadcast(weights)  # 2**bits + 1 numbers

    def score(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield b.assign(score=scores(sent.value, b["host"], b["path"]) if len(b) else np.empty(0))

    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return rows.mapInPandas(score, schema).select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), fit(labelled_urls()))
