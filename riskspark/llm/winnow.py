"""Document fingerprints by winnowing, with DataFrame functions only.

Symbols are pieces of at most ``piece`` code points of the words, so that
texts without blanks have many symbols too. Rolling k-gram hashes are built
by doubling (1, 2, 4 .. symbols), the minimum of every window of w hashes by
doubling as well; among equal hashes of a window the rightmost is chosen.
Each chosen hash is kept with its position, and any match of k + w - 1
symbols that starts at a piece border shares a chosen hash.

Defined results: a null text is an empty one; a text with fewer than k
symbols has one gram of all of them, one without symbols an empty
fingerprint; two empty fingerprints are alike (1.0), an empty and another are
not (0.0). Rows are ordered by id (nulls first), then text; repeated rows
follow each other. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import table

#: Bits of a packed value that hold the position (texts hold at most 2**31
#: characters, fingerprints keep the upper 35 bits of a hash).
POS = 28


def _pairs(df: DataFrame, out: str, col: str, step: int, join) -> DataFrame:
    """out[i] = join(col[i], col[i + step])."""
    c, rest = F.col(col), F.greatest(F.size(col) - step, F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(c, F.lit(1), rest), F.slice(c, F.lit(step + 1), rest), join))


def fingerprint(df: DataFrame, text: str, out: str, k: int = 4, w: int = 4, piece: int = 8) -> DataFrame:
    """Add ``out``: array<long> of the chosen hashes, each packed with its
    position, in text order. ``k`` and ``w`` are powers of two."""
    assert k & (k - 1) == 0 and w & (w - 1) == 0
    h = f"__{out}_h"
    symbols = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{piece}}}"), 0)
    df = df.withColumn(h, F.transform(symbols, lambda s: F.xxhash64(s)))
    all_of_it, size, names = F.xxhash64(F.col(h)), 1, [h]
    while size < k:
        names.append(f"__{out}_g{2 * size}")
        df = _pairs(df, names[-1], names[-2], size, lambda a, b: F.xxhash64(a, b))
        size *= 2
    grams = (F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
             .when(F.size(names[-1]) == 0, F.array(all_of_it)).otherwise(F.col(names[-1])))
    low = F.lit((1 << POS) - 1)
    names.append(f"__{out}_p")
    df = df.withColumn(names[-1], F.transform(grams, lambda g, i: F.shiftleft(
        F.shiftrightunsigned(g, POS + 1), POS).bitwiseOR(low - i.cast("bigint"))))
    first, size = names[-1], 1
    while size < w:
        names.append(f"__{out}_m{2 * size}")
        df = _pairs(df, names[-1], names[-2], size, lambda a, b: F.least(a, b))
        size *= 2
    windows = F.when((F.size(names[-1]) == 0) & (F.size(first) > 0), F.array(F.array_min(first))).otherwise(
        F.col(names[-1]))
    return df.withColumn(out, F.array_distinct(windows)).drop(*names)


def hashes(packed):
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, POS)))


def as_text(packed):
    """hash@position, comma-joined."""
    low = F.lit((1 << POS) - 1)
    return F.array_join(F.transform(packed, lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, POS))), F.lit("@"), (low - x.bitwiseAND(low)).cast("string"))), ",")


def likeness(a, b):
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame, buckets: int) -> tuple[DataFrame, Window]:
    """Rows (id, text) dealt to ``buckets`` id ranges, and the window in which
    the next row stands. Quantiles of the ids (``buckets`` numbers) are the
    range borders; a border row also goes to the end of the range before, and
    the first row of all to the end of the last, marked ``copy``."""
    found = docs.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 10_000).alias("q"),
                     F.min("id").alias("low"), F.max(F.col("id").isNull()).alias("nulls")).first()
    low = None if found["nulls"] else found["low"]
    borders = sorted({q for q in found["q"] or [] if q != low})
    listed = F.array(*[F.lit(b).cast("bigint") for b in borders]) if borders else F.array().cast("array<bigint>")
    bucket = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(listed, lambda b: b <= F.col("id"))))
    place = lambda b, copy, wrap: F.struct(b.alias("bucket"), F.lit(copy).alias("copy"), F.lit(wrap).alias("wrap"))
    places = F.concat(
        F.array(place(F.col("bucket"), False, False)),
        F.when(F.array_contains(listed, F.col("id")), F.array(place(F.col("bucket") - 1, True, False)))
        .otherwise(F.array().cast("array<struct<bucket:int,copy:boolean,wrap:boolean>>")),
        F.when(F.col("id").eqNullSafe(F.lit(low).cast("bigint")), F.array(place(F.lit(len(borders)), True, True)))
        .otherwise(F.array().cast("array<struct<bucket:int,copy:boolean,wrap:boolean>>")))
    dealt = docs.withColumn("bucket", bucket).withColumn("place", F.explode(places)).select("id", "text", "place.*")
    return dealt, Window.partitionBy("bucket").orderBy(
        "wrap", F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first(), "copy")


def fingerprints_with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                                 k: int = 4, w: int = 4, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text (the last quarter
    replaced by the start of the next row's text), and how alike the
    fingerprint is to the edited text's and to the next row's."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, order = with_next(rows, buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = dealt.withColumn("next", F.lead("text").over(order))
    df = fingerprint(df, "text", "own", k, w)
    df = df.withColumn("next_hashes", F.lead(hashes(F.col("own"))).over(order)).where(~F.col("copy"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut),
                                          F.substring(F.col("next"), F.lit(1), cut)))
    df = fingerprint(df, "edited", "other", k, w)
    return df.select(
        F.col("id").alias(id_col), n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(hashes(F.col("own")), hashes(F.col("other"))).alias("near_edited"),
        likeness(hashes(F.col("own")), F.col("next_hashes")).alias("near_next"))


def op3_winnow(spark, sf_dir: str) -> DataFrame:
    return fingerprints_with_neighbours(table(spark, sf_dir, "documents"))
