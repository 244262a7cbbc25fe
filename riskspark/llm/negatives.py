"""Hard-negative mining by Fagin's threshold algorithm.

Vectors become integers (floor of ``scale`` times each component), scores are
integer inner products. Candidates are dealt by ranges of (label, hash) to
blocks of about ``BLOCK`` rows. A block sorts its rows once per dimension and
label run; anchors come to it in chunks of at most ``CHUNK``. For an anchor, the
lists of the dimensions are read from the end that the anchor's sign favours,
some depths at a time; rows met for the first time are scored (random access),
and the threshold is the score of a row that had every dimension's last value
read. Each window (the positives' single one; for negatives one per positive)
is done when the threshold is strictly below its k-th score, or, while it has
fewer than k rows, below its lowest score: rows not met yet score at most the
threshold, so ties by smaller id can't be missed. Per block at most k rows a
window go on; Spark's top-k per window merges the blocks.

Positives are searched in the blocks that hold the anchor's label, negatives
in all blocks; a block's bound (the sum over dimensions of the better end) lets
an anchor skip a block that can't reach its windows.

Skew: a hot label fills more blocks. Copies of one vector and label in a block
stand once in the lists; of each group the k + 1 smallest ids are enough,
because copies score the same and are ordered by id.

Defined results: rows with a null label or vector, or with a null or
non-finite component, take no part. Vectors of unlike length are filled with
zeros. Rows with a null id can be positives or negatives, after the others of
their score, but no anchors. Repeated rows are rows of their own. Scores beyond
a long are an error. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import table, written

BLOCK, CHUNK = 8192, 16384
FIRST = 16  # depths of the first round of sorted access; each round doubles it


def _up(x: float) -> float:
    """Above ``x`` by more than a sum of doubles can be wrong."""
    return x + abs(x) * 1e-10 + 1


class Lists:
    """Sorted candidate lists of one block: distinct (vector, label) rows."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
        # ids ascend (null ids last), so groups keep their smallest ids first
        order = np.lexsort((rows, ids))
        vectors, labels, ids, rows = vectors[order], labels[order], ids[order], rows[order]
        key = np.ascontiguousarray(np.column_stack([labels, vectors]))
        _, head, group = np.unique(key.view(np.dtype((np.void, key.dtype.itemsize * key.shape[1]))).ravel(), return_index=True, return_inverse=True)
        place = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[place], np.arange(len(head) + 1))
        self.members = [place[a:min(a + k + 1, b)] for a, b in zip(starts, starts[1:])] if len(head) < len(ids) else None
        self.head, self.ids, self.rows = head, ids, rows
        self.v, self.labels = vectors[head], labels[head]
        most = np.abs(self.v).max(initial=0)
        self.most = float(most)
        self.f = self.v.astype(np.float64)
        self.order = np.argsort(self.v, axis=0, kind="stable").T.copy()  # a list per dimension, ascending
        self.low, self.high = self.v.min(axis=0), self.v.max(axis=0)

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact integer scores; through doubles while those are exact."""
        bound = self.most * float(np.abs(anchor).sum(dtype=np.float64))
        if bound < 2 ** 53:
            return (self.f[at] @ anchor.astype(np.float64)).astype(np.int64)
        if bound >= 2 ** 63:
            raise OverflowError("an inner product doesn't fit a long")
        return self.v[at] @ anchor

    def bound(self, anchor: np.ndarray) -> float:
        """No row scores higher (rounded up)."""
        best = np.where(anchor >= 0, self.high, self.low)
        return _up(float(best.astype(np.float64) @ anchor.astype(np.float64)))

    def search(self, anchor: np.ndarray, me: int, wanted, windows, k: int):
        """For every (low, high) of ``windows`` the best k rows (by score, then
        id) among the ``wanted`` groups with a score in it, without row ``me``:
        [(window, score, position)]."""
        n, dims = self.v.shape
        lows = np.array([w[0] for w in windows], np.int64)
        highs = np.array([w[1] for w in windows], np.int64)
        used = np.flatnonzero(anchor)  # a dimension where the anchor is zero adds nothing
        seen = np.zeros(n, bool)
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, FIRST
        best = [[] for _ in windows]
        weight = anchor[used].astype(np.float64)
        ends = weight > 0
        exact = self.most * float(np.abs(weight).sum()) < 2 ** 53
        while depth < n:
            stop = min(n, depth + step)
            if len(used):
                up, down = used[~ends], used[ends]
                met = np.concatenate([self.order[up, depth:stop].ravel(), self.order[down, n - stop:n - depth].ravel()])
            else:
                met, stop = np.arange(n), n
            new = np.zeros(n, bool)
            new[met] = True
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new & wanted)
            if len(at):
                s = self.scores(anchor, at)
                inside = (s >= lows.min()) & (s <= highs.max())
                found, scores = np.concatenate([found, at[inside]]), np.concatenate([scores, s[inside]])
            depth, step = stop, step * 2
            last = np.where(ends, self.v[self.order[used, n - stop], used], self.v[self.order[used, stop - 1], used])
            threshold = float(last.astype(np.float64) @ weight)
            threshold = threshold if exact else _up(threshold)
            best, floors = self.top(found, scores, lows, highs, me, k)
            if depth >= n or all(threshold < f for f in floors):
                break
        return [(w, s, p) for w, rows in enumerate(best) for s, p in rows]

    def top(self, found, scores, lows, highs, me, k):
        best, floors = [], []
        order = np.lexsort((self.ids[self.head[found]], -scores))
        found, scores = found[order], scores[order]
        for low, high in zip(lows, highs):
            a, b = np.searchsorted(-scores, -high, "left"), np.searchsorted(-scores, -low, "right")
            rows, limit = [], None
            for g, s in zip(found[a:b].tolist(), scores[a:b].tolist()):
                if limit is not None and s < limit:
                    break
                members = [self.head[g]] if self.members is None else self.members[g]
                rows += [(s, int(m)) for m in members if self.rows[m] != me][:k]
                if limit is None and len(rows) >= k:
                    limit = s  # groups of the same score may hold smaller ids
            rows = sorted(rows, key=lambda x: (-x[0], self.ids[x[1]], self.rows[x[1]]))[:k]
            best.append(rows)
            floors.append(rows[-1][0] if len(rows) == k else low)
        return best, floors


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


#: Null ids come after all others.
NULL_ID = np.iinfo(np.int64).max

FOUND = "anchor_row long, anchor_id long, anchor_label int, window int, low long, high long, score long, id long, row long"


def searcher(k: int, dims: int, same: bool):
    """Search of one block for one chunk of anchors: those of the anchor's
    label in one window, or the others in the anchor's windows."""
    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            ids = rows["vec_id"].fill_null(NULL_ID).to_numpy()
            lists = Lists(_matrix(rows["v"], dims), rows["label"].to_numpy().astype(np.int64), ids, rows["row"].to_numpy(), k)
            vectors = _matrix(anchors["v"], dims)
            meta = list(zip(anchors["row"].to_pylist(), anchors["vec_id"].to_pylist(), anchors["label"].to_pylist()))
            windows = [[(-NULL_ID, NULL_ID)]] * len(meta) if same else [
                [(x["low"], x["high"]) for x in w] for w in anchors["windows"].to_pylist()]
            for (me, name, label), a, w in zip(meta, vectors, windows):
                if not same and lists.bound(a) < min(x[0] for x in w):
                    continue
                wanted = lists.labels == label if same else lists.labels != label
                if not wanted.any():
                    continue
                for i, s, p in lists.search(a, me, wanted, w, k):
                    out.append((me, name, label, i, *w[i], s, None if lists.ids[p] == NULL_ID else int(lists.ids[p]), int(lists.rows[p])))
        names = [f.split()[0] for f in FOUND.split(", ")]
        kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in FOUND.split(", ")]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return search


def prepared(vectors: DataFrame, scale: float, block: int) -> tuple[DataFrame, int, int]:
    """The rows that take part, as integers, dealt to blocks and written;
    the number of blocks and of dimensions."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    sound = F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n = max(1, -(-sizes["n"] // block))
    n = max(n, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes["n"] // (block // 4))))
    dealt = rows.repartitionByRange(n, "label", F.xxhash64("vec_id", "v")).withColumns(
        {"block": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    return written(dealt, "vectors"), sizes["n"], sizes["dims"] or 0


def mine(vectors: DataFrame, k: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: float = 256.0,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its first ``k``
    rows of the same label, the first ``k`` rows of other labels whose score
    lies between ``low`` and ``high`` percent of the positive's."""
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    rows, n, dims = prepared(given, scale, block)
    anchors = rows.where(F.col("vec_id") % every == 0)
    chunks = max(1, -(-anchors.count() // chunk))
    anchors = anchors.select("vec_id", "label", "v", "row", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"))
    many = F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<int>")
    dealt = rows.select(*[F.col(c).alias(c) for c in rows.columns], F.explode(many).alias("chunk")).groupBy("block", "chunk")
    # positives: only the blocks that hold the anchor's label
    places = rows.select("label", "block").distinct()
    asked = anchors.join(places, "label").select("block", "chunk", "row", "vec_id", "label", "v")
    near = asked.groupBy("block", "chunk").cogroup(dealt).applyInArrow(searcher(k, dims, True), FOUND)
    first = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    positives = written(near.select("anchor_row", F.col("id").alias("positive_id"), F.col("rank").alias("positive"), F.col("score").alias("positive_score")), "positives")
    # negatives: windows of the anchor's positives, all blocks
    p = F.col("positive_score")
    windowed = (positives.where(p >= 0).select("anchor_row", F.struct(
        "positive", F.ceil(low * p / 100).alias("low"), p.alias("high")).alias("w"))
        .groupBy("anchor_row").agg(F.sort_array(F.collect_list("w")).alias("windows")))
    blocks = rows.agg(F.max("block")).first()[0]
    asked = (anchors.join(windowed, anchors["row"] == windowed["anchor_row"])
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks or 0)).cast("array<int>")))
             .select("block", "chunk", "row", "vec_id", "label", "v", "windows"))
    far = asked.groupBy("block", "chunk").cogroup(dealt).applyInArrow(searcher(k, dims, False), FOUND)
    first = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    far = far.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return (far.withColumn("positive", F.col("window") + 1).join(positives, ["anchor_row", "positive"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS r
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, b.r, a.label = b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])), 0)::BIGINT AS score
  FROM sound a JOIN sound b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, r) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.id NULLS LAST, n.r)::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
