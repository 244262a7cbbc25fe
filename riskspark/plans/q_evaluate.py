"""Registered evaluation queries (O-126..O-135)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import adapters as A
from riskspark.operators import evaluate as ev
from riskspark.plans.registry import r6, register

S = A.EVAL_SCORED_SQL
GRID = ev.numpy_grid(0.05, 0.96, 0.01)
TABLE_GRID = ev.numpy_grid(0.1, 1.0, 0.05)


def _grid_sql(grid):
    vals = ", ".join(f"(CAST('{t!r}' AS DOUBLE), {i})" for i, t in enumerate(grid))
    return f"g(threshold, i) AS (VALUES {vals})"


CM_SQL = f"""SELECT count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
       count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
       count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
       count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM ({S}) s"""
CURVE_SQL = f"""d AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ({S}) s GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp,
             sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM d)"""


def _scored(spark, sf):
    return A.eval_scored(spark, sf)


def _cm(spark, sf):
    return ev.confusion(_scored(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int")))


@register("o126_confusion_matrix", CM_SQL)
def o126(spark, sf):
    return _cm(spark, sf)


def _d(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


@register("o127_classification_metrics", f"""WITH m AS ({CM_SQL})
SELECT tn, fp, fn, tp, {r6(_d('tp + tn', 'tp + tn + fp + fn'), 'accuracy')},
       {r6(_d('tp', 'tp + fp'), 'precision')}, {r6(_d('tp', 'tp + fn'), 'recall')},
       {r6(_d('2 * tp', '2 * tp + fp + fn'), 'f1')} FROM m""")
def o127(spark, sf):
    return ev.classification_metrics(_cm(spark, sf))


@register("o128_roc_auc", f"""WITH {CURVE_SQL}
SELECT {r6('CAST(sum(CAST(neg AS HUGEINT) * (2 * tp - pos)) AS DOUBLE) / (2.0 * CAST(max(P) AS DOUBLE) * max(N))',
           'roc_auc')} FROM c""")
def o128(spark, sf):
    return ev.roc_auc(_scored(spark, sf))


@register("o129_average_precision", f"""WITH {CURVE_SQL}
SELECT {r6('sum((CAST(pos AS DOUBLE) / P) * (CAST(tp AS DOUBLE) / (tp + fp)))', 'average_precision')} FROM c""")
def o129(spark, sf):
    return ev.average_precision(_scored(spark, sf))


@register("o130_roc_curve", f"""WITH {CURVE_SQL}
SELECT {r6('score', 'score')}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       {r6(_d('tp', 'P'), 'tpr')}, {r6(_d('fp', 'N'), 'fpr')} FROM c""")
def o130(spark, sf):
    return ev.curve(_scored(spark, sf)).select("score", "tp", "fp", "tpr", "fpr")


@register("o130_pr_curve", f"""WITH {CURVE_SQL}
SELECT {r6('score', 'score')}, {r6(_d('tp', 'tp + fp'), 'precision')}, {r6(_d('tp', 'P'), 'recall')}
FROM c WHERE tp - pos < P""")
def o130b(spark, sf):
    return ev.pr_points(_scored(spark, sf)).select("score", "precision", "recall")


@register("o131_best_f1_threshold", f"""WITH {CURVE_SQL},
p AS (SELECT score, CAST(tp AS DOUBLE) / (tp + fp) AS pr, CAST(tp AS DOUBLE) / P AS rc FROM c WHERE tp - pos < P),
f AS (SELECT score, 2 * pr * rc / (pr + rc + 1e-10) AS f1 FROM p)
SELECT {r6('score', 'best_threshold')}, {r6('f1', 'best_f1')} FROM f ORDER BY f1 DESC, score ASC LIMIT 1""")
def o131(spark, sf):
    return ev.best_f1_threshold(_scored(spark, sf))


def _grid_rows_sql(grid):
    return f"""WITH {_grid_sql(grid)},
x AS (SELECT g.i, g.threshold,
             count(*) FILTER (WHERE s.label = 1 AND s.score >= g.threshold) AS tp,
             count(*) FILTER (WHERE s.label = 0 AND s.score >= g.threshold) AS fp,
             count(*) FILTER (WHERE s.label = 1) AS P
      FROM g, ({S}) s GROUP BY g.i, g.threshold)"""


@register("o132_best_grid_threshold", _grid_rows_sql(GRID) + f""",
f AS (SELECT i, threshold, CASE WHEN P + tp + fp = 0 THEN 0.0 ELSE 2.0 * tp / (P + tp + fp) END AS f1 FROM x),
b AS (SELECT * FROM f ORDER BY f1 DESC, i ASC LIMIT 1)
SELECT {r6('CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END', 'best_threshold')},
       {r6('greatest(f1, 0.0)', 'best_f1')} FROM b""")
def o132(spark, sf):
    return ev.best_grid_threshold(_scored(spark, sf), GRID)


@register("o132_threshold_grid_table", _grid_rows_sql(TABLE_GRID) + f"""
SELECT CAST(i AS BIGINT) AS i, {r6('threshold', 'threshold')}, tp, fp, P - tp AS fn,
       {r6(_d('tp', 'tp + fp'), 'precision')}, {r6(_d('tp', 'P'), 'recall')},
       {r6(_d('2 * tp', 'P + tp + fp'), 'f1')} FROM x""")
def o132b(spark, sf):
    return ev.threshold_grid(_scored(spark, sf), TABLE_GRID)


@register("o133_classification_report", f"""WITH m AS ({CM_SQL}),
k AS (SELECT {_d('tn', 'tn + fn')} AS p0, {_d('tn', 'tn + fp')} AS r0, {_d('2 * tn', '2 * tn + fn + fp')} AS f0,
             tn + fp AS s0, {_d('tp', 'tp + fp')} AS p1, {_d('tp', 'tp + fn')} AS r1,
             {_d('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS s1 FROM m)
SELECT '0' AS class, {r6('p0', 'precision')}, {r6('r0', 'recall')}, {r6('f0', 'f1_score')}, s0 AS support FROM k
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM k
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s0 + s1 FROM k
UNION ALL SELECT 'weighted avg', round({_d('p0 * s0 + p1 * s1', 's0 + s1')}, 6), round({_d('r0 * s0 + r1 * s1', 's0 + s1')}, 6),
                 round({_d('f0 * s0 + f1 * s1', 's0 + s1')}, 6), s0 + s1 FROM k""")
def o133(spark, sf):
    return ev.classification_report(_cm(spark, sf))


@register("o135_fpr_at_99_recall", f"""WITH {CURVE_SQL}
SELECT {r6(f"min({_d('fp', 'N')})", 'fpr_at_recall')} FROM c WHERE {_d('tp', 'P')} >= 0.99""")
def o135(spark, sf):
    return ev.fpr_at_recall(_scored(spark, sf))
