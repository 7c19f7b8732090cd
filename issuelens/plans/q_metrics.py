"""Registered queries: metrics and result analytics (AGG-*, TOP-*, SRT-1, SET-*).

Predictions come from ``labels``: label = quality, prediction = 1 - toxic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.operators import metrics as M
from issuelens.plans.catalog import query, round_doubles
from issuelens.sources import tables

_PRED = "SELECT doc_id, quality AS label, 1 - toxic AS prediction FROM labels"

_PER_CLASS_SQL = f"""p AS ({_PRED}),
cm AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction),
al AS (SELECT label AS cls, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp, sum(n) AS support
  FROM cm GROUP BY label),
ap AS (SELECT prediction AS cls, sum(CASE WHEN label <> prediction THEN n ELSE 0 END) AS fp FROM cm GROUP BY prediction),
j AS (SELECT coalesce(al.cls, ap.cls) AS cls, CAST(coalesce(tp, 0) AS BIGINT) AS tp,
  CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(fp, 0) AS BIGINT) AS fp
  FROM al FULL OUTER JOIN ap ON al.cls = ap.cls),
pr AS (SELECT *, support - tp AS fn,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM j),
pc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM pr)"""


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS n FROM ({_PRED}) GROUP BY label, prediction")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(tables.predictions(spark, sf))


@query("macro_metrics", f"""WITH {_PER_CLASS_SQL}
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS fscore FROM pc""")
def macro_metrics(spark, sf):
    return round_doubles(M.macro_metrics(tables.predictions(spark, sf)))


@query("binary_metrics", f"""WITH p AS ({_PRED}),
s AS (SELECT count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS correct,
  sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN label <> 1 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS fn FROM p),
m AS (SELECT n, CASE WHEN n = 0 THEN 0.0 ELSE correct / n END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM s)
SELECT n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS fscore
FROM m""")
def binary_metrics(spark, sf):
    return round_doubles(M.binary_metrics(tables.predictions(spark, sf)))


@query("classification_report", f"""WITH {_PER_CLASS_SQL}
SELECT CASE cls WHEN 0 THEN {fixed.CLASS_NAMES[0]!r} WHEN 1 THEN {fixed.CLASS_NAMES[1]!r}
  ELSE CAST(cls AS VARCHAR) END AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM pc""")
def classification_report(spark, sf):
    return round_doubles(M.classification_report(tables.predictions(spark, sf)))


@query("distinct_values", "SELECT DISTINCT quality AS label FROM labels")
def distinct_values(spark, sf):
    return tables.table(spark, sf, "labels").select(F.col("quality").alias("label")).distinct()


def _softmax_sql(k: int, src: str = "embeddings") -> str:
    """``(doc_id, p)`` with the same deterministic softmax as ``tables.class_scores``."""
    lg = [f"CAST(embedding[{i + 1}] AS DOUBLE) * 10.0" for i in range(k)]
    mx = f"greatest({', '.join(lg)})" if k > 1 else lg[0]
    ex = [f"exp({l} - {mx})" for l in lg]
    tot = " + ".join(f"({e})" for e in ex)
    arr = ", ".join(f"round(({e}) / ({tot}), 9)" for e in ex)
    return f"SELECT vec_id AS doc_id, label AS true_label, embedding, [{arr}] AS p FROM {src}"


SOFTMAX_SQL = _softmax_sql


@query("argmax_class", f"""SELECT doc_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS prediction
FROM ({_softmax_sql(3)})""")
def argmax_class(spark, sf):
    p = tables.class_scores(tables.pool(spark, sf), 3)
    return p.select("doc_id", M.argmax_class(F.col("p")).alias("prediction"))


_CURVE_SQL = f"""WITH p AS ({_softmax_sql(3)}),
pr AS (SELECT doc_id, true_label % 3 AS label, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS prediction,
  CAST((doc_id % 5 + 1) * 100 AS BIGINT) AS training_size, 'strategy_' || CAST(true_label % 2 AS VARCHAR) AS model
  FROM p),
curves AS (SELECT model, training_size, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS fscore
  FROM pr GROUP BY model, training_size)"""


def _curves(spark, sf):
    """A curve table derived from ``embeddings``: per (model, size) the share of
    rows whose argmax class equals ``label % 3``."""
    p = tables.class_scores(tables.pool(spark, sf), 3)
    pr = p.select((F.col("label") % 3).alias("label"), M.argmax_class(F.col("p")).alias("prediction"),
                  ((F.col("doc_id") % 5 + 1) * 100).cast("bigint").alias("training_size"),
                  F.concat(F.lit("strategy_"), (F.col("label") % 2).cast("string")).alias("model"))
    return pr.groupBy("model", "training_size").agg(
        F.avg(F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)).alias("fscore"))


@query("best_iteration", f"""{_CURVE_SQL}
SELECT model, arg_max(training_size, (round(fscore, 9), -training_size)) AS best_training_size,
  round(max(fscore), 6) AS best_fscore FROM curves GROUP BY model""")
def best_iteration(spark, sf):
    c = _curves(spark, sf).withColumn("fscore", F.round("fscore", 9))
    return round_doubles(M.best_iteration(c))


@query("effort_saved", f"""{_CURVE_SQL},
r AS (SELECT model, training_size, round(fscore, 9) AS fscore, max(round(fscore, 9)) OVER (PARTITION BY model) AS t
  FROM curves)
SELECT model, min(CASE WHEN fscore >= t THEN training_size END) AS size_at_target,
  round(1.0 - min(CASE WHEN fscore >= t THEN training_size END) / (SELECT count(*) FROM embeddings), 6) AS effort_saved
FROM r GROUP BY model""")
def effort_saved(spark, sf):
    """RES-3: the part of the whole pool that need not be labelled."""
    c = _curves(spark, sf).withColumn("fscore", F.round("fscore", 9))
    return round_doubles(M.effort_saved(c, tables.table(spark, sf, "embeddings").count()))


@query("global_top_k", """SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25""")
def global_top_k(spark, sf):
    """TOP-1 / SRT-1: a distributed top-k (TakeOrderedAndProject), stable by id."""
    d = tables.table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.orderBy(F.desc("n_chars"), F.asc("doc_id")).limit(25)


@query("top_k_per_group", """SELECT source, doc_id, n_chars, CAST(rk AS INTEGER) AS rk FROM (SELECT source, doc_id,
  n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents) WHERE rk <= 3""")
def top_k_per_group(spark, sf):
    """TOP-2: ``row_number <= k`` per group; Spark plans a WindowGroupLimit that
    keeps only k rows per group before the shuffle."""
    from pyspark.sql import Window
    d = tables.table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), F.asc("doc_id"))
    return d.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= 3)


@query("set_union", """SELECT lang AS value FROM documents UNION SELECT source FROM documents""")
def set_union(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.select(F.col("lang").alias("value")).union(d.select("source")).distinct()


@query("membership_except", """SELECT doc_id FROM documents d WHERE NOT EXISTS
  (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def membership_except(spark, sf):
    """SET-2 / JOIN-5 anti: documents without a label."""
    d = tables.table(spark, sf, "documents").select("doc_id")
    return d.join(tables.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
