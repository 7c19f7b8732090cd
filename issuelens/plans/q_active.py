"""Registered queries: query strategies, pool joins and the active-learning loop.

Pool = ``embeddings`` (doc_id = vec_id); class probabilities ``p`` are the
deterministic softmax of ``tables.class_scores``; the labelled set is the
seeded initial sample of 100 rows; the unlabelled pool is the anti join.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.operators import active as A
from issuelens.operators import metrics as M
from issuelens.operators import sampling as S
from issuelens.operators import strategies as Q
from issuelens.plans.catalog import query, round_doubles
from issuelens.plans.q_metrics import SOFTMAX_SQL
from issuelens.session import scratch_table_dir, written
from issuelens.sources import tables

_INIT_SQL = ("init AS (SELECT vec_id AS doc_id FROM embeddings ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), "
             "vec_id LIMIT 100)")


def _pool_sql(k: int) -> str:
    return f"""{_INIT_SQL},
scored AS ({SOFTMAX_SQL(k)}),
pool AS (SELECT * FROM scored WHERE doc_id NOT IN (SELECT doc_id FROM init)),
lab AS (SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM init))"""


def _split(spark, sf, k=2):
    p = tables.class_scores(tables.pool(spark, sf), k)
    init = S.sample_n(p.select("doc_id"), fixed.QUERY_SIZE, "doc_id", fixed.SEED)
    unl = p.join(init, "doc_id", "left_anti")
    lab = p.join(init, "doc_id", "left_semi")
    return unl, lab


def _strategy_sql(score: str, asc: bool, k: int = 2) -> str:
    order = "ASC" if asc else "DESC"
    return f"""WITH {_pool_sql(k)},
s AS (SELECT doc_id, round({score}, 9) AS score FROM pool)
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score {order}, doc_id) AS INTEGER) AS rank
FROM s ORDER BY score {order}, doc_id LIMIT 100"""


_LC = "list_max(p)"
_BT = "list_sort(p, 'DESC')[1] - coalesce(list_sort(p, 'DESC')[2], 0.0)"
_EN = "-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END))"


@query("pool_anti_join", f"WITH {_pool_sql(2)} SELECT doc_id FROM pool")
def pool_anti_join(spark, sf):
    """JOIN-6 / ACT-1: the unlabelled pool = pool minus the labelled ledger."""
    unl, _ = _split(spark, sf)
    return unl.select("doc_id")


@query("pool_state", f"""WITH {_INIT_SQL}
SELECT e.vec_id AS doc_id, CASE WHEN e.vec_id IN (SELECT doc_id FROM init) THEN e.label ELSE -1 END AS label
FROM embeddings e""")
def pool_state(spark, sf):
    """ACT-1 export form: labels of the labelled rows, -1 elsewhere (left join)."""
    p = tables.pool(spark, sf).select("doc_id", "label")
    init = S.sample_n(p.select("doc_id"), fixed.QUERY_SIZE, "doc_id", fixed.SEED).withColumn("_l", F.lit(True))
    j = p.join(init, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("_l"), F.col("label")).otherwise(F.lit(-1)).alias("label"))


@query("query_least_confidence", _strategy_sql(_LC, True))
def query_least_confidence(spark, sf):
    unl, _ = _split(spark, sf)
    return round_doubles(Q.query_least_confidence(unl, fixed.QUERY_SIZE))


@query("query_breaking_ties", _strategy_sql(_BT, True))
def query_breaking_ties(spark, sf):
    unl, _ = _split(spark, sf)
    return round_doubles(Q.query_breaking_ties(unl, fixed.QUERY_SIZE))


@query("query_breaking_ties_3class", _strategy_sql(_BT, True, 3))
def query_breaking_ties_3class(spark, sf):
    unl, _ = _split(spark, sf, 3)
    return round_doubles(Q.query_breaking_ties(unl, fixed.QUERY_SIZE))


@query("query_entropy", _strategy_sql(_EN, False))
def query_entropy(spark, sf):
    unl, _ = _split(spark, sf)
    return round_doubles(Q.query_entropy(unl, fixed.QUERY_SIZE))


@query("query_random", f"""WITH {_pool_sql(2)}
SELECT doc_id, CAST(NULL AS DOUBLE) AS score,
  CAST(row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS INTEGER) AS rank
FROM pool ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def query_random(spark, sf):
    unl, _ = _split(spark, sf)
    return Q.query_random(unl, fixed.QUERY_SIZE)


@query("attach_labels", f"""WITH {_pool_sql(2)},
s AS (SELECT doc_id FROM pool ORDER BY round({_BT}, 9), doc_id LIMIT 100)
SELECT s.doc_id, e.label FROM s JOIN embeddings e ON e.vec_id = s.doc_id""")
def attach_labels(spark, sf):
    """JOIN-8 / ACT-3: reveal the labels of the selected rows."""
    unl, _ = _split(spark, sf)
    sel = Q.query_breaking_ties(unl, fixed.QUERY_SIZE).select("doc_id")
    return sel.join(tables.pool(spark, sf).select("doc_id", "label"), "doc_id")


def _contrastive_sql(k: int = 10) -> str:
    return f"""WITH {_pool_sql(2)},
nu AS (SELECT doc_id, p, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding,
  lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS e FROM pool),
nl AS (SELECT doc_id, p, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding,
  lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS e FROM lab),
pairs AS (SELECT u.doc_id, l.doc_id AS nb, u.p AS px, l.p AS pn,
  round(sqrt(greatest(list_sum(list_transform(range(1, len(u.e) + 1), lambda i: (u.e[i] - l.e[i]) * (u.e[i] - l.e[i]))), 0.0)), 9) AS dist
  FROM nu u CROSS JOIN nl l WHERE u.doc_id <> l.doc_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dist, nb) AS r FROM pairs) WHERE r <= {k}),
kl AS (SELECT doc_id, list_sum(list_transform(range(1, len(pn) + 1), lambda i: CASE WHEN pn[i] > 0
  THEN pn[i] * ln(pn[i] / greatest(px[i], {Q.KL_EPS!r})) ELSE 0.0 END)) AS kl FROM knn),
s AS (SELECT doc_id, round(avg(kl), 9) AS score FROM kl GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM s ORDER BY score DESC, doc_id LIMIT 100"""


@query("query_contrastive", _contrastive_sql())
def query_contrastive(spark, sf):
    """QRY-6 / JOIN-7: k=10 nearest labelled neighbours, mean KL, top 100."""
    unl, lab = _split(spark, sf)
    return round_doubles(Q.query_contrastive(unl, lab, fixed.QUERY_SIZE, 10))


@query("nearest_to_centroid", """WITH nv AS (SELECT vec_id AS doc_id, label, list_transform(embedding,
  lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))
  AS e FROM embeddings),
dims AS (SELECT label, i, avg(e[i]) AS c FROM nv, range(1, 65) AS r(i) GROUP BY label, i),
cen AS (SELECT label, list(c ORDER BY i) AS c FROM dims GROUP BY label),
cidx AS (SELECT c, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM cen),
d AS (SELECT nv.doc_id, cidx.cluster, round(sqrt(list_sum(list_transform(range(1, 65),
  lambda i: (cidx.c[i] - nv.e[i]) * (cidx.c[i] - nv.e[i])))), 9) AS dist FROM nv CROSS JOIN cidx),
a AS (SELECT doc_id, arg_min(cluster, (dist, cluster)) AS cluster, min(dist) AS dist FROM d GROUP BY doc_id)
SELECT cluster, arg_min(doc_id, (dist, doc_id)) AS doc_id, round(min(dist), 6) AS dist FROM a GROUP BY cluster""")
def nearest_to_centroid(spark, sf):
    """QRY-5 pick step with given centres: the per-label means of the normalised embeddings."""
    from issuelens.functions.vectors import l2_normalise
    e = tables.pool(spark, sf)
    nv = e.select("doc_id", "label", l2_normalise(F.col("embedding")).alias("e"))
    dims = nv.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c"))
    cen = dims.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("s")).orderBy("label")
    centres = [[float(x["c"]) for x in r["s"]] for r in cen.collect()]  # one centre per label (10 x 64)
    return round_doubles(Q.nearest_to_centroid(e, centres))


@query("query_embedding_kmeans")
def query_embedding_kmeans(spark, sf):
    """QRY-5: Spark ML k-means with k=100 on the unlabelled pool; nearest row per centre."""
    unl, _ = _split(spark, sf)
    return round_doubles(Q.query_embedding_kmeans(unl, fixed.QUERY_SIZE))


def _featured(spark, sf):
    """The labelled documents with their features, made in the tasks of the scan and written once, before any split."""
    path = scratch_table_dir(spark, f"features-{uuid.uuid4().hex}")
    A.text_features(tables.labelled(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@query("active_learning_run")
def active_learning_run(spark, sf):
    """ACT-4: BreakingTies, 100 initial + up to 25 rounds of 100 on the labelled
    documents' training split, macro metrics on the stratified test split."""
    lab = _featured(spark, sf)
    split = S.stratified_split(lab, "label", "doc_id")
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    _, curve = A.active_learning_run(spark, train, test, strategy="BreakingTies")
    return round_doubles(curve)


ALL_STRATEGIES = ("RandomSampling", "LeastConfidence", "BreakingTies", "PredictionEntropy", "ContrastiveActiveLearning",
                  "EmbeddingKMeans")


def _pool_and_test(spark, sf):
    split = S.stratified_split(_featured(spark, sf), "label", "doc_id")
    return tuple(split.filter(F.col("split") == part).drop("split") for part in ("train", "test"))


def _stored(pool, test):
    """What the runs read of pool and test, written once for all of them."""
    return tuple(written(df.select("doc_id", "label", "tf", "embedding"), name) for df, name in ((pool, "pool"), (test, "test")))


@query("active_learning_curves")
def active_learning_curves(spark, sf):
    """ACT-4 / ACT-5 / RES-1: the curves of all six strategies on the text pool."""
    pool, test = _stored(*_pool_and_test(spark, sf))
    runs = A.at_once(spark, [partial(A.active_learning_run, spark, pool, test, strategy=s, stored=True) for s in ALL_STRATEGIES])
    return round_doubles(M.union_curves({s: curve for s, (_, curve) in zip(ALL_STRATEGIES, runs)}))


@query("active_learning_ledger")
def active_learning_ledger(spark, sf):
    """ACT-6: the labelled ledger of a run, in query order, with its texts."""
    pool, test = _pool_and_test(spark, sf)
    ledger, _ = A.active_learning_run(spark, *_stored(pool, test), strategy="EmbeddingKMeans", stored=True)
    return A.labelled_export(ledger, pool)


@query("learning_curve_random")
def learning_curve_random(spark, sf):
    """MDL-5: random-sampling baseline curve (grid 100..2300 by 100, binary metrics)."""
    lab = _featured(spark, sf)
    split = S.random_split(lab, "doc_id")
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    return round_doubles(A.learning_curve_random(spark, train, test))
