"""Active-learning query strategies (QRY-*).

Signature: ``(unlabelled[, labelled], n) -> (doc_id, rank, score)``. Class
probabilities are ``p array<double>``. Scores that decide an order are rounded
to 9 decimals; ties go to the smaller id. Selection of ``n`` rows is a
distributed top-k (``orderBy().limit()``), never a global sort.
"""

from __future__ import annotations

import json

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions.vectors import bind, l2_normalise
from issuelens.operators.knn import PIVOTS, k_nearest
from issuelens.operators.sampling import sample_n

KL_EPS = 1e-12


def _top(df: DataFrame, score: Column, n: int, ascending: bool, id_col: str) -> DataFrame:
    s = F.round(score, 9)
    order = [s.asc() if ascending else s.desc(), F.col(id_col).asc()]
    top = df.select(id_col, s.alias("score")).orderBy(*order).limit(n)
    w = Window.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), F.col(id_col).asc())
    return top.withColumn("rank", F.row_number().over(w))


def least_confidence_score(p: Column) -> Column:
    return F.array_max(p)


def breaking_ties_score(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return F.element_at(s, 1) - F.coalesce(F.element_at(s, 2), F.lit(0.0))


def entropy_score(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.log(x)).otherwise(0.0))


def query_random(unlabelled: DataFrame, n: int, id_col: str = "doc_id", seed: int = fixed.SEED) -> DataFrame:
    """QRY-1."""
    s = sample_n(unlabelled.select(id_col), n, id_col, seed)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return s.withColumn("score", F.lit(None).cast("double")).withColumn(
        "rank", F.row_number().over(Window.orderBy(key, F.col(id_col))))


def query_least_confidence(unlabelled: DataFrame, n: int, id_col: str = "doc_id", p_col: str = "p") -> DataFrame:
    """QRY-2: smallest max(p)."""
    return _top(unlabelled, least_confidence_score(F.col(p_col)), n, True, id_col)


def query_breaking_ties(unlabelled: DataFrame, n: int, id_col: str = "doc_id", p_col: str = "p") -> DataFrame:
    """QRY-3: smallest margin between the two largest probabilities."""
    return _top(unlabelled, breaking_ties_score(F.col(p_col)), n, True, id_col)


def query_entropy(unlabelled: DataFrame, n: int, id_col: str = "doc_id", p_col: str = "p") -> DataFrame:
    """QRY-4: largest ``-sum p ln p`` (``0 ln 0 = 0``)."""
    return _top(unlabelled, entropy_score(F.col(p_col)), n, False, id_col)


def contrastive_scores(unlabelled: DataFrame, neighbours: DataFrame, k: int = 10, id_col: str = "doc_id",
                       emb_col: str = "embedding", p_col: str = "p", whole: int = PIVOTS) -> DataFrame:
    """JOIN-7 + KL: mean ``KL(p_neighbour || p_row)`` over the k nearest neighbours (0 without any)."""
    near = k_nearest(unlabelled, neighbours, k, id_col, emb_col, p_col, whole)

    def divergence(q: Column, p: Column) -> Column:
        return F.aggregate(F.zip_with(q, p, lambda a, b: F.when(a > 0, a * F.log(a / F.greatest(b, F.lit(KL_EPS))))
                                      .otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)

    total = F.aggregate("near", F.lit(0.0), lambda s, n: s + divergence(n["q"], F.col(p_col)))
    return near.select(id_col, F.when(F.size("near") > 0, total / F.size("near")).otherwise(0.0).alias("score"))


def query_contrastive(unlabelled: DataFrame, neighbours: DataFrame, n: int, k: int = 10,
                      id_col: str = "doc_id", emb_col: str = "embedding", p_col: str = "p", whole: int = PIVOTS) -> DataFrame:
    """QRY-6: the ``n`` rows with the largest mean KL to their neighbours."""
    s = contrastive_scores(unlabelled, neighbours, k, id_col, emb_col, p_col, whole)
    return _top(s, F.col("score"), n, False, id_col)


def kmeans_fit(df: DataFrame, k: int, emb_col: str = "embedding", seed: int = fixed.SEED):
    """QRY-5 (fit): k-means on L2-normalised embeddings (Spark ML, distributed)."""
    feats = df.withColumn("features", array_to_vector(l2_normalise(F.col(emb_col))))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(feats)


def nearest_to_centroid(df: DataFrame, centres: list[list[float]], id_col: str = "doc_id",
                        emb_col: str = "embedding", cluster_col: str | None = None) -> DataFrame:
    """QRY-5 (pick): per centre, the row nearest to it (distance asc, id asc).

    The centres are one literal. A row that knows its cluster is measured to that
    centre alone, another one to all. ``min_by`` per cluster is a partial
    aggregate, so a big cluster is never gathered in one task.
    """
    cs = F.from_json(F.lit(json.dumps([list(map(float, c)) for c in centres])), "array<array<double>>")

    def distance(x: Column, c: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(c, x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))

    unit = l2_normalise(F.col(emb_col))
    if cluster_col is None:
        best = bind(unit, lambda x: F.array_min(F.transform(cs, lambda c, i: F.struct(
            F.round(distance(x, c), 9).alias("d"), i.alias("c")))))
        d = df.select(id_col, best.alias("_b")).select(id_col, F.col("_b.c").alias("cluster"), F.col("_b.d").alias("dist"))
    else:
        own = bind(F.struct(unit.alias("x"), F.element_at(cs, F.col(cluster_col) + 1).alias("c")),
                   lambda s: distance(s["x"], s["c"]))
        d = df.select(id_col, F.col(cluster_col).alias("cluster"), F.round(own, 9).alias("dist"))
    pick = F.min_by(F.struct(F.col(id_col), F.col("dist")), F.struct(F.col("dist"), F.col(id_col)))
    return d.groupBy("cluster").agg(pick.alias("b")).select(
        "cluster", F.col("b." + id_col).alias(id_col), F.col("b.dist").alias("dist"))


def query_embedding_kmeans(unlabelled: DataFrame, n: int, id_col: str = "doc_id", emb_col: str = "embedding",
                           seed: int = fixed.SEED) -> DataFrame:
    """QRY-5: n clusters; the row nearest each centre; top up at random if short.

    With at most ``n`` different vectors each of them is a cluster of its own,
    so its smallest id is taken without a fit; a pool of at most ``n`` rows is
    taken whole.
    """
    unit = unlabelled.select(id_col, l2_normalise(F.col(emb_col)).alias("e"))
    kinds = unit.groupBy("e").agg(F.min(id_col).alias(id_col))
    # the first rows mostly settle it: more different hashes than n are more different vectors
    if unit.limit(4 * n).select(F.xxhash64("e")).distinct().count() <= n and kinds.limit(n + 1).count() <= n:
        chosen = kinds.select(id_col, F.lit(0.0).alias("score"))
        taken = chosen.count()
    else:
        model = kmeans_fit(unlabelled, n, emb_col, seed)
        centres = [list(c) for c in model.clusterCenters()]
        assigned = model.transform(unlabelled.withColumn("features", array_to_vector(l2_normalise(F.col(emb_col)))))
        picks = nearest_to_centroid(assigned, centres, id_col, emb_col, cluster_col="cluster")
        chosen = picks.select(id_col, F.col("dist").alias("score"))
        found, form = chosen.toArrow(), chosen.schema  # a row a centre
        chosen, taken = unlabelled.sparkSession.createDataFrame(found, form), found.num_rows
    short = n - taken
    if short > 0:
        rest = unlabelled.select(id_col).join(chosen.select(id_col), id_col, "left_anti")
        chosen = chosen.unionByName(sample_n(rest, short, id_col, seed).withColumn("score", F.lit(None).cast("double")))
    w = Window.orderBy(F.col("score").asc_nulls_last(), F.col(id_col))
    return chosen.withColumn("rank", F.row_number().over(w))


STRATEGIES = {
    "RandomSampling": query_random,
    "LeastConfidence": query_least_confidence,
    "BreakingTies": query_breaking_ties,
    "PredictionEntropy": query_entropy,
}
