"""Views of the driver's parquet tables in the engine's schemas.

Each function reads only the columns it needs, so the parquet scan prunes the
rest (``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def issues_from_documents(docs: DataFrame) -> DataFrame:
    """issues ``(doc_id, Key, project, Summary, Description)``.

    ``Key = 'DOC-' || doc_id``, ``project = source``, ``Summary`` = first line
    of ``text``, ``Description`` = the rest (null when there is no newline).
    """
    parts = F.split(F.col("text"), "\n", 2)
    return docs.select(
        "doc_id",
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("Key"),
        F.col("source").alias("project"),
        F.get(parts, 0).alias("Summary"),
        F.get(parts, 1).alias("Description"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues_from_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus ``(doc_id, text, lang)``."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled ``(doc_id, Key, text, label)``: documents joined with labels, label = quality.

    ``labels`` is keyed by ``doc_id`` and both sides are read by column; the
    join is an ordinary equi-join the planner sizes (broadcast when small).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return (docs.join(lab, "doc_id")
            .select("doc_id", F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("Key"),
                    "text", "label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label, prediction)``: label = quality, prediction = 1 - toxic."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label"), (F.lit(1) - F.col("toxic")).alias("prediction"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pool ``(doc_id, embedding array<double>, label)`` from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def class_scores(emb: DataFrame, n_classes: int = 2, col: str = "embedding") -> DataFrame:
    """Deterministic class probabilities: softmax over the first ``n_classes``
    dimensions scaled by 10, rounded to 9 decimals. Same formula in the oracle."""
    logits = [F.element_at(F.col(col), i + 1) * 10.0 for i in range(n_classes)]
    mx = F.greatest(*logits) if n_classes > 1 else logits[0]
    exps = [F.exp(l - mx) for l in logits]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return emb.withColumn("p", F.array(*[F.round(e / total, 9) for e in exps]))
