"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.session import ensure_checkpoint_dir

HELD_OUT_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on every machine (the operators take any path)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there (lineage ends)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: Column) -> Column:
    """True for the evaluation fold: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS == 0


def training_ids(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """A bounded, reproducible sample ``(doc_id, label)`` of labelled rows outside the held-out fold.

    At most ``per_class`` rows of each label 0 and 1, the smallest by a hash of
    the id; rows with a null id or label are left out, a repeated id counts
    with its largest label. This bound is the only one in the subpackage that
    limits what is read, and it limits labelled rows for fitting only.
    """
    rows = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    parts = [rows.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (bounded by its sample size, so it is broadcast)."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def excerpt(text: Column, limit: int, parts: int = 10) -> Column:
    """A text to fit on: whole up to ``limit`` bytes, else ``parts`` stretches at even places with ``limit`` characters in all."""
    size = limit // parts
    step = (F.length(text) - size) / (parts - 1)
    cut_out = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat_ws("", cut_out))
