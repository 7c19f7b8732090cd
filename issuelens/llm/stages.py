"""The stages of the corpus pipeline, in order. Each takes ``(spark, docs, sf_dir)``.

A table without rows goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import decontam, ngram_join, packing, quality_rules, suffix_dedup
from issuelens.llm.common import cut, free, table, tokenizer_path

#: Words of a passage that the documents may hold once only.
PASSAGE_WORDS = 50


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs, table(spark, sf_dir, "labels")).where("rules.kept").select(docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id (null last), then the smallest hash of id and text.

    Groups are of texts, whatever their ids: unlike texts with one id all stay,
    and rows without an id take part. Rows without words are in no group.
    """
    row = free("row", docs.columns)
    named = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = ngram_join.near_groups(named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), "text"))
    groups = found.where("root is not null").groupBy("root", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "copies")).alias("first")
    keep = cut(groups.groupBy("root").agg(first).select(F.col("first.row").alias(row), "first.copies"))
    kept = named.join(keep.where("copies = 1").select(row), row, "left_semi")
    once = named.join(keep.where("copies > 1").select(row), row, "left_semi").dropDuplicates([row])  # rows equal in id and text
    wordless = named.where(~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    return kept.unionByName(once).unionByName(wordless).select(docs.columns)


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches of ``PASSAGE_WORDS`` words or more that are found twice; a text that is all repeated becomes empty."""
    out = suffix_dedup.suffix_dedup(docs, PASSAGE_WORDS, "word").withColumn("text", F.col("dedup.kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in the packed sequences."""
    return packing.pack(packing.tokenize(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality_rules", stage_quality), ("ngram_jaccard_join", stage_near_duplicates),
          ("suffix_array_dedup", stage_suffix_dedup), ("benchmark_decontamination", stage_decontamination),
          ("best_fit_packing", stage_packing)]
