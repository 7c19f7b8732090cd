"""The registered queries of the training-data operators, each over its whole table.

Every query applies its operator with production parameters and derives the
digest columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import (chat, compression, decontam, langid, licenses, negatives, ngram_join, packing, quality_rules, resampling,
                           sharding, suffix_dedup, toxicity)
from issuelens.llm.common import held_out, table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.suffix_dedup(docs).select(
        "doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans").cast("long").alias("n_spans"),
        F.sha2("dedup.kept", 256).alias("kept_sha256"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
            .select("doc_id", F.col("rules.n_words").alias("n_words"), "rules.word_chars", "rules.n_symbols",
                    "rules.n_dup_lines", "rules.n_repeat_words", "rules.base_failed", "rules.kept",
                    "rules.content_share"))


@query
def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression.fit(docs, table(spark, sf_dir, "labels"))
    return compression.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def mask_text(mask: str) -> Column:
    """A mask as text: ``length:train`` of each turn."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["length"].cast("string"), F.lit(":"),
                                                             m["train"].cast("int").cast("string"))), ",")


@query
def op6_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_preferences(chat.preference_pairs(table(spark, sf_dir, "conversations")))
    return pairs.withColumns({c: mask_text(c) for c in ("chosen_mask", "rejected_mask")})


SQL["op6_preference_chat"] = chat.format_sql()


@query
def op7_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "hits")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


SQL["op8_license_scan"] = licenses.scan_sql()


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op11_importance_resampling"] = resampling.resample_sql()


@query
def op12_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


SQL["op12_stratified_sharding"] = sharding.shard_sql()


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


SQL["op13_hard_negatives"] = negatives.hard_negatives_sql()
