"""Lexicon as a table (JOIN-1, TOK-8, TOK-9, TOK-13) and sequence encoding (TOK-15).

The in-row path (``functions.tokens.tag_tokens``) serves bounded literal
lexicons. This module serves a lexicon given as a DataFrame of any size:
tokens are exploded to ``(doc_id, pos, token)`` and joined; the planner sizes the
join (and AQE splits a frequent token's partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions import tokens as K
from issuelens.session import together, written


def lexicon_df(spark: SparkSession, rows=None) -> DataFrame:
    """The lexicon table ``(token, lex_pos, lex_lemma)``; default rows from ``fixed``."""
    rows = rows if rows is not None else fixed.default_lexicon()
    return spark.createDataFrame(rows, "token string, lex_pos string, lex_lemma string")


def explode_tokens(df: DataFrame, text_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, pos int 0-based, token)`` from lower-cased TOK-3 tokens."""
    return df.select(id_col, F.posexplode(K.tokenize_words(F.lower(F.col(text_col)))).alias("pos", "token"))


def lexicon_join(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """JOIN-1: left join; unknown tokens are tagged by rule and are their own lemma."""
    j = tokens.join(lexicon, "token", "left")
    return (j.withColumn("tag", F.coalesce(F.col("lex_pos"), K.rule_pos(F.col("token"))))
             .withColumn("lemma", F.coalesce(F.col("lex_lemma"), F.col("token")))
             .drop("lex_pos", "lex_lemma"))


def filter_pos(tagged: DataFrame, keep) -> DataFrame:
    """TOK-8 on the relational form."""
    return tagged.filter(F.col("tag").isin(list(keep)))


def tag_tokens_table(df: DataFrame, tokens_col: str, lexicon: DataFrame, out: str = "tagged") -> DataFrame:
    """TOK-8/TOK-9 against a lexicon table: adds ``array<struct<tok,pos,lemma>>`` like ``functions.tokens.tag_tokens``.

    Tokens are joined with their places and come back as one array per row, as
    long as the row's own tokens. Rows are dealt out once, whole and only with
    the columns in use; a token carries its row's name, and the other columns go
    with the first token. Where the planner broadcasts the lexicon (it is
    written first, so that its size is known) the tokens of a row are joined and
    regrouped in the task that has the row. A row's name is a hash of its
    content and a number among rows of that hash, so it is the same after a lost
    task, but for rows that repeat each other.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = together(df.withColumn("_row", F.xxhash64(*hashed)), "_row")
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_row").orderBy("_row")))
    rest = {f"_c{i}": c for i, c in enumerate(df.columns)}
    toks = rows.select("_row", "_copy", F.posexplode_outer(tokens_col).alias("_at", "token"), *[F.col(c).alias(a) for a, c in rest.items()])
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    toks = toks.withColumns({a: F.when(first, F.col(a)) for a in rest})
    one = F.struct("_at", F.col("token").alias("tok"), F.coalesce("lex_pos", K.rule_pos(F.col("token"))).alias("pos"),
                   F.coalesce("lex_lemma", "token").alias("lemma"))
    found = toks.join(written(lexicon, "lexicon"), "token", "left").groupBy("_row", "_copy").agg(
        F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), one))).alias("_found"),
        *[F.first(a, ignorenulls=True).alias(a) for a in rest])
    tagged = F.transform("_found", lambda x: F.struct(x["tok"], x["pos"], x["lemma"]))
    return found.select(*[F.col(a).alias(c) for a, c in rest.items() if c != out], tagged.alias(out))


def penn_tag(tag: Column) -> Column:
    m = F.create_map(*[x for k, v in fixed.PENN_OF_POS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, tag), F.lit("NN"))


def dedupe_by_lemma(tagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """TOK-13: one row per lemma with its first position and the last word seen.

    Partial aggregation (``min``/``min_by``/``max_by``) runs map-side, so a
    frequent lemma does not concentrate rows in one task.
    """
    order = F.struct(F.col(id_col), F.col("pos"))
    return tagged.groupBy("lemma").agg(
        F.min(id_col).alias("first_doc"),
        F.min_by("pos", order).alias("first_pos"),
        F.max_by("token", order).alias("last_word"),
        F.count(F.lit(1)).alias("n"))


def build_vocabulary(tokens: DataFrame, vocab_size: int) -> DataFrame:
    """``(tok, id)``: the ``vocab_size`` most frequent tokens, ids from 2 (0 pad, 1 unknown).

    The count is a partial aggregate; the cap is a top-k (TakeOrderedAndProject),
    so the single-partition ``row_number`` only ever sees ``vocab_size`` rows.
    """
    counts = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("cnt"))
    top = counts.orderBy(F.desc("cnt"), F.asc("tok")).limit(vocab_size)
    w = Window.orderBy(F.desc("cnt"), F.asc("tok"))
    return top.select("tok", (F.row_number().over(w) + 1).cast("int").alias("id"))


def encode_sequences(df: DataFrame, tokens_col: str, vocab_size: int = 30000, max_length: int = 512,
                     id_col: str = "doc_id") -> DataFrame:
    """TOK-15: ``input_ids`` and ``attention_mask`` of fixed length ``max_length``.

    Tokens past ``max_length`` are cut before the join, so the per-document
    regroup holds at most ``max_length`` rows per key. Documents' tokens are
    dealt out by id before they are exploded, so the regroup shuffles nothing.
    """
    toks = df.select(id_col, F.posexplode(F.col(tokens_col)).alias("pos", "tok"))
    vocab = build_vocabulary(toks, vocab_size)
    firsts = together(df.select(id_col, F.slice(F.col(tokens_col), 1, max_length).alias("_firsts")), id_col)
    ids = (firsts.select(id_col, F.posexplode("_firsts").alias("pos", "tok"))
           .join(F.broadcast(vocab), "tok", "left")
           .select(id_col, "pos", F.coalesce(F.col("id"), F.lit(1)).alias("id")))
    seqs = ids.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
    out = df.select(id_col).join(seqs, id_col, "left")
    real = F.coalesce(F.transform(F.col("s"), lambda x: x["id"]), F.array().cast("array<int>"))
    return out.select(
        id_col,
        F.concat(real, F.array_repeat(F.lit(0), F.lit(max_length) - F.size(real))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(real)),
                 F.array_repeat(F.lit(0), F.lit(max_length) - F.size(real))).alias("attention_mask"))
