"""Keyword extraction and ranking (KEY-*, FLT-5).

* ``tfidf_top_terms`` (KEY-1): corpus gram counts are a partial aggregate; the
  vocabulary cap is a top-k whose result (``max_features`` rows) is the only
  broadcast; only occurrences of vocabulary grams are shuffled per document.
* ``mmr_keywords`` (KEY-6/7): greedy maximal-marginal-relevance is sequential
  inside one document and independent across documents. A document is one
  row, so the greedy runs in ``mapInArrow`` over batches with no shuffle; its cost is O(top_n x candidates) per document.
* ``fuzzy_exclude`` (KEY-9): the indel ratio needs the LCS length. Against a
  small literal keyword set it is computed in-row with the bit-parallel LCS
  recurrence (64-bit masks, one pass over the term's characters).
* ``expand_keywords`` (KEY-12): a driver loop over a state of at most
  ``seeds + rounds x new`` keywords; the documents' candidates are written out
  once and every round selects from them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions import tokens as K
from issuelens.functions.vectors import KeywordSet
from issuelens.operators import mmr
from issuelens.session import ensure_checkpoint_dir, scratch_table_dir

TFIDF_TOKEN = r"[\p{L}\p{N}_]{2,}"


# -- KEY-1 -------------------------------------------------------------------------

def tfidf_top_terms(docs: DataFrame, text_col: str = "preprocessed", id_col: str = "doc_id", *,
                    n: int = 3, max_features: int = fixed.MAX_FEATURES, top_n: int = fixed.TOP_N_TERMS,
                    stopwords: Iterable[str] = fixed.ENGLISH_STOPWORDS, n_docs: int | None = None) -> DataFrame:
    """Mean TF-IDF of each n-gram over all documents; the ``top_n`` best.

    tokens = runs of >= 2 word characters; stop words out before n-grams; the
    ``max_features`` grams with the largest corpus count (ties: gram) form the
    vocabulary; ``idf = ln((1+N)/(1+df)) + 1``; each document's vector is
    L2-normalised over the vocabulary; the mean runs over all ``N`` documents
    (documents without a vocabulary gram count as zeros).
    """
    toks = K.remove_stopwords(F.regexp_extract_all(F.col(text_col), F.lit(TFIDF_TOKEN), 0), list(stopwords))
    # Cleaning and tokenising cost most and the tokens are read three times (N, corpus counts, tf): they are written
    # to the checkpoint folder once. The n-grams, several times as large, are made from them on the fly.
    ensure_checkpoint_dir(docs.sparkSession)
    tokens = docs.select(id_col, toks.alias("_t")).checkpoint()
    return _tfidf_from_grams(tokens.select(id_col, K.ngrams(F.col("_t"), n).alias("_g")), id_col, max_features, top_n, n_docs)


def _tfidf_from_grams(grams: DataFrame, id_col: str, max_features: int, top_n: int,
                      n_docs: int | None) -> DataFrame:
    occ = grams.select(id_col, F.explode("_g").alias("gram"))
    big_n = n_docs if n_docs is not None else grams.count()
    corpus = occ.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    vocab = corpus.orderBy(F.desc("c"), F.asc("gram")).limit(max_features).select("gram")
    tf = occ.join(F.broadcast(vocab), "gram", "left_semi").groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(1.0) + big_n) / (F.lit(1.0) + F.col("df"))) + 1.0
    w = tf.join(F.broadcast(dfreq), "gram").withColumn("w", F.col("tf") * idf)
    norms = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = (w.join(norms, id_col).groupBy("gram")
              .agg((F.sum(F.col("w") / F.col("norm")) / F.lit(float(big_n))).alias("score")))
    top = rank_top(scored, "score", "gram", top_n)
    return grams.sparkSession.createDataFrame(top.collect(), top.schema)


def rank_top(df: DataFrame, score_col: str, key_col: str, k: int) -> DataFrame:
    """KEY-13 / TOP-1: the k best rows by (rounded score desc, key asc) with a 1-based rank.

    ``orderBy().limit()`` plans as a distributed top-k; the window then only
    sees those k rows.
    """
    from pyspark.sql import Window
    top = df.withColumn("_s", F.round(F.col(score_col), 9)).orderBy(F.desc("_s"), F.asc(key_col)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_s"), F.asc(key_col)))).drop("_s")


# -- KEY-2, FLT-5 ---------------------------------------------------------------------

def candidate_phrases(docs: DataFrame, tokens_col: str, id_col: str = "doc_id", *, n: int = 1,
                      stopwords: Iterable[str] = ()) -> DataFrame:
    """KEY-2: distinct n-grams per document with their first position."""
    stop = list(stopwords)
    toks = K.remove_stopwords(F.col(tokens_col), stop) if stop else F.col(tokens_col)
    grams = F.array_distinct(K.ngrams(toks, n))
    return docs.select(id_col, F.posexplode(grams).alias("first_pos", "phrase"))


def drop_banned_grams(phrases: DataFrame, banned: Iterable[str], phrase_col: str = "phrase") -> DataFrame:
    """FLT-5: drop a phrase if any of its words is banned."""
    b = F.array(*[F.lit(x) for x in sorted(set(banned))])
    return phrases.filter(~F.arrays_overlap(F.split(F.lower(F.col(phrase_col)), " "), b))


# -- KEY-9 ---------------------------------------------------------------------------------

#: Characters that the 64-bit recurrence holds; a longer keyword goes through the plain table.
WORD_BITS = 62


def _lcs_len(term: Column, keyword: str) -> Column:
    """Length of the longest common subsequence of ``term`` and a literal keyword.

    Bit-parallel recurrence over the characters of ``term``:
    ``U = V & M[c]; V = ((V + U) | (V - U)) & mask``, starting from all ones;
    the LCS length is the number of zero bits among the keyword's ``m`` bits.
    A keyword of more than ``WORD_BITS`` characters uses the table of the
    recurrence itself, one row at a time.
    """
    m = len(keyword)
    if m == 0:
        return F.lit(0)
    if m > WORD_BITS:
        return _lcs_table(term, keyword)
    masks: dict[str, int] = {}
    for i, ch in enumerate(keyword):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << m) - 1
    pm = F.create_map(*[x for ch, mk in masks.items() for x in (F.lit(ch), F.lit(mk).cast("long"))])
    chars = F.filter(F.split(term, ""), lambda c: c != "")
    v = F.aggregate(chars, F.lit(full).cast("long"), lambda acc, c: _lcs_step(
        acc, F.coalesce(F.element_at(pm, c), F.lit(0).cast("long")), full))
    return F.lit(m) - F.bit_count(v)


def _lcs_table(term: Column, keyword: str) -> Column:
    """LCS length by rows of the dynamic-programming table, one per character of ``term``.

    ``row[j]`` is the LCS length with the first j keyword characters. The new
    row is the running maximum of ``row[j]`` and, where character j matches,
    ``row[j - 1] + 1``.
    """
    letters = F.from_json(F.lit(json.dumps(list(keyword))), "array<string>")
    m = len(keyword)

    def step(row, c):
        prev = F.concat(F.array(F.lit(0)), F.slice(row, 1, m - 1))
        took = F.zip_with(F.zip_with(letters, prev, lambda k, p: F.when(k == c, p + 1).otherwise(F.lit(0))), row,
                          lambda a, b: F.greatest(a, b))
        return F.aggregate(took, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.greatest(
            x, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))))

    chars = F.filter(F.split(term, ""), lambda c: c != "")
    return F.element_at(F.aggregate(chars, F.array_repeat(F.lit(0), m), step), m)


def _lcs_step(v: Column, match: Column, full: int) -> Column:
    u = v.bitwiseAND(match)
    return ((v + u).bitwiseOR(v - u)).bitwiseAND(F.lit(full).cast("long"))


def fuzzy_match(term: Column, keyword: str, cutoff: int = fixed.FUZZ_CUTOFF) -> Column:
    """``round(100 * 2 * LCS / (la + lb)) > cutoff``, decided in integers.

    ``round(x) > c`` holds exactly when ``x >= c + 0.5`` (both half-up and
    half-even rounding agree there), i.e. ``200 * LCS >= (c + 0.5) * (la + lb)``.
    A cheap length bound skips the LCS when it cannot pass.
    """
    la = F.length(term)
    lb = len(keyword)
    total = la + F.lit(lb)
    bound = 200 * F.least(la, F.lit(lb)) * 2 >= (2 * cutoff + 1) * total
    lcs = _lcs_len(term, keyword)
    return F.when(total == 0, F.lit(False)).when(~bound, F.lit(False)).otherwise(
        400 * lcs >= (2 * cutoff + 1) * total)


def fuzzy_any(term: Column, keywords: Sequence[str], cutoff: int = fixed.FUZZ_CUTOFF) -> Column:
    """True when ``term`` is fuzzy-similar to any keyword."""
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | fuzzy_match(term, kw, cutoff)
    return cond


def fuzzy_exclude(cands: DataFrame, keywords: Sequence[str], term_col: str = "phrase",
                  cutoff: int = fixed.FUZZ_CUTOFF) -> DataFrame:
    """KEY-9 / JOIN-4: the left-anti theta join, as an in-row predicate against a literal set.

    For a keyword table use ``fuzzy.fuzzy_anti_join``.
    """
    return cands.filter(~fuzzy_any(F.col(term_col), list(keywords), cutoff))


def py_fuzz_ratio(a: str, b: str) -> int:
    """Reference of the indel ratio (tests)."""
    if not a and not b:
        return 0
    la, lb = len(a), len(b)
    prev = [0] * (lb + 1)
    for i in range(la):
        cur = [0] * (lb + 1)
        for j in range(lb):
            cur[j + 1] = prev[j] + 1 if a[i] == b[j] else max(prev[j + 1], cur[j])
        prev = cur
    return int(round(100 * 2 * prev[lb] / (la + lb)))


# -- KEY-10, KEY-11 ---------------------------------------------------------------------------

def score_candidates(terms: DataFrame, known: Sequence[str], term_col: str = "phrase") -> DataFrame:
    """KEY-10: ``(mean cos + max cos) / 2`` of each distinct term to the known keywords."""
    kws = KeywordSet({"known": list(known)})
    d = terms.select(term_col).distinct()
    st = F.struct(F.col(term_col).alias(term_col), kws.group_stats(kws.sims(F.col(term_col)), "known").alias("st"))
    return d.select(F.inline(F.array(st))).select(term_col, ((F.col("st.avg") + F.col("st.max")) / 2).alias("score"))


def pick_new_seeds(scored: DataFrame, known: Sequence[str], k: int = fixed.NEW_SEEDS,
                   term_col: str = "phrase", distinct: bool = True) -> DataFrame:
    """KEY-11: the ``k`` best terms, by (rounded score desc, term).

    ``distinct`` leaves out the known ones and repeats; without it they compete
    like any other row, so a term may be picked again.
    """
    fresh = scored.filter(~F.col(term_col).isin(list(known))).dropDuplicates([term_col]) if distinct else scored
    return rank_top(fresh, "score", term_col, k)


# -- KEY-5, KEY-6, KEY-7 ---------------------------------------------------------------------------

def doc_vectors(docs: DataFrame, tokens_col: str, id_col: str = "doc_id") -> DataFrame:
    """KEY-5 as a relation: ``(doc_id, gram, weight)``, the mean of the unit trigram vectors of a document's tokens.

    The token lists are brought together by id, each as one row, and a document
    becomes its vector in the task that has it: neither words nor trigrams are
    shuffled, and a task holds one batch of documents. Rows that share an id are
    added up (over the token count of the first).
    """
    src, key = _with_tokens(docs, tokens_col, id_col)
    together = src.where(F.size("tokens") > 0).repartition("doc_id").sortWithinPartitions("doc_id")
    out = together.mapInArrow(mmr.vectors, key + "gram string, weight double")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def mmr_select(tokens: list[str], n: int, top_n: int, diversity: float,
               seeds: Sequence[str] = (), cache: dict | None = None) -> list[tuple[int, str, float]]:
    """Greedy MMR for one document; returns ``(rank, phrase, relevance)``.

    Candidates are the distinct n-grams in first-position order; a phrase
    vector is the mean of its word vectors; the document vector is the mean
    over all n-gram occurrences (KEY-5), pulled towards the seeds as
    ``(3 * doc + mean(seeds)) / 4`` when seeds are given (KEY-7). Ties go to
    the earlier candidate.

    """
    found = mmr.candidates(tokens, n)
    if found is None:
        return []
    chosen, relevance = mmr.select(found, top_n, diversity, mmr.Seeds(seeds) if seeds else None)
    return [(r + 1, found.phrases[i], float(relevance[i])) for r, i in enumerate(chosen)]


def _with_tokens(docs: DataFrame, tokens_col: str, id_col: str) -> tuple[DataFrame, str]:
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens"))
    return src, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, "


def mmr_keywords(docs: DataFrame, tokens_col: str, id_col: str = "doc_id", *, n: int = 1,
                 top_n: int = fixed.TOP_N_SEED, diversity: float = fixed.DIVERSITY,
                 seeds: Sequence[str] = ()) -> DataFrame:
    """KEY-6 (and KEY-7 with ``seeds``): per-document MMR keyword selection.

    ``mapInArrow`` over ``(doc_id, tokens)`` rows: no shuffle, the unit of work
    is one document.
    """
    src, key = _with_tokens(docs, tokens_col, id_col)
    out = src.mapInArrow(mmr.picked(top_n, diversity, list(seeds), n), key + "rank int, phrase string, relevance double")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def candidate_state(docs: DataFrame, tokens_col: str, n: int = 1, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n, phrases, counts)``: what MMR needs of each document, whatever the seeds.

    Written as Parquet to the checkpoint folder; the tokens are read once.
    """
    src, key = _with_tokens(docs, tokens_col, id_col)
    spark, path = docs.sparkSession, scratch_table_dir(docs.sparkSession, f"candidates-{uuid.uuid4().hex}")
    src.mapInArrow(mmr.stored(n), key + mmr.STATE).write.parquet(path)
    return spark.read.parquet(path)


def mmr_of_state(state: DataFrame, *, top_n: int = fixed.TOP_N_SEED, diversity: float = fixed.DIVERSITY,
                 seeds: Sequence[str] = ()) -> DataFrame:
    """KEY-6 / KEY-7 from a ``candidate_state``: the rows of ``mmr_keywords``."""
    key = f"doc_id {state.schema['doc_id'].dataType.simpleString()}, "
    return state.mapInArrow(mmr.picked(top_n, diversity, list(seeds), None), key + "rank int, phrase string, relevance double")


def corpus_keyword_counts(keywords: DataFrame, k: int = fixed.TOP_N_TERMS, phrase_col: str = "phrase") -> DataFrame:
    """KEY-8 / AGG-1: how many documents chose each keyword; the ``k`` most common."""
    counts = keywords.groupBy(F.lower(F.col(phrase_col)).alias(phrase_col)).agg(F.count(F.lit(1)).alias("count"))
    return rank_top(counts, "count", phrase_col, k)


# -- KEY-12 -----------------------------------------------------------------------------------

def _distinct_phrases(cands: DataFrame) -> DataFrame:
    """The distinct phrases; they depend on an aggregate's result, so that no filter on them moves below it to every document's candidates."""
    counted = cands.groupBy("phrase").agg(F.count(F.lit(1)).alias("_n"))
    return counted.select(F.when(F.col("_n") > 0, F.col("phrase")).alias("phrase"))


def _expansion_picks(cands: DataFrame, known: Sequence[str], new: int) -> DataFrame:
    kept = fuzzy_exclude(_distinct_phrases(cands), known, "phrase")
    return pick_new_seeds(score_candidates(kept, known, "phrase"), known, new, "phrase")


def expansion_round(tokens: DataFrame, known: Sequence[str], *, tokens_col: str = "tokens",
                    top_n: int = fixed.TOP_N_SEED, diversity: float = fixed.DIVERSITY,
                    new: int = fixed.NEW_SEEDS) -> DataFrame:
    """One round of KEY-12: seed-guided MMR -> fuzzy exclusion -> score -> pick."""
    return _expansion_picks(mmr_keywords(tokens, tokens_col, n=1, top_n=top_n, diversity=diversity, seeds=known), known, new)


def expand_keywords(tokens: DataFrame, seeds: Sequence[str] = fixed.SEED_KEYWORDS, *,
                    rounds: int = fixed.EXPANSION_ROUNDS, tokens_col: str = "tokens",
                    top_n: int = fixed.TOP_N_SEED, diversity: float = fixed.DIVERSITY,
                    new: int = fixed.NEW_SEEDS) -> list[tuple[str, float, int, int]]:
    """KEY-12: grow the keyword set for ``rounds`` rounds.

    Returns ``(keyword, score, round, rank)`` for the added keywords, sorted by
    score desc, then round, then rank. Only the (at most ``new``) picks of a
    round reach the driver. The tokens are read once, into the documents'
    ``candidate_state``; a round reads that and moves the relevance by the
    known words.
    """
    state = candidate_state(tokens, tokens_col)
    known = list(seeds)
    added: list[tuple[str, float, int, int]] = []
    for r in range(rounds):
        picks = _expansion_picks(mmr_of_state(state, top_n=top_n, diversity=diversity, seeds=known), known, new).collect()
        for row in picks:
            added.append((row["phrase"], float(row["score"]), r + 1, int(row["rank"])))
            known.append(row["phrase"])
    return sorted(added, key=lambda t: (-round(t[1], 9), t[2], t[3]))
