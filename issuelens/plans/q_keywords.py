"""Registered queries: keyword extraction and labelling variants (KEY-*, LBL-1/4/5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions import tokens as K
from issuelens.functions.vectors import KeywordSet, dense_cosine
from issuelens.operators import fuzzy as FZ
from issuelens.operators import keywords as KW
from issuelens.operators import labelling as L
from issuelens.plans import chains as C
from issuelens.plans import oracle as O
from issuelens.plans.catalog import query, round_doubles
from issuelens.plans.q_text import _lex_join_sql, ngram_rows_sql, tfidf_tokens_sql
from issuelens.sources import tables

_TFIDF_STOP = sorted(set(fixed.ENGLISH_STOPWORDS))


@query("tfidf_top_terms", f"""WITH {tfidf_tokens_sql()},
pre AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS t FROM tt GROUP BY doc_id),
nd AS (SELECT count(*) AS big_n FROM pre),
toks AS (SELECT doc_id, list_filter(regexp_extract_all(t, {O.lit(KW.TFIDF_TOKEN)}),
  lambda x: x NOT IN {O.str_list(_TFIDF_STOP)}) AS a FROM pre),
occ AS (SELECT doc_id, gram FROM ({ngram_rows_sql('toks', 3)})),
vocab AS (SELECT gram FROM occ GROUP BY gram ORDER BY count(*) DESC, gram LIMIT {fixed.MAX_FEATURES}),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM occ WHERE gram IN (SELECT gram FROM vocab) GROUP BY doc_id, gram),
dfq AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
w AS (SELECT tf.doc_id, tf.gram, tf.tf * (ln((1.0 + nd.big_n) / (1.0 + dfq.df)) + 1.0) AS w
  FROM tf JOIN dfq USING (gram) CROSS JOIN nd),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
sc AS (SELECT w.gram, sum(w.w / nrm.norm) / max(nd.big_n) AS score FROM w JOIN nrm USING (doc_id) CROSS JOIN nd
  GROUP BY w.gram)
SELECT gram, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, gram) AS INTEGER) AS rank
FROM sc ORDER BY round(score, 9) DESC, gram LIMIT {fixed.TOP_N_TERMS}""")
def tfidf_top_terms(spark, sf):
    """KEY-1 on the TF-IDF chain (language gate from ``documents.lang``)."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text", "lang")
    pre = d.select("doc_id", K.rejoin_tokens(C.tfidf_tokens(F.col("text"), F.col("lang") == "en")).alias("preprocessed"))
    pre = pre.filter(F.col("preprocessed") != "")
    return round_doubles(KW.tfidf_top_terms(pre, "preprocessed"))


def _keybert_ctes() -> str:
    """``kb(doc_id, i, lemma)``: the MMR chain tokens, 1-based ``i`` after stop-word removal."""
    return f"""t0 AS (SELECT d.doc_id, u.tok, u.pos FROM documents d,
  unnest({O.tokenize("lower(coalesce(d.text, 'nan'))")}) WITH ORDINALITY AS u(tok, pos)),
k0 AS (SELECT t0.doc_id, t0.pos, coalesce(x.llemma, t0.tok) AS lemma FROM t0 {_lex_join_sql('t0.tok')}
  WHERE strpos({O.lit(fixed.PUNCT)}, t0.tok) = 0),
kb AS (SELECT doc_id, lemma, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM k0
  WHERE lower(lemma) NOT IN {O.str_list(C.mmr_stopwords())}),
bi AS (SELECT doc_id, i, lemma || ' ' || lead(lemma) OVER (PARTITION BY doc_id ORDER BY i) AS phrase FROM kb),
cand AS (SELECT doc_id, phrase, min(i) AS fi FROM bi WHERE phrase IS NOT NULL GROUP BY doc_id, phrase),
cand_pos AS (SELECT doc_id, phrase, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fi) - 1 AS INTEGER)
  AS first_pos FROM cand)"""


def _keybert_candidates(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    toks = d.select("doc_id", C.keybert_tokens(F.col("text")).alias("tokens"))
    return KW.candidate_phrases(toks, "tokens", n=2)


@query("candidate_phrases", f"WITH {_keybert_ctes()} SELECT doc_id, first_pos, phrase FROM cand_pos")
def candidate_phrases(spark, sf):
    """KEY-2: distinct bigrams of the MMR chain per document."""
    return _keybert_candidates(spark, sf)


_BANNED = sorted(set(fixed.MMR_STOPWORDS) | set(fixed.MMR_EXCLUDED))


@query("drop_banned_grams", f"""WITH {_keybert_ctes()}
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_phrases FROM cand_pos
WHERE NOT list_has_any(string_split(lower(phrase), ' '), {O.str_array(_BANNED)}) GROUP BY doc_id""")
def drop_banned_grams(spark, sf):
    """FLT-5 on the candidates, counted per document."""
    kept = KW.drop_banned_grams(_keybert_candidates(spark, sf), _BANNED)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_phrases"))


def _seed_tokens(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", C.seed_tokens(F.col("text")).alias("tokens"))


@query("mmr_keywords")
def mmr_keywords(spark, sf):
    """KEY-6: MMR bigram keywords per document (top 25, diversity 0.5)."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    toks = d.select("doc_id", C.keybert_tokens(F.col("text")).alias("tokens"))
    return round_doubles(KW.mmr_keywords(toks, "tokens", n=2, top_n=fixed.TOP_N_TERMS))


@query("doc_vector", f"""WITH t AS (SELECT d.doc_id, u.tok, u.pos FROM documents d,
  unnest({O.tokenize('lower(d.text)')}) WITH ORDINALITY AS u(tok, pos)),
w AS (SELECT t.doc_id, coalesce(x.llemma, t.tok) AS word, count(*) AS k FROM t {_lex_join_sql('t.tok')}
  WHERE t.tok NOT IN {O.str_list(fixed.SEED_STOPWORDS)}
    AND coalesce(x.lpos, {O.rule_pos('t.tok')}) IN {O.str_list(fixed.POS_SEED)}
    AND t.tok NOT IN {O.str_list(fixed.ENGLISH_STOPWORDS)} AND regexp_full_match(t.tok, {O.lit(K.ALPHA_TOKEN[1:-1])})
  GROUP BY ALL),
n AS (SELECT doc_id, sum(k) AS n FROM w GROUP BY doc_id),
g AS (SELECT word, gram, count(*) AS c FROM (SELECT word, unnest(list_transform(range(1, length('^' || word || '$') - 1),
  lambda i: substr('^' || word || '$', i, 3))) AS gram FROM (SELECT DISTINCT word FROM w)) GROUP BY ALL),
u AS (SELECT word, gram, c / sqrt(sum(c * c) OVER (PARTITION BY word)) AS x FROM g),
v AS (SELECT w.doc_id, u.gram, sum(w.k * u.x) / max(n.n) AS weight FROM w JOIN u USING (word) JOIN n USING (doc_id) GROUP BY ALL)
SELECT doc_id, count(*) AS n_grams, round(sqrt(sum(weight * weight)), 6) AS norm, round(max(weight), 6) AS top FROM v GROUP BY doc_id""")
def doc_vector(spark, sf):
    """KEY-5: the document vectors of the seed chain, summarised per document."""
    v = KW.doc_vectors(_seed_tokens(spark, sf), "tokens")
    return round_doubles(v.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_grams"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.max("weight").alias("top")))


@query("seed_guided_keywords")
def seed_guided_keywords(spark, sf):
    """KEY-7: MMR unigram keywords pulled towards the seed keywords (top 10)."""
    return round_doubles(KW.mmr_keywords(_seed_tokens(spark, sf), "tokens", n=1, top_n=fixed.TOP_N_SEED,
                                         seeds=fixed.SEED_KEYWORDS))


@query("corpus_keyword_counts")
def corpus_keyword_counts(spark, sf):
    """KEY-8 + FLT-5: the 25 bigram keywords chosen by most documents."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    toks = d.select("doc_id", C.keybert_tokens(F.col("text")).alias("tokens"))
    kws = KW.drop_banned_grams(KW.mmr_keywords(toks, "tokens", n=2, top_n=fixed.TOP_N_TERMS), _BANNED)
    return KW.corpus_keyword_counts(kws)


_SEED_WORDS_SQL = f"""t AS (SELECT d.doc_id, u.tok, u.pos FROM documents d,
  unnest({O.tokenize('lower(d.text)')}) WITH ORDINALITY AS u(tok, pos)),
sw AS (SELECT DISTINCT coalesce(x.llemma, t.tok) AS term FROM t {_lex_join_sql('t.tok')}
  WHERE t.tok NOT IN {O.str_list(fixed.SEED_STOPWORDS)}
    AND coalesce(x.lpos, {O.rule_pos('t.tok')}) IN {O.str_list(fixed.POS_SEED)}
    AND t.tok NOT IN {O.str_list(fixed.ENGLISH_STOPWORDS)} AND regexp_full_match(t.tok, {O.lit(K.ALPHA_TOKEN[1:-1])}))"""

# Bit-parallel LCS: v & m marks where the term's letter extends a common subsequence; zero bits of the last v count.
_LCS_SQL = """(length(kw) - bit_count(list_reduce(list_prepend((1::BIGINT << length(kw)) - 1, list_transform(string_split(term, ''),
  lambda c: list_sum(list_transform(string_split(kw, ''), lambda k, j: CASE WHEN k = c THEN 1::BIGINT << (j - 1) ELSE 0 END))::BIGINT)),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(kw)) - 1))))"""
# A letter that only one of the two has costs an edit, so most pairs leave before their LCS is computed.
_LETTERS_SQL = "list_aggregate(list_transform(string_split({0}, ''), lambda c: 1::BIGINT << (unicode(c) % 62)), 'bit_or') AS s{0}"
_FUZZY_SQL = f"""t1 AS (SELECT term, {_LETTERS_SQL.format('term')} FROM sw WHERE term <> ''),
k1 AS (SELECT kw, {_LETTERS_SQL.format('kw')} FROM kws WHERE kw <> ''),
pairs AS (SELECT term, kw FROM t1 JOIN k1
  ON 400 * least(length(term), length(kw)) >= {2 * fixed.FUZZ_CUTOFF + 1} * (length(term) + length(kw))
  AND 200 * bit_count(xor(sterm, skw)) <= {199 - 2 * fixed.FUZZ_CUTOFF} * (length(term) + length(kw))),
near AS (SELECT DISTINCT term FROM pairs WHERE 400 * {_LCS_SQL} >= {2 * fixed.FUZZ_CUTOFF + 1} * (length(term) + length(kw)))
SELECT term AS phrase FROM sw WHERE term NOT IN (SELECT term FROM near)"""


@query("fuzzy_exclude", f"""WITH {_SEED_WORDS_SQL},
kws AS (SELECT unnest({O.str_array(fixed.SEED_KEYWORDS)}) AS kw), {_FUZZY_SQL}""")
def fuzzy_exclude(spark, sf):
    """KEY-9: distinct seed-chain words not fuzzy-similar (ratio > 85) to a seed."""
    words = _seed_tokens(spark, sf).select(F.explode("tokens").alias("phrase")).distinct()
    return KW.fuzzy_exclude(words, fixed.SEED_KEYWORDS)


_KNOWN_WORD = "[a-z]{3,20}"


@query("fuzzy_anti_join", f"""WITH {_SEED_WORDS_SQL},
kws AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_KNOWN_WORD}')) AS kw FROM benchmark), {_FUZZY_SQL}""")
def fuzzy_anti_join(spark, sf):
    """KEY-9 / JOIN-4 by the segment index: distinct seed-chain words not fuzzy-similar to a word of ``benchmark``."""
    words = _seed_tokens(spark, sf).select(F.explode("tokens").alias("phrase")).distinct()
    known = tables.table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_KNOWN_WORD), 0)).alias("keyword"))
    return FZ.fuzzy_anti_join(words, known)


_SCORE_SQL = f"""WITH {_SEED_WORDS_SQL},
{O.keyword_ctes({'known': fixed.SEED_KEYWORDS})},
{O.term_sims_ctes('sw')},
scored AS (SELECT term AS phrase, (avg(sim) + max(sim)) / 2 AS score FROM tsim GROUP BY term)"""


@query("score_candidates", f"{_SCORE_SQL} SELECT phrase, round(score, 6) AS score FROM scored")
def score_candidates(spark, sf):
    """KEY-10: every distinct seed-chain word scored against the seed keywords."""
    words = _seed_tokens(spark, sf).select(F.explode("tokens").alias("phrase"))
    return round_doubles(KW.score_candidates(words, fixed.SEED_KEYWORDS))


@query("pick_new_seeds", f"""{_SCORE_SQL}
SELECT phrase, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, phrase) AS INTEGER) AS rank
FROM scored WHERE phrase NOT IN {O.str_list(fixed.SEED_KEYWORDS)}
ORDER BY round(score, 9) DESC, phrase LIMIT {fixed.NEW_SEEDS}""")
def pick_new_seeds(spark, sf):
    """KEY-11 (distinct form): the 3 best new words by score."""
    words = _seed_tokens(spark, sf).select(F.explode("tokens").alias("phrase"))
    return round_doubles(KW.pick_new_seeds(KW.score_candidates(words, fixed.SEED_KEYWORDS), fixed.SEED_KEYWORDS))


@query("expand_keywords")
def expand_keywords(spark, sf):
    """KEY-12 in full: all rounds from the seeds; the keywords added, with score, round and rank."""
    rows = KW.expand_keywords(_seed_tokens(spark, sf), fixed.SEED_KEYWORDS)
    return round_doubles(spark.createDataFrame(rows, "keyword string, score double, round int, rank int"))


@query("pick_new_seeds_any", f"""{_SCORE_SQL}
SELECT phrase, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, phrase) AS INTEGER) AS rank
FROM scored ORDER BY round(score, 9) DESC, phrase LIMIT {fixed.NEW_SEEDS}""")
def pick_new_seeds_any(spark, sf):
    """KEY-11 (``distinct=False``): known words compete too."""
    words = _seed_tokens(spark, sf).select(F.explode("tokens").alias("phrase"))
    scored = KW.score_candidates(words, fixed.SEED_KEYWORDS)
    return round_doubles(KW.pick_new_seeds(scored, fixed.SEED_KEYWORDS, distinct=False))


@query("expand_keywords_round")
def expand_keywords_round(spark, sf):
    """KEY-12, one round from the seeds: seed-guided MMR, fuzzy exclusion, score, pick 3."""
    return round_doubles(KW.expansion_round(_seed_tokens(spark, sf), fixed.SEED_KEYWORDS))


# -- labelling variants ------------------------------------------------------------------

def _lbl_terms_sql() -> str:
    return f"""WITH {O.issues_cte()},
orig AS (SELECT doc_id, coalesce(summary, '') || ' - ' || coalesce(description, '') AS o FROM issues),
{O.labelling_token_ctes('orig', 's.o')}"""


@query("best_keyword_per_term", f"""{_lbl_terms_sql()},
{O.keyword_ctes({'keywords': fixed.KEYWORDS['mmr']})},
{O.term_sims_ctes('(SELECT lemma AS term FROM ltok)')}
SELECT term, keyword AS closest_keyword, round(sim, 6) AS similarity FROM tbest""")
def best_keyword_per_term(spark, sf):
    """LBL-1: closest keyword (MMR list) of every distinct chunk of the labelling chain."""
    iss = tables.issues(spark, sf)
    terms = iss.select(F.explode(C.labelling_tokens(L.T.combine_text(F.col("Summary"), F.col("Description"))))
                       .alias("term")).distinct()
    return round_doubles(L.best_keyword_per_term(terms, fixed.KEYWORDS["mmr"]))


def _label_methods_sql() -> str:
    return f"""{_lbl_terms_sql()},
{O.keyword_ctes(fixed.KEYWORDS)},
{O.term_sims_ctes('(SELECT lemma AS term FROM ltok)')},
dbest AS (SELECT doc_id, grp, keyword, sim FROM (SELECT l.doc_id, b.grp, b.keyword, b.sim, row_number() OVER
  (PARTITION BY l.doc_id, b.grp ORDER BY b.sim DESC, l.pos) AS rk FROM ltok l JOIN tbest b ON b.term = l.lemma)
  WHERE rk = 1),
lab AS (SELECT i.doc_id, i.project, i."Key", m.grp AS method, coalesce(d.keyword, '') AS closest_keyword,
  coalesce(d.sim, 0.0) AS sim
  FROM issues i CROSS JOIN (SELECT DISTINCT grp FROM kw) m LEFT JOIN dbest d ON d.doc_id = i.doc_id AND d.grp = m.grp)"""


@query("label_with_methods", f"""{_label_methods_sql()}
SELECT doc_id, "Key", method, closest_keyword, round(sim, 6) AS similarity_score,
  CASE WHEN sim > {fixed.THRESHOLD!r} THEN {O.lit(fixed.LABEL_POS)} ELSE {O.lit(fixed.LABEL_NEG)} END AS label FROM lab""")
def label_with_methods(spark, sf):
    """LBL-4: the three keyword lists in one pass."""
    iss = tables.issues(spark, sf)
    return round_doubles(L.label_with_methods(iss, fixed.KEYWORDS, keep=["doc_id"]))


@query("candidate_summary", f"""{_label_methods_sql()}
SELECT project, method, CASE WHEN sim > {fixed.THRESHOLD!r} THEN {O.lit(fixed.LABEL_POS)} ELSE {O.lit(fixed.LABEL_NEG)} END
  AS label, count(*) AS n_issues FROM lab GROUP BY ROLLUP (project, method, 3)""")
def candidate_summary(spark, sf):
    """LBL-5: issues per project / method / label with rollup subtotals."""
    iss = tables.issues(spark, sf)
    lab = L.label_with_methods(iss, fixed.KEYWORDS, keep=["project"])
    return L.candidate_summary(lab)


@query("keyword_similarity", f"""{_lbl_terms_sql()},
{O.keyword_ctes(fixed.KEYWORDS)},
{O.term_sims_ctes('(SELECT lemma AS term FROM ltok)')}
SELECT grp AS method, CAST(kid AS INTEGER) AS kid, keyword, count(*) FILTER (WHERE sim > 0) AS n_terms,
  round(avg(sim), 6) AS avg_sim, round(max(sim), 6) AS max_sim FROM tsim GROUP BY grp, kid, keyword""")
def keyword_similarity(spark, sf):
    """JOIN-2 (re-aimed): the chunk x keyword similarity relation, summarised per keyword.

    The pairs are produced inside each term's row (no cross join): the score
    vector is exploded with its position and aggregated per keyword.
    """
    iss = tables.issues(spark, sf)
    terms = iss.select(F.explode(C.labelling_tokens(L.T.combine_text(F.col("Summary"), F.col("Description"))))
                       .alias("term")).distinct()
    kws = KeywordSet(fixed.KEYWORDS)
    meta = F.array(*[F.struct(F.lit(g).alias("method"), F.lit(i).alias("kid"), F.lit(k).alias("keyword"))
                     for g, i, k in kws.flat])
    pairs = terms.select(F.posexplode(kws.sims(F.col("term"))).alias("j", "sim"))
    pairs = pairs.select(F.element_at(meta, F.col("j") + 1).alias("m"), "sim")
    out = pairs.groupBy("m.method", "m.kid", "m.keyword").agg(
        F.count(F.when(F.col("sim") > 0, 1)).alias("n_terms"), F.avg("sim").alias("avg_sim"),
        F.max("sim").alias("max_sim"))
    return round_doubles(out)


@query("term_vectors", f"""{_lbl_terms_sql()},
tg AS (SELECT term, unnest(list_transform(range(1, length('^' || term || '$') - 1),
    lambda i: substr('^' || term || '$', i, 3))) AS gram FROM (SELECT DISTINCT lemma AS term FROM ltok)),
tgc AS (SELECT term, gram, count(*) AS cnt FROM tg GROUP BY term, gram)
SELECT term, count(*) AS n_grams, CAST(sum(cnt * cnt) AS BIGINT) AS norm2 FROM tgc GROUP BY term""")
def term_vectors(spark, sf):
    """KEY-3 (b): the character-trigram vector of every distinct chunk, summarised
    as (distinct grams, squared norm)."""
    iss = tables.issues(spark, sf)
    terms = iss.select(F.explode(C.labelling_tokens(L.T.combine_text(F.col("Summary"), F.col("Description"))))
                       .alias("term")).distinct()
    g = L.term_grams(terms)
    return g.groupBy("term").agg(F.count(F.lit(1)).alias("n_grams"),
                                 F.sum(F.col("cnt") * F.col("cnt")).alias("norm2"))


@query("cosine", """SELECT vec_id AS doc_id, round(CASE WHEN na * nb = 0 THEN 0.0 ELSE dot / (na * nb) END, 6) AS cosine
FROM (SELECT vec_id,
  list_sum(list_transform(range(1, 33), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[i + 32] AS DOUBLE))) AS dot,
  sqrt(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS na,
  sqrt(list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nb
  FROM embeddings)""")
def cosine(spark, sf):
    """KEY-4 (dense): cosine between the two halves of every embedding."""
    e = tables.pool(spark, sf)
    return round_doubles(e.select("doc_id", dense_cosine(F.slice("embedding", 1, 32),
                                                         F.slice("embedding", 33, 32)).alias("cosine")))


@query("label_with_word2vec")
def label_with_word2vec(spark, sf):
    """KEY-3 (c) + JOIN-3: Word2Vec vectors trained on the labelling chunks, then
    every document labelled by the closest MMR-list keyword through the term join."""
    from issuelens.operators import providers as P
    iss = tables.issues(spark, sf)
    ch = iss.select("doc_id", C.labelling_tokens(L.T.combine_text(F.col("Summary"), F.col("Description")))
                    .alias("chunks"))
    vecs = P.word2vec_vectors(ch, "chunks")
    return round_doubles(P.label_with_vectors(ch, vecs, fixed.KEYWORDS["mmr"]))
