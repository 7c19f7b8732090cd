"""Registered queries: projections, filters, cleaning and token operators.

``LIT`` queries prepend a markup fixture (chosen by ``doc_id % k``) to every
document on both sides, because the generated text holds no URL, CamelCase,
backtick, Jira tag, tab or CR. All documents are kept; nothing is filtered by
the modulo.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions import text as T
from issuelens.functions import tokens as K
from issuelens.operators import lexicon as LX
from issuelens.operators.labelling import with_default_key
from issuelens.plans import chains as C
from issuelens.plans import oracle as O
from issuelens.plans.catalog import query
from issuelens.sources import tables

# FIXED VALUES: markup fixtures injected on both sides (FIXTURES.md section D).
FIXTURES = [
    "Use FooBar and fooBar, Foo, HTTPServer now",
    "see https://a.b/c?d=1#e, then stop",
    "```x\ny``` then an inline `z` span",
    "p {code:java}a{code} q {noformat}b{noformat} {color:red}c{color} r",
    "p {code:title=A.java}X{code} keep {code}Y{code} q",
    "\tlead\r\nand\t\ttabs  nbsp  trail \t",
    "() -- . x we move the code",
    "foo foo",
]


def inject(text: Column, doc_id: Column) -> Column:
    arr = F.array(*[F.lit(f) for f in FIXTURES])
    return F.concat(F.element_at(arr, (doc_id % len(FIXTURES) + 1).cast("int")), F.lit(" "), text)


def inject_sql(text: str = "text", doc_id: str = "doc_id") -> str:
    return f"({O.str_array(FIXTURES)})[({doc_id} % {len(FIXTURES)}) + 1] || ' ' || {text}"


def docs(spark, sf, cols=("doc_id", "text")):
    return tables.table(spark, sf, "documents").select(*cols)


def _text_query(name: str, spark_fn, sql_fn, lit_inject: bool):
    """Register ``SELECT doc_id, f(text) AS out FROM documents``."""
    src_sql = inject_sql() if lit_inject else "text"

    @query(name, f"SELECT doc_id, {sql_fn(src_sql)} AS out FROM documents")
    def q(spark, sf):
        d = docs(spark, sf)
        src = inject(F.col("text"), F.col("doc_id")) if lit_inject else F.col("text")
        return d.select("doc_id", spark_fn(src).alias("out"))
    return q


# -- CLN-* -------------------------------------------------------------------
_text_query("strip_camel_case", T.strip_camel_case, lambda e: O.rx_replace(e, T.CAMEL_RE2, ""), True)
_text_query("strip_urls", T.strip_urls, lambda e: O.rx_replace(e, T.URL, ""), True)
_text_query("strip_fenced_code", T.strip_fenced_code, lambda e: O.rx_replace(e, T.FENCED, ""), True)
_text_query("strip_inline_code", T.strip_inline_code, lambda e: O.rx_replace(e, T.INLINE, ""), True)
_text_query("lowercase", T.lowercase, lambda e: f"lower({e})", False)
_text_query("strip_jira_code", T.strip_jira_code, lambda e: O.rx_replace(e, T.JIRA_CODE, " "), True)
_text_query("strip_jira_code_strict", lambda c: T.strip_jira_code(c, True),
            lambda e: O.rx_replace(e, T.JIRA_CODE_STRICT, " "), True)
_text_query("strip_jira_noformat", T.strip_jira_noformat, lambda e: O.rx_replace(e, T.JIRA_NOFORMAT, " "), True)
_text_query("strip_jira_color", T.strip_jira_color, lambda e: O.rx_replace(e, T.JIRA_COLOR, ""), True)
_text_query("collapse_newlines", T.collapse_newlines, lambda e: O.rx_replace(e, T.NEWLINES, " "), True)
_text_query("collapse_whitespace", T.collapse_whitespace, O.collapse_ws, True)
_text_query("strip_non_ascii", T.strip_non_ascii, lambda e: O.rx_replace(e, T.NON_ASCII, ""), False)
_text_query("strip_digits", T.strip_digits, lambda e: O.rx_replace(e, T.DIGITS, ""), False)
_text_query("strip_punctuation", T.strip_punctuation, lambda e: f"translate({e}, {O.lit(fixed.PUNCT)}, '')", True)
_text_query("clean_labelling", T.clean_labelling, O.clean_labelling, True)
_text_query("clean_jira", T.clean_jira, O.clean_jira, True)
_text_query("clean_ascii", T.clean_ascii, O.clean_ascii, False)


# -- TOK-* as text ---------------------------------------------------------------
def _join_sql(arr: str) -> str:
    return f"array_to_string({arr}, '|')"


_text_query("split_words", lambda c: F.array_join(K.split_words(c), "|"),
            lambda e: _join_sql(O.split_words(e)), True)
_text_query("tokenize_words", lambda c: F.array_join(K.tokenize_words(c), "|"),
            lambda e: _join_sql(O.tokenize(e)), True)
_text_query("drop_punct_tokens", lambda c: F.array_join(K.drop_punct_tokens(K.split_words(c)), "|"),
            lambda e: _join_sql(f"list_filter({O.split_words(e)}, lambda t: strpos({O.lit(fixed.PUNCT)}, t) = 0)"),
            True)
_ENG = K.stop_list()
_text_query("remove_stopwords", lambda c: F.array_join(K.remove_stopwords(K.split_words(F.lower(c)), _ENG), "|"),
            lambda e: _join_sql(f"list_filter({O.split_words(f'lower({e})')}, lambda t: t NOT IN {O.str_list(_ENG)})"),
            True)
_LBL_STOP = K.stop_list(extra=["move", "code"], keep=fixed.STOPWORD_WHITELIST)
_text_query("whitelist_token",
            lambda c: F.array_join(K.remove_stopwords(K.split_words(F.lower(c)), _LBL_STOP), "|"),
            lambda e: _join_sql(f"list_filter({O.split_words(f'lower({e})')}, lambda t: t NOT IN {O.str_list(_LBL_STOP)})"),
            True)
_text_query("keep_alpha", lambda c: F.array_join(K.keep_alpha(K.tokenize_words(F.lower(c))), "|"),
            lambda e: _join_sql(f"list_filter({O.tokenize(f'lower({e})')}, lambda t: regexp_full_match(t, {O.lit(K.ALPHA_TOKEN[1:-1])}))"),
            True)
# TOK-14 on every line of a text: the lines that repeat one word, as flags.
_text_query("is_repetitive", lambda c: F.array_join(F.transform(F.split(c, "\n"), lambda x: K.is_repetitive(x).cast("string")), ","),
            lambda e: "array_to_string(list_transform(string_split(" + e + ", chr(10)), lambda x: CAST(coalesce(len(list_distinct("
            + O.split_words("replace(x, chr(34), '')") + ")) = 1, false) AS VARCHAR)), ',')",
            True)


def ngram_rows_sql(src: str, n: int) -> str:
    """``(doc_id, i, gram)`` of an array column ``a``: neighbours by ``lead`` over unnested tokens."""
    parts = " || ' ' || ".join(["tok", *(f"lead(tok, {k}) OVER w" for k in range(1, n))])
    return f"""SELECT doc_id, i, gram FROM (SELECT doc_id, i, {parts} AS gram
  FROM (SELECT s.doc_id, u.tok, u.i FROM {src} s, unnest(s.a) WITH ORDINALITY AS u(tok, i))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL"""


for _n in (2, 3):
    @query(f"ngrams_{_n}", f"""WITH src AS (SELECT doc_id, {O.split_words('lower(text)')} AS a FROM documents),
g AS ({ngram_rows_sql('src', _n)})
SELECT d.doc_id, coalesce(string_agg(g.gram, '|' ORDER BY g.i), '') AS out FROM documents d LEFT JOIN g USING (doc_id)
GROUP BY d.doc_id""")
    def _ngrams(spark, sf, n=_n):
        return docs(spark, sf).select("doc_id", F.array_join(K.ngrams(K.split_words(F.lower("text")), n), "|").alias("out"))


# -- PRJ-* ---------------------------------------------------------------------
@query("combine_text", f"""WITH {O.issues_cte()}
SELECT doc_id, coalesce(summary, '') || ' - ' || coalesce(description, '') AS labelling_text,
       coalesce(summary, '') || '. ' || coalesce(description, '') AS training_text FROM issues""")
def combine_text(spark, sf):
    i = tables.issues(spark, sf)
    return i.select("doc_id", T.combine_text(F.col("Summary"), F.col("Description"), " - ").alias("labelling_text"),
                    T.combine_text(F.col("Summary"), F.col("Description"), ". ").alias("training_text"))


@query("default_key", f"""WITH {O.issues_cte()}
SELECT doc_id, 'unknown-' || CAST(doc_id AS VARCHAR) AS "Key", "Key" AS given_key FROM issues""")
def default_key(spark, sf):
    i = tables.issues(spark, sf)
    keyed = with_default_key(i.withColumnRenamed("Key", "given_key"), order_col="doc_id")
    return keyed.select("doc_id", "Key", "given_key")


#: Every document, and a row without a text for each (the test tables have no null text).
_WITH_NULLS_SQL = "(SELECT doc_id, text AS t FROM documents UNION ALL SELECT -1 - doc_id, NULL FROM documents)"


def _with_nulls(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("text").alias("t"))
    return d.unionByName(d.select((F.lit(-1) - F.col("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("t")))


@query("null_text_policy", f"""SELECT doc_id, coalesce(t, '') AS empty_policy, coalesce(t, 'nan') AS nan_policy,
    t IS NOT NULL AS is_string FROM {_WITH_NULLS_SQL}""")
def null_text_policy(spark, sf):
    d = _with_nulls(spark, sf)
    return d.select("doc_id", T.null_text(F.col("t"), "empty").alias("empty_policy"),
                    T.null_text(F.col("t"), "nan").alias("nan_policy"), F.col("t").isNotNull().alias("is_string"))


@query("skip_non_strings", f"SELECT doc_id, t AS text FROM {_WITH_NULLS_SQL} WHERE t IS NOT NULL")
def skip_non_strings(spark, sf):
    d = _with_nulls(spark, sf)
    return d.filter(F.col("t").isNotNull()).select("doc_id", F.col("t").alias("text"))


_LABEL3_SQL = ("CASE WHEN quality = 0 THEN 'Non-ATD' WHEN toxic = 1 THEN 'Weak-ATD' ELSE 'ATD' END")


def _label3(lab):
    return lab.select("doc_id", F.when(F.col("quality") == 0, "Non-ATD").when(F.col("toxic") == 1, "Weak-ATD")
                      .otherwise("ATD").alias("label"))


@query("encode_label_fixed", f"""SELECT doc_id, label, CASE label WHEN 'Non-ATD' THEN 0 WHEN 'ATD' THEN 1 END AS code
FROM (SELECT doc_id, {_LABEL3_SQL} AS label FROM labels)""")
def encode_label_fixed(spark, sf):
    from issuelens.operators.metrics import encode_label_fixed as enc
    return enc(_label3(tables.table(spark, sf, "labels")), "label", "code")


@query("encode_label_first_seen", f"""WITH l AS (SELECT doc_id, {_LABEL3_SQL} AS label FROM labels),
codes AS (SELECT label, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS code FROM l GROUP BY label)
SELECT l.doc_id, l.label, codes.code FROM l JOIN codes USING (label)""")
def encode_label_first_seen(spark, sf):
    from issuelens.operators.metrics import encode_label_first_seen as enc
    return enc(_label3(tables.table(spark, sf, "labels")), "label", "doc_id", "code")


@query("label_variant", f"""WITH l AS (SELECT doc_id, {_LABEL3_SQL} AS label FROM labels)
SELECT 'drop_weak' AS variant, label, count(*) AS n FROM l WHERE label <> 'Weak-ATD' GROUP BY label
UNION ALL SELECT 'weak_to_atd', CASE WHEN label = 'Weak-ATD' THEN 'ATD' ELSE label END, count(*) FROM l
GROUP BY CASE WHEN label = 'Weak-ATD' THEN 'ATD' ELSE label END""")
def label_variant(spark, sf):
    from issuelens.operators.metrics import label_variant as var
    l3 = _label3(tables.table(spark, sf, "labels"))
    a = var(l3, "drop_weak").groupBy(F.lit("drop_weak").alias("variant"), "label").agg(F.count(F.lit(1)).alias("n"))
    b = var(l3, "weak_to_atd").groupBy(F.lit("weak_to_atd").alias("variant"), "label").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


# -- FLT-* ---------------------------------------------------------------------
@query("filter_token_len", f"""SELECT doc_id, CAST(len({O.split_words(O.clean_jira(inject_sql()))}) AS BIGINT) AS n_tokens
FROM documents WHERE len({O.split_words(O.clean_jira(inject_sql()))}) > {fixed.TOKEN_MIN_EXCL}
  AND len({O.split_words(O.clean_jira(inject_sql()))}) < {fixed.TOKEN_MAX_EXCL}""")
def filter_token_len(spark, sf):
    from issuelens.operators.sampling import filter_token_len as flt
    d = docs(spark, sf).select("doc_id", T.clean_jira(inject(F.col("text"), F.col("doc_id"))).alias("t"))
    return flt(d, "t").select("doc_id", F.size(K.split_words(F.col("t"))).cast("bigint").alias("n_tokens"))


@query("filter_language", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def filter_language(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "source", "lang")
    return d.filter(F.col("lang") == "en").select("doc_id", "source")


@query("misclassified", """SELECT l.doc_id, d.text, l.quality AS label, 1 - l.toxic AS prediction
FROM labels l JOIN documents d USING (doc_id) WHERE 1 - l.toxic <> l.quality""")
def misclassified(spark, sf):
    from issuelens.operators.metrics import misclassified as mis
    p = tables.predictions(spark, sf)
    t = tables.table(spark, sf, "documents").select("doc_id", "text")
    return mis(p.join(t, "doc_id"), keep=["doc_id", "text"])


# -- preprocessing chains --------------------------------------------------------
def _lbl_tokens_sql(src_sql: str) -> str:
    return f"""WITH src AS (SELECT doc_id, {src_sql} AS o FROM documents),
{O.labelling_token_ctes('src', 's.o')}
SELECT s.doc_id, coalesce(p.pre, '') AS preprocessed FROM src s LEFT JOIN lpre p USING (doc_id)"""


@query("preprocess_labelling", _lbl_tokens_sql(inject_sql()))
def preprocess_labelling(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", K.rejoin_tokens(C.labelling_tokens(inject(F.col("text"), F.col("doc_id"))))
                    .alias("preprocessed"))


@query("preprocess_labelling_table", _lbl_tokens_sql("text"))
def preprocess_labelling_table(spark, sf):
    """The labelling chain with the lexicon as a table."""
    out = C.labelling_chain().with_lexicon_table(docs(spark, sf), F.col("text"), LX.lexicon_df(spark))
    return out.select("doc_id", K.rejoin_tokens(F.col("tokens")).alias("preprocessed"))


def _lex_join_sql(tok: str, alias: str = "x") -> str:
    return f"LEFT JOIN {O.lexicon_table(alias)} ON {alias}.ltok = {tok}"


@query("preprocess_seed", f"""WITH t AS (SELECT d.doc_id, u.tok, u.pos FROM documents d,
  unnest({O.tokenize('lower(d.text)')}) WITH ORDINALITY AS u(tok, pos)),
k AS (SELECT t.doc_id, t.pos, coalesce(x.llemma, t.tok) AS lemma FROM t {_lex_join_sql('t.tok')}
  WHERE t.tok NOT IN {O.str_list(fixed.SEED_STOPWORDS)}
    AND coalesce(x.lpos, {O.rule_pos('t.tok')}) IN {O.str_list(fixed.POS_SEED)}
    AND t.tok NOT IN {O.str_list(fixed.ENGLISH_STOPWORDS)} AND regexp_full_match(t.tok, {O.lit(K.ALPHA_TOKEN[1:-1])}))
SELECT d.doc_id, coalesce(string_agg(k.lemma, ' ' ORDER BY k.pos), '') AS preprocessed
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def preprocess_seed(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", K.rejoin_tokens(C.seed_tokens(F.col("text"))).alias("preprocessed"))


@query("preprocess_keybert", f"""WITH src AS (SELECT * FROM {_WITH_NULLS_SQL}),
t AS (SELECT s.doc_id, u.tok, u.pos FROM src s,
  unnest({O.tokenize("lower(coalesce(s.t, 'nan'))")}) WITH ORDINALITY AS u(tok, pos)),
k AS (SELECT t.doc_id, t.pos, coalesce(x.llemma, t.tok) AS lemma FROM t {_lex_join_sql('t.tok')}
  WHERE strpos({O.lit(fixed.PUNCT)}, t.tok) = 0)
SELECT s.doc_id, coalesce(string_agg(k.lemma, ' ' ORDER BY k.pos)
  FILTER (WHERE lower(k.lemma) NOT IN {O.str_list(C.mmr_stopwords())}), '') AS preprocessed
FROM src s LEFT JOIN k USING (doc_id) GROUP BY s.doc_id""")
def preprocess_keybert(spark, sf):
    d = _with_nulls(spark, sf)
    return d.select("doc_id", K.rejoin_tokens(C.keybert_tokens(F.col("t"))).alias("preprocessed"))


_TFIDF_STOP = K.stop_list(extra=fixed.TFIDF_PROJECT_STOPWORDS)


def tfidf_tokens_sql(src: str = "documents") -> str:
    """CTE body ``tt(doc_id, pos, lemma)`` for preprocess_tfidf on ``src(doc_id, text, lang)``."""
    return f"""tt0 AS (SELECT d.doc_id, u.tok, u.pos FROM {src} d,
  unnest({O.tokenize(O.clean_ascii("coalesce(d.text, 'nan')"))}) WITH ORDINALITY AS u(tok, pos)
  WHERE coalesce(d.lang = 'en', false)),
tt AS (SELECT tt0.doc_id, tt0.pos, coalesce(x.llemma, tt0.tok) AS lemma FROM tt0 {_lex_join_sql('tt0.tok')}
  WHERE tt0.tok NOT IN {O.str_list(_TFIDF_STOP)})"""


@query("preprocess_tfidf", f"""WITH {tfidf_tokens_sql()}
SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS preprocessed FROM tt GROUP BY doc_id""")
def preprocess_tfidf(spark, sf):
    """preprocess_tfidf then FLT-2 (rows whose text became empty are dropped)."""
    d = docs(spark, sf, ("doc_id", "text", "lang"))
    out = d.select("doc_id", K.rejoin_tokens(C.tfidf_tokens(F.col("text"), F.col("lang") == "en")).alias("preprocessed"))
    return out.filter(F.col("preprocessed") != "")


# -- lexicon as a table (JOIN-1, TOK-8, TOK-9, TOK-10, TOK-13) --------------------
@query("lexicon_join", f"""SELECT t.doc_id, CAST(t.pos - 1 AS INTEGER) AS pos, t.tok AS token,
  coalesce(x.lpos, {O.rule_pos('t.tok')}) AS tag, coalesce(x.llemma, t.tok) AS lemma
FROM (SELECT d.doc_id, u.tok, u.pos FROM documents d, unnest({O.tokenize('lower(d.text)')}) WITH ORDINALITY AS u(tok, pos)) t
{_lex_join_sql('t.tok')}""")
def lexicon_join(spark, sf):
    toks = LX.explode_tokens(docs(spark, sf), "text")
    return LX.lexicon_join(toks, LX.lexicon_df(spark)).select("doc_id", "pos", "token", "tag", "lemma")


@query("filter_pos", f"""SELECT tag, count(*) AS n FROM (SELECT coalesce(x.lpos, {O.rule_pos('t.tok')}) AS tag
FROM (SELECT unnest({O.tokenize('lower(d.text)')}) AS tok FROM documents d) t {_lex_join_sql('t.tok')})
WHERE tag IN {O.str_list(fixed.POS_LABELLING)} GROUP BY tag""")
def filter_pos(spark, sf):
    toks = LX.explode_tokens(docs(spark, sf), "text")
    tagged = LX.lexicon_join(toks, LX.lexicon_df(spark))
    return LX.filter_pos(tagged, fixed.POS_LABELLING).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("lemmatize", f"""SELECT lemma, count(*) AS n FROM (SELECT coalesce(x.llemma, t.tok) AS lemma
FROM (SELECT unnest({O.tokenize('lower(d.text)')}) AS tok FROM documents d) t {_lex_join_sql('t.tok')})
GROUP BY lemma""")
def lemmatize(spark, sf):
    toks = LX.explode_tokens(docs(spark, sf), "text")
    return LX.lexicon_join(toks, LX.lexicon_df(spark)).groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


_PENN_SQL = "CASE " + " ".join(f"WHEN tag = {O.lit(k)} THEN {O.lit(v)}" for k, v in fixed.PENN_OF_POS.items()) + " ELSE 'NN' END"


@query("map_pos_tag", f"""SELECT wn, count(*) AS n FROM (SELECT CASE substr(penn, 1, 1) WHEN 'J' THEN 'a'
  WHEN 'V' THEN 'v' WHEN 'N' THEN 'n' WHEN 'R' THEN 'r' ELSE 'n' END AS wn
FROM (SELECT {_PENN_SQL} AS penn FROM (SELECT coalesce(x.lpos, {O.rule_pos('t.tok')}) AS tag
FROM (SELECT unnest({O.tokenize('lower(d.text)')}) AS tok FROM documents d) t {_lex_join_sql('t.tok')})))
GROUP BY wn""")
def map_pos_tag(spark, sf):
    toks = LX.explode_tokens(docs(spark, sf), "text")
    tagged = LX.lexicon_join(toks, LX.lexicon_df(spark))
    return (tagged.select(K.map_pos_tag(LX.penn_tag(F.col("tag"))).alias("wn"))
            .groupBy("wn").agg(F.count(F.lit(1)).alias("n")))


@query("dedupe_by_lemma", f"""WITH t AS (SELECT d.doc_id, u.tok, u.pos FROM documents d,
  unnest({O.tokenize('lower(d.text)')}) WITH ORDINALITY AS u(tok, pos)),
j AS (SELECT t.doc_id, CAST(t.pos - 1 AS INTEGER) AS pos, t.tok, coalesce(x.llemma, t.tok) AS lemma
  FROM t {_lex_join_sql('t.tok')} WHERE regexp_full_match(t.tok, {O.lit(K.ALPHA_TOKEN[1:-1])}))
SELECT lemma, min(doc_id) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos,
  arg_max(tok, (doc_id, pos)) AS last_word, count(*) AS n FROM j GROUP BY lemma""")
def dedupe_by_lemma(spark, sf):
    toks = LX.explode_tokens(docs(spark, sf), "text").filter(F.col("token").rlike(K.ALPHA_TOKEN))
    return LX.dedupe_by_lemma(LX.lexicon_join(toks, LX.lexicon_df(spark)))


@query("encode_sequences", f"""WITH t AS (SELECT d.doc_id, u.tok, u.pos FROM documents d,
  unnest({O.split_words(O.clean_jira('d.text'))}) WITH ORDINALITY AS u(tok, pos)),
vocab AS (SELECT tok, CAST(row_number() OVER (ORDER BY count(*) DESC, tok) + 1 AS INTEGER) AS id
  FROM t GROUP BY tok ORDER BY count(*) DESC, tok LIMIT 30000),
ids AS (SELECT t.doc_id, t.pos, coalesce(v.id, 1) AS id FROM t LEFT JOIN vocab v USING (tok) WHERE t.pos <= 512)
SELECT d.doc_id, coalesce(string_agg(CAST(i.id AS VARCHAR), ' ' ORDER BY i.pos), '') AS input_ids,
  CAST(count(i.id) AS INTEGER) AS n_real
FROM documents d LEFT JOIN ids i USING (doc_id) GROUP BY d.doc_id""")
def encode_sequences(spark, sf):
    """TOK-15 (the operator's own vocabulary and length; ids as text, padding dropped)."""
    d = docs(spark, sf).select("doc_id", K.split_words(T.clean_jira(F.col("text"))).alias("tokens"))
    enc = LX.encode_sequences(d, "tokens")
    return enc.select("doc_id", F.array_join(F.filter(F.col("input_ids"), lambda x: x != 0), " ").alias("input_ids"),
                      F.aggregate(F.col("attention_mask"), F.lit(0), lambda a, x: a + x).alias("n_real"))
