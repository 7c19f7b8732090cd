"""Registered queries: language detection, explanations, code-line rules, UDF points."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from issuelens.functions import text as T
from issuelens.operators import explain as X
from issuelens.operators import language as LG
from issuelens.operators import metrics as M
from issuelens.plans import chains as C
from issuelens.plans import oracle as O
from issuelens.plans.catalog import query, round_doubles
from issuelens.session import ensure_checkpoint_dir, together, written
from issuelens.sources import tables

_TRAIN = "md5('lang:' || CAST(doc_id AS VARCHAR)) < '8'"


def _train_flag():
    return F.md5(F.concat(F.lit("lang:"), F.col("doc_id").cast("string"))) < F.lit("8")


@query("detect_language", f"""WITH d AS (SELECT doc_id, lang,
  trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) AS t, {_TRAIN} AS train FROM documents),
g AS (SELECT doc_id, lang, train, substr(t, i, 3) AS gram FROM d, range(1, length(t) - 1) AS r(i) WHERE length(t) >= 3),
cnt AS (SELECT lang, gram, count(*) AS cnt FROM g WHERE train GROUP BY lang, gram),
v AS (SELECT count(DISTINCT gram) AS v FROM cnt),
tot AS (SELECT lang, -ln(sum(cnt) + max(v.v)) AS unseen FROM cnt CROSS JOIN v GROUP BY lang),
prof AS (SELECT lang, gram, ln(cnt + 1.0) AS delta FROM cnt),
occ AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY doc_id, gram),
n AS (SELECT doc_id, sum(c) AS n FROM occ GROUP BY doc_id),
part AS (SELECT o.doc_id, p.lang, sum(o.c * p.delta) AS s FROM occ o JOIN prof p USING (gram) GROUP BY o.doc_id, p.lang),
sc AS (SELECT n.doc_id, t.lang, round(n.n * t.unseen + coalesce(part.s, 0.0), 9) AS score FROM n CROSS JOIN tot t
  LEFT JOIN part ON part.doc_id = n.doc_id AND part.lang = t.lang),
best AS (SELECT doc_id, arg_min(lang, (-score, lang)) AS detected FROM sc GROUP BY doc_id)
SELECT d.doc_id, d.lang, d.train, best.detected FROM d LEFT JOIN best USING (doc_id)""")
def detect_language(spark, sf):
    """LNG-1: every document's language, by a trigram profile trained on the md5 half that ``train`` marks."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("train", _train_flag())
    prof, unseen = LG.train_profile(d.filter("train"))
    return d.select("doc_id", "lang", "train").join(LG.detect_language(d, prof, unseen), "doc_id")


_CODE_FIXTURE = "import a.b;\npublic class X {\nprose stays\n@Override\n"


def _sql_text(value: str) -> str:
    """A SQL string expression with its line feeds written out."""
    return " || chr(10) || ".join(O.lit(part) for part in value.split("\n"))


@query("drop_code_runs", f"""WITH lines AS (
  SELECT d.doc_id, u.i, {O.rx_replace('u.line', '^' + T.WS + '+|' + T.WS + '+$', '')} AS line
  FROM documents d, unnest(string_split({_sql_text(_CODE_FIXTURE)} || d.text, chr(10))) WITH ORDINALITY AS u(line, i)),
flags AS (SELECT doc_id, i, line, regexp_matches(line, {O.lit(T.CODE_LINE)}) AS f FROM lines),
near AS (SELECT *, coalesce(lag(f) OVER w, false) OR coalesce(lead(f) OVER w, false) AS n FROM flags
  WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, {O.collapse_ws("coalesce(string_agg(line, ' ' ORDER BY i) FILTER (WHERE NOT (f AND n) AND line <> ''), '')")} AS out
FROM near GROUP BY doc_id""")
def drop_code_runs(spark, sf):
    """CLN-18 over every document with a code-run fixture before it."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", T.drop_code_runs(F.concat(F.lit(_CODE_FIXTURE), F.col("text"))).alias("out"))


_LINE_FIXTURE = ("[info] build\ndiff --git a b\n+x\n-y\nafter\n{{log}} org.a:b ...... 1.2 -> 1.3\n< old --- new\n"
                 "> added\n12c13\n")


def _line_rules_sql(e: str) -> str:
    """The rules in order; the one look-ahead is a captured tail that is put back."""
    for name, pattern, by in T.OPTIONAL_LINE_RULES:
        if name == "diff_blocks":
            pattern, by = r"diff --git[\s\S]*?(\n[^+\-@\s]|$)", r" \1"
        e = O.rx_replace(e, pattern, by)
    return e


@query("optional_line_rules", f"""SELECT doc_id, {_line_rules_sql(f"{_sql_text(_LINE_FIXTURE)} || text")} AS out FROM documents""")
def optional_line_rules(spark, sf):
    """CLN-17: all opt-in line rules folded into one expression."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", T.optional_line_rules(F.concat(F.lit(_LINE_FIXTURE), F.col("text"))).alias("out"))


@query("apply_text_fn", "SELECT doc_id, lower(text) AS out FROM documents")
def apply_text_fn(spark, sf):
    """UDF-1: a caller function as an Arrow pandas UDF; checked against its native twin."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", T.apply_text_fn(F.col("text"), lambda s: s.str.lower()).alias("out"))


def balanced_accuracy(df):
    """An example caller metric (UDF-2): mean recall over classes."""
    pc = M.per_class(M.confusion_matrix(df))
    return pc.agg(F.avg("recall").alias("balanced_accuracy"))


@query("custom_metric", """WITH p AS (SELECT quality AS label, 1 - toxic AS prediction FROM labels),
r AS (SELECT label, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS rec FROM p GROUP BY label)
SELECT round(avg(rec), 6) AS balanced_accuracy FROM r""")
def custom_metric(spark, sf):
    """UDF-2: metric callbacks are ``DataFrame -> DataFrame`` over (label, prediction)."""
    return round_doubles(M.custom_metric(tables.predictions(spark, sf), balanced_accuracy))


_XPL_TOKENS = f"""t AS (SELECT d.doc_id, u.tok FROM documents d, unnest({O.tokenize("lower(coalesce(d.text, 'nan'))")}) AS u(tok)),
x AS (SELECT doc_id, tok, CAST(count(*) AS DOUBLE) AS v FROM t WHERE regexp_full_match(tok, '\\p{{L}}+') GROUP BY doc_id, tok),
nd AS (SELECT count(*) AS big_n FROM documents),
w AS (SELECT tok, (length(tok) % 5 - 2) / 10.0 AS weight FROM (SELECT DISTINCT tok FROM x)),
mu AS (SELECT x.tok, sum(x.v) / max(nd.big_n) AS mean FROM x CROSS JOIN nd GROUP BY x.tok)"""


@query("explain_linear", f"""WITH {_XPL_TOKENS},
base AS (SELECT 0.1 + sum(w.weight * mu.mean) AS base FROM w JOIN mu USING (tok)),
c AS (SELECT x.doc_id, sum(w.weight * (x.v - mu.mean)) AS nz, sum(w.weight * mu.mean) AS nzmean, count(*) AS n
  FROM x JOIN w USING (tok) JOIN mu USING (tok) GROUP BY x.doc_id),
m AS (SELECT x.doc_id, 0.1 + sum(w.weight * x.v) AS margin FROM x JOIN w USING (tok) GROUP BY x.doc_id)
SELECT d.doc_id, round(coalesce(m.margin, 0.1), 6) + 0.0 AS margin,
  round(b.base + coalesce(c.nz, 0.0) + ((b.base - 0.1) - coalesce(c.nzmean, 0.0)) * -1, 6) + 0.0 AS reconstructed,
  coalesce(c.n, 0) + 1 AS n_terms
FROM documents d CROSS JOIN base b LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""")
def explain_linear(spark, sf):
    """XPL-1: additive contributions ``w_j (x_j - mean_j)`` for a linear model with given
    weights (``(len(token) % 5 - 2) / 10``, bias 0.1) on word counts; per document the
    margin and ``base + sum(contributions)``, which must agree."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    toks = together(d, "doc_id").select("doc_id", F.explode(F.filter(C.K.tokenize_words(F.lower(T.null_text(F.col("text"), "nan"))),
                                                 lambda t: t.rlike(r"^\p{L}+$"))).alias("feature"))
    ensure_checkpoint_dir(spark)
    # the counts are read by every step below: tokenise once and go on from the written table
    x = toks.groupBy("doc_id", "feature").agg(F.count(F.lit(1)).cast("double").alias("value")).checkpoint()
    weights = written(x.select("feature").distinct().select(
        "feature", ((F.length("feature") % 5 - 2) / 10.0).alias("weight")), "weights")
    contrib, base = X.explain_linear(x, weights, 0.1, d.select("doc_id"))
    per_doc = contrib.groupBy("doc_id").agg(F.sum("contribution").alias("s"), F.count(F.lit(1)).alias("n_terms"))
    margins = X.linear_margin(x, weights, 0.1, d.select("doc_id"))
    out = margins.join(per_doc, "doc_id", "left").select(
        "doc_id", "margin", (F.lit(base) + F.coalesce(F.col("s"), F.lit(0.0))).alias("reconstructed"),
        F.coalesce(F.col("n_terms"), F.lit(1)).cast("bigint").alias("n_terms"))
    return round_doubles(out)


@query("explain_fitted")
def explain_fitted(spark, sf):
    """XPL-1 of the classifier trained on the labelled documents: of every document its margin, the sum of its
    tokens' contributions, and the token that weighs most."""
    from issuelens.operators import active as A
    docs = tables.table(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL")
    model = A.train_classifier(tables.labelled(spark, sf))
    contrib, base = X.explain_model(model, docs)
    per_doc = contrib.groupBy("doc_id").agg(
        F.sum("contribution").alias("s"), F.count(F.lit(1)).alias("n_tokens"),
        F.max_by("token", F.struct(F.round(F.abs("contribution"), 9), "token")).alias("top_token"))
    margins = model.transform(docs).select("doc_id", F.element_at(vector_to_array("rawPrediction"), 2).alias("margin"))
    return round_doubles(margins.join(per_doc, "doc_id", "left").select(
        "doc_id", "margin", (F.lit(base) + F.coalesce("s", F.lit(0.0))).alias("reconstructed"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "top_token"))


@query("explain_lime")
def explain_lime(spark, sf):
    """XPL-2: LIME-style token weights for every document (the operator's 50 masked
    variants each) under a text classifier trained on the labelled documents."""
    from issuelens.operators import active as A
    model = A.train_on_counts(tables.labelled(spark, sf))
    return round_doubles(X.explain_lime(model, tables.table(spark, sf, "documents").select("doc_id", "text")))
