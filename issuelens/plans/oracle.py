"""DuckDB twins of the registered queries (the correctness oracle).

The oracle is written relationally on purpose (unnest, joins, window ranks),
while the Spark plans mostly work inside the row, so the two formulations
check each other. Literal tables (keywords, lexicon, stop lists) come from
``issuelens.fixed``, the same source the Spark side reads.

DuckDB notes: RE2 regex (no look-around; ``(?U)`` would mean ungreedy), the
``'g'`` flag for replace-all, ``lambda x: ...`` syntax, ``sum(int)`` is
HUGEINT (always cast).
"""

from __future__ import annotations

from collections import Counter

from issuelens import fixed
from issuelens.functions import text as T
from issuelens.functions import tokens as K
from issuelens.functions.vectors import py_char_grams


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "(" + ", ".join(lit(x) for x in items) + ")"


def str_array(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def values(rows, names, alias: str = "t") -> str:
    """A ``(VALUES ...) AS alias(names)`` table expression."""
    def one(v):
        if isinstance(v, str):
            return lit(v)
        if v is None:
            return "NULL"
        return repr(v)
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(names)})"


def rx_replace(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)}, 'g')"


# -- cleaning expressions ----------------------------------------------------

def clean_labelling(e: str) -> str:
    e = rx_replace(e, T.CAMEL_RE2, "")
    e = rx_replace(e, T.URL, "")
    e = rx_replace(e, T.FENCED, "")
    e = rx_replace(e, T.INLINE, "")
    return f"lower({e})"


def clean_jira(e: str, strict: bool = False) -> str:
    e = f"lower({e})"
    e = rx_replace(e, T.JIRA_CODE_STRICT if strict else T.JIRA_CODE, " ")
    e = rx_replace(e, T.JIRA_NOFORMAT, " ")
    e = rx_replace(e, T.JIRA_COLOR, "")
    e = rx_replace(e, T.URL, " ")
    e = rx_replace(e, T.NEWLINES, " ")
    return collapse_ws(e)


def collapse_ws(e: str) -> str:
    return f"trim({rx_replace(e, T.WS + '+', ' ')})"


def clean_ascii(e: str) -> str:
    e = f"lower({e})"
    e = rx_replace(e, T.NON_ASCII, "")
    e = rx_replace(e, T.DIGITS, "")
    return f"translate({e}, {lit(fixed.PUNCT)}, '')"


def tokenize(e: str) -> str:
    return f"regexp_extract_all({e}, {lit(K.TOKEN_PATTERN)})"


def split_words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, {lit(T.WS + '+')}), lambda x: x <> '')"


def rule_pos(tok: str) -> str:
    return (f"CASE WHEN regexp_full_match({tok}, {lit(K.NUM_TOKEN[1:-1])}) THEN 'NUM' "
            f"WHEN regexp_full_match({tok}, {lit(K.SYM_TOKEN[1:-1])}) THEN 'SYM' ELSE 'NOUN' END")


def lexicon_table(alias: str = "x") -> str:
    return values(fixed.default_lexicon(), ["ltok", "lpos", "llemma"], alias)


def issues_cte() -> str:
    """issues view of ``documents`` (same mapping as ``sources.tables``)."""
    nl = "strpos(text, chr(10))"
    return (f"issues AS (SELECT doc_id, 'DOC-' || CAST(doc_id AS VARCHAR) AS \"Key\", source AS project, "
            f"CASE WHEN {nl} > 0 THEN substr(text, 1, {nl} - 1) ELSE text END AS summary, "
            f"CASE WHEN {nl} > 0 THEN substr(text, {nl} + 1) END AS description FROM documents)")


def labelling_token_ctes(src: str, text_col: str) -> str:
    """CTEs ``ltok(doc_id, pos, lemma)`` = preprocess_labelling, 1-based ``pos``
    renumbered after filtering, and ``lpre(doc_id, pre)`` = rejoined text."""
    stop = K.stop_list(keep=fixed.STOPWORD_WHITELIST)
    return f"""
raw_tok AS (SELECT s.doc_id, t.tok, t.pos FROM {src} s,
    unnest({tokenize(clean_labelling(text_col))}) WITH ORDINALITY AS t(tok, pos)),
tagged AS (SELECT r.doc_id, r.pos, coalesce(x.lpos, {rule_pos('r.tok')}) AS tag,
    trim(coalesce(x.llemma, r.tok)) AS lemma
    FROM raw_tok r LEFT JOIN {lexicon_table('x')} ON x.ltok = r.tok
    WHERE r.tok NOT IN {str_list(stop)} AND NOT regexp_full_match(r.tok, {lit(K.PUNCT_TOKEN[1:-1])})),
kept AS (SELECT doc_id, pos, lemma FROM tagged
    WHERE tag IN {str_list(fixed.POS_LABELLING)} AND lemma <> '' AND strpos({lit(fixed.PUNCT)}, lemma) = 0),
ltok AS (SELECT doc_id, lemma, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS pos FROM kept),
lpre AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS pre FROM ltok GROUP BY doc_id)"""


def keyword_ctes(groups: dict[str, list[str]]) -> str:
    """``kw(grp, kid, keyword)``, ``kwg(grp, kid, gram, kcnt)``, ``kwn(grp, kid, kn2)``."""
    kw_rows, g_rows, n_rows = [], [], []
    for g, kws in groups.items():
        for i, k in enumerate(kws):
            c = Counter(py_char_grams(k))
            kw_rows.append((g, i, k))
            n_rows.append((g, i, sum(v * v for v in c.values())))
            g_rows.extend((g, i, gram, n) for gram, n in sorted(c.items()))
    return (f"kw AS (SELECT * FROM {values(kw_rows, ['grp', 'kid', 'keyword'])}),\n"
            f"kwg AS (SELECT * FROM {values(g_rows, ['grp', 'kid', 'gram', 'kcnt'])}),\n"
            f"kwn AS (SELECT * FROM {values(n_rows, ['grp', 'kid', 'kn2'])})")


def term_sims_ctes(terms_src: str) -> str:
    """``tsim(term, grp, kid, keyword, sim)``: rounded trigram cosine of each
    distinct term of ``terms_src(term)`` to each keyword, relationally."""
    return f"""
tgrams AS (SELECT term, unnest(list_transform(range(1, length('^' || term || '$') - 1),
    lambda i: substr('^' || term || '$', i, 3))) AS gram FROM (SELECT DISTINCT term FROM {terms_src})),
tgc AS (SELECT term, gram, count(*) AS cnt FROM tgrams GROUP BY term, gram),
tn AS (SELECT term, sum(cnt * cnt) AS n2 FROM tgc GROUP BY term),
tdot AS (SELECT c.term, k.grp, k.kid, sum(c.cnt * k.kcnt) AS dot FROM tgc c JOIN kwg k USING (gram)
    GROUP BY c.term, k.grp, k.kid),
tsim AS (SELECT n.term, w.grp, w.kid, w.keyword,
    CAST(coalesce(d.dot, 0) AS DOUBLE) / sqrt(CAST(n.n2 * kn.kn2 AS DOUBLE)) AS sim
    FROM tn n CROSS JOIN kw w JOIN kwn kn ON kn.grp = w.grp AND kn.kid = w.kid
    LEFT JOIN tdot d ON d.term = n.term AND d.grp = w.grp AND d.kid = w.kid),
tbest AS (SELECT term, grp, kid, keyword, sim FROM (SELECT *, row_number() OVER
    (PARTITION BY term, grp ORDER BY sim DESC, kid) AS rk FROM tsim) WHERE rk = 1)"""


def label_issues_sql(keywords=fixed.KEYWORDS["seed_expansion"], threshold=fixed.THRESHOLD) -> str:
    return f"""WITH {issues_cte()},
orig AS (SELECT doc_id, "Key", coalesce(summary, '') || ' - ' || coalesce(description, '') AS o FROM issues),
{labelling_token_ctes('orig', 's.o')},
{keyword_ctes({'keywords': list(keywords)})},
{term_sims_ctes('(SELECT lemma AS term FROM ltok)')},
dbest AS (SELECT doc_id, keyword, sim FROM (SELECT l.doc_id, b.keyword, b.sim, row_number() OVER
    (PARTITION BY l.doc_id ORDER BY b.sim DESC, l.pos) AS rk FROM ltok l JOIN tbest b ON b.term = l.lemma)
    WHERE rk = 1)
SELECT o.doc_id, o."Key", o.o AS Summary_Description_Original,
    coalesce(p.pre, '') AS Summary_Description_Preprocessed,
    coalesce(d.keyword, '') AS closest_keyword,
    round(coalesce(d.sim, 0.0), 6) AS similarity_score,
    CASE WHEN coalesce(d.sim, 0.0) > {threshold!r} THEN {lit(fixed.LABEL_POS)} ELSE {lit(fixed.LABEL_NEG)} END AS label
FROM orig o LEFT JOIN lpre p USING (doc_id) LEFT JOIN dbest d USING (doc_id)"""
