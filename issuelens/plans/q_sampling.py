"""Registered queries: splits and samples (SMP-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.operators import sampling as S
from issuelens.plans.catalog import query
from issuelens.sources import tables

_LAB = "SELECT d.doc_id, l.quality AS label FROM documents d JOIN labels l USING (doc_id)"
_KEY = "md5('42:' || CAST(doc_id AS VARCHAR))"

_QUOTA_SQL = f"""l AS ({_LAB}),
c AS (SELECT label, count(*) AS n FROM l GROUP BY label),
tot AS (SELECT sum(n) AS total_n, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS T FROM c),
q0 AS (SELECT label, n, (n * T) // total_n AS fl, (n * T) % total_n AS rem, T FROM c, tot),
q AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
  <= max(T) OVER () - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM q0)"""


@query("stratified_split", f"""WITH {_QUOTA_SQL},
r AS (SELECT l.doc_id, l.label, row_number() OVER (PARTITION BY l.label ORDER BY {_KEY}, l.doc_id) AS rk FROM l)
SELECT r.doc_id, r.label, CASE WHEN r.rk <= q.quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN q USING (label)""")
def stratified_split(spark, sf):
    lab = tables.labelled(spark, sf).select("doc_id", "label")
    return S.stratified_split(lab, "label", "doc_id").select("doc_id", "label", "split")


@query("random_split", f"""WITH l AS ({_LAB}),
r AS (SELECT doc_id, label, row_number() OVER (ORDER BY {_KEY}, doc_id) AS rk, count(*) OVER () AS n FROM l)
SELECT doc_id, label, CASE WHEN rk <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def random_split(spark, sf):
    lab = tables.labelled(spark, sf).select("doc_id", "label")
    return S.random_split(lab, "doc_id").select("doc_id", "label", "split")


@query("sample_n", f"SELECT doc_id, source FROM documents ORDER BY {_KEY}, doc_id LIMIT 100")
def sample_n(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "source")
    return S.sample_n(d, 100, "doc_id", fixed.SEED)


@query("random_initial_pool", """SELECT vec_id AS doc_id, label FROM embeddings
ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100""")
def random_initial_pool(spark, sf):
    """SMP-4: the first labelled set, uniform random without replacement (n=100)."""
    p = tables.pool(spark, sf).select("doc_id", "label")
    return S.sample_n(p, fixed.QUERY_SIZE, "doc_id", fixed.SEED)


def _rep_sql() -> str:
    return f"""WITH l AS (SELECT d.doc_id, d.source, lb.quality AS label FROM documents d JOIN labels lb USING (doc_id)),
nn AS (SELECT count(*) AS total_n FROM l),
sz AS (SELECT CAST(ceil((1.96 * 1.96 * 0.5 * 0.5 / (0.05 * 0.05)) / (1 + ((1.96 * 1.96 * 0.5 * 0.5 / (0.05 * 0.05)) - 1) / total_n))
  AS BIGINT) AS T, total_n FROM nn),
st AS (SELECT doc_id, source || chr(1) || CAST(label AS VARCHAR) AS stratum FROM l),
c AS (SELECT stratum, count(*) AS n FROM st GROUP BY stratum),
q0 AS (SELECT stratum, (n * T) // total_n AS fl, (n * T) % total_n AS rem, T FROM c, sz),
q AS (SELECT stratum, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, stratum)
  <= max(T) OVER () - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_KEY}, doc_id) AS rk FROM st)
SELECT r.doc_id FROM r JOIN q USING (stratum) WHERE r.rk <= q.quota"""


@query("representative_sample", _rep_sql())
def representative_sample(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "source")
    lab = d.join(tables.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return S.representative_sample(lab, ["source", "label"], "doc_id").select("doc_id")
