"""Registered queries: keyword-similarity labelling (LBL-*, PRJ-5, FLT-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.operators import labelling as L
from issuelens.plans import oracle as O
from issuelens.plans.catalog import query, round_doubles
from issuelens.sources import tables


@query("label_issues", O.label_issues_sql())
def label_issues(spark, sf):
    """LBL-3 flagship: every document labelled by its closest keyword."""
    iss = tables.issues(spark, sf)
    return round_doubles(L.label_issues(iss, fixed.KEYWORDS["seed_expansion"], keep=["doc_id"]))


@query("label_issues_by_terms", O.label_issues_sql())
def label_issues_by_terms(spark, sf):
    """LBL-1 / LBL-3 by the term dictionary: every distinct chunk scored once, joined back to the documents."""
    return round_doubles(L.label_issues(tables.issues(spark, sf), fixed.KEYWORDS["seed_expansion"], keep=["doc_id"], scoring="terms"))
