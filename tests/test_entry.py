"""Driver contract: entry, registry and oracle parity on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"

FAST = ["label_issues", "label_with_methods", "clean_jira", "preprocess_labelling", "tfidf_top_terms",
        "stratified_split", "macro_metrics", "query_breaking_ties", "query_contrastive", "candidate_summary",
        "encode_sequences", "pick_new_seeds"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "Key", "Summary_Description_Original", "Summary_Description_Preprocessed",
                          "closest_keyword", "similarity_score", "label"]
    assert df.count() == 200


def test_every_sql_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_oracle_parity_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


def test_queries_without_the_training_data_operators(monkeypatch):
    """The other queries are there when the subpackage and its pipeline are gone."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    left = E.queries()
    assert "label_issues" in left and "pipeline" not in left and not any(k.startswith("op1_") for k in left)
    assert set(E.oracle_sql()) <= set(left)
