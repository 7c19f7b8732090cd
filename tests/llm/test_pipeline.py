"""The pipeline's stages: columns, order, effect of each decision, odd and empty tables."""
import corpus_pipeline
from issuelens.llm import decontam, quality_rules, stages
from tests.llm.test_dedup import near_groups, without_repeated_words

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == names
        old = {r.doc_id: r for r in before.collect()}
        rows = after.collect()
        if name == "quality_rules":
            judged = quality_rules.quality_rules(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in rows} == {r.doc_id for r in judged.where("rules.kept").collect()}
        elif name == "ngram_jaccard_join":
            pairs = [(i, r.text) for i, r in old.items()]
            assert {r.doc_id for r in rows} == {c if n else i for i, n, c in near_groups(pairs)}
        elif name == "suffix_array_dedup":
            want = dict(zip(old, without_repeated_words([r.text for r in old.values()], 50)))
            assert len(rows) == len(old) and want != {i: r.text for i, r in old.items()}
            for r in rows:
                assert r.n_chars == len(r.text) and r.text == want[r.doc_id]
        elif name == "benchmark_decontamination":
            dirty = {r.doc_id for r in decontam.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert dirty and {r.doc_id for r in rows} == old.keys() - dirty
        else:
            assert {r.doc_id for r in rows} == old.keys()
        before = after


def test_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in stages.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "best_fit_packing" or out.columns == docs.columns
            out.collect()


def test_one_row_of_each_near_duplicate_group(spark):
    """Unlike texts with one id stay, copies go whatever their ids, and of rows that repeat one stays."""
    from issuelens.llm.stages import stage_near_duplicates
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (2, c), (2, c), (None, c), (None, b + " more"), (None, "lone words"), (5, "lone words"), (None, "x"),
            (None, "x"), (6, None), (6, None), (7, " "), (7, " ")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(4)
    got = stage_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, a), (1, b), (2, c), (5, "lone words"), (None, "x"), (6, None), (6, None), (7, " "), (7, " ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
