"""Language detection, code-run rule, linear explanations, optional rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.functions import text as T
from issuelens.operators import explain as X
from issuelens.operators import language as LG


def test_language_detection_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    d = d.withColumn("_train", F.md5(F.concat(F.lit("lang:"), F.col("doc_id").cast("string"))) < F.lit("8"))
    prof, unseen = LG.train_profile(d.filter("_train"))
    ev = d.filter(~F.col("_train"))
    out = ev.join(LG.detect_language(ev, prof, unseen), "doc_id")
    acc = out.select(F.avg((F.col("lang") == F.col("detected")).cast("double"))).collect()[0][0]
    assert acc > 0.9


def test_drop_code_runs(spark):
    s = "import a.b;\npublic class X {\nprose stays\n@Override\n  \nend line\n}\n;"
    df = spark.createDataFrame([(s,)], "t string")
    out = df.select(T.drop_code_runs(F.col("t"))).collect()[0][0]
    assert out == "prose stays @Override end line"


def test_optional_rules_named_subset(spark):
    df = spark.createDataFrame([("[info] build\nkeep\n{{x}} y",)], "t string")
    out = df.select(T.optional_line_rules(F.col("t"), ["info_lines", "double_brace"])).collect()[0][0]
    assert "build" not in out and "keep" in out and "{{" not in out


def test_linear_explanation_adds_up(spark):
    x = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "b", 3.0)], "doc_id long, feature string, value double")
    w = spark.createDataFrame([("a", 0.5), ("b", -0.25), ("c", 1.0)], "feature string, weight double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    contrib, base = X.explain_linear(x, w, 0.1, docs)
    sums = {r[0]: r[1] for r in contrib.groupBy("doc_id").agg(F.sum("contribution")).collect()}
    margins = {r[0]: r[1] for r in X.linear_margin(x, w, 0.1, docs).collect()}
    for d in (1, 2, 3):
        assert abs(base + sums[d] - margins[d]) < 1e-12


def test_fitted_explanation_adds_up_to_the_model(spark):
    """Base and contributions are the raw prediction, also where tokens share one of few hashed features."""
    from pyspark.ml.functions import vector_to_array
    from issuelens.operators import active as A
    rows = [(i, ("refactor module " if i % 2 else "weather ") + f"common words here w{i % 9} " + "again " * (i % 3), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows + [(60, "", 0), (61, "the", 1)], "doc_id long, text string, label int")
    for size in (1 << 14, 4):
        model = A.train_classifier(df, A.text_pipeline(num_features=size))
        contrib, base = X.explain_model(model, df)
        got = {}
        for r in contrib.collect():
            got.setdefault(r.doc_id, {})[r.token] = r.contribution
        raw = model.transform(df).select("doc_id", vector_to_array("rawPrediction")[1].alias("m")).collect()
        assert all(abs(base + sum(got.get(r.doc_id, {}).values()) - r.m) < 1e-9 for r in raw) and 60 not in got
        tf, idf, lr = model.stages[2], model.stages[3].idf.toArray(), model.stages[4]
        for token, value in got[2].items():
            j = tf.indexOf(token)
            assert abs(value - dict(zip(*np.unique(rows[2][1].split(), return_counts=True)))[token] * idf[j] * lr.coefficients[j]) < 1e-9
    assert max(contrib.collect(), key=lambda r: r.doc_id).doc_id <= 61


def test_lime_recovers_the_decisive_token(spark):
    from issuelens.operators import active as A
    rows = [(i, ("refactor " if i % 2 else "weather ") + "common words here " + str(i % 7), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = A.train_classifier(df)
    out = X.explain_lime(model, df.filter("doc_id < 4").select("doc_id", "text"), n_samples=40).collect()
    top = {r["doc_id"]: r["token"] for r in out if r["rank"] == 1}
    assert top == {0: "weather", 1: "refactor", 2: "weather", 3: "refactor"}
    assert all(r["rank"] <= 10 for r in out)


def test_lime_against_brute_force_without_a_shuffle(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from issuelens.operators import active as A
    rows = [(i, ("refactor " if i % 2 else "weather ") + "common words here " + str(i % 7), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = A.train_classifier(df)
    long = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, rows[1][1]), (2, rows[2][1]), (2, "refactor here"), (3, None), (4, "refactor " + long), (5, "")],
                                 "doc_id long, text string").coalesce(1)
    got = X.explain_lime(model, docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # an issue goes over several batches
    try:
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id for r in got} >= {1, 2, 4} and 3 not in {r.doc_id for r in got}
    for doc_id, text in ((1, rows[1][1]), (2, rows[2][1]), (2, "refactor here"), (4, "refactor " + long)):
        one = spark.createDataFrame([(doc_id, text)], "doc_id long, text string")
        var = (model.transform(X.lime_variants(one)).select("v", "toks", "kept", vector_to_array("probability")[1].alias("p"))
               .orderBy("v").collect())
        assert len(var) == 50
        x = np.array([r.kept for r in var], float)
        y = np.array([r.p for r in var])
        w = np.sqrt(np.exp(-(100 * (1 - np.sqrt(x.mean(axis=1)))) ** 2 / 625))
        full = np.column_stack([x, np.ones(len(x))])  # the intercept is not penalised
        beta = np.linalg.solve(full.T @ (w[:, None] * full) + np.diag([1.0] * x.shape[1] + [0.0]), full.T @ (w * y))
        want = {t: (b, beta[-1]) for t, b in zip(var[0].toks, beta)}
        mine = [r for r in got if r.doc_id == doc_id and r.token in want and abs(r.intercept - beta[-1]) < 1e-7]
        assert len(mine) == min(10, len(want))
        assert all(abs(r.weight - want[r.token][0]) < 1e-7 for r in mine)
        assert sorted(round(abs(r.weight), 7) for r in mine) == sorted(sorted((round(abs(b), 7) for b, _ in want.values()))[-10:])


def test_lime_query_explains_all_documents(spark):
    from issuelens.plans import q_misc
    from issuelens.sources import tables
    docs = tables.table(spark, "/root/testdata/sf0.001", "documents").where("length(trim(text)) > 0").select("doc_id")
    assert q_misc.explain_lime(spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() == docs.distinct().count()


def test_lime_masks_are_deterministic(spark):
    df = spark.createDataFrame([(1, "a b c a")], "doc_id long, text string")
    v1 = sorted((r["v"], tuple(r["kept"]), r["text"]) for r in X.lime_variants(df, n_samples=5).collect())
    v2 = sorted((r["v"], tuple(r["kept"]), r["text"]) for r in X.lime_variants(df.repartition(3), n_samples=5).collect())
    assert v1 == v2
    assert v1[0] == (0, (True, True, True), "a b c a")


def test_lime_scores_each_word_once(spark, monkeypatch):
    """a model whose raw prediction adds up over words gives the same rows without any text of a variant."""
    from issuelens.operators import active as A
    rows = [(i, ("refactor " if i % 2 else "weather ") + "common-words here, Here " + str(i % 7), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = A.train_classifier(df)
    docs = spark.createDataFrame([(1, rows[1][1] + " refactor refactor"), (2, "weather here ... the"), (None, "refactor here"),
                                  (3, None), (4, "weather " + " ".join(f"w{i}-here" for i in range(70))), (5, " ")],
                                 "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(X, "adds_up_over_words", lambda model: False)
        want = X.explain_lime(model, docs).orderBy("doc_id", "rank").collect()

    def no_variants(*args, **kwargs):
        raise AssertionError("a text for each variant")
    monkeypatch.setattr(X, "lime_variants", no_variants)
    got = X.explain_lime(model, docs).orderBy("doc_id", "rank").collect()
    assert [r[:3] for r in got] == [r[:3] for r in want] and {r.doc_id for r in got} == {None, 1, 2, 4}
    assert all(abs(a.weight - b.weight) < 1e-9 and abs(a.intercept - b.intercept) < 1e-9 for a, b in zip(got, want))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouping_of_counts_shuffles_whole_rows(spark, monkeypatch):
    """rows are dealt out by id before they are exploded, so their counts are grouped without another shuffle."""
    from issuelens.session import together
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (1, "a")], "doc_id long, text string")
    x = together(df, "doc_id").select("doc_id", F.explode(F.split("text", " ")).alias("feature")).groupBy("doc_id", "feature").count()
    assert _plan(x).count("Exchange") == 1
    assert sorted(map(tuple, x.collect())) == [(1, "a", 3), (1, "b", 1), (2, "b", 1)]
    from issuelens.plans import catalog
    calls, real = [], X.together if hasattr(X, "together") else None
    monkeypatch.setattr(X, "together", lambda df, *c: (calls.append(c), real(df, *c))[1])
    from issuelens.operators import active as A
    model = A.train_classifier(spark.createDataFrame([(0, "good day", 0), (1, "bad rain", 1)] * 4, "doc_id long, text string, label int"))
    contrib, base = X.explain_model(model, spark.createDataFrame([(5, "bad bad day"), (5, "day")], "doc_id long, text string"))
    assert calls == [("doc_id",)] and sorted((r.doc_id, r.token, r["count"]) for r in contrib.collect()) == [(5, "bad", 2.0), (5, "day", 2.0)]


def test_trigrams_are_counted_in_the_row(spark):
    """one row for each distinct trigram of a row, and one join whatever the number of languages."""
    from issuelens.operators import language as LG
    df = spark.createDataFrame([(1, "Abab ab!", "x"), (2, None, "x"), (3, "\U0001F600é", "y"), (3, "xyz\U00010400z", None)],
                               "doc_id long, text string, lang string")
    counts = LG.trigram_counts(df)
    code = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    want = [(1, code(g), n) for g, n in (("aba", 1), ("bab", 1), ("ab ", 1), ("b a", 1), (" ab", 1))]
    want += [(3, code(g), 1) for g in ("xyz", "yz\U00010428", "z\U00010428z")]
    assert sorted(map(tuple, counts.collect())) == sorted(want) and "Exchange" not in _plan(counts)
    prof, unseen = LG.train_profile(df)
    out = LG.detect_language(df, prof, unseen)
    assert _plan(out).count("Generate") == 0
    assert {r.doc_id: r.detected for r in out.collect()}[1] == "x"


def test_fuzzy_rows_are_made_once(spark):
    """what makes the terms runs once, not for each of the three reads of the join."""
    from issuelens.operators import fuzzy as FZ
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    rows = spark.createDataFrame([("refactor",), ("weather",), (None,)], "phrase string").mapInArrow(count, "phrase string")
    known = spark.createDataFrame([("refactors",)], "keyword string")
    assert {r.phrase for r in FZ.fuzzy_anti_join(rows, known).collect()} == {"weather", None} and made.value == 3


def test_sequences_are_regrouped_without_a_shuffle_of_tokens(spark):
    """documents are dealt out before their tokens are exploded."""
    from issuelens.operators import lexicon as LX
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c"])], "doc_id long, tokens array<string>")
    out = LX.encode_sequences(df, "tokens", vocab_size=2, max_length=2)
    assert {r.doc_id: list(r.input_ids) for r in out.collect()} == {1: [2, 3], 2: [0, 0], 3: [0, 0], 4: [1, 0]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan


@pytest.mark.parametrize("chunk", [7, 32_768])
def test_first_bits_of_many_digests(monkeypatch, chunk):
    """every message's first bit as hashlib gives it, of one block or more, numbers of one to three digits."""
    import hashlib
    import numpy as np
    from issuelens.functions import md5bits
    monkeypatch.setattr(md5bits, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    heads = [b"42:7:", b"42:", b"42:-123456789012:", "sé:".encode(), b"42:8:"]
    sizes = [40, 11, 30, 5, 0]
    tokens = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in [*range(0, 70), *rng.integers(1, 9, 16).tolist()]]
    for n in (1, 2, 10, 50, 120):
        got = md5bits.first_bits_clear(heads, sizes, tokens, n)
        of = np.repeat(np.arange(len(heads)), sizes)
        want = [[v == 0 or hashlib.md5(heads[of[i]] + f"{v}:".encode() + t).digest()[0] < 128 for i, t in enumerate(tokens)] for v in range(n)]
        assert got.shape == (n, len(tokens)) and (got == np.array(want)).all()
    assert md5bits.first_bits_clear([], [], [], 50).shape == (50, 0)


def test_training_on_counts_is_training_on_texts(spark):
    """the same weights from words counted once."""
    import numpy as np
    from issuelens.operators import active as A
    from issuelens.operators import explain as X
    from issuelens.sources import tables
    lab = tables.labelled(spark, "/root/testdata/sf0.001")
    a, b = A.train_classifier(lab), A.train_on_counts(lab)
    assert X.adds_up_over_words(b)
    assert np.allclose(a.stages[-1].coefficients.toArray(), b.stages[-1].coefficients.toArray(), atol=1e-7)
