"""Quality rules, toxicity, language and compression: base counts against brute force, held-out accuracy, odd rows."""
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import common, compression, langid, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    label = np.asarray(label)
    return (rank[label == 1].mean() - (label.sum() - 1) / 2) / (len(label) - label.sum())


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def test_quality_base_counts(spark):
    got = queries.op5_quality_rules(spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_drops_junk(spark, labels):
    got = queries.op5_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    rows = np.array([0] * 5 + [2] * 7 + [3])
    for _ in range(30):
        emit, stay = rng.normal(size=len(rows)), rng.normal()
        got = quality_rules.viterbi(emit, stay, rows, 4)
        for r in (0, 2, 3):
            e = emit[rows == r]
            value = lambda p: sum(e[i] for i in range(len(p)) if p[i]) + sum(stay for a, b in zip(p, p[1:]) if a == b)
            best = max(value(p) for p in itertools.product((0, 1), repeat=len(e)))
            assert value(got[rows == r]) == pytest.approx(best)


def test_crf_gradient_finds_the_pattern():
    rng = np.random.default_rng(0)
    rows = np.repeat(np.arange(80), 6)
    y = np.repeat(np.arange(80) % 2, 6)
    x = np.zeros((480, len(quality_rules.FEATURES)))
    x[:, 0] = 1
    x[:, 2] = np.where(y == 0, 0.8, 0.1) + rng.normal(scale=0.05, size=480)
    weights, stay = quality_rules.train(x, y, rows)
    assert (quality_rules.viterbi(x @ weights, stay, rows, 80) == y).mean() > 0.97


def test_fold():
    assert toxicity.fold("1D10T іdіоt ｉｄｉｏｔ st​up1d") == " idiot idiot idiot stupid "
    assert toxicity.fold("c1own C|own") == toxicity.fold("clown clown")


def test_toxicity_exceptions_and_length():
    model = toxicity.Lexicon({" trash": 4.0, " idiot": 5.0}, ("trash can",))  # no l in them: entries are folded text
    search = model.automaton()
    assert toxicity.hits(search, toxicity.fold("a trash can")) == {}
    assert list(toxicity.hits(search, toxicity.fold("you trash idiot")).values()) == [4.0, 5.0]
    short, long = toxicity.fold("idiot"), toxicity.fold("idiot " + "word " * 2000)
    assert toxicity.level(toxicity.hits(search, short), short) > toxicity.level(toxicity.hits(search, long), long) > 0


def test_toxicity_words_after_other_signs():
    model = toxicity.Lexicon({" idiot": 5.0, " ass ": 3.0, " f*ck": 4.0, " ugi": 4.0}, ("trash can",))
    search = model.automaton()
    found = lambda text: sorted(toxicity.text_hits(search, toxicity.readings(text)).values())
    for sign in "\"'([{<-/*_¡¿«„“‘—…#~.,;:&%\\+=`|!@$2 ":
        assert found(f"x {sign}idiot{sign} y") == found(f"{sign * 3}idiot") == found(f"x{sign}idiot") == [5.0]
    assert found("idiot|idiot") == found("idiot*idiot") == [5.0] * 2
    assert found("you ass") == found("an (ass).") == found("ass!") == found("A$$") == found("@ss!!") == [3.0]
    assert found("assume a class, pass") == found("") == []
    assert found("f*ck it") == found("!f*ck!") == found("**f*ck**") == [4.0] and found("you*idiot") == [5.0]
    assert found("1d1ot, !diot |idiots|") == [5.0] * 3


def test_toxicity_learns_short_words(spark):
    from pyspark.sql import Row
    rows = [(i, f"w{chr(97 + i // 2 % 20)}ord some -{'sod' if i % 2 else 'sad'}- more") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([Row(doc_id=i, toxic=i % 2) for i in range(200)]))
    assert " sod " in model.weights
    got = {r.doc_id: r.hits for r in toxicity.score(docs, model).collect()}
    assert got[1] == 1 and got[2] == 0


def test_toxicity_held_out(spark, more, labels):
    out = toxicity.score(more, toxicity.fit(more, labels)).where(common.held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    assert auc(out.score, out.toxic) > 0.85


def test_compression_held_out(spark, more, labels):
    out = compression.score(more, compression.fit(more, labels)).where(common.held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    assert auc(out.score, out.quality) > 0.9


def test_language_held_out(spark):
    out = queries.op9_language_id(spark, SF).where("held_out").join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁a", "▁ab", "a", "b", "c", "bc", "abc", "▁"])
    prob = np.random.default_rng(0).random((pieces.n + 1, 2))
    prob[-1] = 0
    model = langid.Model(["x", "y"], pieces, prob)
    word = np.frombuffer(b"abc", np.uint8)
    got = np.exp(model.word_scores(word, np.array([0]), np.array([3])))[0]

    def ids(text, start):
        text = np.frombuffer(text.encode(), np.uint8)
        from issuelens.llm.textbytes import PrefixHash
        return int(pieces.find(PrefixHash(text).of(np.array([0]), np.array([len(text)])), start)[0])
    want = np.zeros(2)
    for cuts in itertools.product((0, 1), repeat=2):
        parts, at = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append("abc"[at:i])
                at = i
        for start in (True, False):  # the first piece with the mark in it, or after a mark of its own
            k = [ids(parts[0], start), *(ids(p, False) for p in parts[1:])]
            if min(k) >= 0:
                want += np.prod([prob[i] for i in k], axis=0) * (1 if start else prob[pieces.mark])
    assert got == pytest.approx(want)


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 17, 12345, -3)], "doc_id long")
    for r in df.select("doc_id", common.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_odd_rows(odd, none, no_labels, labels, more):
    models = {
        "rules": [lambda d, m=m: quality_rules.judge(d, m) for m in (quality_rules.fit(more, labels), quality_rules.fit(none, no_labels))],
        "score": [lambda d, m=m: compression.score(d, m) for m in (compression.fit(more, labels), compression.fit(none, no_labels))]
        + [lambda d, m=m: toxicity.score(d, m) for m in (toxicity.fit(more, labels), toxicity.fit(none, no_labels))],
    }
    for column, runs in models.items():
        for run in runs:
            out = run(odd)
            assert column in out.columns and len(out.columns) == len(set(out.columns))
            rows = out.collect()
            assert len(rows) == odd.count()
            if column == "score":
                assert all(0 <= r.score <= 1 for r in rows)
                empty = {r.score for r in rows if not r.text}
                assert len(empty) == 1
            else:
                assert not any(r.rules.kept for r in rows if not (r.text or "").strip())
            assert run(none).count() == 0


def test_language_odd_rows(odd, none, more):
    vocab = langid.vocabulary(common.tokenizer_path("piece_bpe_32k.model"))
    model = langid.fit(more, vocab)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert langid.identify(none, model).count() == 0
    bare = langid.fit(none.withColumn("lang", F.lit(None).cast("string")), vocab)
    assert {r.lang_pred for r in langid.identify(odd, bare).collect()} == {"und"}


def test_fits_on_long_texts_only(spark):
    """Languages and classes whose labelled texts are all long are learned too, from the whole text."""
    rng = np.random.default_rng(6)
    words = {"de": "und der nicht strasse wirklich schnell".split(), "en": "the and quickly really street not".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 6000)), lang) for i, lang in enumerate(["de", "en"] * 20)]
    assert min(len(t) for _, t, _ in rows) > langid.TRAIN_MAX_BYTES
    rows += [(1000, "nicht wirklich schnell und", None), (1001, "not really the street", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs, langid.vocabulary(common.tokenizer_path("piece_bpe_32k.model")))).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {i: ("de", "en")[i % 2] for i in range(40)} | {1000: "de", 1001: "en"}
    labels = docs.where("doc_id < 1000").selectExpr("doc_id", "doc_id % 2 AS quality")
    scores = compression.score(docs, compression.fit(docs, labels)).collect()
    assert min(r.score for r in scores if r.doc_id < 1000 and r.doc_id % 2) > max(r.score for r in scores if r.doc_id < 1000 and not r.doc_id % 2)


def test_lines_of_long_documents_are_used_in_stretches():
    row = np.repeat([0, 1, 2], [150, 1000, 201])
    use = quality_rules.in_stretches(row, 3)
    assert np.bincount(row[use]).tolist() == [150, 200, 200]
    at = np.flatnonzero(use[150:1150])
    assert at[0] == 0 and at[-1] == 999 and (np.diff(at) > 1).sum() == 3
