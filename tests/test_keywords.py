"""Keyword extraction: fuzzy ratio, MMR invariants, TF-IDF against a brute-force twin."""

from math import sqrt
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.operators import fuzzy as FZ
from issuelens.operators import keywords as KW
from issuelens.functions.vectors import py_char_grams
from issuelens.operators import mmr


def test_fuzzy_fixture_ratios(spark):
    pairs = [("refactor", "refactoring", 84), ("move", "remove", 80), ("update", "updates", 92)]
    for a, b, r in pairs:
        assert KW.py_fuzz_ratio(a, b) == r
    df = spark.createDataFrame([(a,) for a, _, _ in pairs], "phrase string")
    kept = {r[0] for r in KW.fuzzy_exclude(df, ["refactoring", "remove", "updates"]).collect()}
    assert kept == {"refactor", "move"}


def test_bit_parallel_lcs_matches_dp(spark):
    import random
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12))) for _ in range(200)]
    kw = "abcabdeab"
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [r[0] for r in df.select(KW._lcs_len(F.col("t"), kw)).collect()]

    def lcs_dp(a, b):
        prev = [0] * (len(b) + 1)
        for ch in a:
            cur = [0]
            for j, cb in enumerate(b):
                cur.append(prev[j] + 1 if ch == cb else max(prev[j + 1], cur[j]))
            prev = cur
        return prev[-1]
    assert got == [lcs_dp(w, kw) for w in words]


def test_mmr_subset_and_order(spark):
    toks = ["alpha", "beta", "alpha", "gamma", "delta", "beta", "epsilon"]
    sel = KW.mmr_select(toks, 1, 4, 0.5)
    cands = list(dict.fromkeys(toks))
    assert [r for r, _, _ in sel] == [1, 2, 3, 4]
    assert len({p for _, p, _ in sel}) == 4 and all(p in cands for _, p, _ in sel)
    assert KW.mmr_select(["a"], 2, 5, 0.5) == []
    assert len(KW.mmr_select(toks, 1, 50, 0.5)) == len(cands)


def test_mmr_distributed_equals_local(spark):
    rows = [(1, ["move", "code", "module", "move"]), (2, ["update", "dependency"]), (3, [])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    got = sorted(tuple(r) for r in KW.mmr_keywords(df, "tokens", n=1, top_n=3).collect())
    want = sorted((d, r, p, s) for d, t in rows for r, p, s in KW.mmr_select(t, 1, 3, 0.5))
    assert got == want


def _tfidf_brute(docs, n=3, max_features=1000, top_n=25):
    import re
    stop = set(fixed.ENGLISH_STOPWORDS)
    grams = {}
    for d, t in docs:
        toks = [x for x in re.findall(r"\w{2,}", t) if x not in stop]
        grams[d] = [" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1)]
    big_n = len(docs)
    c = Counter(g for gs in grams.values() for g in gs)
    vocab = set(sorted(c, key=lambda g: (-c[g], g))[:max_features])
    dfq = Counter(g for gs in grams.values() for g in set(gs) if g in vocab)
    score = Counter()
    for d, gs in grams.items():
        tf = Counter(g for g in gs if g in vocab)
        w = {g: v * (math.log((1 + big_n) / (1 + dfq[g])) + 1) for g, v in tf.items()}
        nrm = math.sqrt(sum(x * x for x in w.values()))
        for g, x in w.items():
            score[g] += x / nrm / big_n
    return sorted(score.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:top_n]


def test_tfidf_matches_brute_force(spark):
    docs = [(i, " ".join(f"w{(i * j) % 7} x{j % 5} y{(i + j) % 3}" for j in range(10))) for i in range(30)]
    docs.append((99, "no grams"))
    df = spark.createDataFrame(docs, "doc_id long, preprocessed string")
    got = [(r["gram"], round(r["score"], 9)) for r in KW.tfidf_top_terms(df).orderBy("rank").collect()]
    want = [(g, round(s, 9)) for g, s in _tfidf_brute(docs)]
    assert [g for g, _ in got] == [g for g, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))


def test_expand_keywords_grows_and_excludes_known(spark):
    rows = [(i, ["moving", "mover", "refactoring", "zebra", "updated", "module", "modules", "coupling"])
            for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    added = KW.expand_keywords(df, fixed.SEED_KEYWORDS, rounds=2)
    words = [a[0] for a in added]
    assert len(words) == len(set(words)) <= 6
    assert not set(words) & set(fixed.SEED_KEYWORDS)
    for w in words:
        assert all(KW.py_fuzz_ratio(w, s) <= 85 for s in fixed.SEED_KEYWORDS)


def test_fuzzy_keywords_of_any_length(spark):
    """Keywords beyond the 64-bit recurrence give the same ratio as the plain table."""
    import random
    rng = random.Random(2)
    long = "".join(rng.choice("abcd") for _ in range(80))
    terms = [long, long[:70], long[5:] + "xx", long[::-1], "abc", "", long.replace("a", "b", 3)]
    df = spark.createDataFrame([(t,) for t in terms], "phrase string")
    for keyword in (long, long[:62], long[:63], long * 2):
        kept = {r.phrase for r in KW.fuzzy_exclude(df, [keyword]).collect()}
        assert kept == {t for t in terms if KW.py_fuzz_ratio(t, keyword) <= 85}


def test_mmr_takes_text_ids(spark):
    df = spark.createDataFrame([("K-1", ["move", "code", "module", "code"]), ("K-2", ["fix"]), (None, [])],
                               "Key string, tokens array<string>")
    got = KW.mmr_keywords(df, "tokens", "Key", n=1, top_n=2).collect()
    assert {r.Key for r in got} == {"K-1", "K-2"} and all(r["rank"] in (1, 2) for r in got)


def _random_words(rnd, n, longest):
    """Words and edited copies of them, with letters beyond ASCII, from 1 letter to ``longest``."""
    words = {"".join(rnd.choice("abcdefgé日") for _ in range(rnd.randint(1, longest))) for _ in range(n)}
    for w in list(words):
        letters = list(w)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(letters) + 1)
            if rnd.random() < 0.5:
                letters.insert(at, rnd.choice("abcx"))
            elif len(letters) > 1 and at < len(letters):
                del letters[at]
        words.add("".join(letters))
    return sorted(words)


@pytest.mark.parametrize("longest,cutoff", [(9, 85), (24, 85), (24, 67), (90, 90)])
def test_fuzzy_pairs_equal_all_pairs(spark, longest, cutoff):
    rnd = random.Random(longest)
    words = _random_words(rnd, 150 if longest < 50 else 40, longest)
    known = _random_words(rnd, 20, longest) + [w + "a" for w in words[::3]]
    a = spark.createDataFrame([(w,) for w in [*words, *words[:5], None, ""]], "phrase string")
    b = spark.createDataFrame([(w,) for w in [*known, *known[:5], None, ""]], "keyword string")
    want = {(x, y) for x in words for y in known if KW.py_fuzz_ratio(x, y) > cutoff}
    got = [tuple(r) for r in FZ.fuzzy_pairs(a, b, cutoff=cutoff).collect()]
    assert len(got) == len(set(got)) and want and set(got) == want


def test_fuzzy_anti_join_of_ten_thousand_keywords(spark):
    """The plan does not grow with the keyword table, and its rows are those of the literal form."""
    rnd = random.Random(5)
    known = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 12))) for _ in range(10_000)]
    words = sorted({k[:2] + k[3:] for k in known[:300]} | {"".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300)})
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "phrase string, k int")
    table = spark.createDataFrame([(w,) for w in known], "keyword string")
    got = {r.phrase for r in FZ.fuzzy_anti_join(rows, table).collect()}
    near = {w for w in words for k in known if abs(len(w) - len(k)) <= 4 and KW.py_fuzz_ratio(w, k) > 85}
    assert got == set(words) - near and near and got
    plans = [FZ.fuzzy_anti_join(rows, t)._jdf.queryExecution().optimizedPlan().toString().count("\n") for t in (table, table.limit(10))]
    assert plans[0] <= plans[1]


def test_fuzzy_anti_join_odd_rows(spark):
    rows = spark.createDataFrame([("update", 1), ("upgrades", 2), ("", 3), (None, 4), ("update", 5)], "phrase string, keyword int")
    known = spark.createDataFrame([("updated",), (None,), ("",)], "keyword string")
    got = sorted((r.keyword, r.phrase) for r in FZ.fuzzy_anti_join(rows, known).collect())
    assert got == [(2, "upgrades"), (3, ""), (4, None)]
    assert FZ.fuzzy_anti_join(rows, known.limit(0)).count() == 5
    with pytest.raises(ValueError):
        FZ.fuzzy_pairs(rows, known, cutoff=50)


def _plain_mmr(tokens, n, top_n, diversity, seeds):
    """MMR with dictionaries, all similarities anew in each step."""
    def unit(word):
        c = Counter(f"^{word}$"[i:i + 3] for i in range(len(word)))
        length = math.sqrt(sum(v * v for v in c.values()))
        return {g: v / length for g, v in c.items()}

    def mean(vectors):
        out = Counter()
        for v in vectors:
            for g, x in v.items():
                out[g] += x / len(vectors)
        return out

    def dot(a, b):
        return sum(x * b.get(g, 0.0) for g, x in a.items())

    grams = [tokens[i:i + n] for i in range(len(tokens) - n + 1)]
    if not grams:
        return []
    phrases = list(dict.fromkeys(" ".join(g) for g in grams))
    raw = {p: mean([unit(w) for w in p.split(" ")]) for p in phrases}
    vec = {p: {g: x / math.sqrt(dot(v, v)) for g, x in v.items()} for p, v in raw.items()}
    doc = mean([raw[" ".join(g)] for g in grams])
    if seeds:
        pull = mean([unit(s) for s in seeds])
        doc = {g: (3 * doc.get(g, 0.0) + pull.get(g, 0.0)) / 4 for g in {*doc, *pull}}
    rel = {p: round(dot(vec[p], doc) / math.sqrt(dot(doc, doc)), 9) for p in phrases}
    chosen = [max(phrases, key=lambda p: rel[p])]
    while len(chosen) < min(top_n, len(phrases)):
        score = {p: round((1 - diversity) * rel[p] - diversity * max(dot(vec[p], vec[c]) for c in chosen), 9)
                 for p in phrases if p not in chosen}
        chosen.append(max(score, key=lambda p: score[p]))
    return [(i + 1, p, rel[p]) for i, p in enumerate(chosen)]


@pytest.mark.parametrize("n,seeds", [(1, []), (1, ["moving", "code"]), (2, []), (2, ["zz"])])
def test_mmr_equals_plain_greedy(n, seeds):
    rnd = random.Random(n)
    letters = "abcdeé日"
    for size in (0, 1, 2, 5, 40, 120):
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(max(1, size // 2))]
        tokens = [rnd.choice(words) for _ in range(size)]
        got, want = KW.mmr_select(tokens, n, 8, 0.4, seeds), _plain_mmr(tokens, n, 8, 0.4, seeds)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 2e-9 for g, w in zip(got, want))


def test_stored_candidates_give_the_same_rows(spark):
    """A round reads the stored candidates only, and picks what it picks from the tokens."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(80)]
    rows = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 40))]) for i in range(60)] + [(60, None), (61, [])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    state = KW.candidate_state(df, "tokens")
    for seeds in ([], words[:3], words[:3] + ["abcabc"]):
        got = sorted(map(tuple, KW.mmr_of_state(state, seeds=seeds).collect()))
        assert got == sorted(map(tuple, KW.mmr_keywords(df, "tokens", seeds=seeds).collect())) and got
    assert "tokens" not in state.columns
    known, want = list(words[:3]), []
    for r in range(3):  # the loop over tokens
        picks = KW.expansion_round(df, known).collect()
        want += [(p.phrase, p.score, r + 1, p["rank"]) for p in picks]
        known += [p.phrase for p in picks]
    assert sorted(KW.expand_keywords(df, words[:3], rounds=3)) == sorted(want)


def test_word_vectors_are_made_once_a_task(spark, monkeypatch):
    """the state has words and counts only; phrases of two words, and tasks that forget their words, give the rows of the tokens too."""
    from issuelens.operators import mmr
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdé\U0001f600") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    rows = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 30))]) for i in range(50)] + [(50, None), (7, ["a", "a", "b"]), (7, ["a", "a", "b"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").coalesce(1)
    for n in (1, 2):
        state = KW.candidate_state(df, "tokens", n)
        assert state.columns == ["doc_id", "n", "phrases", "counts"]
        for seeds in ([], words[:2] + ["zzzz", "zzzz"]):
            want = sorted(map(tuple, KW.mmr_keywords(df, "tokens", n=n, seeds=seeds).collect()))
            assert sorted(map(tuple, KW.mmr_of_state(state, seeds=seeds).collect())) == want and want
    monkeypatch.setattr(mmr, "CACHED_WORDS", 5)
    made = [b for r in rows for b in mmr.stored(1)(iter([pa.RecordBatch.from_pylist([{"doc_id": r[0], "tokens": r[1]}], pa.schema(
        [("doc_id", pa.int64()), ("tokens", pa.list_(pa.string()))]))]))]
    got = [tuple(x.values()) for b in mmr.picked(10, 0.5, words[:3], None)(iter(made)) for x in b.to_pylist()]
    assert sorted(got) == sorted(map(tuple, KW.mmr_keywords(df, "tokens", seeds=words[:3]).collect()))


def test_fuzzy_exclusion_sees_distinct_phrases(spark):
    """the filter of a round stays above the aggregate that makes phrases distinct."""
    cands = spark.createDataFrame([("move",), ("moves",), ("zebra",), ("zebra",), (None,)], "phrase string")
    kept = KW.fuzzy_exclude(KW._distinct_phrases(cands), ["moved"])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Aggregate") and plan.count("Filter") == 1
    assert sorted(map(str, KW._distinct_phrases(cands).collect())) == sorted(map(str, cands.distinct().collect()))


def test_doc_vectors_shuffle_documents_not_trigrams(spark):
    rows = [(1, ["move", "moved", "aa", "aaaa", "move"]), (2, []), (3, None), (4, ["x"]), (5, ["\U0001f600é", "zz"]), (6, ["aa"]), (6, ["aa"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    out = KW.doc_vectors(df, "tokens")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for doc_id, tokens in rows:
        for w in tokens or []:
            counts = Counter(py_char_grams(w))
            for g, c in counts.items():
                key = doc_id, g
                want[key] = want.get(key, 0.0) + c / sqrt(sum(x * x for x in counts.values())) / len(tokens)
    got = {(r["doc_id"], r["gram"]): r["weight"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_word_vectors_at_once_are_those_of_single_words():
    words = ["move", "aaaa", "x", "\U0001f600é", "remove"]
    grams, word, gram, weight = mmr.word_vectors(words)
    for i, w in enumerate(words):
        counts = Counter((ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in py_char_grams(w))
        norm = sqrt(sum(x * x for x in counts.values()))
        mine = word == i
        assert dict(zip(grams[gram[mine]].tolist(), weight[mine].tolist())) == {g: c / norm for g, c in counts.items()}
