"""Metrics, splits, strategies and the active-learning loop (invariants)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.operators import active as A
from issuelens.operators import knn
from issuelens.operators import metrics as M
from issuelens.operators import sampling as S
from issuelens.operators import strategies as Q
from issuelens.sources import tables


def test_metrics_one_class_fixture(spark):
    rows = [(1, 0)] * 220 + [(0, 0)] * 443
    df = spark.createDataFrame(rows, "label int, prediction int")
    r = M.macro_metrics(df).collect()[0]
    assert round(r["accuracy"], 6) == 0.668175
    assert round(r["precision"], 6) == 0.334087
    assert r["recall"] == 0.5
    assert round(r["fscore"], 6) == 0.400542


def test_binary_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "label int, prediction int")
    b = M.binary_metrics(df).collect()[0]
    assert (b["precision"], b["recall"]) == (2 / 3, 2 / 3)
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert set(rep) == {"Non-ATD", "ATD", "macro avg", "weighted avg"}


def test_stratified_split_exact_and_stable(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, label int")
    a = S.stratified_split(df.repartition(3), "label", "doc_id")
    b = S.stratified_split(df.repartition(11), "label", "doc_id")
    ca = {(r["doc_id"], r["split"]) for r in a.collect()}
    assert ca == {(r["doc_id"], r["split"]) for r in b.collect()}
    test = [r for r in a.collect() if r["split"] == "test"]
    assert len(test) == 200 and len(ca) == 1000
    pos = sum(r["label"] for r in test)
    assert pos in (28, 29)


def test_selection_equals_window_rank(spark):
    rows = [(i, i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, g int")
    q = spark.createDataFrame([(0, 17), (1, 0), (2, 1000)], "g int, quota long")
    got = {r["doc_id"] for r in S.select_smallest(df, q, "doc_id", 42, "g", "s").filter("s").collect()}
    import hashlib
    want = set()
    for g, k in [(0, 17), (1, 0), (2, 1000)]:
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, gg in rows if gg == g)
        want |= {i for _, i in ids[:k]}
    assert got == want


def test_two_class_uncertainty_strategies_agree(spark):
    rows = [(i, [p, 1 - p]) for i, p in enumerate([0.5, 0.9, 1.0, 0.0, 0.55, 0.3, 0.71, 0.49])]
    df = spark.createDataFrame(rows, "doc_id long, p array<double>")
    ids = [[r["doc_id"] for r in f(df, 5).orderBy("rank").collect()]
           for f in (Q.query_least_confidence, Q.query_breaking_ties, Q.query_entropy)]
    assert ids[0] == ids[1] == ids[2]


def test_three_class_strategies_may_differ(spark):
    df = spark.createDataFrame([(1, [0.4, 0.39, 0.21]), (2, [0.36, 0.32, 0.32])], "doc_id long, p array<double>")
    lc = Q.query_least_confidence(df, 1).collect()[0]["doc_id"]
    bt = Q.query_breaking_ties(df, 1).collect()[0]["doc_id"]
    assert (lc, bt) == (2, 1)


def test_contrastive_knn_bruteforce(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    emb = rng.normal(size=(60, 4))
    p = rng.dirichlet([1, 1], size=60)
    rows = [(i, emb[i].tolist(), p[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>, p array<double>")
    lab, unl = df.filter("doc_id < 15"), df.filter("doc_id >= 15")
    got = {r["doc_id"]: r["score"] for r in Q.contrastive_scores(unl, lab, k=3).collect()}
    e = emb / np.linalg.norm(emb, axis=1, keepdims=True)
    for i in range(15, 60):
        d = np.linalg.norm(e[:15] - e[i], axis=1)
        nb = sorted(range(15), key=lambda j: (round(d[j], 9), j))[:3]
        kl = [sum(p[j][c] * np.log(p[j][c] / max(p[i][c], 1e-12)) for c in range(2) if p[j][c] > 0) for j in nb]
        assert abs(got[i] - np.mean(kl)) < 1e-9


def test_active_learning_ledger_invariants(spark, tmp_path):
    from issuelens.operators import active as A
    from issuelens.sources import tables
    lab = tables.labelled(spark, "/root/testdata/sf0.01")
    split = S.stratified_split(lab, "label", "doc_id")
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    ledger, curve = A.active_learning_run(spark, train, test, strategy="LeastConfidence", query_size=100,
                                          rounds=2, run_dir=str(tmp_path / "al"))
    ids = [r["doc_id"] for r in ledger.collect()]
    assert len(ids) == len(set(ids)) == 300
    assert ledger.join(test, "doc_id").count() == 0
    sizes = [r["training_size"] for r in curve.orderBy("iteration").collect()]
    assert sizes == [100, 200, 300]
    best = A.load_model(str(tmp_path / "al" / "best_model"))
    assert A.predict(best, test, ["doc_id"]).count() == test.count()


@pytest.mark.parametrize("strategy", ["RandomSampling", "LeastConfidence", "BreakingTies", "PredictionEntropy",
                                      "ContrastiveActiveLearning", "EmbeddingKMeans"])
def test_all_strategies_on_texts(spark, tmp_path, strategy):
    """A text pool without embeddings: no item twice, none of the test rows, and the export keeps the query order."""
    lab = tables.labelled(spark, "/root/testdata/sf0.01").limit(240)
    test = lab.filter("doc_id % 4 = 0")
    ledger, curve = A.active_learning_run(spark, lab.filter("doc_id % 4 <> 0"), test, strategy=strategy, query_size=30,
                                          rounds=2, run_dir=str(tmp_path / "run"))
    ids = [r.doc_id for r in ledger.collect()]
    assert len(ids) == len(set(ids)) == 90 and not any(i % 4 == 0 for i in ids)
    assert [r.training_size for r in curve.orderBy("iteration").collect()] == [30, 60, 90]
    out = A.labelled_export(ledger, lab).orderBy("index").collect()
    assert [r["index"] for r in out] == list(range(1, 91)) and all(r.text for r in out)


@pytest.mark.parametrize("rows,copies", [(3, 1), (8, 1), (9, 1), (4, 5), (9, 3), (40, 1)])
def test_kmeans_query_of_small_pools(spark, rows, copies):
    """Fewer rows than clusters, as many, more, and repeated vectors: n rows (or all), none twice."""
    vec = np.random.default_rng(rows).normal(size=(rows, 6)).tolist()
    data = [(10 * i + c, v) for i, v in enumerate(vec) for c in range(copies)]
    df = spark.createDataFrame(data, "doc_id long, embedding array<double>")
    got = Q.query_embedding_kmeans(df, 8).collect()
    assert len({r.doc_id for r in got}) == len(got) == min(8, len(data))
    assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    if rows <= 8:  # every vector is a cluster, named by its smallest id
        assert {10 * i for i in range(rows)} <= {r.doc_id for r in got}


@pytest.mark.parametrize("strategy", ["EmbeddingKMeans", "ContrastiveActiveLearning", "PredictionEntropy"])
def test_strategies_until_the_pool_is_empty(spark, tmp_path, strategy):
    lab = tables.labelled(spark, "/root/testdata/sf0.001")
    test, pool = lab.filter("doc_id % 4 = 0"), lab.filter("doc_id % 4 <> 0")
    ledger, curve = A.active_learning_run(spark, pool, test, strategy=strategy, query_size=25, rounds=20, run_dir=str(tmp_path / "run"))
    ids = [r.doc_id for r in ledger.collect()]
    assert len(ids) == len(set(ids)) == pool.count()
    assert curve.count() == -(-len(ids) // 25)


def test_an_interrupted_run_goes_on_to_the_same_ledger(spark, tmp_path, monkeypatch):
    """A run that dies in its second round, before or after that round is evaluated, ends like one that did not."""
    lab = tables.labelled(spark, "/root/testdata/sf0.001")
    test, pool = lab.filter("doc_id % 4 = 0"), lab.filter("doc_id % 4 <> 0")

    def run(name, **kw):
        ledger, curve = A.active_learning_run(spark, pool, test, strategy="LeastConfidence", query_size=12, rounds=2, run_dir=str(tmp_path / name), **kw)
        return (sorted(tuple(r) for r in ledger.select("iteration", "rank", "doc_id", "label").collect()),
                sorted(tuple(r) for r in curve.select("iteration", "training_size", F.round("fscore", 9)).collect()))

    want = run("whole")
    for broken in ("evaluate", "_select"):
        calls, real = [], getattr(A, broken)

        def dies(*args, **kw):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("lost")
            return real(*args, **kw)
        with monkeypatch.context() as m:
            m.setattr(A, broken, dies)
            with pytest.raises(RuntimeError):
                run(broken)
        folder = tmp_path / broken / "ledger"
        rounds = sum(p.name.startswith("iteration") for p in folder.iterdir())
        spark.read.parquet(str(folder / "iteration=0")).limit(3).write.parquet(str(folder / f"iteration={rounds}"))  # a lost attempt's rows
        assert run(broken, resume=True) == want
    assert run(broken, resume=True) == want  # a finished run stays as it is


def test_learning_curve_reports_sizes_above_the_pool(spark):
    lab = tables.labelled(spark, "/root/testdata/sf0.01").limit(200)
    rows = A.learning_curve_random(spark, lab.filter("doc_id % 4 <> 0"), lab.filter("doc_id % 4 = 0"), lo=50, hi=250, step=100).collect()
    assert [(r.training_size, r.status) for r in rows] == [(50, "ok"), (150, rows[1].status), (250, "pool too small")]
    assert rows[2].fscore is None and 0 <= rows[0].fscore <= 1


def _all_pairs(rows, neighbours, k):
    """Distances and ids of the k nearest by all distances."""
    def units(table):
        x = np.array([v for _, v in table if v is not None], float)
        n = np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
        return [i for i, v in table if v is not None], np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    ids, x = units(rows)
    others, y = units(neighbours)
    out = {i: [] for i, _ in rows}
    for i, v in zip(ids, x):
        d = np.round(np.sqrt(((y - v) ** 2).sum(1)), 9) if len(others) else []
        out[i] = sorted((float(a), j) for a, j in zip(d, others) if j != i)[:k]
    return out


def _knn_rows(spark, rows):
    return spark.createDataFrame([(i, v, [0.25, 0.75]) for i, v in rows], "doc_id string, embedding array<double>, p array<double>").repartition(3)


def _same(got, want):
    assert {r.doc_id for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        assert [n.i for n in r.near] == [j for _, j in want[r.doc_id]]
        assert np.allclose([n.d for n in r.near], [d for d, _ in want[r.doc_id]], atol=2e-8)


@pytest.mark.parametrize("pivots,block,team", [(256, 20_000, 100_000), (7, 9, 5), (1, 40, 11)])
def test_knn_index_equals_all_pairs(spark, monkeypatch, pivots, block, team):
    """Clusters of unlike sizes, text ids, null, zero and repeated vectors, small blocks and teams."""
    for name, value in (("PIVOTS", pivots), ("BLOCK", block), ("TEAM", team)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(pivots)
    centre = rng.normal(size=(6, 8)) * 3
    rows = [(f"K-{i:03}", [float(x) for x in np.round(centre[min(5, i % 9)] + rng.normal(size=8) * 0.3, 2)]) for i in range(140)]
    rows += [("null", None), ("zero", [0.0] * 8), ("copy", rows[3][1]), ("twice", rows[3][1])]
    near = rows[::2] + rows[-3:]
    _same(knn.k_nearest(_knn_rows(spark, rows), _knn_rows(spark, near), 4, "doc_id", "embedding", "p").collect(), _all_pairs(rows, near, 4))


def test_knn_of_few_or_no_neighbours(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)]
    _same(knn.k_nearest(_knn_rows(spark, rows), _knn_rows(spark, rows), 5, "doc_id", "embedding", "p").collect(), _all_pairs(rows, rows, 5))
    none = _knn_rows(spark, rows).limit(0)
    _same(knn.k_nearest(_knn_rows(spark, rows), none, 5, "doc_id", "embedding", "p").collect(), {i: [] for i, _ in rows})
    assert knn.k_nearest(none, none, 5, "doc_id", "embedding", "p").count() == 0


def test_knn_index_leaves_out_most_pairs_of_clusters(spark):
    """Where vectors have clusters, a tenth of the pairs is compared at most."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 16))
    rows = [(f"{i:04}", [float(x) for x in centre[i % 60] + rng.normal(size=16) * 0.05]) for i in range(2000)]
    got = knn.k_nearest(_knn_rows(spark, rows), _knn_rows(spark, rows), 5, "doc_id", "embedding", "p").collect()
    _same(got, _all_pairs(rows, rows, 5))
    assert sum(r.pairs for r in got) < 0.1 * len(rows) ** 2


def test_split_reads_the_source_a_few_times(spark):
    """No row is joined with itself: the ids are read for two histograms, the rows once."""
    from issuelens.plans import catalog
    catalog.load_all()
    df = catalog.QUERIES["stratified_split"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents") <= 4 and plan.lower().count("broadcast") == 0


def test_fits_read_the_labelled_rows_not_the_pool(spark, tmp_path, monkeypatch):
    """features given are kept, and a fit reads the few labelled rows in one task."""
    lab = A.text_features(tables.labelled(spark, "/root/testdata/sf0.01")).repartition(8).cache()
    seen, real = [], A.train_classifier

    def train(rows, *args):
        files = rows.inputFiles()
        seen.append((rows.count(), rows.rdd.getNumPartitions(), all("/labelled/" in f for f in files)))
        return real(rows, *args)
    monkeypatch.setattr(A, "train_classifier", train)
    monkeypatch.setattr(A, "save_model", lambda *a: None)
    A.active_learning_run(spark, lab.filter("doc_id % 4 <> 0"), lab.filter("doc_id % 4 = 0"), query_size=20, rounds=2, run_dir=str(tmp_path / "r"))
    assert seen == [(20, 1, True), (40, 1, True), (60, 1, True)]


def test_fits_run_at_once_in_order(spark):
    """independent fits share the cluster; results keep their order."""
    import threading
    meet = threading.Barrier(3, timeout=60)  # passes only if three tasks are there together
    assert A.at_once(spark, [lambda i=i: (meet.wait(), spark.range(i).count())[1] for i in (3, 1, 2)]) == [3, 1, 2]


@pytest.mark.parametrize("rows,k", [(300, 4), (300, 400)])
def test_few_neighbours_are_all_compared(spark, monkeypatch, rows, k):
    """above ``PIVOTS`` too, if they are known to be few; ties, null vectors and small stretches included."""
    monkeypatch.setattr(knn, "DISTANCES_AT_ONCE", 2000)
    rng = np.random.default_rng(k)
    data = [(f"K-{i:03}", [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(rows)] + [("null", None)]
    near = data[::1][:-1] + data[-1:]
    got = knn.k_nearest(_knn_rows(spark, data), _knn_rows(spark, near), k, "doc_id", "embedding", "p", whole=1000).collect()
    _same(got, _all_pairs(data, near, k))
    assert {r.pairs for r in got if r.doc_id != "null"} == {rows}


def test_macro_of_cells_is_macro_metrics(spark):
    for cells in ([(1, 1, 3), (1, 0, 2), (0, 0, 7), (0, 1, 1)], [(0, 0, 4)], [(1, 0, 2), (None, 1, 3), (2, None, 1), (None, None, 2)], [(1, 0, 5)]):
        df = spark.createDataFrame([c[:2] for c in cells for _ in range(c[2])], "label int, prediction int")
        want = M.macro_metrics(df).collect()[0]
        got = M.macro_of_cells(cells)
        assert got.keys() == {"accuracy", "precision", "recall", "fscore"}
        assert all(abs(v - want[name]) < 1e-12 for name, v in got.items())


def test_runs_share_one_copy_of_the_pool(spark, tmp_path, monkeypatch):
    """all strategies read the pool and test rows that were written once."""
    from issuelens.plans import q_active as QA
    seen = []

    def run(session, pool, test, **kw):
        seen.append((kw["strategy"], kw["stored"], tuple(sorted(pool.inputFiles())), tuple(sorted(test.inputFiles())), sorted(pool.columns)))
        return None, spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.5, kw["strategy"], 0)], A.CURVE_FORM)
    monkeypatch.setattr(A, "active_learning_run", run)
    assert QA.active_learning_curves(spark, "/root/testdata/sf0.001").count() == 6
    assert len({s[1:4] for s in seen}) == 1 and len({s[0] for s in seen}) == 6 and seen[0][4] == ["doc_id", "embedding", "label", "tf"]


def test_a_run_on_stored_tables_is_that_of_copies(spark, tmp_path):
    lab = A.text_features(tables.labelled(spark, "/root/testdata/sf0.001")).drop("text", "Key")
    for name, rows in (("pool", "doc_id % 4 <> 0"), ("test", "doc_id % 4 = 0")):
        lab.filter(rows).write.parquet(str(tmp_path / name))
    pool, test = (spark.read.parquet(str(tmp_path / name)) for name in ("pool", "test"))
    runs = [A.active_learning_run(spark, pool, test, strategy="ContrastiveActiveLearning", query_size=12, rounds=2, run_dir=str(tmp_path / f"run-{stored}"), stored=stored)
            for stored in (False, True)]
    ledgers, curves = ([sorted(map(tuple, r[i].collect())) for r in runs] for i in (0, 1))
    assert ledgers[0] == ledgers[1] and curves[0] == curves[1]
    assert (tmp_path / "run-False" / "pool").exists() and not (tmp_path / "run-True" / "pool").exists()
