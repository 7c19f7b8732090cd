"""Model training/inference (MDL-*) and the pool-based active-learning loop (ACT-*).

The classifier is a ``pyspark.ml`` pipeline (distributed fit). The loop is a
driver loop over small state: per round one selected-id table (at most
``query_size`` rows) is written to the ledger in the run's folder and read back, so lineage never grows with the rounds and a
lost executor only recomputes the current round.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from issuelens import fixed
from issuelens.operators import metrics as M
from issuelens.operators import sampling as S
from issuelens.operators import strategies as Q
from issuelens.session import ensure_checkpoint_dir, scratch_table_dir, written


#: What lies between two tokens of a text.
TOKEN_GAP = r"[^\p{L}\p{N}_']+"


def text_pipeline(text_col: str = "text", label_col: str = "label", num_features: int = 1 << 14,
                  max_iter: int = 30, reg: float = 0.01) -> Pipeline:
    """MDL-1 default estimator: tokenise -> stop words -> hashed TF -> IDF -> logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_GAP, toLowercase=True),
        StopWordsRemover(inputCol="_tok", outputCol="_tok2"),
        HashingTF(inputCol="_tok2", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=reg),
    ])


#: Places of the hashed word counts that stand in for an embedding when a text pool has none.
EMBEDDING_SIZE = 64


def count_stages(text_col: str = "text", num_features: int = 1 << 14) -> list:
    """Texts to hashed word counts ``tf``; nothing to fit."""
    return [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_GAP, toLowercase=True),
            StopWordsRemover(inputCol="_tok", outputCol="_tok2"),
            HashingTF(inputCol="_tok2", outputCol="tf", numFeatures=num_features)]


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Word counts of the texts, made once: ``tf`` (hashed), and ``embedding`` if the table has none.

    The stand-in embedding is a short hashed count vector of the same words.
    A table that has ``tf`` stays as it is.
    """
    if "tf" in df.columns:
        return df
    stages = count_stages(text_col)
    if "embedding" not in df.columns:
        stages.append(HashingTF(inputCol="_tok2", outputCol="_short", numFeatures=EMBEDDING_SIZE))
    out = df
    for stage in stages:
        out = stage.transform(out)
    if "embedding" not in df.columns:
        out = out.withColumn("embedding", vector_to_array("_short"))
    return out.drop("_tok", "_tok2", "_short")


def counts_pipeline(label_col: str = "label", max_iter: int = 30, reg: float = 0.01) -> Pipeline:
    """MDL-1 on ``text_features``: what is left to fit on the labelled rows of a round."""
    return Pipeline(stages=[IDF(inputCol="tf", outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=reg)])


def embedding_pipeline(label_col: str = "label", max_iter: int = 50, reg: float = 0.01) -> Pipeline:
    """MDL-1 on precomputed embeddings (``features`` built by ``with_embedding_features``)."""
    return Pipeline(stages=[LogisticRegression(featuresCol="features", labelCol=label_col,
                                               maxIter=max_iter, regParam=reg)])


def with_embedding_features(df: DataFrame, emb_col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(emb_col)))


def train_classifier(train: DataFrame, estimator: Pipeline | None = None, label_col: str = "label") -> PipelineModel:
    """MDL-1: fit the estimator (a parameter) on the labelled rows."""
    est = estimator or text_pipeline(label_col=label_col)
    return est.fit(train.withColumn(label_col, F.col(label_col).cast("double")))


def train_on_counts(train: DataFrame, text_col: str = "text", label_col: str = "label") -> PipelineModel:
    """MDL-1: ``text_pipeline`` fitted with the words counted once, and not by every pass of the fit before its rows are kept."""
    counts = written(text_features(train, text_col).select(label_col, "tf"), "counts")
    return PipelineModel([*count_stages(text_col), *train_classifier(counts, counts_pipeline(label_col), label_col).stages])


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """MDL-2 / MDL-3: ``prediction int`` and class probabilities ``p array<double>``."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array(F.col("probability")).alias("p"))


def evaluate(model: PipelineModel, test: DataFrame, id_col: str = "doc_id", label_col: str = "label") -> dict:
    """Macro accuracy / precision / recall / F1 on the test rows: one job counts the cells of the confusion matrix."""
    cells = M.confusion_matrix(predict(model, test, [label_col]), label_col, "prediction").collect()
    return M.macro_of_cells([(r["label"], r["prediction"], r["n"]) for r in cells])


#: Labelled rows up to which a round compares all of them with the pool's rows: they are an annotation budget, a few thousand.
LABELLED_WHOLE = 20_000


def _select(strategy: str, unlabelled: DataFrame, labelled: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    if strategy == "RandomSampling":
        return Q.query_random(unlabelled, n, id_col, seed)
    if strategy == "ContrastiveActiveLearning":
        return Q.query_contrastive(unlabelled, labelled, n, 10, id_col, whole=LABELLED_WHOLE)
    if strategy == "EmbeddingKMeans":
        return Q.query_embedding_kmeans(unlabelled, n, id_col, seed=seed)
    return Q.STRATEGIES[strategy](unlabelled, n, id_col)


#: Independent fits that share the cluster at a time: one alone leaves most cores idle between its many small jobs.
FITS_AT_ONCE = 6


def at_once(spark: SparkSession, tasks: list[Callable]) -> list:
    """The results of the tasks, in order; their jobs run side by side."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]


#: Labelled rows in a task of a fit: each of its iterations is a job over all tasks.
FIT_ROWS = 10_000


def fit_rows(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` written rows of a fit in as few tasks as ``FIT_ROWS`` allows."""
    return df.coalesce(max(1, math.ceil(n / FIT_ROWS)))


CURVE_FORM = "training_size long, accuracy double, precision double, recall double, fscore double, model string, iteration int"
CURVE_COLUMNS = [f.split()[0] for f in CURVE_FORM.split(", ")]


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or nothing if none was ever finished there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def active_learning_run(spark: SparkSession, pool: DataFrame, test: DataFrame, *, strategy: str = "BreakingTies",
                        query_size: int = fixed.QUERY_SIZE, rounds: int = fixed.NUM_QUERIES,
                        estimator: Pipeline | None = None, id_col: str = "doc_id", label_col: str = "label",
                        seed: int = fixed.SEED, run_dir: str | None = None, resume: bool = False,
                        stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """ACT-4: initial sample -> train -> evaluate -> ``rounds`` x (query, label, retrain, evaluate).

    Returns ``(ledger, curve)`` and saves the best round's model under
    ``run_dir/best_model`` (ACT-7). The ledger is ``(iteration, rank, doc_id, label)``
    and holds no test row; ``curve.training_size`` is the actual ledger size
    (ACT-5). A round whose query comes back empty is skipped; once the pool is
    exhausted the remaining rounds would all be skipped, so the loop stops.

    Ledger and curve are tables with a folder ``iteration=N`` for each round
    (SNK-4), written whole and over whatever an interrupted attempt left there,
    so a round is never in them twice. A round counts once its curve row is
    written. ``resume=True`` goes on after the last such round of ``run_dir``;
    selections are seeded by the round, so the ledger is that of a run without
    a break.

    The labelled rows with their features are a table of the same form, which
    the fits read: a round reads the pool to score it, to pick from the scored
    rows and to fetch the picked rows, not for the fit. The test rows are scored
    beside the next query and fit.

    ``stored=True`` says that ``pool`` and ``test`` are written tables that have
    their features: they are read where they are, so that several runs share one copy.
    """
    run_dir = run_dir or scratch_table_dir(spark, f"al-{uuid.uuid4().hex}")
    ledger_path, labelled_path, curve_path = f"{run_dir}/ledger", f"{run_dir}/labelled", f"{run_dir}/curve"
    done = _written(spark, curve_path) if resume else None
    curve = [] if done is None else [tuple(r) for r in done.select(*CURVE_COLUMNS).orderBy("iteration").collect()]  # a row for each round
    # every round reads the pool and the test rows: their features are made once and written to the run's folder
    own_features = estimator is None
    if own_features:
        estimator = counts_pipeline(label_col)
    if not curve and not stored:
        if own_features:
            pool, test = text_features(pool), text_features(test)
        kept = [id_col, label_col, *[c for c in ("tf", "embedding", "features") if c in pool.columns]]
        for name, df in (("pool", pool), ("test", test)):
            columns = [c for c in (kept if "tf" in df.columns else df.columns) if c in df.columns]
            df.select(*columns).write.mode("overwrite" if resume else "error").parquet(f"{run_dir}/{name}")
    if not stored:
        pool, test = (spark.read.parquet(f"{run_dir}/{name}") for name in ("pool", "test"))
    pool_n = pool.count()
    # given here, the form of the small tables is not looked up in their files each time
    round_form = StructType([StructField("iteration", IntegerType())])
    picked_form = StructType([StructField("rank", IntegerType()), pool.schema[id_col], pool.schema[label_col]])

    def write_round(rows: DataFrame, path: str, it: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/iteration={it}")

    def ledger_of(it: int) -> DataFrame:
        """What was labelled up to round ``it``."""
        return (spark.read.schema(StructType([*picked_form, *round_form])).parquet(ledger_path).where(F.col("iteration") <= it)
                .select("iteration", "rank", id_col, label_col))

    def write_labelled(it: int) -> None:
        of_round = spark.read.schema(picked_form).parquet(f"{ledger_path}/iteration={it}").select(id_col)
        write_round(pool.join(of_round, id_col, "left_semi"), labelled_path, it)

    def fitted(it: int) -> tuple[PipelineModel, DataFrame, DataFrame, int]:
        ledger = ledger_of(it)
        n = int(ledger.count())
        labelled = spark.read.schema(StructType([*pool.schema, *round_form])).parquet(labelled_path)
        labelled = fit_rows(labelled.where(F.col("iteration") <= it).drop("iteration"), n)
        return train_classifier(labelled, estimator, label_col), labelled, ledger, n

    for it in range(len(curve)):  # of a run that goes on
        if _written(spark, f"{labelled_path}/iteration={it}") is None:
            write_labelled(it)

    if not curve:
        init = S.sample_n(pool.select(id_col), query_size, id_col, seed)
        init = init.withColumn("rank", F.row_number().over(
            Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col))))
        write_round(init.join(pool.select(id_col, label_col), id_col).select("rank", id_col, label_col), ledger_path, 0)
        write_labelled(0)

    def query(it: int, model: PipelineModel, labelled: DataFrame, ledger: DataFrame) -> bool:
        """Write what round ``it + 1`` labels; false if nothing is left."""
        if labelled.count() == pool_n:  # the labelled rows are those of the pool that have an id of the ledger
            return False
        unlabelled = pool.join(ledger.select(id_col), id_col, "left_anti")
        scored = predict(model, unlabelled, [id_col, *[c for c in unlabelled.columns if c == "embedding"]])
        lab_scored = predict(model, labelled, [id_col, *[c for c in labelled.columns if c == "embedding"]])
        picked = _select(strategy, scored, lab_scored, query_size, id_col, seed + it + 1)
        write_round(picked.select(id_col, "rank").join(pool.select(id_col, label_col), id_col).select("rank", id_col, label_col),
                    ledger_path, it + 1)
        write_labelled(it + 1)
        return True

    best = max(range(len(curve)), key=lambda i: (round(curve[i][4], 9), -i), default=0)
    best_model = None
    curve_fields = [f.split() for f in CURVE_FORM.split(", ")]

    def better(at: int) -> bool:
        return round(curve[at][4], 9) > round(curve[best][4], 9)

    def score(it: int, model: PipelineModel, n: int) -> None:
        """The row of round ``it`` in the curve."""
        m = evaluate(model, test, id_col, label_col)
        row = (n, m["accuracy"], m["precision"], m["recall"], m["fscore"], strategy, it)
        write_round(spark.range(1, numPartitions=1).select(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(row, curve_fields[:-1])]),
                    curve_path, it)
        curve.append(row)

    def scored_best(scores: tuple | None) -> None:
        """Wait for the scores of the round before; its model is kept if it is the best."""
        nonlocal best, best_model
        if scores:
            it, model, done = scores
            done.result()
            if it == best or better(it):
                best, best_model = it, model

    with ThreadPoolExecutor(1) as beside:
        scores, known = None, len(curve)
        for it in range(max(known - 1, 0), rounds + 1):
            model, labelled, ledger, n = fitted(it)
            scored_best(scores)
            scores = None
            # the next query and fit need no test rows, so they are scored beside them
            if it >= known:
                scores = it, model, beside.submit(inheritable_thread_target(spark)(score), it, model, n)
            elif it == best:
                best_model = model
            if it == rounds or not query(it, model, labelled, ledger):
                break
        scored_best(scores)
    # ACT-7 / TOP-4: keep the model of the first round with the best F1
    model = best_model or fitted(best)[0]
    if own_features:  # the saved model reads texts
        model = PipelineModel([*count_stages(), *model.stages])
    save_model(model, f"{run_dir}/best_model")
    return ledger_of(len(curve) - 1), spark.createDataFrame(curve, CURVE_FORM)


def labelled_export(ledger: DataFrame, texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """ACT-6: ``(index, key, text, label)`` in query order (iteration, rank).

    The ledger's ids are ranked first (one row per labelled item, the annotation
    budget); the texts are joined to them afterwards.
    """
    order = Window.orderBy("iteration", "rank", id_col)
    ranked = ledger.select(id_col, "label", F.row_number().over(order).alias("index"))
    return ranked.join(texts.drop("label"), id_col).select("index", F.col("Key").alias("key"), "text", "label")


def learning_curve_random(spark: SparkSession, train: DataFrame, test: DataFrame, *, lo: int = 100,
                          hi: int = 2300, step: int = 100, runs: int = 1, estimator: Pipeline | None = None,
                          id_col: str = "doc_id", label_col: str = "label", model_name: str = "random") -> DataFrame:
    """MDL-5: train at each grid size x run on a fresh seeded sample; binary metrics on ``test``.

    The sampling seed is a counter over all (run, size) fits, so sets are not
    nested. A size above the pool's is reported with status ``pool too small``
    and no metrics. Features are made once for all fits, and a sample is written
    once for the passes of its fit.
    """
    ensure_checkpoint_dir(spark)
    samples = scratch_table_dir(spark, f"lc-{uuid.uuid4().hex}")
    if estimator is None:
        train, test = text_features(train), text_features(test)
        estimator = counts_pipeline(label_col)
        train, test = (df.select(id_col, label_col, "tf") for df in (train, test))
    train, test = train.checkpoint(), test.checkpoint()
    pool_n = train.count()

    def fitted(run: int, size: int, counter: int) -> tuple:
        if size > pool_n:
            return (model_name, run, size, None, None, None, None, "pool too small")
        S.sample_n(train, size, id_col, counter).write.parquet(f"{samples}/{counter}")
        sample = fit_rows(spark.read.parquet(f"{samples}/{counter}"), size)
        model = train_classifier(sample, estimator, label_col)
        pred = predict(model, test, [id_col, label_col])
        r = M.binary_metrics(pred, label_col, "prediction").collect()[0]
        return (model_name, run, size, float(r["recall"]), float(r["fscore"]),
                float(r["precision"]), float(r["accuracy"]), "ok")

    grid = [(run, size) for run in range(runs) for size in range(lo, hi + step, step)]
    rows = at_once(spark, [partial(fitted, run, size, i) for i, (run, size) in enumerate(grid, 1)])
    return spark.createDataFrame(rows, "model string, run int, training_size int, recall double, fscore double, "
                                       "precision double, accuracy double, status string")


def save_model(model: PipelineModel, path: str) -> None:
    """SNK-6."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
