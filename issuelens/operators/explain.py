"""Per-issue explanations (XPL-1, XPL-2).

For a linear model ``margin = b + sum_j w_j x_j`` the additive (SHAP-style)
contribution of feature j is ``w_j (x_j - mean_j)`` with
``base = b + sum_j w_j mean_j``. Only a document's non-zero features get their
own row; the zero features of a document are summed into one ``__rest__``
row (``-sum w_j mean_j`` over them), so the output is as sparse as the input
and ``base + sum(contributions) = margin`` holds per document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDFModel, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.functions.md5bits import first_bits_clear
from issuelens.functions.tokens import split_words
from issuelens.operators.active import TOKEN_GAP
from issuelens.session import ensure_checkpoint_dir, together, written

REST = "__rest__"


def feature_means(x: DataFrame, n_docs: int) -> DataFrame:
    """``(feature, mean)`` over all documents (absent = 0): a partial aggregate."""
    return x.groupBy("feature").agg((F.sum("value") / F.lit(float(n_docs))).alias("mean"))


def explain_linear(x: DataFrame, weights: DataFrame, bias: float, docs: DataFrame,
                   id_col: str = "doc_id") -> tuple[DataFrame, float]:
    """``(contributions(doc_id, feature, contribution), base)``.

    ``x`` is the sparse design ``(doc_id, feature, value)``; ``weights`` is
    ``(feature, weight)``. ``base`` is one number brought to the driver.
    """
    n = docs.count()
    wm = written(weights.join(feature_means(x, n), "feature").withColumn("wm", F.col("weight") * F.col("mean")), "means")
    s_all = wm.agg(F.sum("wm")).collect()[0][0] or 0.0
    base = bias + s_all
    nz = x.join(wm, "feature").select(id_col, "feature",
                                      (F.col("weight") * (F.col("value") - F.col("mean"))).alias("contribution"),
                                      "wm")
    rest_part = nz.groupBy(id_col).agg(F.sum("wm").alias("s_doc"))
    rest = docs.select(id_col).join(rest_part, id_col, "left").select(
        id_col, F.lit(REST).alias("feature"),
        (-(F.lit(s_all) - F.coalesce(F.col("s_doc"), F.lit(0.0)))).alias("contribution"))
    return nz.drop("wm").unionByName(rest), base


def linear_margin(x: DataFrame, weights: DataFrame, bias: float, docs: DataFrame,
                  id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, margin)``; a document without features has margin ``bias``."""
    m = x.join(weights, "feature").groupBy(id_col).agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    return docs.select(id_col).join(m, id_col, "left").select(
        id_col, (F.lit(bias) + F.coalesce(F.col("s"), F.lit(0.0))).alias("margin"))


def explain_model(model: PipelineModel, docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, float]:
    """XPL-1 of a fitted text classifier (MDL-1): ``(contributions(doc_id, token, count, contribution), base)``.

    From its hashed counts on the pipeline is linear, so a token's weight is
    the margin of a text that holds it once, less ``base``, the margin of a text
    without words. Every distinct token goes through the fitted stages once and
    is joined back. Tokens that share a hashed feature share its weight, each
    with its own count, so ``base`` and a document's contributions add up to the
    raw prediction of the model. Documents without words have no rows.
    """
    at = next(i for i, stage in enumerate(model.stages) if isinstance(stage, HashingTF))
    column = model.stages[at].getInputCol()
    words, rest = PipelineModel(model.stages[:at]), PipelineModel(model.stages[at:])

    def margins(df: DataFrame) -> DataFrame:
        return rest.transform(df).withColumn("margin", F.element_at(vector_to_array("rawPrediction"), 2))

    base = margins(docs.sparkSession.createDataFrame([([],)], f"`{column}` array<string>")).head()["margin"]
    ensure_checkpoint_dir(docs.sparkSession)
    counts = (words.transform(together(docs, id_col)).select(id_col, F.explode(column).alias("token"))
              .groupBy(id_col, "token").agg(F.count(F.lit(1)).cast("double").alias("count")).checkpoint())
    weights = written(margins(counts.select("token").distinct().withColumn(column, F.array("token"))).select(
        "token", (F.col("margin") - F.lit(base)).alias("weight")), "token-weights")
    return counts.join(weights, "token").select(id_col, "token", "count", (F.col("count") * F.col("weight")).alias("contribution")), base


# -- XPL-2 ---------------------------------------------------------------------------

LIME_SCHEMA = "doc_id long, rank int, token string, weight double, intercept double"
#: Distinct words from which a task explains the issues that it has gathered.
WORDS_AT_ONCE = 131_072
LIME_ARROW = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("token", pa.string()), ("weight", pa.float64()),
                        ("intercept", pa.float64())])


def lime_variants(docs: DataFrame, *, n_samples: int = 50, seed: int = 42, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Masked variants: ``(doc_id, v, toks, kept array<boolean>, text)``.

    Masks are per distinct whitespace token and come from seeded md5 bits, so
    they do not depend on partitioning; variant 0 keeps every token. A masked
    token disappears everywhere in the text.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), split_words(F.col(text_col)).alias("all"))
    base = base.withColumn("toks", F.array_distinct("all"))
    v = base.select("doc_id", "all", "toks", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("v"))
    key = lambda t: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"),
                                      F.col("v").cast("string"), t))
    keep = lambda t: (F.col("v") == 0) | (F.substring(key(t), 1, 1) < "8")
    v = v.withColumn("kept", F.transform("toks", keep))
    # the mask is a function of (doc, variant, token), so every occurrence
    # decides for itself: linear in the text, no set lookups
    return v.withColumn("text", F.array_join(F.filter(F.col("all"), keep), " ")).drop("all")


def _surrogate(top_k: int, ridge: float, width: float):
    """The weighted ridge fit of one issue: ``(tokens, masks, probabilities)`` to ``(tokens by weight, weights, intercept)``."""
    import numpy as np

    def fit(toks: list[str], kept: list, p1: list[float]) -> tuple[list[str], list[float], float]:
        x = np.asarray(kept, dtype=np.float64)
        y = np.asarray(p1, dtype=np.float64)
        share = x.mean(axis=1)
        d = 1.0 - np.sqrt(share)
        w = np.sqrt(np.exp(-((100.0 * d) ** 2) / width ** 2))
        sw = w.sum()
        xm = (w[:, None] * x).sum(0) / sw
        ym = float((w * y).sum() / sw)
        xc, yc = x - xm, y - ym
        if x.shape[1] <= x.shape[0]:
            a = xc.T @ (w[:, None] * xc) + ridge * np.eye(x.shape[1])
            beta = np.linalg.solve(a, xc.T @ (w * yc))
        else:
            # dual form: an n x n solve instead of d x d (d = distinct tokens >> n samples);
            # (X'WX + rI)^-1 X'W y = B'(BB' + rI)^-1 sqrt(w) y with B = sqrt(w) X
            sw_ = np.sqrt(w)
            b = sw_[:, None] * xc
            beta = b.T @ np.linalg.solve(b @ b.T + ridge * np.eye(x.shape[0]), sw_ * yc)
        intercept = ym - float(xm @ beta)
        size = np.round(np.abs(beta), 9)
        order = np.flatnonzero(size >= np.partition(size, -top_k)[-top_k]) if top_k < len(size) else range(len(toks))
        order = sorted(order, key=lambda j: (-size[j], toks[j]))[:top_k]
        return [toks[j] for j in order], [float(beta[j]) for j in order], intercept
    return fit


def _ridge_per_doc(top_k: int, ridge: float, width: float):
    import pandas as pd

    surrogate = _surrogate(top_k, ridge, width)

    def fit(doc_id: int, *issue) -> pd.DataFrame:
        toks, weights, intercept = surrogate(*issue)
        return pd.DataFrame({"doc_id": doc_id, "rank": list(range(1, len(toks) + 1)), "token": toks, "weight": weights,
                             "intercept": intercept})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """An issue's variants follow each other, from variant 0 on; they may go over several batches."""
        issue = None
        for pdf in batches:
            out = []
            for doc_id, v, toks, kept, p1 in zip(pdf["doc_id"], pdf["v"], pdf["toks"], pdf["kept"], pdf["p1"]):
                if v == 0:
                    if issue:
                        out.append(fit(*issue))
                    issue = (doc_id, list(toks), [], [])
                issue[2].append(kept)
                issue[3].append(p1)
            if out:
                yield pd.concat(out)
        if issue:
            yield fit(*issue)
    return run


def adds_up_over_words(model) -> bool:
    """Whether the raw prediction of a text is a sum over its blank-separated words.

    It is for ``active.text_pipeline``: its tokens never cross a blank, and from
    the hashed counts on it is linear.
    """
    if not isinstance(model, PipelineModel) or not model.stages or not isinstance(model.stages[0], RegexTokenizer):
        return False
    first, *rest = model.stages
    kinds = [type(stage) for stage in rest]
    return (kinds == [StopWordsRemover, HashingTF, IDFModel, LogisticRegressionModel]
            and first.getGaps() and first.getPattern() == TOKEN_GAP and not rest[1].getBinary() and rest[3].numClasses == 2)


def _ridge_per_doc_of_words(base: float, n_samples: int, seed: int, top_k: int, ridge: float, width: float):
    import numpy as np

    fit = _surrogate(top_k, ridge, width)

    def explained(issues: list[tuple]) -> pa.RecordBatch:
        """The rows of issues ``(doc_id, words, distinct words, margins)``, whose masks are made together."""
        heads = [f"{seed}:{'' if i[0] is None else f'{i[0]}:'}".encode() for i in issues]
        sizes = [len(i[2]) for i in issues]
        masks = first_bits_clear(heads, sizes, [t.encode() for i in issues for t in i[2]], n_samples)  # the bits of ``lime_variants``
        out = [[] for _ in LIME_ARROW]
        at = 0
        for (doc_id, words, toks, margins), size in zip(issues, sizes):
            counts = Counter(words)
            weights = np.array([counts[t] for t in toks], dtype=np.float64) * (np.array(margins) - base)
            kept = masks[:, at:at + size]
            at += size
            found, betas, intercept = fit(toks, kept, np.exp(-np.logaddexp(0.0, -(kept @ weights + base))))
            n = len(found)
            for column, values in zip(out, ([doc_id] * n, range(1, n + 1), found, betas, [intercept] * n)):
                column.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, LIME_ARROW)], schema=LIME_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An issue's words follow each other, from word 0 on; they may go over several batches."""
        issues, waiting = [], 0
        for batch in batches:
            ids, at, raw = batch["doc_id"].to_pylist(), batch["at"].to_numpy(), batch["raw"].to_numpy()
            words, toks = batch["words"], batch["tok"].to_numpy(zero_copy_only=False).tolist()
            starts = np.flatnonzero(at == 0).tolist()
            for start, end in zip([0, *starts], [*starts, len(at)]):
                if start < end and at[start] == 0:
                    if waiting >= WORDS_AT_ONCE:  # all of them are whole
                        yield explained(issues)
                        issues, waiting = [], 0
                    issues.append((ids[start], words[start].values.to_numpy(zero_copy_only=False).tolist(), [], []))
                if start < end:
                    issues[-1][2].extend(toks[start:end])
                    issues[-1][3].extend(raw[start:end])
                    waiting += end - start
        if issues:
            yield explained(issues)
    return run


def explain_lime(model, docs: DataFrame, *, n_samples: int = 50, seed: int = 42, ridge: float = 1.0,
                 kernel_width: float = 25.0, top_k: int = 10, id_col: str = "doc_id",
                 text_col: str = "text", positive: int = 1) -> DataFrame:
    """XPL-2: local surrogate per issue.

    All variants of all issues are scored by one ``model.transform`` and stay
    in the task that made them, one issue after the other; the weighted ridge
    fit (intercept unpenalised) is a closed-form solve per issue there. The
    model must transform rows in place. Nothing is shuffled, a task holds the
    masks of one issue's ``n_samples`` variants, and its tokens go to Python
    once. An issue without tokens has no rows; rows that repeat are each
    explained.

    Where the model's raw prediction adds up over words, ``model.transform``
    scores each distinct word of an issue alone, once, and a variant's raw
    prediction is the sum over the words that its mask keeps: the same numbers
    without ``n_samples`` texts of each issue.
    """
    if adds_up_over_words(model):
        words = model.stages[0].getInputCol()
        raw = F.element_at(vector_to_array("rawPrediction"), positive + 1)
        empty = docs.sparkSession.createDataFrame([("",)], f"`{words}` string")
        base = model.transform(empty).select(raw.alias("raw")).head()["raw"]
        if math.isfinite(base):
            one = docs.select(F.col(id_col).cast("long").alias("doc_id"), split_words(F.col(text_col)).alias("words"))
            one = one.select("doc_id", "words", F.posexplode(F.array_distinct("words")).alias("at", words))
            scored = model.transform(one).select("doc_id", "at", F.when(F.col("at") == 0, F.col("words")).alias("words"),
                                                 F.col(words).alias("tok"), raw.alias("raw"))
            return scored.mapInArrow(_ridge_per_doc_of_words(base, n_samples, seed, top_k, ridge, kernel_width), LIME_SCHEMA)

    var = lime_variants(docs, n_samples=n_samples, seed=seed, id_col=id_col, text_col=text_col)
    scored = model.transform(var.where(F.size("toks") > 0)).select(
        "doc_id", "v", F.when(F.col("v") == 0, F.col("toks")).alias("toks"),
        "kept", F.element_at(vector_to_array("probability"), positive + 1).alias("p1"))
    return scored.mapInPandas(_ridge_per_doc(top_k, ridge, kernel_width), LIME_SCHEMA)
