"""Label encoding, classification metrics and result analytics.

PRJ-6..8, FLT-6, AGG-5..9, TOP-3, TOP-4, RES-1..3, UDF-2. Every metric is a
``DataFrame -> DataFrame`` over ``(label, prediction)``: the confusion matrix
is one partial aggregate (a handful of groups), everything after it works on
that tiny table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens import fixed


def encode_label_fixed(df: DataFrame, label_col: str = "label", out: str = "label") -> DataFrame:
    """PRJ-6: ``Non-ATD`` -> 0, ``ATD`` -> 1, anything else -> null."""
    code = (F.when(F.col(label_col) == fixed.CLASS_NAMES[0], 0)
            .when(F.col(label_col) == fixed.CLASS_NAMES[1], 1))
    return df.withColumn(out, code)


def require_codes(df: DataFrame, col: str) -> DataFrame:
    """Guard for PRJ-6: fail if any label did not encode."""
    if not df.filter(F.col(col).isNull()).isEmpty():
        raise ValueError(f"unknown label value in column {col!r}")
    return df


def encode_label_first_seen(df: DataFrame, label_col: str, order_col: str, out: str = "code") -> DataFrame:
    """PRJ-7: code labels 0, 1, ... by first appearance along ``order_col``.

    ``groupBy(label).min(order)`` is a partial aggregate with one row per distinct
    label. Codes are consecutive, so these rows (and only they) are ranked in one
    window; the planner sizes the join back.
    """
    firsts = df.groupBy(label_col).agg(F.min(order_col).alias("_first"))
    codes = firsts.select(label_col, (F.row_number().over(Window.orderBy("_first", label_col)) - 1)
                          .cast("int").alias(out))
    return df.join(codes, label_col)


def label_variant(df: DataFrame, variant: str, label_col: str = "label") -> DataFrame:
    """PRJ-8: ``drop_weak`` removes Weak-ATD; ``weak_to_atd`` folds it into ATD."""
    if variant == "drop_weak":
        return df.filter(F.col(label_col) != "Weak-ATD")
    if variant == "weak_to_atd":
        return df.withColumn(label_col, F.when(F.col(label_col) == "Weak-ATD", "ATD").otherwise(F.col(label_col)))
    raise ValueError(f"unknown variant {variant!r}")


def misclassified(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                  keep: Sequence[str] = ("text",)) -> DataFrame:
    """FLT-6: rows with prediction != label."""
    return df.filter(F.col(pred_col) != F.col(label_col)).select(*keep, label_col, pred_col)


def confusion_matrix(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """AGG-5: ``(label, prediction, n)``."""
    return df.groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def per_class(cm: DataFrame) -> DataFrame:
    """``(cls, tp, fp, fn, support, precision, recall, f1)``; classes = labels ∪ predictions.

    Works on the confusion matrix (at most classes² rows).
    """
    as_label = cm.groupBy(F.col("label").alias("cls")).agg(
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    as_pred = cm.groupBy(F.col("prediction").alias("cls")).agg(
        F.sum(F.when(F.col("label") != F.col("prediction"), F.col("n")).otherwise(0)).alias("fp"))
    j = as_label.join(as_pred, "cls", "full")
    j = j.select("cls", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "support", "fp")])
    j = j.withColumn("fn", F.col("support") - F.col("tp"))
    p = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    j = j.withColumn("precision", p).withColumn("recall", r)
    return j.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall")))


def macro_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """AGG-6: one row ``(n, accuracy, precision, recall, fscore)``, macro means, 0 on zero division."""
    pc = per_class(confusion_matrix(df, label_col, pred_col))
    return pc.agg(
        F.sum("support").alias("n"),
        _safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("fscore"))


def macro_of_cells(cells: Sequence[tuple]) -> dict[str, float]:
    """AGG-6 of the collected cells ``(label, prediction, n)`` of a confusion matrix, a row a pair of classes."""
    tp, support, fp = Counter(), Counter(), Counter()
    for label, prediction, n in cells:
        # a null label and a null prediction are no class in common
        own, other = ("label", None) if label is None else label, ("prediction", None) if prediction is None else prediction
        tp[own] += n if own == other else 0
        support[own] += n
        fp[other] += n if own != other and None not in (label, prediction) else 0
    found = []
    for c in support.keys() | fp.keys():
        p, r = (tp[c] / d if d else 0.0 for d in (tp[c] + fp[c], support[c]))
        found.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
    total = sum(support.values())
    means = [math.fsum(x) / len(found) for x in zip(*found)]
    return dict(zip(("accuracy", "precision", "recall", "fscore"), [sum(tp.values()) / total if total else 0.0, *means]))


def binary_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                   pos_label: int = 1) -> DataFrame:
    """AGG-7: accuracy and P/R/F1 of the positive class."""
    s = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(label_col) == F.col(pred_col), 1).otherwise(0)).alias("correct"),
        F.sum(F.when((F.col(label_col) == pos_label) & (F.col(pred_col) == pos_label), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col(label_col) != pos_label) & (F.col(pred_col) == pos_label), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col(label_col) == pos_label) & (F.col(pred_col) != pos_label), 1).otherwise(0)).alias("fn"))
    p = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    s = s.select("n", _safe_div(F.col("correct"), F.col("n")).alias("accuracy"), p.alias("precision"),
                 r.alias("recall"))
    return s.withColumn("fscore", _safe_div(2 * F.col("precision") * F.col("recall"),
                                            F.col("precision") + F.col("recall")))


def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                          names: Sequence[str] = fixed.CLASS_NAMES) -> DataFrame:
    """AGG-8: per-class rows plus ``macro avg`` and ``weighted avg`` rows."""
    pc = per_class(confusion_matrix(df, label_col, pred_col))
    name_map = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    rows = pc.select(F.coalesce(F.element_at(name_map, F.col("cls").cast("int")), F.col("cls").cast("string"))
                     .alias("class"), "precision", "recall", "f1", "support")
    macro = pc.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    tot = F.sum("support")
    weighted = pc.agg(F.lit("weighted avg").alias("class"),
                      _safe_div(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
                      _safe_div(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
                      _safe_div(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"),
                      tot.alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def argmax_class(p: Column) -> Column:
    """TOP-3: 0-based index of the largest score, first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def best_iteration(curves: DataFrame, model_col: str = "model", it_col: str = "training_size",
                   score_col: str = "fscore") -> DataFrame:
    """TOP-4 / RES-2: per model, the first row with the largest score."""
    best = F.max_by(F.struct(F.col(it_col), F.col(score_col)), F.struct(F.col(score_col), -F.col(it_col)))
    return curves.groupBy(model_col).agg(best.alias("b")).select(
        model_col, F.col("b." + it_col).alias("best_" + it_col), F.col("b." + score_col).alias("best_" + score_col))


def effort_saved(curves: DataFrame, total: int | Column, target: float | None = None,
                 model_col: str = "model", size_col: str = "training_size", score_col: str = "fscore") -> DataFrame:
    """RES-3: ``1 - size_at_target / total``; target defaults to the model's best score.

    Null when the target is never reached.
    """
    total_c = total if isinstance(total, Column) else F.lit(total)
    if target is None:
        w = Window.partitionBy(model_col)
        reach = curves.withColumn("_t", F.max(score_col).over(w))
    else:
        reach = curves.withColumn("_t", F.lit(target))
    first = reach.groupBy(model_col).agg(
        F.min(F.when(F.col(score_col) >= F.col("_t"), F.col(size_col))).alias("size_at_target"))
    return first.withColumn("effort_saved", F.lit(1.0) - F.col("size_at_target") / total_c)


def union_curves(frames: dict[str, DataFrame]) -> DataFrame:
    """RES-1: strategy curves as one table with a ``model`` column."""
    out = None
    for model, df in frames.items():
        d = df.withColumn("model", F.lit(model))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def custom_metric(df: DataFrame, fn, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """UDF-2: a caller metric is any ``DataFrame(label, prediction) -> DataFrame``."""
    return fn(df.select(F.col(label_col).alias("label"), F.col(pred_col).alias("prediction")))
