"""Quality score by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained here, one from texts labelled good, one
from texts labelled bad. A text is cut into blocks of ``BLOCK`` bytes, so that
a dictionary helps a long text as much as a short one, and every block is
compressed with both. The difference of the compressed sizes and the smaller
size's level (text that repeats itself compresses to next to nothing under
either), both divided by the size of the text, go through a logistic curve
fitted on other labelled texts.

Defined results: a null or empty text has difference and level 0, so it gets
the curve's value there; with no labelled text of a class every score is the share of label
1 among the labels (0.5 with none); equal texts get equal scores; an empty
table gives an empty result; other columns pass through, except that ``score``
is added (a column of that name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import excerpt, held_out, training_ids, with_ids

BLOCK = 2048
LEVEL = 3
DICT_BYTES = 128 * 1024
#: Labelled texts of each class: at most this many rows, and no longer ones than this, are used to fit.
TRAIN_PER_CLASS = 2000
TRAIN_MAX_BYTES = 20_000


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray  # of difference, level and 1


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, model: Model) -> None:
        self.by = []
        for data in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False))

    def features(self, data: bytes) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one, the smaller of the two) / bytes of the text."""
        if not data:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(data[a:a + BLOCK])) for a in range(0, len(data), BLOCK)) for c in self.by)
        return (bad - good) / len(data), min(bad, good) / len(data)


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """The content of a dictionary that holds what the texts have in common."""
    blocks = [t[a:a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
    total = b"".join(blocks)
    if len(total) <= size or len(blocks) < 16:
        return total[-size:]
    return zstandard.train_dictionary(size, blocks, k=200, d=8).as_bytes()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of ``x`` and of 1 in a logistic curve, by Newton's method."""
    scale = np.append(np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0), 1.0)
    design = np.column_stack([x, np.ones(len(x))]) / scale
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - ridge * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_PER_CLASS) -> Model:
    """Dictionaries from two thirds of a bounded sample of labelled texts, the curve from the other third.

    The driver gets at most ``2 * per_class`` texts; of one with more than
    ``TRAIN_MAX_BYTES`` it gets stretches with as many characters. The curve is weighted to the label shares of all
    labelled rows outside the held-out fold.
    """
    some = docs.where(F.octet_length("text") > 0)
    got = (with_ids(some, training_ids(labels, label, per_class)).withColumn("text", excerpt(F.col("text"), TRAIN_MAX_BYTES))
           .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))).toArrow().to_pandas())
    got = got.sort_values(["doc_id", "text"], kind="stable")
    texts = np.array([t.encode() for t in got["text"]], object)
    y, part = got["label"].to_numpy().astype(int), got["part"].to_numpy()
    share = len(y) and training_share(labels, label)
    if not len(y) or y.min() == y.max():
        p = min(max(share if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(b"", b"", np.array([0.0, 0.0, np.log(p / (1 - p))]))
    model = Model(*(dictionary(list(texts[(y == k) & (part != 0)])) for k in (1, 0)), np.zeros(3))
    test = part == 0 if len(set(y[part == 0])) == 2 else np.ones(len(y), bool)
    sizes = Sizes(model)
    x = np.array([sizes.features(t) for t in texts[test]])
    yt = y[test]
    weight = np.where(yt == 1, share / max(1, (yt == 1).sum()), (1 - share) / max(1, (yt == 0).sum())) * len(yt)
    model.weights = logistic(x, yt, weight)
    return model


def training_share(labels: DataFrame, label: str) -> float:
    """Share of label 1 among all labelled rows outside the held-out fold."""
    found = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(label)).head()[0]
    return 0.5 if found is None else float(found)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score``: a narrow map over whole texts."""
    names = [c for c in docs.columns if c.lower() != "score"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model) if model.good and model.bad else None
        for batch in batches:
            x = np.array([sizes.features(t.as_py().encode()) if sizes and t.is_valid else (0.0, 0.0)
                          for t in batch.column("text")], float).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:2] + model.weights[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p, pa.float64())],
                                             names=[*names, "score"])

    return docs.select(*names).mapInArrow(run, schema)
