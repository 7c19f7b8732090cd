"""Hard negatives against the scores of all pairs, and the DuckDB twin."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import negatives
from tests.llm.test_native import twin

FORM = "id long, label int, vector array<double>, score double, part string, block int"


def plain(rows, every, positives, count, low, high, scale):
    ok = [(i, y, [math.floor(x * scale) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in ok:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in ok if j != i)
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            found = [(n, -t) for t, n, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:count]
            out += [(i, p, r + 1, n, -s, t) for r, (n, t) in enumerate(found)]
    return sorted(out)


def check(spark, rows, every=5, positives=5, count=3, low=50, high=95, scale=16):
    df = spark.createDataFrame([(*r, 0.5, "x", 3) for r in rows], FORM).repartition(3)
    got = negatives.hard_negatives(df, F.col("id") % every == 0, positives, count, low, high, scale)
    want = plain(rows, every, positives, count, low, high, scale)
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.mark.parametrize("width,blocks", [(1, 1 << 16), (3, 64), (12, 256), (40, 1 << 16)])
def test_negatives_are_exact(spark, monkeypatch, width, blocks):
    """Many ties (small whole numbers), clusters, negative and zero components, one label with most rows."""
    monkeypatch.setattr(negatives, "BLOCK_LEAST", blocks)
    monkeypatch.setattr(negatives, "FIRST_DEPTH", 4)
    monkeypatch.setattr(negatives, "GROUP", 7)
    rng = np.random.default_rng(width)
    centre = rng.normal(size=(4, width))
    rows = [(int(i), int(y), [float(x) for x in np.round(centre[y] + rng.normal(size=width) * 0.4, 1)])
            for i, y in zip(rng.permutation(400), rng.choice(4, 400, p=[0.6, 0.2, 0.15, 0.05]))]
    assert check(spark, rows, low=5)


def test_odd_rows(spark):
    v = [0.5, 1.0, -0.25]
    rows = [(0, 1, v), (5, 1, [0.0, 0.0, 0.0]), (10, 2, v), (10, 2, v), (None, 1, v), (3, None, v), (4, 1, None), (6, 1, [0.5, None, 1.0]),
            (7, 1, [0.5, math.nan, 1.0]), (8, 1, [math.inf, 0.0, 0.0]), (9, 1, [0.5]), (11, 2, []), (12, 2, [0.4, 0.9, -0.25]),
            (13, 2, [0.3, 0.8]), (14, 1, [0.6, 1.0, -0.3]), (15, 3, v), (16, 2, [0.4, 0.9, -0.25]), (20, 4, [-1.0, 0.0, 0.0])]
    want = check(spark, rows)
    assert {w[0] for w in want} == {0, 5, 10}
    check(spark, [])
    check(spark, rows[:1])


def test_large_numbers_stay_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=4) * 2.0 ** 24]) for i in range(60)]
    assert check(spark, rows, low=0, high=99)


def test_the_threshold_stops_before_the_end():
    """With components that fall off, the best rows are found without scoring all."""
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.exponential(size=(20_000, 3)) ** 3)
    block, scored = negatives.Block(np.arange(20_000), np.full(20_000, "a"), vectors), []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            scored.append(len(key))
            return np.asarray(self)[key]
    block.vectors = vectors.view(Counted)
    anchor = np.array([2.0, 1.0, 3.0])
    _, ids, scores = next(block.search(anchor, np.ones(20_000, bool), negatives.score_windows(None, 0, 0), 5))
    assert scores.tolist() == np.sort(vectors @ anchor)[::-1][:5].tolist() and sum(scored) < 2000


def test_twin(spark):
    twin(spark, "op13_hard_negatives", "embeddings")
