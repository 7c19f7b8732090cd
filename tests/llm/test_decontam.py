"""Decontamination: exact distances, recall at the edit bound, odd rows."""
import random
import re

import numpy as np
from pyspark.sql import functions as F

from issuelens.llm import decontam


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def distance(item, text):
    """Edits between an item and the closest stretch of a text, by the plain recurrence."""
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(text):
            new.append(min(cost[j] + (w != v), cost[j + 1] + 1, new[j] + 1))
        cost = new
    return min(cost)


def test_closest_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        item = [rng.randrange(5) for _ in range(rng.randint(1, 9))]
        text = [rng.randrange(5) for _ in range(rng.randint(0, 14))]
        d, s, e = decontam.closest(np.array(item, np.uint64), np.array(text, np.uint64))
        assert d == distance(item, text) and 0 <= s <= e <= len(text)
        assert distance(item, text[s:e]) == d


def edited(item, edits, rng):
    out = list(item)
    for _ in range(edits):
        p, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[p] = f"new{rng.randrange(999)}"
        elif kind == 1:
            out.insert(p, f"new{rng.randrange(999)}")
        else:
            del out[p]
    return out


def test_recall_at_the_bound(spark, more):
    """Items planted with as many edits as allowed are found; the rest of the corpus agrees with brute force."""
    rng = random.Random(9)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r.item_id: words(r.text) for r in bench.collect()}
    clean = [words(r.text) for r in more.orderBy("doc_id").limit(60).collect()]
    rows, truth = [], set()
    for n in range(300):
        k = rng.choice(list(items))
        around = rng.choice(clean)[:200]
        at = rng.randint(0, len(around))
        text = around[:at] + edited(items[k], int(0.2 * len(items[k])), rng) + around[at:]
        rows.append((n, " ".join(w.upper() if rng.random() < 0.2 else w + "," for w in text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(df, bench).collect()}
    truth = {(i, k): distance(w, words(t)) for i, t in rows for k, w in items.items()}
    truth = {p: d for p, d in truth.items() if d <= int(0.2 * len(items[p[1]]))}
    assert got.keys() <= truth.keys()
    assert len(got) >= 0.97 * len(truth)
    assert all(truth[p] == d for p, d in got.items())


def test_blocks_of_items_give_the_same(spark, more):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    one = sorted(map(tuple, decontam.contaminated(more, bench).collect()))
    assert one and one == sorted(map(tuple, decontam.contaminated(more, bench, item_bytes=3000).collect()))
    dirty = {r[0] for r in one}
    left = {r.doc_id for r in decontam.decontaminated(more, bench, item_bytes=3000).select("doc_id").collect()}
    assert left == {r.doc_id for r in more.select("doc_id").collect()} - dirty


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "...")], "item_id long, text string")
    got = decontam.contaminated(odd, bench).groupBy("doc_id", "item_id").count().collect()
    assert sorted(((r.doc_id or 0), r.item_id, r["count"]) for r in got) == [(0, 3, 2), (4, 3, 4)]
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(odd, bench.where("item_id > 9")).count() == 0
    kept = decontam.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.where(F.col("text") == "one two").count() == 0
