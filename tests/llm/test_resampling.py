"""Importance resampling against a plain count of every word and n-gram, and its DuckDB twin."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from issuelens.llm import resampling
from tests.llm.test_native import twin

LETTERS = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, target, least, most, buckets, percent, least_words):
    """(id, n_features, weight, score, rank, n_words) of every row, sorted by place."""
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
        return [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                for n in range(least, most + 1) for i in range(len(words) - n + 1)], len(words)
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[0])
    for text in target:
        t.update(grams(text)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, text in rows:
        found, n = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((n < least_words, -(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))), i is None, i, len(found), weight, n))
    out.sort(key=lambda x: x[:3] + (x[3] or 0,))
    draw = sum(not x[0] for x in out) * percent // 100
    return [(x[3], x[4], x[5], -x[1], k + 1 if k < draw and not x[0] else None, x[6]) for k, x in enumerate(out)]


def no_nulls(rows):
    return sorted((tuple((x is None, x or 0) for x in r) for r in map(tuple, rows)))


@pytest.mark.parametrize("least,most,buckets", [(1, 1, 10_000), (1, 2, 500), (2, 4, 1000)])
def test_resampling_is_exact(spark, docs, odd, monkeypatch, least, most, buckets):
    monkeypatch.setattr(resampling, "JOIN_BYTES", 3000)
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", 100)
    monkeypatch.setattr(resampling, "KEPT_HASHES", 300)
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text")
    got = resampling.resample(rows, target, least, most, buckets, 30, 5).collect()
    want = plain([tuple(r) for r in rows.collect()], [r.text for r in target.collect()], least, most, buckets, 30, 5)
    assert no_nulls(got) == no_nulls(want)
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_texts_of_a_batch_stay_apart():
    doc, crc, n_words = resampling.features(["a b", None, "", "c", "D é9!x"], 1, 3, {})
    words = [["a", "b", "a b"], [], [], ["c"], ["d", "é9", "x", "d é9", "é9 x", "d é9 x"]]
    assert sorted(zip(doc.tolist(), crc.tolist())) == sorted((k, zlib.crc32(w.encode())) for k, own in enumerate(words) for w in own)
    assert n_words.tolist() == [2, 0, 0, 1, 3]


def test_empty_tables(spark, odd, none):
    assert resampling.resample(none, odd).count() == 0
    rows = resampling.resample(odd, none, percent=100, least_words=1).collect()
    assert len(rows) == odd.count() and {r.weight for r in rows if r.n_features == 0} == {0}
    assert sum(r.rank is not None for r in rows) == sum(r.n_words > 0 for r in rows)


def test_twin(spark):
    twin(spark, "op11_importance_resampling", "documents", "benchmark")
