"""Suffix dedup and the n-gram join against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from issuelens.llm import graph, ngram_join, suffix_dedup
from issuelens.llm.textbytes import repeated


def removed(texts, length):
    """Per text: (bytes, removed, runs, sha256 of the rest), by counting every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def without_repeated_words(texts, length):
    """Texts without their stretches of ``length`` words that are found twice, by counting every window."""
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    words = [tuple(m[0] for m in f) for f in found]
    seen = Counter(w[i:i + length] for w in words for i in range(len(w) - length + 1))
    out = []
    for text, f, w in zip(texts, found, words):
        spans = [(f[i].start(), f[i + length - 1].end()) for i in range(len(w) - length + 1) if seen[w[i:i + length]] > 1]
        gone = [False] * len(text or "")
        for a, b in spans:
            gone[a:b] = [True] * (b - a)
        out.append(None if text is None else "".join(c for c, g in zip(text, gone) if not g))
    return out


@pytest.mark.parametrize("length,block", [(8, 4000), (8, 2), (50, 4000)])
def test_suffix_dedup_of_words_is_exact(spark, docs, odd, monkeypatch, length, block):
    """Whatever white space is between the words, and with letters of several bytes."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(length)
    words = [f"wörd{i}" if i % 3 else f"日{i}" for i in range(60)]
    own = [(1000 + k, "".join(w + rng.choice([" ", "\n", "\t  "]) for w in words[rng.randint(0, 5):rng.randint(40, 60)])) for k in range(20)]
    rows = [(r.doc_id, r.text) for d in (docs, odd) for r in d.select("doc_id", "text").collect()] + own
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(i, t) for (i, _), t in zip(rows, without_repeated_words([t for _, t in rows], length))]
    got = suffix_dedup.suffix_dedup(df, length, "word").select("doc_id", "dedup.kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def suffix_rows(df, length):
    got = suffix_dedup.suffix_dedup(df, length).select(
        "doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans"), F.sha2("dedup.kept", 256)).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("length,block", [(60, 4000), (60, 2), (400, 4000)])
def test_suffix_dedup_is_exact(spark, docs, monkeypatch, length, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *v) for r, v in zip(rows, removed([r.text for r in rows], length)))
    assert suffix_rows(docs, length) == want


def test_suffix_dedup_of_shared_passages(spark, monkeypatch):
    """One passage in every text, at every overlap, with periodic and multi-byte text."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(rng.randint(0, 20))) + passage[rng.randint(0, 60):len(passage) - rng.randint(0, 60)]
             + " ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(25)]
    texts += ["ab" * 60, "ab" * 45, "a" * 200, passage, passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *v) for i, v in enumerate(removed(texts, 40)))
    assert suffix_rows(df, 40) == want


def test_suffix_dedup_odd_rows(odd, none):
    got = suffix_dedup.suffix_dedup(odd, 400)
    assert got.columns == [c for c in odd.columns if c != "dedup"] + ["dedup"]
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        whole = r.doc_id in (5, 6)
        assert r.dedup.n_removed == (r.dedup.n_bytes if whole else 0)
        assert r.dedup.kept_text == ("" if whole else r.text)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_groups(rows):
    """(set size, smallest linked id) of each row, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(ids.get(root(k), i), i)
    return [(i, len(s), ids.get(root(k), None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_ngram_join_is_exact(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.ngram_join(docs).collect())) == sorted(near_groups(rows))


def text_batches(texts, rows):
    return [pa.record_batch({"text": pa.array(texts[i:i + rows], pa.string())}) for i in range(0, len(texts), rows)]


def test_shingle_count_costs_the_same_in_many_ranges():
    """Classes are listed once for the rows gathered, not again with every range."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(600)) for _ in range(200)]
    sizes = [sum(b.nbytes for b in ngram_join.shingle_blocks(5, ranges)(iter(text_batches(texts, 50)))) for ranges in (8, 256)]
    assert sizes[1] < 1.2 * sizes[0]


@pytest.mark.parametrize("rows,ranges", [(7, 3), (1, 16), (100, 1)])
def test_shingle_count_keeps_the_classes_that_may_link(monkeypatch, rows, ranges):
    """Copies of a class in several blocks are no other class; near copies, also of copied texts, are."""
    monkeypatch.setattr(ngram_join, "GATHER", 1)
    rng = random.Random(rows)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = [words(rng.randint(1, 60)) for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join(b) for b in base[:10] for _ in range(3)]
    texts += [" ".join(b + words(k)) for b in base[5:25] for k in (1, 4, 12)] + ["", None, "x"]
    rng.shuffle(texts)
    blocks = ngram_join.shingle_blocks(5, ranges)(iter(text_batches(texts, rows)))
    table = pa.Table.from_batches(blocks)
    parts = [table.filter(pa.compute.equal(table["part"], k)).to_batches() for k in range(ranges)]
    counts = pa.Table.from_batches([b for p in parts for b in ngram_join.shared_counts(iter(p))]).sort_by("block")
    got = Counter()
    for b in ngram_join.reaches(75)(iter(counts.to_batches(max_chunksize=4))):
        for cls, reach in zip(b.column("cls").to_pylist(), b.column("reach").to_pylist()):
            got[cls, reach] += 1
    kept = {cls for (cls, reach), own in got.items() if reach > own}
    sets = {shingles(t) for t in texts} - {frozenset()}
    names = {}
    for chunk in ngram_join.text_chunks(pa.array(texts)):
        for t, c in zip(texts, ngram_join.fingerprints(*ngram_join.shingle_sets(chunk)).view(np.int64).tolist()):
            names[shingles(t)] = c
    want = {names[s] for s in sets if 100 * sum(any(x in o for o in sets if o != s) for x in s) >= 75 * len(s)}
    assert kept == want and 10 < len(want) < len(sets)


def test_ngram_join_of_near_copies(spark):
    """Chains of near copies around the threshold, shared passages, and short texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts, common = [], [word() for _ in range(25)]
    for _ in range(6):
        base = [word() for _ in range(60)]
        for _ in range(20):
            base = list(base) if rng.random() < 0.5 else texts[-1].split() if texts else base
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base + (common if rng.random() < 0.3 else [])))
    texts += ["x", "X", "x y", "", None]
    rows = [(7 * i % 1000, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect())) == sorted(near_groups(rows))


def test_ngram_join_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, ngram_join.ngram_join(odd).collect()), key=key) == sorted(near_groups(rows), key=key)
    assert ngram_join.ngram_join(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {k: k for e in edges for k in e}
    for _ in range(500):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {k: v for k, v in parent.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_repeated():
    twice, later = repeated(np.array([3, 1, 3, 2, 1, 3], np.uint64))
    assert twice.tolist() == [True, True, True, False, True, True]
    assert later.tolist() == [False, False, True, False, True, True]
