"""Sharding: counts, slots, mixture of each shard, odd tables, and the DuckDB twin."""
import zlib
from collections import Counter

import pytest

from issuelens.llm import sharding
from tests.llm.test_native import twin


def layout(rows, shards):
    """Checks what the law asks for and returns the rows of each shard."""
    sizes = Counter(r.shard for r in rows)
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(sizes) <= set(range(shards))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    return counts


@pytest.mark.parametrize("shards", [1, 7, 40, 500])
def test_every_shard_matches_the_mixture(spark, shards):
    """One source with a third of the rows, many with one, one null; each has its share of a shard within three rows."""
    rows = [(i, f"text {i % 11}", "hot" if i % 3 == 0 else f"s{i % 5}" if i % 3 == 1 else f"one{i}" if i % 2 else None) for i in range(900)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), shards).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.source) for r in got) == [
        (i, len(t) + 16, zlib.crc32(t.encode()), s) for i, t, s in rows]
    layout(got, shards)
    share, found = Counter(s for _, _, s in rows), Counter((r.shard, r.source) for r in got)
    for source in ("hot", "s1", None):
        for k in range(shards):
            assert abs(found[k, source] - share[source] / shards) <= 3
    if shards == 7:  # sources of one row are spread too
        assert min(sum(v for (k, s), v in found.items() if k == j and (s or "").startswith("one")) for j in range(7)) > 18


def test_shards_do_not_depend_on_partitions(spark, docs):
    one, two = (sorted(map(tuple, sharding.shard_documents(d).collect())) for d in (docs.coalesce(1), docs.repartition(6)))
    assert one == two


def test_odd_and_empty_tables(spark, odd, none):
    odd = odd.withColumn("source", odd.rules)
    got = sharding.shard_documents(odd, 4).collect()
    assert len(got) == odd.count() and sum(layout(got, 4)) == len(got)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(16, 0)}
    assert sharding.shard_documents(none.withColumn("source", none.rules)).count() == 0
    assert sum(r.rows for r in sharding.mixture(sharding.shard_documents(odd, 4)).collect()) == len(got)


def test_twin(spark):
    twin(spark, "op12_stratified_sharding", "documents")
