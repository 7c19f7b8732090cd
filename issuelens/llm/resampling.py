"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features are the runs of ``least`` to ``most`` words of a text, joined by one
space, hashed into ``buckets`` by crc32. They are found by *batch
concatenation*: the texts of a batch are joined with separator bytes that are
in no word, one pass of a regular expression finds the words of all texts,
``searchsorted`` on the documents' offsets names each word's document, n-grams
whose first and last word are in different documents are masked, and the rest
goes into ``bincount``: over buckets to count a table, over documents to sum
weights.

The gain of a bucket is the log ratio of its smoothed shares in target and
source, in whole thousandths. A document's weight is the sum of its gains, its
score adds seeded Gumbel noise from a hash of its id, so the highest scores are
a sample without replacement in proportion to the weights. The draw is a place
in a global order, found in sorted ranges.

Defined results: a null or empty text has no features and weight 0, and is
never drawn; rows that repeat have equal scores and are drawn each for itself;
a null id hashes as the empty string and comes last among ties; an empty target
or source counts 0 in every bucket; an empty table gives an empty result; other
columns are not read. A text of any length is handled whole, in memory of a few
times its size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.ranking import global_rank, numbered
from issuelens.llm.sqltext import CRC_TABLE_SQL, crc_sql

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Words of UTF-8 bytes: digits, lower-case letters and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
SEPARATOR = b"\n"
#: Bytes of texts that are joined, and words that are Python objects at a time.
JOIN_BYTES = 1 << 22
WORDS_AT_ONCE = 200_000
#: Hashes of words that a task keeps.
KEPT_HASHES = 500_000
#: The same words of a text for DuckDB: code points instead of bytes.
WORDS_SQL = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


def words(data: bytes, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, crc32) of every word of the joined texts, by one pass of the regular expression."""
    found, parts = WORD.finditer(data), []
    while block := list(islice(found, WORDS_AT_ONCE)):
        own = [m.group() for m in block]
        new = set(own).difference(known)
        if len(known) + len(new) > KEPT_HASHES:
            known.clear()
            new = set(own)
        known.update((w, zlib.crc32(w)) for w in new)
        parts.append((np.fromiter((m.start() for m in block), np.int64, len(own)),
                      np.fromiter((m.end() for m in block), np.int64, len(own)),
                      np.fromiter(map(known.__getitem__, own), np.int64, len(own))))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts))


def features(texts: list[str | None], least: int, most: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, crc32 of each feature, words of each document) of a batch of texts."""
    texts = [(t or "").encode().lower() for t in texts]  # bytes.lower changes A-Z only
    data = SEPARATOR.join(texts)
    offsets = np.cumsum([0, *(len(t) + len(SEPARATOR) for t in texts)])
    start, end, crc = words(data, known)
    doc = np.searchsorted(offsets, start, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    docs, hashes = [], []
    for n in range(1, most + 1):
        if n > 1:  # runs of n words: those of n - 1 with the next word, where it is in the same document
            whole = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
            grown = np.zeros(max(0, len(doc) - n + 1), np.int64)
            grown[whole] = np.fromiter((zlib.crc32(data[a:b], zlib.crc32(b" ", c)) for a, b, c in zip(
                start[whole + n - 1].tolist(), end[whole + n - 1].tolist(), crc[whole].tolist())), np.int64, len(whole))
            crc = grown
        else:
            whole = np.arange(len(doc))
        if n >= least:
            docs.append(doc[whole])
            hashes.append(crc[whole])
    return np.concatenate(docs), np.concatenate(hashes), n_words


def text_batches(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of whole rows with about ``JOIN_BYTES`` bytes, or one longer text."""
    sizes = np.frombuffer(column.cast(pa.large_string()).buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = min(max(at + 1, int(np.searchsorted(sizes, sizes[at] + JOIN_BYTES, "right")) - 1), len(column))
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def counted(least: int, most: int, buckets: int):
    """Task body over ``text``: ``(bucket, n)``, the task's count of features in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), {}
        for batch in batches:
            for _, texts in text_batches(batch.column("text")):
                total += np.bincount(features(texts, least, most, known)[1] % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})
    return run


def bucket_counts(table: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts of ``table`` in each bucket (at most ``buckets`` rows reach the driver)."""
    rows = (table.select("text").mapInArrow(counted(least, most, buckets), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(buckets, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of each bucket's smoothed shares, as integers."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(gain: np.ndarray, least: int, most: int):
    """Task body over ``(doc_id, text)``: ``(doc_id, n_words, n_features, weight)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for first, texts in text_batches(batch.column("text")):
                doc, crc, n_words = features(texts, least, most, known)
                n = np.bincount(doc, minlength=len(texts))
                weight = np.bincount(doc, weights=gain[crc % len(gain)], minlength=len(texts))  # whole numbers below 2**53
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(first, len(texts)), "n_words": pa.array(n_words.astype(np.int64)),
                    "n_features": pa.array(n.astype(np.int64)), "weight": pa.array(weight.astype(np.int64))})
    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from the first 8 hex digits of sha256(``seed:doc_id``)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank, n_words)`` of every row of ``docs``; ``rank`` is null where not drawn.

    The draw is ``percent`` percent, rounded down, of the documents with at
    least ``least_words`` words: the highest scores, ties to the smaller id.
    Texts are read twice, to count and to weigh; what is sorted is one short row
    for each document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(docs, least, most, buckets), bucket_counts(target, least, most, buckets))
    rows = (docs.mapInArrow(weighed(gain, least, most), "doc_id long, n_words long, n_features long, weight long")
            .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= least_words))
    rows = numbered(rows, "row")
    draw = rows.where("fit").count() * percent // 100
    placed = global_rank(rows, "place", F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    rank = F.when(F.col("fit") & (F.col("place") < draw), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")


def resample_sql(least_words: int = LEAST_WORDS, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """DuckDB twin of the single-word form over the views ``documents`` and ``benchmark``."""
    return f"""WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
hashed AS (SELECT w, {crc_sql("w")} % {buckets} AS k FROM vocab, crc_table),
src AS (SELECT k, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY k),
tgt AS (SELECT k, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY k),
tot AS (SELECT coalesce((SELECT sum(n) FROM src), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM tgt), 0)::DOUBLE AS t),
gain AS (SELECT src.k, floor(1000 * ln((coalesce(tgt.n, 0) + 1) * (tot.s + {buckets}) / ((src.n + 1) * (tot.t + {buckets}))))::BIGINT AS g
  FROM src LEFT JOIN tgt USING (k), tot),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_features >= {least_words} DESC, score DESC, doc_id) AS place,
  count(*) FILTER (n_features >= {least_words}) OVER () * {percent} // 100 AS draw FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank, n_features AS n_words FROM ranked"""
