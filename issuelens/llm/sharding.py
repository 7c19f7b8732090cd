"""Shards that each match the mixture of sources: proportional stratified interleaving.

Within a source, rows are put in a seeded order and the row at place r of n
gets the fractional rank (r + phase) / n. Phases are the radical inverses of
the sources' places by size, so that sources of one size, those of one row
above all, are spread evenly too. All rows are sorted by fractional rank, which
deals every source out evenly, and the order is cut into shards whose row
counts are at most one apart (the law ``rows``): a source has its share of
every shard but for one row and its part of the others' rounding.

Both orders are found in sorted ranges (``ranking.global_rank``), so a source
with any share of the rows is spread over many tasks. Rows that are shuffled
hold ids and digests, never texts.

Defined results: a null text has size 16 and the crc32 of no bytes; null
sources are one source; a null id orders as the empty string; rows that repeat
are dealt each for itself; with fewer rows than shards some shards stay
empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.ranking import global_rank, numbered
from issuelens.llm.sqltext import CRC_TABLE_SQL, crc_sql

SHARDS = 40
SEED = 2024
#: Bytes of a row besides its text.
ROW_BYTES = 16


def digits(text: Column, n: int) -> Column:
    """The first ``n`` (at most 15) hex digits of sha256 as a number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, n), 16, 10).cast("long")


def radical_inverse(place: Column) -> Column:
    """The binary digits of a place read backwards behind the point: 0, 1/2, 1/4, 3/4, ..."""
    return F.conv(F.reverse(F.lpad(F.bin(place), 32, "0")), 2, 10).cast("double") / 4294967296


def interleave(rows: DataFrame, stratum: str, key: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (place in the shard, gapless from 0).

    ``rows`` has the columns ``key`` (orders the shuffle) and ``stratum``, and
    none named ``row``, ``name``, ``mixed``, ``place``, ``first``, ``n``, ``at``,
    ``phase`` or ``part_of``.
    """
    name = F.when(F.col(stratum).isNotNull(), F.concat(F.lit("s"), F.col(stratum).cast("string"))).otherwise(F.lit(""))
    mixed = digits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 15)
    rows = numbered(rows.withColumns({"name": name, "mixed": mixed}), "row")
    by_source = global_rank(rows, "place", F.asc("name"), F.asc("mixed"), F.asc_nulls_last(key), F.asc("row"))
    sources = by_source.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    sources = global_rank(sources, "at", F.asc("n"), F.asc("name")).withColumn("phase", radical_inverse(F.col("at")))
    part_of = (F.col("place") - F.col("first") + F.col("phase")) / F.col("n")
    dealt = (by_source.join(sources, "name").withColumn("part_of", part_of)
             .drop("name", "place", "first", "n", "at", "phase"))
    total = rows.count()
    placed = global_rank(dealt, "place", F.asc("part_of"), F.asc("mixed"), F.asc_nulls_last(key), F.asc("row"))
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    return (placed.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.expr(f"place - (shard * {total} + {shards - 1}) div {shards}"))
            .drop("row", "mixed", "part_of", "place"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, source)`` of every document."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                       (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return interleave(rows, "source", "doc_id", shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def mixture(sharded: DataFrame) -> DataFrame:
    """``(shard, source, rows, bytes)``: what each shard holds of each source."""
    return sharded.groupBy("shard", "source").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def shard_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """DuckDB twin over the view ``documents``."""
    def digits_sql(text: str, n: int) -> str:
        return f"('0x' || substr(sha256({text}), 1, {n}))::BIGINT"

    return f"""WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
  CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS name,
  {digits_sql(f"'{seed}:' || coalesce(doc_id::VARCHAR, '')", 15)} AS mixed FROM documents),
sized AS (SELECT r, doc_id, source, name, mixed, octet_length(encode(text)) + {ROW_BYTES} AS size, {crc_sql("text")} AS text_crc32 FROM d, crc_table),
sources AS (SELECT name, count(*) AS n, row_number() OVER (ORDER BY count(*), name) - 1 AS pos FROM d GROUP BY name),
parts AS (SELECT s.*, (row_number() OVER (PARTITION BY s.name ORDER BY mixed, doc_id, r) - 1
  + ('0b' || reverse(lpad(bin(pos), 32, '0')))::BIGINT / 4294967296) / n AS part_of FROM sized s JOIN sources USING (name)),
placed AS (SELECT *, row_number() OVER (ORDER BY part_of, mixed, doc_id, r) - 1 AS place, count(*) OVER () AS total FROM parts)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (place * {shards} // total)::INTEGER AS shard,
  place - ((place * {shards} // total) * total + {shards - 1}) // {shards} AS slot, NULL::INTEGER AS grown_shard, source FROM placed"""
