"""Reproducible splits and samples (SMP-*, FLT-1).

Every row gets a rank key ``(md5(seed || ':' || id), id)``: the same inputs
give the same split whatever the partitioning, and the DuckDB oracle computes
the same key.

Exact selection of the ``quota`` smallest keys per group finds the boundary
key of each group and compares every row with it:

1. a histogram of the first ``PREFIX_DIGITS`` digits of the hash per group (partial
   aggregates) gives the bucket that holds the quota-th key;
2. only the rows of that bucket (a 65,536th of the group) are ranked, which gives
   the boundary key ``(hash, id)``;
3. a row is selected if its key is not above its group's boundary.

That is three scans of the input, two of which read the id and the group only.
The group tables are joined by the planner's choice, never under a broadcast
hint, and rows are never joined with themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions.tokens import split_words

#: Hash bits of the histogram, in hexadecimal digits of four bits.
PREFIX_DIGITS = 4


def rank_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def filter_token_len(df: DataFrame, text_col: str, lo: int = fixed.TOKEN_MIN_EXCL,
                     hi: int = fixed.TOKEN_MAX_EXCL) -> DataFrame:
    """FLT-1: keep ``lo < whitespace tokens < hi`` (both strict)."""
    n = F.size(split_words(F.col(text_col)))
    return df.filter((n > lo) & (n < hi))


def boundaries(keys: DataFrame, quotas: DataFrame, g: str, id_col: str) -> DataFrame:
    """``(g, quota, last_h, last_id)``: the quota-th smallest key of each group.

    A quota past the group's end has null keys (all rows are in), one of 0 too.
    """
    bucket = F.substring("_h", 1, PREFIX_DIGITS)
    hist = keys.groupBy(g, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(g).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    upto = hist.withColumn("_upto", F.sum("_n").over(run)).join(quotas, g)
    edge = (upto.where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
            .select(g, "_b", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need")))
    inner = keys.withColumn("_b", bucket).join(edge, [g, "_b"])
    rank = F.row_number().over(Window.partitionBy(g).orderBy("_h", id_col))
    last = (inner.withColumn("_rk", rank).where(F.col("_rk") == F.col("_need"))
            .select(g, F.col("_h").alias("_last_h"), F.col(id_col).alias("_last_id")))
    return quotas.join(last, g, "left")


def select_smallest(df: DataFrame, quotas: DataFrame, id_col: str, seed: int,
                    group_col: str | None = None, out: str = "selected") -> DataFrame:
    """Flag, per group, the ``quota`` rows with the smallest ``(md5, id)`` key.

    ``quotas`` holds ``(group_col, quota)``, or a single ``quota`` row when
    ``group_col`` is None. Rows of groups without a quota are left out. Rows that
    repeat an id share its key and are selected together.
    """
    g = group_col or "_g"
    base = df if group_col else df.withColumn("_g", F.lit(0))
    q = (quotas if group_col else quotas.withColumn("_g", F.lit(0))).select(g, F.col("quota").cast("long").alias("quota"))
    keys = base.select(g, id_col, rank_hash(id_col, seed).alias("_h"))
    last = boundaries(keys, q, g, id_col).withColumnRenamed("quota", "_quota")
    h = base.withColumn("_h", rank_hash(id_col, seed)).join(last, g)
    below = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col(id_col) <= F.col("_last_id")))
    picked = h.withColumn(out, F.when(F.col("_last_h").isNull(), F.col("_quota") > 0).otherwise(below))
    return picked.drop("_h", "_last_h", "_last_id", "_quota", *([] if group_col else ["_g"]))


def stratified_quotas(df: DataFrame, label_col: str, test_share: float | None = fixed.TEST_SHARE,
                      total: int | None = None) -> DataFrame:
    """Per-class test quotas: ``T = ceil(share * N)`` (or ``total``); ``floor(n*T/N)``
    plus one for the largest remainders (ties: label ascending) until they sum to T.

    Runs on the class-count table (one row per class), so the global window is tiny.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w_all = Window.partitionBy()
    # column names are case-insensitive: keep "n" and the total apart
    c = counts.withColumn("total_n", F.sum("n").over(w_all))
    t = (F.lit(total).cast("long") if total is not None
         else F.ceil(F.lit(test_share) * F.col("total_n")).cast("long"))
    c = c.withColumn("target", t)
    c = c.withColumn("fl", F.floor(F.col("n") * F.col("target") / F.col("total_n")).cast("long"))
    c = c.withColumn("rem", (F.col("n") * F.col("target")) % F.col("total_n"))
    c = c.withColumn("short", F.col("target") - F.sum("fl").over(w_all))
    c = c.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("rem"), F.asc(label_col))))
    return c.select(label_col, (F.col("fl") + F.when(F.col("_r") <= F.col("short"), 1).otherwise(0)).alias("quota"))


def stratified_split(df: DataFrame, label_col: str = "label", id_col: str = "doc_id", *,
                     test_share: float = fixed.TEST_SHARE, seed: int = fixed.SEED) -> DataFrame:
    """SMP-1: add ``split`` in {'train', 'test'} with class shares kept."""
    q = stratified_quotas(df, label_col, test_share)
    s = select_smallest(df, q, id_col, seed, label_col, "_test")
    return s.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def random_split(df: DataFrame, id_col: str = "doc_id", *, test_share: float = fixed.TEST_SHARE,
                 seed: int = fixed.SEED) -> DataFrame:
    """SMP-2: ``ceil(share * N)`` rows with the smallest rank key are the test set."""
    q = df.agg(F.ceil(F.lit(test_share) * F.count(F.lit(1))).cast("long").alias("quota"))
    s = select_smallest(df, q, id_col, seed, None, "_test")
    return s.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def sample_n(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = fixed.SEED) -> DataFrame:
    """SMP-3 / SMP-4 / QRY-1: ``n`` rows without replacement, reproducible, by the boundary selection for any ``n``."""
    q = df.agg(F.lit(n).cast("long").alias("quota"))
    return select_smallest(df, q, id_col, seed, None, "_s").filter("_s").drop("_s")


def cochran_size(population: int, z: float = 1.96, p: float = 0.5, e: float = 0.05) -> int:
    """SMP-6 size: ``n0 = z^2 p (1-p) / e^2``, finite-population corrected."""
    n0 = z * z * p * (1 - p) / (e * e)
    return int(math.ceil(n0 / (1 + (n0 - 1) / population)))


def representative_sample(df: DataFrame, strata: list[str], id_col: str = "doc_id", *,
                          seed: int = fixed.SEED, z: float = 1.96, e: float = 0.05) -> DataFrame:
    """SMP-6: Cochran-sized sample, allocated over ``strata`` like SMP-1."""
    n = df.count()
    size = cochran_size(n, z=z, e=e)
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata])
    d = df.withColumn("_stratum", key)
    q = stratified_quotas(d, "_stratum", None, total=size)
    s = select_smallest(d, q, id_col, seed, "_stratum", "_s")
    return s.filter("_s").drop("_s", "_stratum")


def size_grid(spark, lo: int, hi: int, step: int) -> DataFrame:
    """SMP-5: ``range(lo, hi + step, step)`` as ``training_size``."""
    return spark.range(lo, hi + step, step).withColumnRenamed("id", "training_size")
