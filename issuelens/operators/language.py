"""LNG-1: language detection from a character-trigram profile learned with Spark.

``log p(g, lang) = ln((cnt + 1) / (total_lang + V))`` with V = distinct grams
overall. A document's score for a language is the sum over its trigrams; a
gram the profile never saw contributes ``ln(1 / (total_lang + V))``. The
profile is stored as ``delta = log p - unseen_lang`` so that only seen grams
need to be joined: ``score = n_grams * unseen_lang + sum(cnt * delta)``.

The profile has (languages x distinct trigrams) rows; the planner sizes its join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.session import ensure_checkpoint_dir, written


def letters_only(text: Column) -> Column:
    """Lower-case, keep letters and single blanks."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.trim(t)


#: Rows of trigram counts that a task holds at a time.
COUNTS_AT_ONCE = 1 << 20


def trigram_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, gram long, cnt long)``: the distinct 3-character substrings of each row, counted in the row's task.

    A trigram is a number, 21 bits for each character.
    """
    import numpy as np
    import pyarrow as pa

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, counts, held = [], [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                c = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
                gram, cnt = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)
                rows.append(np.full(len(gram), i))
                grams.append(gram)
                counts.append(cnt)
                held += len(gram)
                if held >= COUNTS_AT_ONCE or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(grams)),
                                                      pa.array(np.concatenate(counts))], names=[id_col, "gram", "cnt"])
                    rows, grams, counts, held = [], [], [], 0

    return df.select(id_col, letters_only(F.col(text_col)).alias("_letters")).mapInArrow(run, f"`{id_col}` {kind}, gram long, cnt long")


def train_profile(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, dict[str, float]]:
    """Returns ``(profile(lang, gram, delta), unseen {lang: ln(1 / (total + V))})``.

    ``delta = log p - unseen = ln(cnt + 1)``. The unseen map has one entry per
    language (a bounded, tiny result brought to the driver).
    """
    occ = trigram_counts(df, text_col, lang_col)  # the language goes with the counts, so nothing is joined back
    ensure_checkpoint_dir(df.sparkSession)
    counts = occ.groupBy(lang_col, "gram").agg(F.sum("cnt").alias("cnt")).checkpoint()
    v = counts.select("gram").distinct().count()
    totals = counts.groupBy(lang_col).agg(F.sum("cnt").alias("total")).collect()
    unseen = {r[lang_col]: -math.log(r["total"] + v) for r in totals}
    prof = counts.select(lang_col, "gram", F.log(F.col("cnt") + 1.0).alias("delta"))
    return prof, unseen


def detect_language(df: DataFrame, profile: DataFrame, unseen: dict[str, float], text_col: str = "text",
                    id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, detected)``; a document without a trigram gets null (treated as not English).

    ``score(doc, lang) = n_grams * unseen_lang + sum(cnt * delta)``. The
    per-language base terms come from the bounded ``unseen`` literal. The
    profile is brought to one row a trigram with a column for each language, so
    a document's distinct trigrams are joined once, and is written first, so
    that the planner knows its size.
    """
    langs = sorted(unseen, key=lambda k: (k is not None, k))  # a null language has a base and meets no profile row
    delta = [F.max(F.when(F.col(lang_col) == F.lit(k), F.col("delta"))).alias(f"_{i}") for i, k in enumerate(langs)]
    if not langs:
        return df.select(id_col, F.lit(None).cast("string").alias("detected"))
    wide = written(profile.groupBy("gram").agg(*delta), "profile")
    found = trigram_counts(df, text_col, id_col).join(wide, "gram", "left")
    sums = found.groupBy(id_col).agg(F.sum("cnt").alias("n"), *[F.sum(F.col("cnt") * F.col(f"_{i}")).alias(f"_{i}") for i in range(len(langs))])
    scores = F.array(*[F.struct((-F.round(F.col("n") * F.lit(unseen[k]) + F.coalesce(F.col(f"_{i}"), F.lit(0.0)), 9)).alias("cost"),
                                F.lit(k).cast("string").alias("lang")) for i, k in enumerate(langs)])
    best = sums.select(id_col, F.array_min(scores)["lang"].alias("detected"))
    return df.select(id_col).join(best, id_col, "left")
