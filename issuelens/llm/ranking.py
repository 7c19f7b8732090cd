"""Places of rows in a global order, without gathering the rows in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import cut

#: ``monotonically_increasing_id`` is the partition's number, then 33 bits of the row's place in it.
PLACE_BITS = 33


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written to the checkpoint folder, with a number that stays the same in every later read."""
    return cut(rows).withColumn(name, F.monotonically_increasing_id())


def global_rank(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with ``name``: the place (0, 1, 2, ...) of each row in ``order``.

    Rows are sorted in ranges and written; a place is the rows in earlier
    ranges plus the place in the own one. The driver sees one count for each
    range. The order should tell all rows apart (by ``numbered``, say), or rows
    that are equal in it fall into one range.
    """
    ranges = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(name, PLACE_BITS)
    counts = sorted(map(tuple, ranges.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()))
    before = [0, *accumulate(n for _, n in counts)]
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_part long, _before long")
    place = F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return ranges.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, place).drop("_part", "_before")
