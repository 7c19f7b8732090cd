"""Hard negatives of anchor vectors by Fagin's threshold algorithm over integer inner products.

Rows are dealt into blocks. In a block, every dimension has a list of the rows
sorted by its component. For an anchor, the lists are read in step from the end
that its component's sign makes best (sorted access); a row seen in any list is
scored whole, with integers (random access); and the anchor's components times
the components last read give a threshold that no unseen row can exceed. A
block is left once the threshold is strictly below the score that matters in
each *window* of scores: the k-th found, or the window's lower end.

* Positives are the best rows of an anchor's own label: blocks hold one label,
  and the window is open.
* Negatives are searched in blocks of all labels, with one window for each
  positive, and rows of the anchor's label masked.

Anchors go to every block that may hold their answers, in rows that follow the
block's own rows in a sorted partition. Anchors are dealt into groups and a
block is copied for each, so the work of a task is bounded by both sizes; it
sends at most k rows for a window. The best k over
blocks are a group-limited window, so nothing is gathered.

Defined results: rows without id, label or vector, or with a null or
non-finite component, take no part; each row counts for itself, also where
rows repeat, and the *other* rows of an anchor are those with another id;
shorter vectors end in zeros; ties go to the smaller id; anchors without
positives or negatives have no result; an empty table gives an empty result;
scores beyond 64 bits stop at their bounds; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.ranking import numbered

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SCALE = 256
#: Components in a block at most, and at least where blocks can keep more tasks busy.
BLOCK_MOST, BLOCK_LEAST = 1 << 21, 1 << 16
#: Anchors that meet one copy of a block.
GROUP = 1 << 15
#: Depth of the first step of sorted access; each later step is twice as deep.
FIRST_DEPTH = 64
BOUND = (1 << 63) - 1
WINDOWS = "array<struct<id:long,score:long>>"
ROW = "part string, block int, team int, anchor boolean, row long, id long, label string, vector array<long>, windows " + WINDOWS
HIT = "row long, anchor_id long, positive_id long, positive_score long, id long, score long"


class Block:
    """Rows with their components in one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.kinds, self.label = np.unique(labels, return_inverse=True)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.lists = np.ascontiguousarray(order.T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, 0).T)

    def of_label(self, label: str) -> np.ndarray:
        at = np.searchsorted(self.kinds, label)
        return self.label == at if at < len(self.kinds) and self.kinds[at] == label else np.zeros(len(self.ids), bool)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, ids, scores) of the ``k`` best allowed rows with a score in each window."""
        n, up, down = len(self.ids), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        left = allowed.copy()
        found, scores = np.zeros(0, np.int64), anchor[:0]
        depth, step = 0, FIRST_DEPTH
        while depth < n and left.any():
            to = min(n, depth + step)
            if len(up) + len(down) == 0:
                to = n  # every score is 0: there is nothing to sort by
            seen = np.zeros(n, bool)
            if to == n:
                seen[:] = True
            else:
                seen[self.lists[up, n - to:n - depth].ravel()] = True
                seen[self.lists[down, depth:to].ravel()] = True
            new = np.flatnonzero(seen & left)
            left[new] = False
            found, scores = np.concatenate([found, new]), np.concatenate([scores, self.vectors[new] @ anchor])
            if to < n:
                reach = anchor[up] @ self.values[up, n - to] + anchor[down] @ self.values[down, to - 1]
                if all(self.settled(scores, window, k, reach) for window in windows):
                    break
            depth, step = to, 2 * step
        for w, (low, high) in enumerate(windows):
            at = np.flatnonzero((scores >= low) & (scores <= high))
            if len(at) > k:
                at = at[scores[at] >= np.sort(scores[at])[-k]]  # ties stay in
            at = at[np.lexsort((self.ids[found[at]], -scores[at]))][:k]
            yield w, self.ids[found[at]], scores[at]

    @staticmethod
    def settled(scores: np.ndarray, window: tuple[int, int], k: int, reach: float) -> bool:
        """Whether no unseen row, of at most the score ``reach``, can be among the window's k best."""
        low, high = window
        if high < low or reach < low:
            return True
        inside = scores[(scores >= low) & (scores <= high)]
        return len(inside) >= k and reach < np.sort(inside)[-k]


def score_windows(windows: list[dict] | None, low: int, high: int) -> list[tuple[int, int]]:
    """The scores wanted for each positive: from ``low`` to ``high`` percent of its own; all scores without positives."""
    if windows is None:
        return [(-BOUND - 1, BOUND)]
    return [(-((-low * w["score"]) // 100), high * w["score"] // 100) for w in windows]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, with zeros after the shorter ones; exact in double, or as Python integers."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
        column.flatten().to_numpy()
    exact = not out.size or max(int(out.max()), -int(out.min())) ** 2 * max(width, 1) < 1 << 53
    return out.astype(float) if exact else out.astype(object)


def searched(width: int, k: int, low: int, high: int):
    """Task body over partitions sorted by (part, block, team, anchor): the best rows of each block for its anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block", "team", "anchor")]
            if not batch.num_rows:
                continue
            kind = keys[-1]
            turn = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in keys])) + 1
            for a, b in zip([0, *turn], [*turn, batch.num_rows]):
                if at != (now := tuple(c[a] for c in keys[:-1])):
                    at, held, block = now, [], None
                rows = batch.slice(a, b - a)
                vectors = matrix(rows.column("vector"), width)
                ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy(zero_copy_only=False)
                if not kind[a]:
                    held.append((ids, labels, vectors))
                elif held or block:
                    if block is None:
                        block, held = Block(*(np.concatenate(c) for c in zip(*held))), []
                    yield hits(block, rows, ids, labels, vectors)

    def hits(block: Block, rows: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        wanted = rows.column("windows").to_pylist()
        for name, id_, label, vector, positives in zip(rows.column("row").to_pylist(), ids, labels, vectors, wanted):
            if vector.dtype != block.vectors.dtype:  # an anchor or a block with large numbers: both as Python integers
                vector = np.array([int(x) for x in vector], object)
            allowed = block.ids != id_ if positives is None else ~block.of_label(label)
            for w, found, scores in block.search(vector, allowed, score_windows(positives, low, high), k):
                p = positives[w] if positives else {"id": None, "score": None}
                out += [(name, id_, p["id"], p["score"], i, max(-BOUND - 1, min(BOUND, int(s)))) for i, s in zip(found, scores)]
        names = [f.split()[0] for f in HIT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * len(names), names=names)

    return run


def best(candidates: DataFrame, anchors: DataFrame, width: int, k: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The ``k`` best rows of each (anchor, window), of ``candidates`` and ``anchors`` in their blocks, with ``place``."""
    rows = candidates.unionByName(anchors)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = (rows.repartition(tasks, "part", "block", "team").sortWithinPartitions("part", "block", "team", "anchor")
             .mapInArrow(searched(width, k, low, high), HIT))
    order = Window.partitionBy("row", "positive_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """``(id, label, vector)`` of the rows ``(id, label, vector)`` that take part, with whole components."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.where("id is not null and label is not null and vector is not null").where(finite)
            .select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
                    F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` over ``rows (id, label, vector)``."""
    rows = numbered(usable(rows, scale), "row")
    width = rows.agg(F.max(F.size("vector"))).head()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism

    def blocks(n: Column) -> Column:
        """How many blocks n rows make: few enough to fill, and enough for the cores if they can be."""
        most, least = F.ceil(n * max(width, 1) / BLOCK_LEAST), F.ceil(n * max(width, 1) / BLOCK_MOST)
        return F.greatest(F.lit(1), least, F.least(most, F.lit(2 * cores))).cast("int")

    def teams(n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / GROUP)).cast("int")

    def dealt(n: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("int")

    def to_all(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    def sides(table: DataFrame, asking: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows in their block, for each group of anchors; anchors in their group, for each block."""
        candidates = table.withColumns({"anchor": F.lit(False), "windows": F.lit(None).cast(WINDOWS), "block": dealt(F.col("blocks"), 13)})
        asked = asking.withColumns({"anchor": F.lit(True), "team": dealt(F.col("teams"), 17)})
        columns = [f.split()[0] for f in ROW.split(", ")]
        return (candidates.withColumn("team", to_all(F.col("teams"))).select(columns),
                asked.withColumn("block", to_all(F.col("blocks"))).select(columns))

    labels = rows.groupBy("label").agg(blocks(F.count("*")).alias("blocks"), teams(F.count_if(is_anchor)).alias("teams"))
    own = rows.join(labels, "label").withColumn("part", F.col("label"))
    near = best(*sides(own, own.where(is_anchor).withColumn("windows", F.lit(None).cast(WINDOWS))), width, positives)
    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("windows"))  # at most `positives`
    sizes = rows.agg(blocks(F.count("*")).alias("blocks"), teams(F.count_if(is_anchor)).alias("teams")).head()
    whole = rows.withColumns({"part": F.lit(""), "blocks": F.lit(sizes.blocks), "teams": F.lit(sizes.teams)})
    candidates, asked = sides(whole, whole.where(is_anchor).join(windows, "row"))
    return best(candidates, asked, width, negatives, low, high).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def hard_negatives_sql() -> str:
    """DuckDB twin of the registered query over the view ``embeddings``: every pair is scored."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    score = "list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT"
    return f"""WITH rows AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {finite}),
scored AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, coalesce({score}, 0) AS score
  FROM rows a, rows b WHERE a.id % 50 = 0 AND a.id <> b.id),
pos AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score,
  row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM scored WHERE same) WHERE r <= {POSITIVES}),
neg AS (SELECT pos.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM pos JOIN scored ON scored.anchor_id = pos.anchor_id AND NOT same
    AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}"""
