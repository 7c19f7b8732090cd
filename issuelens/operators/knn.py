"""JOIN-7: exact k nearest neighbours of every row by a pivot index.

1. ``PIVOTS`` neighbours (at most; the smallest by a hash of the id) are the
   pivots. Every neighbour belongs to the *cell* of its nearest pivot; cells
   with their smallest and largest radius are a table of one row each.
2. A row's distances to the pivots bound its k-th distance from above (pivots
   are neighbours too; if there are no others, the distances settle the row),
   and the triangle inequality bounds its distance to all
   neighbours of a cell from below: by the cell's radii, and by the plane
   halfway between the row's own pivot and the cell's.
3. Rows meet the cells nearest to them first, which makes the upper bound
   sharp; then only the cells whose lower bound does not exceed it. In a cell,
   neighbours are sorted by radius and only those within the bound of the row's
   own distance to the pivot are compared.

Rows and neighbours meet in sorted partitions by cell: large cells are cut into
blocks by hash and the rows that visit a block into teams, so the work of a
task is bounded, and neither goes through the driver. The k best of a row over
its blocks are a group-limited window. Only the pivots and the cells are
broadcast, at most ``PIVOTS`` rows each.

Vectors are compared by the Euclidean distance of their unit vectors, rounded
to 9 decimals, ties by id; the bounds leave room for the rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.functions.vectors import l2_normalise
from issuelens.session import ensure_checkpoint_dir

PIVOTS = 256
#: Neighbours that a task holds at a time, and rows that visit one copy of them.
BLOCK = 20_000
TEAM = 100_000
#: Rows that a task compares at a time.
ROWS_AT_ONCE = 64
#: Distances that a task holds at a time where all neighbours are compared.
DISTANCES_AT_ONCE = 1_000_000
#: Room for the rounding of distances.
SLACK = 1e-7


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T
    return np.sqrt(np.maximum(d2, 0.0))


def stack(column: pd.Series) -> np.ndarray:
    return unit_rows(np.stack(column.to_numpy()).astype(np.float64))


def nearest(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest finite distances, by (distance, id)."""
    at = np.flatnonzero(np.isfinite(dist))
    if len(at) > k:
        at = at[dist[at] <= np.partition(dist[at], k - 1)[k - 1]]  # ties at the k-th distance stay in
    return at[np.lexsort((ids[at], dist[at]))][:k]


class Cells:
    """Pivots and, for each, how its neighbours lie around it."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.apart = distances(pivots, pivots)
        self.least = self.most = self.count = self.parts = np.zeros(0)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest pivot, distances to all pivots) of unit vectors."""
        d = distances(x, self.pivots)
        return d.argmin(1), d

    def lower(self, d: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The least distance that a neighbour of each cell can have to each row."""
        rows = np.arange(len(d))
        ring = np.maximum(d - self.most[None, :], self.least[None, :] - d)
        gap = self.apart[own]  # a neighbour is nearer to its pivot than to the row's: beyond the halfway plane
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (d * d - (d[rows, own] ** 2)[:, None]) / (2 * gap), 0.0)
        low = np.maximum(np.maximum(ring, plane), 0.0) - SLACK
        low[:, self.count == 0] = np.inf
        return low


def placed(cells: Cells, emb_col: str):
    """Task body: the neighbours with their cell and radius."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, d = cells.of(stack(pdf[emb_col]))
                yield pdf.assign(cell=cell.astype(np.int32), radius=d[np.arange(len(d)), cell])
    return run


def visits(cells: Cells, k: int, emb_col: str, first: bool):
    """Task body: the cells that each row visits, ``(row, cell)``; first those that hold k neighbours, then all that can matter."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            own, d = cells.of(stack(pdf[emb_col]))
            low = cells.lower(d, own)
            order = np.argsort(low, axis=1, kind="stable")
            held = np.cumsum(cells.count[order], axis=1)
            early = np.zeros_like(low, bool)  # the nearest cells, until they hold k and the row itself
            np.put_along_axis(early, order, (held - cells.count[order]) < k + 1, axis=1)
            early &= np.isfinite(low)
            use = early if first else ~early & (low <= pdf["bound"].to_numpy()[:, None])
            row, cell = np.nonzero(use)
            yield pd.DataFrame({"row": pdf["row"].to_numpy()[row], "cell": cell.astype(np.int32)})
    return run


def compared(k: int, id_col: str, emb_col: str, p_col: str, pivots: np.ndarray):
    """Task body over partitions sorted by (cell, part, team, asks): each asking row's k nearest neighbours of the block."""
    key = ["cell", "part", "team"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for pdf in batches:
            for (now, asks), rows in pdf.groupby([pdf[key].apply(tuple, axis=1), "asks"], sort=False):
                if now != at:
                    at, held, block = now, [], None
                if not asks:
                    held.append(rows)
                elif held or block is not None:
                    if block is None:
                        block = pd.concat(held).sort_values("radius", kind="stable")
                        vectors, radius, held = stack(block[emb_col]), block["radius"].to_numpy(), []
                        ids, probs = block[id_col].to_numpy(), block[p_col].to_numpy()
                    yield answer(rows, vectors, radius, ids, probs, pivots[now[0]])

    def answer(rows: pd.DataFrame, vectors: np.ndarray, radius: np.ndarray, ids: np.ndarray, probs: np.ndarray, pivot: np.ndarray) -> pd.DataFrame:
        x = stack(rows[emb_col])
        away = distances(x, pivot[None, :])[:, 0]
        order = np.argsort(away, kind="stable")
        x, away, rows = x[order], away[order], rows.iloc[order]
        bound = rows["bound"].to_numpy()
        start = np.searchsorted(radius, away - bound - SLACK, "left")
        stop = np.searchsorted(radius, away + bound + SLACK, "right")
        out, own, names = [], rows[id_col].to_numpy(), rows["row"].to_numpy()
        for a in range(0, len(rows), ROWS_AT_ONCE):
            s, e = int(start[a:a + ROWS_AT_ONCE].min()), int(stop[a:a + ROWS_AT_ONCE].max())
            dist = np.round(distances(x[a:a + ROWS_AT_ONCE], vectors[s:e]), 9)
            dist[own[a:a + ROWS_AT_ONCE][:, None] == ids[s:e][None, :]] = np.inf
            for r in range(len(dist)):
                i, lo, hi = a + r, int(start[a + r]) - s, int(stop[a + r]) - s
                near = nearest(dist[r, lo:hi], ids[s + lo:s + hi], k) + lo
                out.append((names[i], [{"d": float(dist[r, j]), "i": ids[s + j], "q": probs[s + j]} for j in near], e - s))
        return pd.DataFrame(out, columns=["row", "near", "pairs"])

    return run


def to_pivots(k: int, id_col: str, emb_col: str, p_col: str, pivots: pd.DataFrame):
    """Task body where the pivots are all neighbours there are: a row's distances to them settle it.

    The k smallest distances, with ties, are found for many rows at once.
    """
    ids, probs = pivots[id_col].to_numpy(), pivots[p_col].to_numpy()
    vectors = stack(pivots[emb_col]) if len(pivots) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near, there = [[]] * len(pdf), np.flatnonzero(pdf[emb_col].notna())
            step = max(1, DISTANCES_AT_ONCE // max(1, len(ids)))
            for a in range(0, len(there) if vectors is not None else 0, step):
                some = there[a:a + step]
                own = pdf[id_col].to_numpy()[some]
                dist = np.round(distances(stack(pdf[emb_col].iloc[some]), vectors), 9)
                dist[own[:, None] == ids[None, :]] = np.inf
                last = np.partition(dist, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(some), np.inf)
                close = (dist <= last[:, None]) & np.isfinite(dist)  # ties at the k-th distance stay in
                for r, at in zip(some, np.split(np.nonzero(close)[1], np.cumsum(close.sum(1))[:-1])):
                    near[r] = at
                for r, d in zip(some, dist):
                    at = near[r]
                    near[r] = [{"d": float(d[j]), "i": ids[j], "q": probs[j]} for j in at[np.lexsort((ids[at], d[at]))][:k]]
            yield pdf.assign(near=near, pairs=np.where(pdf[emb_col].notna(), len(pivots), 0))
    return run


def k_nearest(rows: DataFrame, neighbours: DataFrame, k: int, id_col: str, emb_col: str, p_col: str,
              whole: int = PIVOTS) -> DataFrame:
    """``rows`` with ``near array<struct<d, i, q>>``, their k nearest neighbours of another id, and ``pairs``, the neighbours compared.

    Up to ``whole`` neighbours are sent to the tasks and all compared, without the index: where they are known to be few,
    its steps cost more than the distances. Null vectors take no part as neighbours and get an empty ``near`` as rows.
    """
    kind = neighbours.schema[id_col].dataType.simpleString()
    near_type = f"array<struct<d:double,i:{kind},q:array<double>>>"
    spark = rows.sparkSession
    rows = rows.select(id_col, emb_col, F.col(p_col).cast("array<double>").alias(p_col))
    others = neighbours.select(id_col, emb_col, F.col(p_col).cast("array<double>").alias(p_col)).where(F.col(emb_col).isNotNull())
    picked = others.orderBy(F.xxhash64(id_col), F.col(id_col)).limit(max(whole, PIVOTS) + 1).toPandas()
    if len(picked) <= max(whole, PIVOTS):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInPandas(to_pivots(k, id_col, emb_col, p_col, picked), f"{fields}, near {near_type}, pairs long")
    # Numbers of the written rows stay the same in every later read.
    ensure_checkpoint_dir(spark)
    rows = rows.checkpoint().withColumn("row", F.monotonically_increasing_id())
    others = others.checkpoint()
    cells = Cells(np.unique(stack(picked[emb_col].iloc[:PIVOTS]), axis=0))
    schema = f"{id_col} {kind}, {emb_col} {others.schema[emb_col].dataType.simpleString()}, {p_col} array<double>"
    others = others.mapInPandas(placed(cells, emb_col), schema + ", cell int, radius double").checkpoint()
    found = others.groupBy("cell").agg(F.min("radius").alias("least"), F.max("radius").alias("most"), F.count("*").alias("n")).toPandas()
    n = len(cells.pivots)
    cells.least, cells.most, cells.count = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
    at = found["cell"].to_numpy()
    cells.least[at], cells.most[at], cells.count[at] = found["least"], found["most"], found["n"]
    parts = F.element_at(F.array([F.lit(int(-(-c // BLOCK)) or 1) for c in cells.count]), F.col("cell") + 1)
    asking = rows.where(F.col(emb_col).isNotNull())
    order = Window.partitionBy("row").orderBy("n.d", "n.i")

    def meet(visit: DataFrame, asked: DataFrame) -> DataFrame:
        """``(row, near, pairs)`` of the visits ``(row, cell)`` of the rows ``asked``, with ``bound`` for each."""
        teams = visit.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / TEAM)).cast("int").alias("teams"))
        come = (visit.join(asked, "row").join(teams, "cell")
                .withColumns({"part": F.explode(F.sequence(F.lit(0), parts - 1)), "team": F.pmod(F.xxhash64("row"), "teams").cast("int"),
                              "asks": F.lit(True), "radius": F.lit(None).cast("double")}))
        wait = (others.join(teams, "cell").withColumns({
            "part": F.pmod(F.xxhash64(id_col), parts).cast("int"), "team": F.explode(F.sequence(F.lit(0), F.col("teams") - 1)),
            "asks": F.lit(False), "row": F.lit(None).cast("long"), "bound": F.lit(None).cast("double")}))
        columns = ["cell", "part", "team", "asks", "row", id_col, emb_col, p_col, "radius", "bound"]
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return (wait.select(columns).unionByName(come.select(columns)).repartition(tasks, "cell", "part", "team")
                .sortWithinPartitions("cell", "part", "team", "asks")
                .mapInPandas(compared(k, id_col, emb_col, p_col, cells.pivots), f"row long, near {near_type}, pairs long"))

    def best(met: DataFrame) -> DataFrame:
        flat = met.select("row", F.explode("near").alias("n")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        return flat.groupBy("row").agg(F.sort_array(F.collect_list("n")).alias("near"))  # at most k

    free = F.lit(float("inf"))
    one = asking.mapInPandas(visits(cells, k, emb_col, True), "row long, cell int")
    early = meet(one, asking.withColumn("bound", free)).checkpoint()
    bound = best(early).select("row", F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(free).alias("bound"))
    bounded = asking.join(bound, "row", "left").withColumn("bound", F.coalesce("bound", free)).checkpoint()
    two = bounded.mapInPandas(visits(cells, k, emb_col, False), "row long, cell int")
    met = early.unionByName(meet(two, bounded)).checkpoint()
    pairs = met.groupBy("row").agg(F.sum("pairs").alias("pairs"))
    return (rows.join(best(met), "row", "left").join(pairs, "row", "left")
            .select(id_col, emb_col, p_col, F.coalesce("near", F.array().cast(near_type)).alias("near"),
                    F.coalesce("pairs", F.lit(0)).alias("pairs")))
