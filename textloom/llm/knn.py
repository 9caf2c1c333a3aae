"""Exact top-k search by a Voronoi kNN join: a set of the rows are queries, and all other rows are searched.

Pivots split the space into Voronoi cells; each vector goes to its nearest pivot. From summaries of the cells (largest
distance of a query to the pivot, the k + 1 smallest of all rows) follows a bound for each cell: no query in it has its
k-th neighbour farther away than that. Cells are put in groups by their queries. By the triangle inequality a vector
can only serve a group if its distance to its own pivot reaches the group's distance bound for that cell, so only such
vectors are replicated. Distances are Euclidean.

Distribution. A group's queries are cut in tiles of QUERIES, and the vectors that it needs in slices of ROWS, both by a
hash of the id; each tile and slice is one task with a partition of its own, and holds no more than both (about).
Tasks return the k nearest of their slice for each query, from which the k nearest of all are merged. Pivots are drawn
by a hash of the id, the square root of the rows, PIVOTS at most; they and the cells' summaries are broadcast. Any pivots give the
same result. Where the bounds exclude little, as for data without clusters in many dimensions, every group needs nearly every vector.

Defined results. Rows with a null id, or a vector that is null, empty, holds a null or a value that isn't finite, or has
another length than most rows do (of equally frequent lengths the least), neither ask nor answer. Rows that repeat an
id count once, with the least vector. Ties in distance go to the smaller id, equal vectors of other ids are neighbours
at distance 0, and fewer than k other rows give fewer neighbours. Distances are rounded to six digits after ranking.
Without queries the result is empty, as for empty tables. Other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, give_back, prepare, written

K, EVERY, PIVOTS, QUERIES, ROWS, PAD = 10, 20, 1024, 4096, 16_384, 1e-9


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with one usable vector an id, as a written table."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    v = written(v, "vectors")
    length = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length:
        v = v.where(F.size("v") == length["n"])
    return v.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared(matrix(batch.column(1)), pivots)
                cell = d.argmin(1)
                near = np.sqrt(((matrix(batch.column(1)) - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(near)], ["id", "v", "cell", "near"])

    return run


def _summaries(k: int, every: int):
    """(cell, queries, farthest query, k + 1 smallest distances) of a task's rows; it holds k + 1 numbers a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, nears, n, far = np.zeros(0, np.int64), np.zeros(0), Counter(), {}
        for batch in batches:
            ids, cell, near = (batch.column(c).to_numpy() for c in range(3))
            asks = ids % every == 0
            n.update(cell[asks].tolist())
            for c, d in zip(cell[asks].tolist(), near[asks].tolist(), strict=True):
                far[c] = max(d, far.get(c, 0.0))
            cells, nears = np.concatenate((cells, cell)), np.concatenate((nears, near))
            order = np.lexsort((nears, cells))
            cells, nears = cells[order], nears[order]
            start = np.searchsorted(cells, cells)
            keep = np.arange(len(cells)) - start <= k
            cells, nears = cells[keep], nears[keep]
        own, first = np.unique(cells, return_index=True)
        low = [x.tolist() for x in np.split(nears, first[1:])] if len(own) else []
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([n[c] for c in own.tolist()], pa.int64()), pa.array([far.get(c) for c in own.tolist()], pa.float64()), pa.array(low, pa.list_(pa.float64()))], ["cell", "n", "far", "low"])

    return run


def cell_bounds(pivots: np.ndarray, largest: np.ndarray, smallest: list[list[float]], k: int) -> np.ndarray:
    """For each cell a distance within which every query in it has k neighbours besides itself."""
    between = np.sqrt(squared(pivots, pivots)) + PAD
    near = np.full((len(pivots), k + 1), math.inf)
    for j, low in enumerate(smallest):
        near[j, : len(low)] = low[: k + 1]
    out = np.full(len(pivots), math.inf)
    if near.size > k:
        for i in np.flatnonzero(np.isfinite(largest)).tolist():
            out[i] = np.partition((largest[i] + between[i][:, None] + near).ravel(), k)[k] + PAD  # k + 1 are within reach, one may be the query
    return out


def group_bounds(pivots: np.ndarray, largest: np.ndarray, bounds: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """[group, cell]: the least distance to its pivot from which a vector of the cell may serve the group."""
    between = np.sqrt(squared(pivots, pivots)) - PAD
    lower = between - (largest + bounds)[:, None]  # [query cell, data cell]
    lower[np.isinf(largest)] = math.inf
    return np.array([lower[group == g].min(0) if (group == g).any() else np.full(len(pivots), math.inf) for g in range(groups)]).reshape(groups, len(pivots))


class Plan:
    """What all tasks know: from which distance a vector may serve a group, each cell's group, and the groups' tiles and slices."""

    def __init__(self, need: np.ndarray, group: np.ndarray, every: int):
        self.need, self.group, self.every = need, group, every
        self.tiles = self.slices = np.ones(len(need), np.int64)

    def first_units(self) -> np.ndarray:
        return np.cumsum(self.tiles * self.slices) - self.tiles * self.slices

    def serves(self, g: int, cell: np.ndarray, near: np.ndarray) -> np.ndarray:
        return near >= self.need[g, cell] - PAD


def _counts(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(plan.need), np.int64)
        for batch in batches:
            cell, near = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n += [int(plan.serves(g, cell, near).sum()) for g in range(len(n))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["g", "n"])

    return run


def _replicate(plan: Plan):
    first = plan.first_units()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cell, near, hashed = (batch.column(c).to_numpy() for c in (0, 2, 3, 4))

            def rows(row: np.ndarray, unit: np.ndarray, asks: bool, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), *(batch.column(c).take(pa.array(row)) for c in (0, 1)), pa.array(np.full(len(row), asks))], ["unit", "id", "v", "asks"])

            asks = np.flatnonzero(ids % plan.every == 0)
            for g in range(len(plan.need)):
                tiles, slices = int(plan.tiles[g]), int(plan.slices[g])
                if len(own := asks[plan.group[cell[asks]] == g]):
                    for s in range(slices):
                        yield rows(own, first[g] + hashed[own] % tiles * slices + s, True)
                if len(data := np.flatnonzero(plan.serves(g, cell, near))):
                    for t in range(tiles):
                        yield rows(data, first[g] + t * slices + hashed[data] // 4096 % slices, False)

    return run


def nearest(ask_ids: np.ndarray, ask: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, block: int = 256) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest of other ids, by (distance, id), in exact arithmetic order."""
    norm = (data * data).sum(1)
    slack = 1e-9 * (1 + norm.max(initial=0))
    for a in range(0, len(ask), block):
        q = ask[a : a + block]
        d = (q * q).sum(1)[:, None] + norm - 2 * (q @ data.T)
        for x in range(len(q)):
            row = d[x]
            edge = np.partition(row, k)[k] if len(row) > k + 1 else math.inf
            some = np.flatnonzero(row <= edge + 2 * slack)  # all that rounding could put among the first
            some = some[ids[some] != ask_ids[a + x]]
            exact = np.sqrt(((data[some] - q[x]) ** 2).sum(1))
            order = np.lexsort((ids[some], exact))[:k]
            yield int(ask_ids[a + x]), list(zip(exact[order].tolist(), ids[some][order].tolist(), strict=True))


def _solve(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            part = pa.Table.from_batches(held)
            ids, vectors, asks = part.column(1).to_numpy(), matrix(part.column(2)), np.asarray(part.column(3))
            rows = [(q, d, n) for q, near in nearest(ids[asks], vectors[asks], ids[~asks], vectors[~asks], k) for d, n in near]
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), (pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "d", "n"])
        give_back()

    return run


def knn_join(vectors: DataFrame, *, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, queries: int = QUERIES, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other rows of every row whose id is divisible by ``every``."""
    spark, scratch = vectors.sparkSession, []
    prepare(spark)
    clean = written(clean_vectors(vectors, id_col, vector_col), "clean", scratch)
    most = max(1, min(pivots, math.isqrt(clean.count())))
    chosen = [r["v"] for r in clean.orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    empty = "query_id long, rank int, neighbor_id long, distance double"
    if not chosen:
        return spark.createDataFrame([], empty)
    at = np.unique(np.array(chosen, float), axis=0)
    cells = clean.mapInArrow(_assign(at), "id long, v array<double>, cell int, near double").withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    cells = written(cells, "cells", scratch)
    largest, smallest, asked = np.full(len(at), math.inf), [[] for _ in at], np.zeros(len(at), int)
    low = cells.select("id", "cell", "near").mapInArrow(_summaries(k, every), "cell int, n long, far double, low array<double>")
    for r in low.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("low"))), 1, k + 1).alias("low")).collect():
        smallest[r["cell"]], asked[r["cell"]] = r["low"], r["n"]
        if r["n"]:
            largest[r["cell"]] = r["far"]
    if not asked.sum():
        return spark.createDataFrame([], empty)
    bounds = cell_bounds(at, largest, smallest, k)
    groups = max(1, min(len(at), -(-int(asked.sum()) // queries)))
    # neighbouring cells together: cells in the order of their projection on the widest direction, cut into equal parts
    centred = at - at.mean(0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    group = np.empty(len(at), np.int64)
    group[order] = np.minimum((np.cumsum(asked[order]) - 1).clip(0) * groups // int(asked.sum()), groups - 1)
    plan = Plan(group_bounds(at, largest, bounds, group, groups), group, every)
    found = cells.select("cell", "near").mapInArrow(_counts(plan), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    need = np.zeros(groups, np.int64)
    for r in found:
        need[r["g"]] = r["n"]
    plan.tiles = np.maximum(1, -(-np.bincount(group, asked, groups).astype(np.int64) // queries))
    plan.slices = np.maximum(1, -(-need // rows))
    copies = cells.mapInArrow(_replicate(plan), "unit int, id long, v array<double>, asks boolean")
    solved = copies.repartitionById(int((plan.tiles * plan.slices).sum()), F.col("unit")).mapInArrow(_solve(k), "query_id long, d double, n long")
    best = solved.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "n"))), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("at", "near")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("near.n").alias("neighbor_id"), F.round("near.d", 6).alias("distance"))
    out = written(out, "nearest")
    dropped(spark, scratch)
    return out


SQL = f"""
WITH e AS (SELECT vec_id AS id, min(embedding::DOUBLE[]) AS v FROM embeddings GROUP BY vec_id),
p AS (SELECT a.id AS query_id, b.id AS neighbor_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id <> b.id WHERE a.id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, round(d, 6) AS distance FROM r WHERE rank <= {K}
"""
