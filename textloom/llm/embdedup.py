"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one, so a cosine of at least the threshold is a squared distance of at most r2 = 2 - 2 *
threshold, and rotated (by the principal axes, dealt out to the blocks in turn), which changes no distance. Split into
m blocks of dimensions, two vectors within r2 must in some block be within r2 * (the block's dimensions) / (all): the
proportional budget. Each block is range-joined under its budget: a k-d tree over the block's dimensions cuts it in
boxes, and every vector meets those of its own box and of the boxes within the block's radius. Whatever is within a block's
budget is verified on the whole vectors, in the first block for which that holds, so each pair counts once.

Distribution. Equal vectors are one row from here on, with a weight. The rotation is a matrix of the vectors' dimensions;
the trees are fitted on SAMPLE vectors at most, chosen by a hash of the id, and only decide where work is done: every
vector is routed, and the result is the same for any trees. A box is a task, or several if it holds more than TILE
rows: a task holds one tile of its box and lets the rest, and the visitors, stream past. Of two boxes one visits the other,
by turns. Tasks return links and a star of each connected group, never pairs. On data spread evenly over many dimensions
boxes exclude little, every vector visits half of all boxes, and work grows with the square of the rows.

Defined results. Rows with a null id are left out. A vector that is null, empty, of another length than most, has a null or a
value that isn't finite, or is zero, has no links. Rows that repeat an id count once, with the least usable vector. Pairs exactly
at the threshold belong (within 1e-12). Classes are what links connect, named by their least id. In dedup that id stays, and
rows without links stay. Empty tables give empty results. Other columns are carried and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, give_back, joined, prepare, sized, written
from .knn import clean_vectors, matrix

THRESHOLD, BLOCKS, TILE, BOX_ROWS, SAMPLE, EDGE = 0.9, 4, 16_384, 12_288, 20_000, 1e-12
#: Rows compared with a tile at once, and pairs verified at once.
ROWS, PAIRS = 256, 1 << 15


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def rotation(second: np.ndarray, blocks: int) -> tuple[np.ndarray, list[int]]:
    """(matrix, first column of each block and the end): principal axes, dealt to the blocks in turn."""
    axes = np.linalg.eigh(second)[1][:, ::-1]
    m = min(blocks, len(axes))
    dealt = [list(range(b, len(axes), m)) for b in range(m)]
    return axes[:, [x for d in dealt for x in d]], [0, *np.cumsum([len(d) for d in dealt]).tolist()]


def boxes(sample: np.ndarray, rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of boxes that divide space: x is in the box with lo < x <= hi. Each has about ``most`` of the rows at the most."""
    dims = sample.shape[1]
    done, open_ = [], [(sample, np.full(dims, -np.inf), np.full(dims, np.inf))]
    while open_:
        part, lo, hi = open_.pop()
        if len(part) * rows > most * len(sample) and len(part) > 1:
            for d in np.argsort(-part.var(0), kind="stable").tolist():
                cut = np.partition(part[:, d], (len(part) - 1) // 2)[(len(part) - 1) // 2]
                low = part[:, d] <= cut
                if not low.all():
                    up, down = lo.copy(), hi.copy()
                    up[d] = down[d] = cut
                    open_ += [(part[~low], up, hi), (part[low], lo, down)]
                    break
            else:
                done.append((lo, hi))
        else:
            done.append((lo, hi))
    return np.array([x for x, _ in done]), np.array([x for _, x in done])


def visits(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """(each row's box, [row, box]: whether the row visits the box). Of two boxes the lower visits if their sum is even, else the higher."""
    home, far = np.zeros(len(x), np.int64), np.zeros((len(x), len(lo)), bool)
    number = np.arange(len(lo))
    for k in range(len(lo)):
        inside = ((x > lo[k]) & (x <= hi[k])).all(1)
        home[inside] = k
        far[:, k] = (np.maximum(np.maximum(lo[k] - x, x - hi[k]), 0) ** 2).sum(1) <= budget
    turn = (home[:, None] < number) == ((home[:, None] + number) % 2 == 0)
    return home, far & turn & (home[:, None] != number)


def _second(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                u = units(matrix(batch.column(0)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["at", "x"])

    return run


class Plan:
    """What all tasks know: the rotation, the blocks with their budgets and boxes, and the tiles of each box."""

    def __init__(self, turn: np.ndarray, ends: list[int], r2: float, trees: list[tuple[np.ndarray, np.ndarray]]):
        self.turn, self.ends, self.trees = turn, ends, trees
        self.budgets = [r2 * (b - a) / ends[-1] * (1 + 1e-9) + 1e-9 for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.tiles = [np.ones(len(lo), np.int64) for lo, _ in trees]

    def first_units(self) -> list[np.ndarray]:
        """The number of the first task of each box."""
        counts = np.concatenate(self.tiles)
        return np.split(np.cumsum(counts) - counts, np.cumsum([len(t) for t in self.tiles])[:-1])


def _counts(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(lo), np.int64) for lo, _ in plan.trees]
        for batch in batches:
            if batch.num_rows:
                u = units(matrix(batch.column(0))) @ plan.turn
                for b, (lo, hi) in enumerate(plan.trees):
                    total[b] += np.bincount(visits(u[:, plan.ends[b] : plan.ends[b + 1]], lo, hi, -1.0)[0], minlength=len(lo))
        n = np.concatenate(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["box", "n"])

    return run


def _send(plan: Plan):
    """(id, w, tile hash, vector) to (unit, guest, b, id, w, vector) for every task that the row takes part in; vectors rotated."""
    firsts = plan.first_units()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = units(matrix(batch.column(3))) @ plan.turn
            hashed = batch.column(2).to_numpy()
            values = pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), u.shape[1]).cast(pa.list_(pa.float64()))

            def rows(row: np.ndarray, unit: np.ndarray, guest: bool, b: int, batch: pa.RecordBatch = batch, values: pa.Array = values) -> pa.RecordBatch:
                at = pa.array(row)
                return pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(np.full(len(row), guest)), pa.array(np.full(len(row), b), pa.int32()), batch.column(0).take(at), batch.column(1).take(at), values.take(at)], ["unit", "guest", "b", "id", "w", "v"])

            for b, (lo, hi) in enumerate(plan.trees):
                home, goes = visits(u[:, plan.ends[b] : plan.ends[b + 1]], lo, hi, plan.budgets[b])
                tiles, first = plan.tiles[b], firsts[b]
                tile = hashed % tiles[home]
                yield rows(np.arange(len(u)), first[home] + tile, False, b)
                for t in range(int(tiles.max()) - 1):  # a row streams past the tiles before its own
                    row = np.flatnonzero(tile > t)
                    if len(row):
                        yield rows(row, first[home[row]] + t, True, b)
                row, box = np.nonzero(goes)
                for t in range(int(tiles.max())):
                    some = tiles[box] > t
                    if some.any():
                        yield rows(row[some], first[box[some]] + t, True, b)

    return run


LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _join(plan: Plan, threshold: float):
    def near(a: np.ndarray, h: np.ndarray, norm: np.ndarray, part: np.ndarray, b: int, lower: bool, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in a, in h) of the pairs that belong to block b; lower: only those with the place in h below at + the place in a."""
        lo, hi = plan.ends[b : b + 2]
        x = a[:, lo:hi].astype(np.float32)
        d = (x * x).sum(1)[:, None] + norm - 2 * (x @ part.T)
        i, j = np.nonzero(d <= plan.budgets[b] + 1e-5)
        if lower:
            i, j = i[j < i + at], j[j < i + at]
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), PAIRS):
            p, q = a[i[s : s + PAIRS]], h[j[s : s + PAIRS]]
            square = (p - q) ** 2
            mine = np.ascontiguousarray(square[:, lo:hi]).sum(1) <= plan.budgets[b]
            for e in range(b):
                mine &= np.ascontiguousarray(square[:, plan.ends[e] : plan.ends[e + 1]]).sum(1) > plan.budgets[e]
            keep[s : s + PAIRS] = mine & ((p * q).sum(1) >= threshold - EDGE)
        return i[keep], j[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        held: list[np.ndarray] = []
        h = None
        for batch in batches:
            if not batch.num_rows:
                continue
            guest, i_, w_, v_ = np.asarray(batch.column(1)), batch.column(3).to_numpy(), batch.column(4).to_numpy(), matrix(batch.column(5))
            own = ~guest
            if own.any():
                ids.append(i_[own])
                weights.append(w_[own])
                held.append(v_[own])
            if own.all():
                continue
            if not held:
                return  # nothing at home
            if h is None:
                h, hid, hw, b = np.concatenate(held), np.concatenate(ids), np.concatenate(weights), batch.column(2)[0].as_py()
                part = np.ascontiguousarray(h[:, plan.ends[b] : plan.ends[b + 1]], np.float32)
                norm, links, up = (part * part).sum(1), np.zeros(len(h), np.int64), np.arange(len(h))
            g, gi, gw = v_[guest], i_[guest], w_[guest]
            for s in range(0, len(g), ROWS):
                i, j = near(g[s : s + ROWS], h, norm, part, b, False, 0)
                if len(i):
                    np.add.at(links, j, gw[s + i])
                    got = np.zeros(len(g[s : s + ROWS]), np.int64)
                    np.add.at(got, i, hw[j])
                    some, first = np.unique(i, return_index=True)
                    up = joined(up, np.repeat(j[first], np.diff(np.append(first, len(i)))), j)
                    yield pa.RecordBatch.from_arrays([pa.array(gi[s + some]), pa.array(got[some]), pa.array(hid[j[first]])], schema=LINKS)
        if not held:
            return
        if h is None:
            h, hid, hw, b = np.concatenate(held), np.concatenate(ids), np.concatenate(weights), batch.column(2)[0].as_py()
            part = np.ascontiguousarray(h[:, plan.ends[b] : plan.ends[b + 1]], np.float32)
            norm, links, up = (part * part).sum(1), np.zeros(len(h), np.int64), np.arange(len(h))
        for s in range(0, len(h), ROWS):
            end = min(len(h), s + ROWS)
            i, j = near(h[s:end], h[:end], norm[:end], part[:end], b, True, s)
            i = i + s
            np.add.at(links, i, hw[j])
            np.add.at(links, j, hw[i])
            up = joined(up, i, j)
        root = np.full(len(h), np.iinfo(np.int64).max)
        np.minimum.at(root, up, hid)  # a group's least id
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(hid[some]), pa.array(links[some]), pa.array(root[up[some]])], schema=LINKS)
        give_back()

    return run


def near_classes(vectors: DataFrame, *, threshold: float = THRESHOLD, blocks: int = BLOCKS, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, box_rows: int = BOX_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(id, class_id, n_links) of every id.

    n_links counts the other ids whose vectors' cosine with its own is at least the threshold, above 0; ids that links
    connect, over others too, are a class.
    """
    spark, scratch = vectors.sparkSession, []
    prepare(spark)
    r2 = 2 - 2 * threshold
    clean = written(clean_vectors(vectors, id_col, vector_col).where("exists(v, x -> x <> 0)"), "unit-vectors", scratch)
    keys = clean.select("id", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(7)).alias("h2"))
    same = written(keys.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("w")).where("w > 1"), "equal", scratch)
    copies = written(keys.join(sized(same), ["h", "h2"]).select("id", "rep", "w"), "copies", scratch)
    rows = clean.join(sized(copies.where("id <> rep").select("id")), "id", "left_anti").join(sized(copies.where("id = rep").select("id", "w")), "id", "left")
    rows = written(rows.select("id", F.coalesce("w", F.lit(1)).alias("w"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("hash"), "v"), "rows", scratch)
    every = vectors.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        return every.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    dims, total = first["n"], rows.count()
    sums = rows.select("v").mapInArrow(_second(dims), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    turn, ends = rotation(np.array([r["x"] for r in sums]).reshape(dims, dims), blocks)
    drawn = rows.where(F.col("hash") < min(1.0, sample / total) * (1 << 30)).select("v").toArrow().column(0)
    fit = units(matrix(drawn)) @ turn if len(drawn) else np.zeros((1, dims))
    plan = Plan(turn, ends, r2, [boxes(fit[:, a:b], total, box_rows) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    found = rows.select("v").mapInArrow(_counts(plan), "box long, n long").groupBy("box").agg(F.sum("n").alias("n")).orderBy("box").collect()
    tiles = np.maximum(1, -(-np.array([r["n"] for r in found]) // tile))
    plan.tiles = np.split(tiles, np.cumsum([len(lo) for lo, _ in plan.trees])[:-1])
    sent = rows.mapInArrow(_send(plan), "unit int, guest boolean, b int, id long, w long, v array<double>")
    links = sent.repartitionById(int(tiles.sum()), F.col("unit")).sortWithinPartitions("guest").mapInArrow(_join(plan, threshold), "node long, links long, root long")
    links = written(links, "links", scratch)
    root = components(links, "node", "root")
    near = links.groupBy("node").agg(F.sum("links").alias("links")).join(root, F.col("node") == F.col("__node"), "left").select("node", "links", F.col("__root").alias("root"))
    out = every.join(copies.select(F.col("id").alias("copy"), "rep", "w"), F.col("id") == F.col("copy"), "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(near, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1).alias("n_links"))
    out = written(out, "near-classes")
    dropped(spark, scratch)
    return out


def embedding_dedup(vectors: DataFrame, *, id_col: str = "vec_id", **kw) -> DataFrame:
    """vectors, all columns, without the rows of all but the least id of each class."""
    gone = written(near_classes(vectors, id_col=id_col, **kw).where("id <> class_id").select(F.col("id").alias("__gone")), "gone")
    return vectors.join(sized(gone), vectors[id_col].cast("long") == gone["__gone"], "left_anti")


SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, min(embedding::DOUBLE[]) AS v FROM embeddings GROUP BY vec_id),
p AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD} - {EDGE}),
l AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(id, class_id) AS (SELECT id, id FROM e UNION SELECT l.y, r.class_id FROM r JOIN l ON r.id = l.x)
SELECT id AS vec_id, class_id, coalesce(n, 0) AS n_links FROM (SELECT id, min(class_id) AS class_id FROM r GROUP BY id)
LEFT JOIN (SELECT x AS id, count(*) AS n FROM l GROUP BY x) USING (id)
"""
