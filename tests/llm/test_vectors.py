from __future__ import annotations

import duckdb
import numpy as np
import pytest

from textloom.llm import embdedup, knn

KIND = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) if len(r) == 2 else r for r in rows], KIND)


def clustered(rng, n, dims, centres, spread):
    c = rng.normal(size=(centres, dims))
    return (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def brute_knn(rows, k, every=1):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float32).astype(float)
    want = set()
    for a in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((v - v[a]) ** 2).sum(1))
        order = [b for b in np.lexsort((ids, d)) if ids[b] != ids[a]][:k]
        want |= {(int(ids[a]), r + 1, int(ids[b]), round(float(d[b]), 5)) for r, b in enumerate(order)}
    return want


@pytest.mark.parametrize(("dims", "spread", "queries", "rows"), [(2, 0.05, 20, 40), (8, 0.3, 50, 1000), (24, 1.0, 7, 60), (3, 0.0, 30, 30)])
def test_knn_matches_brute_force(spark, dims, spread, queries, rows):
    rng = np.random.default_rng(dims)
    table = [(int(i), v.tolist()) for i, v in zip(rng.permutation(1000)[:300], clustered(rng, 300, dims, 12, spread), strict=True)]
    for every in (1, 3):
        got = {(r.query_id, r.rank, r.neighbor_id, round(r.distance, 5)) for r in knn.knn_join(frame(spark, table), k=4, every=every, pivots=20, queries=queries, rows=rows).collect()}
        assert {x[:3] for x in got} == {x[:3] for x in brute_knn(table, 4, every)}
        assert len(got) == 4 * sum(i % every == 0 for i, _ in table)


def test_clusters_are_not_copied_everywhere():
    rng = np.random.default_rng(4)
    at = rng.normal(size=(16, 8)) * 10
    data = at[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 8))
    cell = knn.squared(data, at).argmin(1)
    near = np.sqrt(((data - at[cell]) ** 2).sum(1))
    largest = np.array([near[cell == c].max() for c in range(16)])
    group = np.arange(16) // 2
    plan = knn.Plan(knn.group_bounds(at, largest, knn.cell_bounds(at, largest, [sorted(near[cell == c])[:11] for c in range(16)], 10), group, 8), group, 1)
    assert sum(plan.serves(g, cell, near).sum() for g in range(8)) < 2000 * 8 / 2


def test_bounds_exclude_something():
    rng = np.random.default_rng(1)
    pivots = rng.normal(size=(10, 2)) * 100
    data = pivots[rng.integers(0, 10, 500)] + rng.normal(size=(500, 2))
    cell = knn.squared(data, pivots).argmin(1)
    near = np.sqrt(((data - pivots[cell]) ** 2).sum(1))
    largest = np.array([near[cell == c].max() for c in range(10)])
    need = knn.group_bounds(pivots, largest, knn.cell_bounds(pivots, largest, [sorted(near[cell == c])[:6] for c in range(10)], 5), np.arange(10), 10)
    copies = sum(((cell == g) | (near >= need[g, cell])).sum() for g in range(10))
    assert copies < 1500  # of 5000


def test_knn_edges(spark):
    assert knn.knn_join(frame(spark, [])).count() == 0
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.5, 9.0]), (None, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [1.0]), (8, []), (9, [float("inf"), 0.0])]
    d = frame(spark, rows).selectExpr("*", "1 as id", "2 as v", "3 as cell", "4 as near")
    got = sorted((r.query_id, r.rank, r.neighbor_id) for r in knn.knn_join(d, k=5, every=1).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]  # ties to the smaller id; id 3 is (0.5, 9)
    assert knn.knn_join(frame(spark, [(20, [1.0, 2.0])])).count() == 0
    assert knn.knn_join(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no query
    assert knn.knn_join(frame(spark, [(1, None)])).count() == 0
    same = [(i, [1.0, 1.0]) for i in range(30)]
    assert {(r.query_id, r.rank, r.neighbor_id) for r in knn.knn_join(frame(spark, same), k=2, every=1, queries=7, rows=9).collect()} == {x[:3] for x in brute_knn(same, 2)}


def brute_classes(rows, t):
    v = np.array([x for _, x in rows], np.float32).astype(float)
    u = v / np.sqrt((v * v).sum(1))[:, None]
    near = u @ u.T >= t - 1e-12
    np.fill_diagonal(near, False)
    ids, classes = np.array([i for i, _ in rows]), {}
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            todo += (new := set(np.flatnonzero(near[todo.pop()]).tolist()) - seen)
            seen |= new
        classes[int(ids[a])] = int(min(ids[list(seen)]))
    return sorted((int(i), classes[int(i)], int(near[a].sum())) for a, i in enumerate(ids))


def near(df):
    return sorted((r[0], r[1], r[2]) for r in df.collect())


@pytest.mark.parametrize(("dims", "blocks", "t", "box"), [(1, 4, 0.9, 50), (2, 1, 0.99, 20), (6, 4, 0.9, 30), (16, 4, 0.8, 1000), (32, 8, 0.5, 40), (64, 4, 0.9, 60)])
def test_near_classes_match_brute_force(spark, dims, blocks, t, box):
    rng = np.random.default_rng(dims)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 250, dims, 40, 0.3 if dims > 1 else 0.1))]
    rows += [(1000 + i, [x * 3 for x in rows[i][1]]) for i in range(10)] + [(2000 + i, rows[i][1]) for i in range(0, 30, 2)]
    got = near(embdedup.near_classes(frame(spark, rows), threshold=t, blocks=blocks, box_rows=box))
    assert got == brute_classes(rows, t) and sum(n for *_, n in got)


@pytest.mark.parametrize(("tile", "sample"), [(16, 200), (7, 5), (1000, 1)])
def test_near_classes_in_tiles(spark, tile, sample):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 200, 8, 3, 0.2))]
    assert near(embdedup.near_classes(frame(spark, rows), tile=tile, box_rows=40, sample=sample)) == brute_classes(rows, 0.9)


def test_pairs_at_the_threshold_belong(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])]
    assert near(embdedup.near_classes(frame(spark, rows), threshold=0.6)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    assert near(embdedup.near_classes(frame(spark, rows), threshold=0.81)) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_boxes_divide_space():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    lo, hi = embdedup.boxes(x[:100], 400, 60)
    assert len(lo) > 4 and (((x[:, None] > lo) & (x[:, None] <= hi)).all(2).sum(1) == 1).all()
    home, goes = embdedup.visits(x, lo, hi, 0.04)
    for i, j in np.argwhere(((x[:, None] - x) ** 2).sum(2) <= 0.04):
        assert home[i] == home[j] or goes[i, home[j]] != goes[j, home[i]]
    assert goes.mean() < 0.4


def test_dedup_and_edges(spark):
    assert embdedup.near_classes(frame(spark, [])).count() == 0
    rows = [(5, [1.0, 0.0]), (2, [2.0, 0.01]), (9, [1.0, 0.02]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [1.0])]
    d = frame(spark, rows).selectExpr("*", "1 as id", "2 as a", "3 as rep", "4 as `__gone`")
    assert near(embdedup.near_classes(d)) == [(2, 2, 2), (3, 3, 0), (4, 4, 0), (5, 2, 2), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 2, 2)]
    kept = embdedup.embedding_dedup(d)
    assert kept.columns == d.columns
    assert sorted(str(r.vec_id) for r in kept.collect()) == sorted(["2", "3", "3", "None", "4", "6", "7", "8"])
    only = frame(spark, [(1, None), (2, [0.0])])
    assert near(embdedup.near_classes(only)) == [(1, 1, 0), (2, 2, 0)]


def test_sql_says_the_same_with_copies_planted(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 120, 16, 60, 0.2))]
    rows += [(500 + i, (np.array(rows[i][1]) * 1.01 + 0.001).tolist()) for i in range(0, 120, 10)]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    got = near(embdedup.near_classes(frame(spark, rows)))
    assert sorted(con.execute(embdedup.SQL).fetchall()) == got and sum(n for *_, n in got) > 20
