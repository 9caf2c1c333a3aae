from __future__ import annotations

import itertools
import random

import pytest

from textloom.llm import sharding as m

from .conftest import words


def fewest(sizes, capacities):
    """Least bytes that must leave, over all ways to keep whole units in place."""
    best = None
    for stay in itertools.product(*(range(min(s, capacities.get(n, 0)) + 1) for n, s in sizes.items())):
        moved = sum(sizes.values()) - sum(stay)
        room = sum(capacities.values()) - sum(stay)
        if moved <= room and (best is None or moved < best):
            best = moved
    return best


@pytest.mark.parametrize("seed", range(30))
def test_flow_moves_the_fewest(seed):
    rng = random.Random(seed)
    names = "abcde"
    sizes = {n: rng.randrange(0, 7) for n in rng.sample(names, rng.randrange(1, 5))}
    capacities = {n: rng.randrange(0, 9) for n in rng.sample(names, rng.randrange(1, 6))}
    if sum(sizes.values()) > sum(capacities.values()):
        with pytest.raises(ValueError, match="fit"):
            m.transfers(sizes, capacities)
        return
    flows = m.transfers(sizes, capacities)
    assert sum(flows.values()) == fewest(sizes, capacities)
    for n in capacities:
        load = sizes.get(n, 0) - sum(f for (o, _), f in flows.items() if o == n) + sum(f for (_, t), f in flows.items() if t == n)
        assert load <= capacities[n]
    for n in set(sizes) - set(capacities):
        assert sum(f for (o, _), f in flows.items() if o == n) == sizes[n]


def test_network_with_costs():
    net = m.Network(4)
    cheap, dear = net.arc(0, 1, 3, 1), net.arc(0, 2, 5, 2)
    net.arc(1, 3, 2, 1)
    net.arc(2, 3, 5, 5)
    net.arc(1, 2, 9, 0)
    assert net.solve(0, 3) == (7, 2 * 2 + 1 * 6 + 4 * 7)
    assert net.flow(cheap) == 3 and net.flow(dear) == 4


def table(docs, n=300):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", "hot" if rng.random() < 0.6 else rng.choice(["b", "c", None]), 1) for i in range(n)]
    return rows + [(None, "no id", "en", "b", 1), (900, None, "en", "c", 1), (901, "", "en", "hot", 0), (0, rows[0][1], "en", rows[0][3], 1)]


def test_reshard_keeps_rows_and_capacities(docs):
    rows = table(docs)
    out = m.reshard(docs(rows)).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in out if r.doc_id is not None and r.text) == sorted((r[0], r[1], r[3]) for r in rows if r[0] is not None and r[1])
    assert len(out) == len(rows)
    sizes: dict[str, int] = {}
    total = 0
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + len((r.text or "").encode())
        total += len((r.text or "").encode())
    room = total * 1.05 / 8 + 1
    assert max(sizes.values()) <= room + total / m.BLOCKS  # a transfer falls short by less than a block
    for r in out:
        assert r.moved == (r.shard != (r.source or m.NULL_NAME))
    moved = sum(len((r.text or "").encode()) for r in out if r.moved)
    old: dict[str, int] = {}
    for r in rows:
        old[r[3] or m.NULL_NAME] = old.get(r[3] or m.NULL_NAME, 0) + len((r[1] or "").encode())
    assert moved <= sum(max(0, s - int(room)) for s in old.values())


def test_dissolved_and_untouched_shards(docs):
    rows = table(docs)
    out = m.reshard(docs(rows), {"b": 10**6, "new": 10**6, "hot": 10**6}).collect()
    assert {r.shard for r in out} <= {"b", "new", "hot"}
    assert all(r.shard == r.source and not r.moved for r in out if r.source in ("b", "hot"))
    same = m.reshard(docs(rows), {"b": 10**6, "c": 10**6, "hot": 10**6, m.NULL_NAME: 10**6}).collect()
    assert not any(r.moved for r in same) and len(same) == len(rows)


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_a_hot_shard_gives_up_what_it_must(docs, share):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", "hot" if rng.random() < share else f"s{i % 19:02d}", 1) for i in range(3000)]
    rows += rows[:50]
    for capacities in (None, {f"t{i}": sum(len(r[1]) for r in rows) // 7 + 1 for i in range(7)}):
        out = m.reshard(docs(rows), capacities).collect()
        assert len(out) == len(rows)
        sizes: dict[str, int] = {}
        for r in out:
            sizes[r.shard] = sizes.get(r.shard, 0) + len(r.text)
        total = sum(sizes.values())
        room = int(total * 1.05 / 24) + 1 if capacities is None else total // 7 + 1
        assert max(sizes.values()) <= room + 2 * max(len(r[1]) for r in rows)  # rows that repeat are one document
        assert len({(r.doc_id, r.shard) for r in out}) == 3000


def test_edges(docs):
    assert m.reshard(docs([])).count() == 0
    with pytest.raises(ValueError, match="fit"):
        m.reshard(docs(table(docs)), {"b": 10})
    d = docs([(1, "x" * 500_000, "en", "a/b=1", 1, "k"), (2, "y", "en", "", 1, None)], ", shard string").selectExpr("*", "1 as `__old`", "2 as moved", "3 as `__block`")
    out = m.reshard(d, {"new one": 10**6, "": 10})
    assert sorted(out.columns) == sorted(set(d.columns))
    assert sorted((r.doc_id, r.shard, r.moved) for r in out.collect()) == [(1, "new one", True), (2, "", False)]
