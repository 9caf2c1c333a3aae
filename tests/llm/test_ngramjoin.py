from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from textloom.llm import common
from textloom.llm import ngramjoin as m

from .conftest import words


def brute(rows, n=m.N, t=m.THRESHOLD):
    def grams(text):
        w = text.lower().split()
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [(i, grams(x)) for i, x in rows if i is not None and x]
    best = {}
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y and (j := len(x & y) / len(x | y)) >= t - 1e-9:
            k = (min(a, b), max(a, b))
            best[k] = max(best.get(k, 0), round(j, 6))
    return best


def corpus(seed=5):
    rng, rows = random.Random(seed), []
    shared = words(rng, 60)
    for g in range(25):
        base = words(rng, rng.randrange(8, 200)).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = [w if rng.random() > 0.06 else f"x{rng.randrange(999)}" for w in base]
            rows.append((len(rows), " ".join(copy) + (" " + shared if g % 3 == 0 else "")))
    return rows + [(900, rows[0][1]), (901, rows[0][1]), (902, "One Two"), (903, "one two"), (904, ""), (905, "  \n "), (906, None), (None, rows[1][1])]


def classes(rows):
    """{(id, text): (class id, links)}, by all pairs."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    numbered = list(enumerate(x or "" for _, x in docs))
    up, links = list(range(len(docs))), [0] * len(docs)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in brute(numbered):
        links[i] += 1
        links[j] += 1
        x, y = sorted((root(i), root(j)))
        up[y] = x
    return sorted(((docs[i][0], docs[root(i)][0], links[i]) for i in range(len(docs))), key=repr)


def found(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


@pytest.mark.parametrize("edges", [0, 400_000])
@pytest.mark.parametrize(("chunk", "local", "parts"), [(2_000_000, 64, 1), (3000, 2, 5)])
def test_join_matches_brute_force(docs, monkeypatch, edges, chunk, local, parts):
    monkeypatch.setattr(common, "DRIVER_EDGES", edges)
    rows = corpus()
    got = found(m.ngram_jaccard_join(docs(rows), chunk_grams=chunk, local=local, parts=parts))
    assert got == classes(rows)
    assert (903, 902, 1) in got and len({c for _, c, _ in got}) < len(got)


def test_dedup_keeps_the_least_of_each_class(docs):
    rows = corpus(6)
    want = sorted({c for _, c, _ in classes([r for r in rows if r[0] is not None])})
    kept = m.ngram_jaccard_dedup(docs(rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want
    assert not [r for r in kept if r.doc_id is None]  # a copy of document 1, which comes before it


def test_edges(spark, docs):
    empty = docs([])
    assert m.ngram_jaccard_join(empty).count() == 0 and m.ngram_jaccard_dedup(empty).count() == 0
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long, None, None, None, "a"), (2, long + " more", None, None, None, "b"), (2, long + " more", None, None, None, "b"), (3, None, "en", "s", 1, None), (4, "", "en", "s", 0, None), (None, None, "en", "s", 0, None)]
    d = docs(rows, ", k string").selectExpr("*", "doc_id as `__id`", "text as `__text`", "1 as h", "2 as node", "3 as `__gone_id`")
    assert found(m.ngram_jaccard_join(d)) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (None, None, 0)]
    kept = m.ngram_jaccard_dedup(d)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    twins = docs([(5, "a b c d e"), (5, "a b c d e"), (6, "z y x w v")])
    assert sorted(r.doc_id for r in m.ngram_jaccard_dedup(twins).collect()) == [5, 5, 6]  # repeated rows are one document
    only = docs([(5, None), (6, "")])
    assert found(m.ngram_jaccard_join(only)) == [(5, 5, 0), (6, 6, 0)]


def test_copies_count_without_pairs(docs):
    rng = random.Random(8)
    base, other = words(rng, 80), words(rng, 30)
    rows = [(i, base) for i in range(300)] + [(500 + i, base + " tail") for i in range(200)] + [(900, other)]
    assert found(m.ngram_jaccard_join(docs(rows))) == sorted([(i, 0, 499) for i, _ in rows[:500]] + [(900, 900, 0)], key=repr)


def test_passages_that_many_share_bind_nothing(docs):
    rng = random.Random(1)
    passage = words(rng, 60)
    rows = [(i, words(rng, 90) + " " + passage) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    got = found(m.ngram_jaccard_join(docs(rows), local=4))
    assert got == classes(rows) and sum(n for _, _, n in got) == 10


@pytest.mark.parametrize("seed", range(3))
def test_a_shared_passage_hides_no_pair(docs, seed):
    """3,000 documents of a common passage and private words: every link, wherever the passage's hashes fall."""
    rng = random.Random(seed)
    passage = words(rng, 30)
    rows = [(i, passage + " " + " ".join(f"p{i}_{k}" for k in range(rng.randrange(5, 24)))) for i in range(3000)]
    got = {r.doc_id: r.n_links for r in m.ngram_jaccard_join(docs(rows), local=10).collect()}
    shared, sizes = 28, [len(x.split()) - 2 for _, x in rows]
    count = Counter(sizes)
    assert got == {i: sum(c for s, c in count.items() if shared >= m.THRESHOLD * (s + sizes[i] - shared) - 1e-9) - (shared >= m.THRESHOLD * (2 * sizes[i] - shared) - 1e-9) for i, _ in rows}
    assert len(set(got.values())) > 3


def test_the_bound_excludes_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        for _ in range(4):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.9, base, rng.integers(0, 2**63, len(base), dtype=np.uint64))))
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if (x := len(np.intersect1d(sets[i], sets[j]))) >= 0.6 * (len(sets[i]) + len(sets[j]) - x)}
    assert {(int(i), int(j)) for x, y in m.similar(sets, 0.6) for i, j in zip(x, y, strict=True)} == want
    order = sorted(range(len(sets)), key=lambda x: (sets[x][0], len(sets[x])))
    assert len(list(m.leaf_pairs([(len(sets[x]), *m.bitmap(sets[x])) for x in order], 0.6))) < 36  # of 8 leaves' 36 pairs


def test_tiles_join_like_one(docs, monkeypatch):
    rng = random.Random(9)
    base = words(rng, 60).split()
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(999)}" for w in base)) for i in range(40)]
    monkeypatch.setattr(m, "TILE", 7)
    assert found(m.ngram_jaccard_join(docs(rows))) == classes(rows)


def test_rounds_send_each_set_to_few_tiles(docs, monkeypatch, tmp_path):
    """A cluster of 150 near copies in 38 tiles: disk follows the documents, not their number times the tiles."""
    rng = random.Random(8)
    base = words(rng, 80).split()
    rows = [(i, " ".join([*base, *words(rng, 12).split()])) for i in range(150)] + [(1000 + i, words(rng, 30)) for i in range(1500)]
    real, rounds = m._links, []

    def counted(t):
        path = tmp_path / str(len(rounds))
        path.mkdir()
        rounds.append(path)

        def run(batches):
            def seen():
                for batch in batches:
                    (path / str(random.getrandbits(64))).write_text(str(batch.num_rows))
                    yield batch

            return real(t)(seen())

        return run

    monkeypatch.setattr(m, "TILE", 4)
    monkeypatch.setattr(m, "_links", counted)
    got = m.ngram_jaccard_join(docs(rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((i, 0 if i < 150 else i, 149 if i < 150 else 0) for i, _ in rows)
    sent = [sum(int(p.read_text()) for p in path.iterdir()) for path in rounds]
    assert len(sent) > 1
    assert max(sent) <= 2 * m.NEAR * 150


def counted_links(monkeypatch, tmp_path):
    """Count the sets that _links gets: what has been counted so far."""
    real = m._links

    def counted(t):
        def run(batches):
            def seen():
                for batch in batches:
                    (tmp_path / str(random.getrandbits(64))).write_text(str(batch.num_rows))
                    yield batch

            return real(t)(seen())

        return run

    monkeypatch.setattr(m, "_links", counted)
    return lambda: sum(int(p.read_text()) for p in tmp_path.iterdir())


@pytest.mark.parametrize(("chunk", "few"), [(1_000_000, 32), (2000, 32), (2000, 2)])
def test_grams_shared_by_chance_tie_nothing(docs, monkeypatch, tmp_path, chunk, few):
    """500 documents of few different words, each of which shares some grams with others: no cluster of them all."""
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(20, 60), 24)) for i in range(500)]
    for i in range(40):
        rows.append((1000 + i, " ".join(w if rng.random() > 0.05 else "x" for w in rows[i][1].split())))
    sent = counted_links(monkeypatch, tmp_path)
    got = found(m.ngram_jaccard_join(docs(rows), chunk_grams=chunk, few=few))
    assert got == classes(rows) and sum(n for _, _, n in got) > 40
    if few == m.FEW:
        assert sent() < 160


def test_pairs_at_the_threshold_are_tied(docs):
    """Sets of which one holds the other, or that differ at the ends, at 0.6 exactly and next to it."""
    rng = random.Random(12)
    rows = []
    for size in (3, 5, 8, 20, 40, 50):
        base = [f"b{size}_{k}" for k in range(size + 2)]
        for cut in range(size):
            rows.append((len(rows), " ".join(base[: size + 2 - cut])))
            rows.append((len(rows), " ".join([*base[cut:], *(f"c{rng.randrange(30)}" for _ in range(cut // 2))])))
    assert found(m.ngram_jaccard_join(docs(rows), few=400)) == found(m.ngram_jaccard_join(docs(rows), few=3)) == classes(rows)


def test_sql_says_the_same(docs, tmp_path):
    rows = [(i, x) for i, x in corpus(7) if i is not None]
    docs(rows).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert sorted(con.execute(m.SQL).fetchall(), key=repr) == found(m.ngram_jaccard_join(docs(rows)))
