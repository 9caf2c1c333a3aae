from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import substring as m

from .conftest import words


def brute(rows, k):
    """doc order (id, nulls last): windows but the first of their kind cover words that go."""
    token = re.compile(r"[^ \t\n\r\f\x0b]+[ \t\n\r\f\x0b]*")
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[i] = (None, 0)
            continue
        toks = token.findall(text)
        ws = [t.strip(" \t\n\r\f\x0b") for t in toks]
        gone = set()
        for p in range(len(ws) - k + 1):
            w = tuple(ws[p : p + k])
            if w in seen:
                gone.update(range(p, p + k))
            seen.add(w)
        lead = text[: len(text) - sum(map(len, toks))]
        out[i] = (text if not gone else lead + "".join(t for x, t in enumerate(toks) if x not in gone), len(gone))
    return out


def check(docs, rows, **kw):
    got = {r.doc_id: (r.text, r.n_removed) for r in m.substring_dedup(docs(rows), **kw).collect()}
    assert got == brute(rows, kw.get("window", m.WINDOW))


def test_matches_brute_force(docs):
    rng = random.Random(2)
    passages = [words(rng, n) for n in (49, 50, 51, 70, 130)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 80)) for _ in range(3)]
        for p in rng.sample(passages, rng.randrange(3)):
            parts.insert(rng.randrange(4), p)
        rows.append((i, rng.choice(["", "\n "]) + rng.choice(["\n", "  ", "\t"]).join(x for x in parts if x)))
    rows += [(100, rows[3][1]), (101, "x " * 200), (102, "a b c " * 90), (103, "a b c " * 40), (104, None), (105, ""), (106, " \n"), (None, rows[5][1])]
    check(docs, rows)
    check(docs, rows, window=12, gram=4)
    check(docs, rows, hot=3)
    check(docs, rows, window=12, gram=4, hot=1)


def test_a_phrase_in_many_contexts_is_no_bucket(docs):
    """One phrase of GRAM words in 10,000 contexts: a hot minimiser, whose windows go by digest."""
    rng = random.Random(12)
    phrase = words(rng, m.GRAM)
    rows = [(i, " ".join(f"a{i}_{k}" for k in range(45)) + " " + phrase + " " + " ".join(f"b{i}_{k}" for k in range(45))) for i in range(10_000)]
    rows += [(20_000 + i, rows[i][1]) for i in range(20)]
    got = {r.doc_id: r.n_removed for r in m.substring_dedup(docs(rows), hot=1000).where("n_removed > 0").collect()}
    assert got == dict.fromkeys(range(20_000, 20_020), 100)


def test_minimisers_of_equal_windows_are_equal():
    """Ties of hashes go to the left, whatever the length of the document."""
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 6, 400).astype(np.uint64) << np.uint64(61)
    h, s, n = m.super_kmers(grams, 7)
    at = np.repeat(np.arange(len(s)), n)
    assert n.sum() == 394 and all(h[at[x]] == grams[x : x + 7].min() for x in range(394))


def test_halves_of_equal_windows_have_equal_keys():
    rng, w, gram = np.random.default_rng(4), 41, 10
    passage = rng.integers(0, 50, 70)
    keys = []
    for seed in (1, 2):
        around = np.random.default_rng(seed).integers(0, 50, 200)
        hashes = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64)[np.concatenate((around[:90], passage, around[90:]))]
        key, first, wins = m.super_kmers(m.rolled(hashes, gram), w, gram)
        of = {x: k for k, a, n in zip(key.tolist(), first.tolist(), wins.tolist(), strict=True) for x in range(a, a + n)}
        assert sorted(of) == list(range(len(hashes) - 49))  # each window in one part
        keys.append([of[x] for x in range(90, 90 + 70 - 49)])
    assert keys[0] == keys[1]


def test_a_phrase_that_repeats_alone_does_not_travel():
    """Documents that share a minimiser of 10 words, but no 30 words around it, share no key."""
    rng = np.random.default_rng(6)
    phrase, keys, plain = rng.integers(0, 1 << 63, 10).astype(np.uint64), [], []
    for _ in range(50):
        grams = m.rolled(np.concatenate((rng.integers(0, 1 << 63, 60).astype(np.uint64), phrase, rng.integers(0, 1 << 63, 60).astype(np.uint64))), 10)
        grams[60] = 0  # the least
        keys += m.super_kmers(grams, 41, 10)[0].tolist()
        plain += m.super_kmers(grams, 41)[0].tolist()
    assert plain.count(0) == 50
    assert len(set(keys)) == len(keys)


def test_repeated_rows_are_one_document(docs):
    rng = random.Random(3)
    t = words(rng, 120)
    rows = [(1, t), (1, t), (2, t), (2, t)]
    got = sorted((r.doc_id, r.n_removed, r.text) for r in m.substring_dedup(docs(rows)).collect())
    assert got == [(1, 0, t), (1, 0, t), (2, 120, ""), (2, 120, "")]


def test_clashing_columns_empty_and_long(docs):
    assert m.substring_dedup(docs([])).count() == 0
    long = " ".join(f"t{i}" for i in range(80_000))
    rows = [(1, long, None, None, None, 1), (2, "start " + long, None, None, None, 2)]
    d = docs(rows, ", h long").selectExpr("*", "1 as `__th`", "2 as `__spans`", "'t' as packed", "9 as n_removed")
    out = {r.doc_id: r for r in m.substring_dedup(d).collect()}
    assert set(m.substring_dedup(d).columns) == set(d.columns)
    assert out[1].text == long and out[2].text == "start " and out[2].n_removed == 80_000 and out[2].h == 2


def test_hot_passage_with_a_small_memory(docs, monkeypatch):
    rng = random.Random(4)
    p = words(rng, 60)
    rows = [(i, words(rng, 30) + " " + p) for i in range(80)]
    check(docs, rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=4, max_size=30), min_size=1, max_size=6))
def test_repeated_windows_is_exact(rows):
    import numpy as np

    k = 4
    row, off = m.repeated_windows([b" ".join(r) for r in rows], [np.arange(len(rows))], np.zeros(len(rows), np.int64), k)
    seen, want = set(), []
    for i, r in enumerate(rows):
        for p in range(len(r) - k + 1):
            w = tuple(r[p : p + k])
            if w in seen:
                want.append((i, p))
            seen.add(w)
    assert list(zip(row.tolist(), off.tolist(), strict=True)) == want
