from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np
import pytest

from textloom.llm import langid as m

SF = "/root/testdata/sf0.01"
LANGS = {"aa": "ka lo mi nu pe ra so tu vi wo", "bb": "xar yel zim qon fub dak jep gul hos cit", "cc": "éta öri ñul ßag çoh êmi ùso àne ïva üxo"}


def text(rng, lang, n):
    parts = LANGS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return m.Model([(x, text(rng, x, 200)) for x in LANGS for _ in range(20)])


def test_held_out_accuracy():
    rows = duckdb.connect().execute(f"SELECT lang, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    model = m.Model(rows[:300])
    found = m.Identifier(model).identify([t for _, t in rows[300:]])
    right = sum(bool(f) and f[0][0] == lang for f, (lang, _) in zip(found, rows[300:], strict=True))
    assert right >= 0.98 * len(found)
    assert all(f and f[0][0] != m.UND for f in found)  # no document of the table is rejected


def test_mixtures_and_their_shares(model):
    rng = random.Random(2)
    texts = [text(rng, "aa", 120), text(rng, "aa", 90) + " " + text(rng, "bb", 30), " ".join((text(rng, "bb", 40), text(rng, "cc", 60), text(rng, "aa", 20)))]
    a, b, c = m.Identifier(model).identify(texts)
    assert [x for x, _ in a] == ["aa"] and [x for x, _ in b] == ["aa", "bb"] and [x for x, _ in c] == ["cc", "bb", "aa"]
    assert abs(b[0][1] - 0.75) < 0.03 and abs(c[0][1] - 0.5) < 0.03


def test_equals_a_plain_search_over_nested_sets(model):
    """The batched EM against a loop over single documents and all prefixes of the ranking by share."""
    rng = random.Random(3)
    ident = m.Identifier(model)

    def em(like, may):
        pi = may / may.sum()
        for _ in range(ident.rounds):
            g = like * pi
            pi = (g / g.sum(1, keepdims=True)).mean(0)
        return pi, np.log((like * pi).sum(1)).sum()

    texts = [" ".join(text(rng, x, rng.randrange(0, 40)) for x in rng.sample(sorted(LANGS), k)) for k in (1, 2, 3) for _ in range(15)] + ["qqqq wwww zzzz jjjj " * 10]
    for t, got in zip(texts, ident.identify(texts), strict=True):
        words = m.letters(t)
        if not words:
            assert got == []
            continue
        logs = np.array([sum(model.rows[model.at.get(w[i - 2 : i + 1]) or model.at.get(w[i - 1 : i + 1]) or model.at.get(w[i]) or 0] for i in range(2, len(w))) for w in (f"  {x.decode()} " for x in words)])
        like, price = np.exp(logs), ident.penalty * np.log(len(words) + 1)
        alone = logs.sum(0)
        alone[-1] -= price
        best, names = alone.max(), [ident.names[alone.argmax()]]
        full, _ = em(like, np.ones(len(ident.names)))
        order = np.argsort(-full, kind="stable")
        for k in range(2, len(order) + 1):
            may = np.zeros(len(order))
            may[order[:k]] = 1
            pi, ll = em(like, may)
            if ll - (k - 1) * price > best + 1e-3:
                best = ll - (k - 1) * price
                names = [ident.names[x] for _, x in sorted((-pi[x], x) for x in order[:k])]
        assert [x for x, _ in got] == names


def test_rejects_what_no_model_explains(model):
    found = m.Identifier(model).identify(["qwrtpsdfg hjklzxcvb " * 30, "123 456 !!!", "", "ka lo"])
    assert found[0][0][0] == m.UND and found[1] == [] and found[2] == [] and found[3][0][0] == "aa"


def test_columns(spark, docs):
    rng = random.Random(4)
    rows = [(i, text(rng, x, 50), x, "s", 1, i) for i, x in enumerate(itertools.islice(itertools.cycle(LANGS), 30))]
    rows += [(100, None, "aa", "s", None, 0), (101, "", None, None, None, 1), (None, text(rng, "bb", 30), None, "s", 2, 2), (103, "99 %% 1", "bb", "s", 3, 3), (104, text(rng, "cc", 30_000), "cc", "s", 4, None), (0, rows[0][1], "aa", "s", 1, 0)]
    d = docs(rows, ", shares int").selectExpr("*", "1 as `__r`", "2 as accepted", "3 as `__row`")
    out = m.language_mixtures(d).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by[None].lang == "bb" and by[104].lang == "cc" and by[1].languages == ["bb"]
    assert [by[i].accepted for i in (100, 101, 103)] == [False] * 3 and by[100].lang is None and by[101].shares == []
    kept = m.keep_identified(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([0, *range(30), 104])
    assert m.language_mixtures(docs([])).count() == 0
    unlabelled = m.language_mixtures(docs([(1, "ka lo", None, "s", 1)])).first()
    assert unlabelled.accepted is False and unlabelled.lang is None
