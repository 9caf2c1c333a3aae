from __future__ import annotations

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import bpe as m

V = m.Vocabulary(m.read_ranks(m.VOCABULARY))
REF = tiktoken.Encoding("ref", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=dict(V.ranks), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_encoder_equals_reference(texts):
    ids, counts = m.Encoder(V).encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == REF.encode_ordinary(t)
        at += n


def test_many_rows_and_single_trees_agree():
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoin shrdlué") for _ in range(rng.randrange(2, 64))).encode()[:64] for _ in range(400)]
    for leaves in (2, 4, 8, 16, 32, 64):
        own = [w for w in words if leaves // 2 < len(w) <= leaves]
        if own:
            ids, lens = m.merge_many(own, leaves, V)
            assert ids.tolist() == [t for w in own for t in m.merge_one(w, V)]
            assert lens.tolist() == [len(m.merge_one(w, V)) for w in own]


def test_long_words_and_forgetting(monkeypatch):
    monkeypatch.setattr(m, "CACHE_WORDS", 50)
    e = m.Encoder(V)
    texts = ["ab" * 20_000, "x" * 3000, "日本語" * 2000, " ".join(f"word{i}" for i in range(300))] * 2
    for t in texts:
        ids, _ = e.encode([t])
        assert ids.tolist() == REF.encode_ordinary(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken"])
def test_other_vocabularies(name):
    raw = m.read_ranks(f"/opt/tokenizers/{name}")
    v = m.Vocabulary(raw)
    ref = tiktoken.Encoding("own", pat_str=REF._pat_str, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    text = "The quick brown fox, l'été: 12.5% über alles!\n\n\tTabs  and   spaces "
    assert m.Encoder(v).encode([text])[0].tolist() == ref.encode_ordinary(text)


def test_columns(spark, docs):
    rows = [(1, "Hello wörld\n"), (2, None), (3, ""), (None, "a b"), (5, "y" * 200_000), (5, "same"), (5, "same")]
    d = docs(rows).selectExpr("*", "1 as `__text`", "2 as token_ids", "3 as n_tokens")
    out = m.bpe_round_trip(d).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    by = {r.doc_id: r for r in out}
    assert by[2].token_ids is None and by[2].n_tokens is None and by[3].token_ids == [] and by[3].n_tokens == 0
    assert by[1].token_ids == REF.encode_ordinary("Hello wörld\n")
    assert m.bpe_round_trip(docs([])).count() == 0
    ids = spark.createDataFrame([(1, [0, 10**6]), (2, [-1]), (3, None), (4, []), (5, [None]), (6, REF.encode_ordinary("é")[:1])], "i int, ids array<int>")
    back = {r.i: r.t for r in ids.select("i", m.decode(spark, F.col("ids")).alias("t")).collect()}
    assert back == {1: None, 2: None, 3: None, 4: "", 5: None, 6: REF.decode(REF.encode_ordinary("é")[:1])}
