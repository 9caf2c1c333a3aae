from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from textloom.llm import mixing as m

from .conftest import words


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 4097])
def test_permutation(n):
    for key in (0, 1, 2**63 + 5):
        assert sorted(m.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    if n >= 100:
        assert m.permuted(np.arange(n), n, 1).tolist() != m.permuted(np.arange(n), n, 2).tolist()


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(doc_id, text):
    """(bucket hash, text hash) as Spark's xxhash64 gives them."""
    th = xxhash.xxh64_intdigest(text.encode(), seed=42)
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(int(doc_id).to_bytes(8, "little", signed=True), seed=42)
    return signed(xxhash.xxh64_intdigest(th.to_bytes(8, "little"), seed=seed)), signed(th)


def brute(rows, block, slots, shards, seed, alpha=m.ALPHA, weights=None, buckets=m.BUCKETS):
    by = defaultdict(list)
    for i, text, lang, source in rows:
        if text is not None and text.split():
            b, th = spark_hash(i, text)
            by[source].append((b % buckets, i is None, i or 0, th, lang, text))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    blocks = []
    for s in names:
        out, parts, n = [], [], 0
        for *_, lang, text in sorted(by[s], key=lambda r: r[:4]):
            starts = [k for k in range(len(text)) if text[k] not in " \n\t" and (not k or text[k - 1] in " \n\t")]
            a = 0
            while a < len(starts):
                b = min(len(starts), a + block - n)
                parts.append((lang, text[starts[a] : starts[b] if b < len(starts) else len(text)].rstrip()))
                n += b - a
                a = b
                if n == block:
                    out.append((n, parts))
                    parts, n = [], 0
        if n:
            out.append((n, parts))
        blocks.append(out)
    tokens = [(s, sum(n for n, _ in b)) for s, b in zip(names, blocks, strict=True)]
    share = m.target_weights(tokens, weights, alpha)
    shards = shards or max(1, round(sum(map(len, blocks)) / slots))
    before, want = np.zeros(len(names), int), {}
    for shard in range(shards):
        source, index = m.slot_blocks(shard, slots, share, [len(b) for b in blocks], before, seed)
        for slot, (s, x) in enumerate(zip(source.tolist(), index.tolist(), strict=True)):
            n, parts = blocks[s][x]
            want[shard, slot] = (names[s], x, n, parts[0][0], "\n\n".join(p for _, p in parts))
            before[s] += 1
    return want


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.choice([1, 5, 40, 300])).replace(" ", rng.choice([" ", "\n", "  "])), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return [*rows, (500, None, "en", "a"), (501, "", "en", "b"), (502, " \n ", "en", "only blank"), (None, "x y z", "en", "c")]


@pytest.mark.parametrize("how", [{}, {"weights": {"a": 1, "b": 3, None: 1, "absent": 5}}, {"shards": 9}])
def test_matches_brute_force(docs, how):
    rows = corpus()
    d = docs([(i, t, lang, s, None) for i, t, lang, s in rows])
    got = {(r.shard, r.slot): (r.source, r.block, r.n_tokens, r.lang, r.text) for r in m.mix_sources(d, block=64, slots=16, seed=5, **how).collect()}
    assert got == brute(rows, 64, 16, how.get("shards"), 5, weights=how.get("weights"))


def test_every_block_once_before_any_twice(docs):
    rows = corpus(2)
    out = m.mix_sources(docs([(i, t, lang, s, None) for i, t, lang, s in rows]), block=16, slots=32, shards=40, weights={"a": 1.0}).collect()
    counts = Counter(r.block for r in out)
    assert len(out) == 1280 and {r.source for r in out} == {"a"} and max(counts.values()) - min(counts.values()) <= 1


def test_weights_are_met(docs):
    rows = corpus(3)
    share = Counter(r.source for r in m.mix_sources(docs([(i, t, lang, s, None) for i, t, lang, s in rows]), block=32, slots=64, shards=100, weights={"a": 0.5, "b": 0.3, "c": 0.2}).collect())
    for s, w in {"a": 0.5, "b": 0.3, "c": 0.2}.items():
        assert abs(share[s] / 6400 - w) < 0.03


def test_edges(spark, docs):
    assert m.mix_sources(docs([])).count() == 0
    assert m.mix_sources(docs([(1, "a b", "en", "a", 1)]), weights={"z": 1.0}).count() == 0
    twice = docs([(1, "a b c", "en", "a", 1)] * 2, "").selectExpr("*", "1 as shard", "2 as bucket", "3 as n", "4 as known")
    out = m.mix_sources(twice, block=6, slots=2, shards=1).collect()
    assert [r.text for r in out] == ["a b c\n\na b c"] * 2
    long = docs([(1, " ".join(f"t{i}" for i in range(50_000)), "en", "a", 1)])
    got = m.mix_sources(long, block=500, slots=100, shards=1, weights={"a": 1}).collect()
    assert sorted(r.block for r in got) == list(range(100)) and all(r.n_tokens == 500 for r in got)
    mixed = m.mixed_documents(long, slots=100, block=500, shards=1)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and mixed.select("doc_id").distinct().count() == 100
