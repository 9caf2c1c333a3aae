from __future__ import annotations

import random

import corpus_pipeline
from textloom.llm import bpe, langid, mixing, ngramjoin, substring

from .conftest import words
from .test_mixing import brute as brute_mix
from .test_ngramjoin import brute as brute_pairs
from .test_substring import brute as brute_substrings


def corpus(tmp_path, spark):
    rng = random.Random(11)
    passage = words(rng, 70)
    rows = [(i, words(rng, rng.randrange(20, 200)), "en", rng.choice("ab"), 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "a", 1) for i in range(5)]
    rows += [(200 + i, rows[i][1].rsplit(" ", 1)[0] + " changed", "en", "b", 1) for i in range(10)]
    rows += [(300 + i, words(rng, 90) + " " + passage + " " + words(rng, 90), "en", "b", 1) for i in range(4)]
    rows += [(400, None, "en", "a", 0), (401, "", "en", "a", 0), (402, "12 34 !", "en", "a", 7), (None, words(rng, 30), None, "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    # language ID: by the plain identifier
    labelled = [(r[2], r[1]) for r in rows if r[2] and r[1] is not None]
    found = langid.Identifier(langid.Model(labelled)).identify([r[1] or "" for r in rows])
    rows = [(*r[:2], f[0][0], *r[3:]) for r, f in zip(rows, found, strict=True) if f and f[0][0] != langid.UND]
    # n-gram Jaccard join: the least id of each connected group
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in brute_pairs([r[:2] for r in rows]):
        x, y = sorted((root(a), root(b)))
        up[y] = x
    rows = [r for r in rows if r[0] is None or root(r[0]) == r[0]]
    # substring dedup
    cut = brute_substrings([r[:2] for r in rows], substring.WINDOW)
    rows = [(r[0], cut[r[0]][0], *r[2:]) for r in rows if not cut[r[0]][1] or cut[r[0]][0].split()]
    # mixing, then BPE
    slots = brute_mix([(r[0], r[1], r[2], r[3]) for r in rows], mixing.BLOCK, mixing.SLOTS, None, mixing.SEED)
    encode = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(bpe.VOCABULARY)))
    want = sorted((shard * mixing.SLOTS + slot, source, encode.encode([text])[0].tolist()) for (shard, slot), (source, _, _, _, text) in slots.items())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in out)
    assert sorted((r.doc_id, r.source, list(r.token_ids)) for r in out) == want


def test_stage_columns_and_names(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_dedup", "substring_dedup", "mix_sources", "bpe_encode"]
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, str(tmp_path)).columns == docs.columns


def test_clean_documents_stay(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, words(rng, 120), "en", "a", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES[:3]:
        docs = f(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [r[:2] for r in rows]
    assert ngramjoin.THRESHOLD < 1
