"""Mixing sources to target weights, in blocks of a fixed number of tokens.

Each source's documents, in a pseudorandom but fixed order, are one stream of tokens (words with the white space after
them), cut into blocks of ``block`` tokens; only a source's last block is shorter. Parts of two documents in a block
are set apart by an empty line; white space at the ends of a part is left out. Every output shard has ``slots`` slots and draws how many go to each source from a
multinomial with the target weights. The slots of a source count on from shard to shard; slot j takes block perm(j mod
n), perm being a keyed Feistel permutation of the source's n blocks, a new one each time that all were used. Slots and
blocks are joined by block index.

Distribution. Token counts per (source, bucket) give every bucket's place in its source's stream, so no source is ever
in one task; documents are shuffled once by bucket to be cut, the parts once by block to be joined. The draws are made
where the shards are; the driver holds the weights, one number a source.

Defined results. Null texts and texts without a word have no token and vanish. A null source is a source of its own,
null in the result; a weight may be given for None. Weights of absent sources are left out and the rest is scaled; no
source with a positive weight gives an empty result. The order is by a hash of (doc_id, text), then doc_id, nulls last,
then hash of the text: rows that repeat both are adjacent and each counts. Long texts span as many blocks as they
need. Other columns than doc_id, text, source and lang aren't read and don't reach the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, give_back, prepare, sized, text_hash, written

BLOCK, SLOTS, ALPHA, SEED, BUCKETS = 512, 256, 0.5, 17, 16_384
M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n), at the given places: four Feistel rounds, walked on until within range."""
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = np.uint64(((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.uint64(key & M64) + np.arange(4, dtype=np.uint64))
    out = np.asarray(index, np.uint64).copy()
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def shard_draw(shard: int, slots: int, weights: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots per source, source of each slot) of one shard."""
    rng = np.random.Generator(np.random.PCG64([seed, shard]))
    counts = rng.multinomial(slots, weights)
    return counts, rng.permutation(np.repeat(np.arange(len(weights)), counts))


def slot_blocks(shard: int, slots: int, weights: np.ndarray, blocks: list[int], before: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(source, block) of each slot of a shard; before: slots that each source has had in the shards before."""
    _, source = shard_draw(shard, slots, weights, seed)
    index = np.zeros(slots, np.int64)
    for s in np.unique(source).tolist():
        own = np.flatnonzero(source == s)
        j = before[s] + np.arange(len(own))
        for epoch in np.unique(j // blocks[s]).tolist():
            now = j // blocks[s] == epoch
            index[own[now]] = permuted(j[now] % blocks[s], blocks[s], int(_mix(np.array([seed ^ (s << 40) ^ (epoch << 8)], np.uint64))[0]))
    return source, index


PIECES = pa.schema([("sid", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("tokens", pa.int32()), ("lang", pa.string()), ("piece", pa.string())])


def pieces(text: str, at: int, block: int) -> list[tuple[int, int, int, bytes]]:
    """(block, place in the stream, tokens, bytes) of the parts of a text that starts at a place in the stream."""
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    out, i = [], 0
    while i < len(starts):
        j = min(len(starts), i + block - (at + i) % block)
        out.append(((at + i) // block, at + i, j - i, raw[starts[i] : starts[j] if j < len(starts) else len(raw)].rstrip(b" \t\n\r\f\x0b")))
        i = j
    return out


def _cut(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            rows = []
            for sid, text, lang, start in zip(*(batch.column(c).to_pylist() for c in ("sid", "text", "lang", "start")), strict=True):
                if start is not None:
                    at = start
                    continue
                got = pieces(text, at, block)
                rows += [(sid, b, p, n, lang, raw.decode()) for b, p, n, raw in got]
                at += sum(n for _, _, n, _ in got)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)] if rows else [pa.array([], f.type) for f in PIECES], schema=PIECES)
        give_back()

    return run


def _draws(slots: int, weights: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column(0).to_pylist()
            counts = [shard_draw(s, slots, weights, seed)[0] for s in shards]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shards, len(weights)), pa.int64()), pa.array(np.tile(np.arange(len(weights)), len(shards)), pa.int32()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], ["shard", "sid", "n"])

    return run


def _slots(slots: int, weights: np.ndarray, blocks: list[int], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = np.zeros(len(weights), np.int64)
                for b in before:
                    base[b["sid"]] = b["before"]
                source, index = slot_blocks(shard, slots, weights, blocks, base, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(slots, shard)), pa.array(np.arange(slots), pa.int32()), pa.array(source, pa.int32()), pa.array(index)], ["shard", "slot", "sid", "block"])

    return run


def target_weights(tokens: list[tuple[str | None, int]], weights: Mapping[str | None, float] | None, alpha: float) -> np.ndarray:
    """The share of slots of each (source, tokens): as given, or by tokens to the power alpha."""
    raw = np.array([(n**alpha if weights is None else max(0.0, weights.get(s, 0.0))) if n else 0.0 for s, n in tokens], float)
    return raw / raw.sum() if raw.sum() > 0 else raw


def mix_sources(docs: DataFrame, *, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, slots: int = SLOTS, shards: int | None = None, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(shard, slot, source, block, n_tokens, lang, text) of every slot of every output shard.

    Without weights a source's share is its tokens to the power alpha; without shards there are as many as give about
    the number of blocks that there are. lang is that of the block's first document.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("source").alias("source"), F.col("doc_id").cast("long").alias("id"), text_hash("text").alias("th"), F.col("text").alias("text"), F.col("lang").alias("lang")).where("text is not null")
    base = base.withColumn("bucket", F.pmod(F.xxhash64("id", "th"), F.lit(buckets)).cast("int"))
    sums = written(base.groupBy("source", "bucket").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("n")).where("n > 0"), "tokens")
    tokens = sorted(((r["source"], r["n"]) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    share = target_weights(tokens, weights, alpha)
    blocks = [-(-n // block) for _, n in tokens]
    if not share.sum():
        return spark.createDataFrame([], "shard long, slot int, source string, block long, n_tokens int, lang string, text string")
    shards = max(1, round(sum(blocks) / slots)) if shards is None else shards
    sources = sized(spark.createDataFrame([(s, i) for i, (s, _) in enumerate(tokens) if share[i] > 0], "known string, sid int"), len(tokens))
    starts = sums.join(sources, F.col("source").eqNullSafe(F.col("known"))).select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("start"))
    rows = base.join(sources, F.col("source").eqNullSafe(F.col("known"))).select("sid", "bucket", F.col("id").isNull().alias("none"), "id", "th", "lang", "text", F.lit(None).cast("long").alias("start"))
    rows = rows.unionByName(starts.withColumns({"none": F.lit(False), "id": F.lit(None).cast("long"), "th": F.lit(0).cast("long"), "lang": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}))
    # a bucket's first row tells where it starts; its documents follow
    cut = rows.repartition("sid", "bucket").sortWithinPartitions("sid", "bucket", F.col("start").isNull(), "none", "id", "th").mapInArrow(_cut(block), "sid int, block long, at long, tokens int, lang string, piece string")
    whole = cut.groupBy("sid", "block").agg(F.sum("tokens").cast("int").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "lang", "piece"))).alias("parts"))
    whole = whole.select("sid", "block", "n_tokens", F.col("parts")[0]["lang"].alias("lang"), F.array_join("parts.piece", "\n\n").alias("text"))
    tasks = max(1, min(1000, shards // 64))
    draws = spark.range(0, shards, 1, tasks).mapInArrow(_draws(slots, share, seed), "shard long, sid int, n long").withColumn("group", F.floor(F.col("shard") / 1024))
    groups = draws.groupBy("sid", "group").agg(F.sum("n").alias("sum"))
    groups = groups.select("sid", "group", (F.sum("sum").over(Window.partitionBy("sid").orderBy("group")) - F.col("sum")).alias("base"))
    before = draws.hint("merge").join(groups, ["sid", "group"]).select("shard", "sid", (F.col("base") + F.sum("n").over(Window.partitionBy("sid", "group").orderBy("shard")) - F.col("n")).alias("before"))
    places = before.groupBy("shard").agg(F.collect_list(F.struct("sid", "before")).alias("before")).mapInArrow(_slots(slots, share, blocks, seed), "shard long, slot int, sid int, block long")
    # both sides grow with the data: never broadcast one, however well it compresses
    return places.hint("merge").join(whole, ["sid", "block"]).join(sources, "sid").select("shard", "slot", F.col("known").alias("source"), "block", "n_tokens", "lang", "text")


def mixed_documents(docs: DataFrame, *, slots: int = SLOTS, **kw) -> DataFrame:
    """The mix as documents (doc_id, text, lang, source, n_chars): a row for each slot, numbered through the shards."""
    out = mix_sources(docs, slots=slots, **kw)
    return out.select((F.col("shard") * slots + F.col("slot")).alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
