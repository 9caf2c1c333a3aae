"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into words by the tokenizer's pattern; within a word, a segment tree holds for each position the rank of
the pair that starts there, and its root yields the leftmost pair of lowest rank. A merge changes three leaves, each a
logarithmic update, and the next root is read, until no pair can be merged. Words that a task meets for the first time
are merged together: one array holds the trees of all words of a size class, and every step advances all of them. Few
or long words use the same tree one by one. Results per word are remembered in the worker, within bounds.

Distribution. Row by row, no shuffle. The vocabulary is read once on the driver and broadcast; its size is that of the
vocabulary file and doesn't grow with the data.

Defined results. A null text gives null, an empty one an empty list; decoding a null list gives null, an empty one an
empty text; a null or unknown id within a list makes the decoded text null; bytes that aren't UTF-8 decode to U+FFFD.
Encoding is exact for every text, however long; decoding it gives the text back. Rows are independent, so ties and
repeated rows need no rule. Other columns are carried; the output column replaces one of the same name.
"""

from __future__ import annotations

import base64
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, prepare, remembered

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Where byte-level tokenizers of this family cut words; white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.int64(1) << 62
CHUNK_CHARS, CACHE_WORDS, CACHE_IDS = 1 << 18, 200_000, 2_000_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Token bytes by id, and the rank of every pair of tokens that makes a token."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.encoders: dict[str, Encoder] = {}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it can't be merged."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)


def merge_one(word: bytes, v: Vocabulary) -> list[int]:
    """One word's ids, by its own segment tree."""
    ids = v.byte[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    if n < 2:
        return ids
    leaves = 1 << (n - 1).bit_length()
    none, ranks, tokens = int(NONE), v.ranks, v.tokens
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        r = ranks.get(tokens[ids[i]] + tokens[ids[i + 1]])
        if r is not None:
            tree[leaves + i] = r * leaves + i  # least rank first, then leftmost
    for x in range(leaves - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def put(i: int, key: int) -> None:
        x = leaves + i
        tree[x] = key
        while x > 1:
            x >>= 1
            low = min(tree[2 * x], tree[2 * x + 1])
            if tree[x] == low:
                break
            tree[x] = low

    while (root := tree[1]) != none:
        rank, i = divmod(root, leaves)
        j = after[i]
        k = after[j]
        ids[i], after[i], alive[j] = rank, k, False
        put(j, none)
        r = None
        if k < n:
            before[k] = i
            r = ranks.get(tokens[rank] + tokens[ids[k]])
        put(i, none if r is None else r * leaves + i)
        if (p := before[i]) >= 0:
            r = ranks.get(tokens[ids[p]] + tokens[rank])
            put(p, none if r is None else r * leaves + p)
    return [t for t, a in zip(ids, alive, strict=True) if a]


def merge_many(words: list[bytes], leaves: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per word) of words of 2 to ``leaves`` bytes: one segment tree a row, all rows a step at a time."""
    count = len(words)
    lens = np.fromiter(map(len, words), np.int64, count)
    flat = v.byte[np.frombuffer(b"".join(words), np.uint8)]
    alive = np.arange(leaves) < lens[:, None]
    ids = np.zeros((count, leaves), np.int64)
    ids[alive] = flat
    tree = np.full((count, 2 * leaves), NONE)
    ranks = v.pair_ranks(ids[:, :-1], ids[:, 1:])
    ranks[~alive[:, 1:]] = NONE
    place = np.arange(leaves - 1)
    tree[:, leaves:-1] = np.where(ranks < NONE, ranks * leaves + place, NONE)
    level = leaves
    while level > 1:
        half = level // 2
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
        level = half
    after = np.broadcast_to(np.arange(1, leaves + 1), (count, leaves)).copy()
    before = np.broadcast_to(np.arange(-1, leaves - 1), (count, leaves)).copy()
    row = np.flatnonzero(tree[:, 1] < NONE)
    while len(row):
        root = tree[row, 1]
        rank, i = root // leaves, root % leaves
        j = after[row, i]
        k = after[row, j]
        p = before[row, i]
        ids[row, i] = rank
        after[row, i] = k
        alive[row, j] = False
        has_k, has_p = k < lens[row], p >= 0
        rk, kk = row[has_k], k[has_k]
        before[rk, kk] = i[has_k]
        key_i = np.full(len(row), NONE)
        r = v.pair_ranks(rank[has_k], ids[rk, kk])
        key_i[has_k] = np.where(r < NONE, r * leaves + i[has_k], NONE)
        rp, pp = row[has_p], p[has_p]
        r = v.pair_ranks(ids[rp, pp], rank[has_p])
        where = np.concatenate((row, row, rp))
        x = np.concatenate((j, i, pp)) + leaves
        tree[where, x] = np.concatenate((np.full(len(row), NONE), key_i, np.where(r < NONE, r * leaves + pp, NONE)))
        for _ in range(leaves.bit_length() - 1):
            x >>= 1
            tree[where, x] = np.minimum(tree[where, 2 * x], tree[where, 2 * x + 1])
        row = row[tree[row, 1] < NONE]
    return ids[alive], alive.sum(1)


class Encoder:
    """Texts to ids; words met before are looked up."""

    def __init__(self, v: Vocabulary, pattern: str = PATTERN):
        self.v, self.find = v, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, words: list[str]) -> None:
        """Append the ids of new words."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        lens, parts = np.ones(len(raw), np.int64), {}
        classes = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        for leaves in np.unique(classes).tolist():
            own = np.flatnonzero(classes == leaves)
            if len(own) < 48 or leaves > 512:
                got = [merge_one(raw[x], self.v) for x in own.tolist()]
                parts[leaves] = np.array([t for g in got for t in g], np.int64)
                lens[own] = [len(g) for g in got]
            else:
                parts[leaves], lens[own] = merge_many([raw[x] for x in own.tolist()], leaves, self.v)
        first = len(self.index) - len(words)
        total, end = int(lens.sum()), self.used + int(lens.sum())
        while end > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while first + len(words) > len(self.begin):
            self.begin, self.lens = np.concatenate((self.begin, np.zeros_like(self.begin))), np.concatenate((self.lens, np.zeros_like(self.lens)))
        begin = self.used + np.cumsum(lens) - lens
        self.begin[first : first + len(words)], self.lens[first : first + len(words)] = begin, lens
        for leaves, part in parts.items():
            own = classes == leaves
            self.flat[ragged(begin[own], lens[own])] = part
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        ids, counts, a = [], [], 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and (b == a or chars + len(texts[b]) <= CHUNK_CHARS):
                chars += len(texts[b])
                b += 1
            if len(self.index) > CACHE_WORDS or self.used > CACHE_IDS:
                self.forget()
            words = [self.find(t) for t in texts[a:b]]
            known, index = len(self.index), self.index
            codes = np.array([index.setdefault(w, len(index)) for ws in words for w in ws], np.int64)
            if len(index) > known:
                new = []
                for w in reversed(index):  # the latest come first
                    if len(new) == len(index) - known:
                        break
                    new.append(w)
                self.learn(new[::-1])
            lens = self.lens[codes]
            ids.append(self.flat[ragged(self.begin[codes], lens)])
            per = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(per)]
            counts.append(np.diff(ends, prepend=0))
            a = b
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def ragged(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each run of lens."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - (ends - lens), lens)


def vocabulary(ranks_file: bytes) -> Vocabulary:
    return remembered(("bpe", hash(ranks_file)), lambda: Vocabulary(ranks_file))


def encoder(ranks_file: bytes, pattern: str) -> Encoder:
    """The worker's encoder: later tasks use what earlier ones learnt."""
    v = vocabulary(ranks_file)
    if pattern not in v.encoders:
        v.encoders[pattern] = Encoder(v, pattern)
    return v.encoders[pattern]


def _lists(values: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=pa.array(null))


def encode(spark: SparkSession, text: Column, *, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """A column of token ids (array<int>) of a column of texts."""
    prepare(spark)
    shared: Any = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        null = np.asarray(texts.is_null())
        ids, counts = encoder(shared.value, pattern).encode(texts.drop_null().to_pylist())
        full = np.zeros(len(texts), np.int64)
        full[~null] = counts
        give_back()
        return _lists(ids, full, null)

    return run(text)


def decode(spark: SparkSession, ids: Column, *, path: str = VOCABULARY) -> Column:
    """The texts of a column of token ids."""
    prepare(spark)
    shared: Any = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf(T.StringType())
    def run(lists: pa.Array) -> pa.Array:
        tokens = vocabulary(shared.value).tokens
        size = len(tokens)
        out: list[str | None] = []
        for x in range(len(lists)):
            ids = lists[x].values
            if ids is None or ids.null_count:
                out.append(None)
                continue
            ids = ids.to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= size):
                out.append(None)
                continue
            try:
                out.append(b"".join(map(tokens.__getitem__, ids.tolist())).decode(errors="replace"))
            except TypeError:  # an id that the vocabulary leaves free
                out.append(None)
        return pa.array(out, pa.string())

    return run(ids)


CHECKED = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])


def encode_checked(spark: SparkSession, text: Column, *, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """A struct of a text's token ids and whether decoding them gives the text back; of null, null ids and true.

    One function does both: as a chain of two, Spark would run the encoding twice.
    """
    prepare(spark)
    shared: Any = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf(CHECKED)
    def run(texts: pa.Array) -> pa.Array:
        null = np.asarray(texts.is_null())
        some = texts.drop_null().to_pylist()
        ids, counts = encoder(shared.value, pattern).encode(some)
        tokens = vocabulary(shared.value).tokens
        full, same, a = np.zeros(len(texts), np.int64), np.ones(len(texts), bool), 0
        full[~null] = counts
        back = []
        for t, n in zip(some, counts.tolist(), strict=True):
            back.append(b"".join(map(tokens.__getitem__, ids[a : a + n].tolist())).decode(errors="replace") == t)
            a += n
        same[~null] = back
        give_back()
        return pa.StructArray.from_arrays([_lists(ids, full, null), pa.array(same)], names=["token_ids", "round_trip"])

    return run(text)


def bpe_round_trip(docs: DataFrame, *, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): each text's ids, and whether decoding them gives the text back."""
    out = docs.select("doc_id", encode_checked(docs.sparkSession, F.col("text"), path=path, pattern=pattern).alias("__r"))
    return out.select("doc_id", F.when(F.col("__r.token_ids").isNotNull(), F.size("__r.token_ids")).alias("n_tokens"), "__r.token_ids", "__r.round_trip")
