"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words (cut at ASCII white space, compared as they are). Windows that occur more than
once keep their first occurrence, in the order (doc_id, hash of the text, position), null doc_ids last; a word that
any later occurrence covers is removed together with the white space after it. A text that repeats itself with a
short period keeps one period.

Distribution. The minimiser of a window is the leftmost least hash of its GRAM-word grams; consecutive windows with
the same minimiser position form a super-k-mer. Equal windows have it at the same place, so it is cut in two: windows
that begin at least half of the other words before the minimiser share all those words and it, the others share at
least as many words after it. The hash of these words, some 30 of a window's 50, is the part's key, and it travels as
one packed string to its key's bucket. A window that repeats has a key that repeats, so keys are counted first and only
parts of repeated ones travel; texts are shuffled only if a bitmap says that they hold such parts, or lose words. Of equal packed strings only the first can hold first occurrences; later ones are dropped where
they are met, before the shuffle already, so a passage that very many documents share stays small. Within a bucket
the windows are counted exactly, by sorting: ranks of words give ranks of 2, 4, ... and finally WINDOW words.

Hot keys. A phrase that very many different contexts surround makes a bucket that no task should hold. Windows of a key
with more than HOT parts go by their own 128-bit digests instead, one row each, and
are counted by aggregation and join, which split any group; so no bucket in a task has more than HOT packed strings.

Defined results. A null text stays null, texts below WINDOW words stay as they are. A null doc_id is a document like
any other, named by its text. Rows that repeat doc_id and text are one document: all get the same text. A document of
which nothing is left has an empty text (or its leading white space). Empty tables give empty results. Other columns
are carried and never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, bundles, dropped, give_back, keyed, looked_up, prepare, rolled, text_hash, written

WINDOW, GRAM, HOT = 50, 10, 50_000
_MUL, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
TOKEN = re.compile(rb"[^ \t\n\r\f\x0b]+[ \t\n\r\f\x0b]*")


def super_kmers(grams: np.ndarray, w: int, gram: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each run of windows of w grams whose leftmost least gram is the same one.

    gram: the words of a gram, to cut each run in two by the words that its windows share, with a key of these instead.
    """
    n = len(grams) - w + 1
    order = np.argsort(grams, kind="stable")
    x = np.empty(len(grams), np.int64)
    x[order] = np.arange(len(grams))  # places in the order of (hash, position)
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[:n], x[w - span : w - span + n])
    at = order[x]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    at, ends = at[starts], np.append(starts[1:], n)
    if gram is None:
        return grams[at], starts, ends - starts
    half = (w - 1) // 2
    cut = np.clip(at - half + 1, starts, ends)  # windows before it begin half words before the minimiser, or more
    out = []
    for a, b, lo, hi in ((starts, cut, -half, 0), (cut, ends, 0, w - half)):
        some = b > a
        key = np.zeros(int(some.sum()), np.uint64)
        for x in sorted({*range(lo, hi, gram), hi}):
            key = (key ^ grams[at[some] + x]) * _MUL
            key ^= key >> _SHIFT
        out.append((key, a[some], (b - a)[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _marks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            hs, starts, wins, row = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = text.encode().split()
                if len(words) >= window:
                    h, s, n = super_kmers(rolled(hashes.of(words), gram), window - gram + 1, gram)
                    hs.append(h)
                    starts.append(s)
                    wins.append(n)
                    row.append(np.full(len(h), i))
            if hs:
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(wins), pa.int32())], ["h", "__id", "__th", "start", "wins"])
        del hashes
        give_back()

    return run


PACKED = pa.schema([("h", pa.int64()), ("packed", pa.binary()), ("none", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _packed(window: int, most: int = 80_000):
    """Packed strings of the wanted super-k-mers; packed is null in rows that name a span already known to be a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            rows = []
            for i, th, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                words = text.encode().split()
                for s in wanted:
                    a, b = s["start"], s["start"] + s["wins"] + window - 1
                    packed, me = b" ".join(words[a:b]), (i is None, i or 0, th, a)
                    first = seen.get(packed)
                    if first is None or me <= first:
                        if len(seen) >= most:
                            seen.clear()
                        seen[packed] = me
                        rows.append((s["h"], packed, *me, b))
                    else:
                        rows.append((hash(me), None, *me, b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED)
        seen.clear()
        give_back()

    return run


def _windows(window: int):
    """The digest of each window of the wanted super-k-mers, and where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, th, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                words = text.encode().split()
                at = sorted({x for s in wanted for x in range(s["start"], s["start"] + s["wins"])})
                digests = [xxhash.xxh128_digest(b" ".join(words[x : x + window])) for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([i] * len(at), pa.int64()), pa.array([th] * len(at), pa.int64()), pa.array(at, pa.int32())], ["digest", "id", "th", "a"])

    return run


def repeated_windows(packed: list[bytes], order: list[np.ndarray], start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of the windows in packed strings that aren't the first of their kind, exactly.

    order: keys, most significant first, by which rows come before one another; start: their positions, which come next.
    """
    codes: dict[bytes, int] = {}
    words = [p.split() for p in packed]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((codes.setdefault(w, len(codes)) for ws in words for w in ws), np.int64, int(lens.sum()))
    begin = np.cumsum(lens) - lens
    rank, span = flat, 1
    while span * 2 <= window:  # rank[i]: of the span words from i on; beyond a row's end it may mix rows, and isn't used
        _, rank = np.unique(rank[:-span] * (rank.max() + 1) + rank[span:], return_inverse=True)
        span *= 2
    wins = lens - window + 1
    row = np.repeat(np.arange(len(words)), wins)
    off = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
    at = begin[row] + off
    key = rank[at] * (rank.max() + 1) + rank[at + window - span]
    by = np.lexsort((start[row] + off, *(k[row] for k in reversed(order)), key))
    later = np.concatenate(([False], key[by][1:] == key[by][:-1]))
    picked = np.sort(by[later])
    return row[picked], off[picked]


SPANS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(ids: list, ths: list, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], schema=SPANS)

        out: list[pa.RecordBatch] = []

        def firsts() -> Iterator[pa.RecordBatch]:
            """Rows that are the first of their packed string; the spans of the others go to out."""
            last = first = None
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("packed", "none", "id", "th", "a", "b")]
                known, old = np.zeros(batch.num_rows, bool), []
                for x, (p, none, *me, b) in enumerate(zip(*cols, strict=True)):
                    if p is not None and p != last:
                        last, first = p, (none, *me)
                        continue
                    known[x] = True
                    if p is None or (none, *me) != first:  # the same document's row again is no repeat
                        old.append((None if none else me[0], me[1], me[2], b))
                if old:
                    out.append(spans(*zip(*old, strict=True)))
                yield batch.filter(pa.array(~known))

        for table, _ in bundles(firsts(), 1):
            yield from out
            out.clear()
            none, ids, th, a = (table.column(c).to_numpy() for c in ("none", "id", "th", "a"))
            row, off = repeated_windows(table.column("packed").to_pylist(), [none, ids, th], a.astype(np.int64), window)
            if len(row):
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1))))
                end = np.append(new[1:], len(row)) - 1
                r = row[new]
                yield spans([None if none[x] else ids[x] for x in r], th[r].tolist(), a[r] + off[new], a[r] + off[end] + window)
        yield from out
        give_back()

    return run


def cut(text: str, spans: list) -> tuple[str, int]:
    """The text without the words that the spans (first, end) cover, and how many those are."""
    raw = text.encode()
    tokens = TOKEN.findall(raw)
    keep = np.ones(len(tokens), bool)
    for s in spans:
        keep[s["a"] : s["b"]] = False
    lead = raw[: len(raw) - sum(map(len, tokens))]
    return (lead + b"".join(t for t, k in zip(tokens, keep.tolist(), strict=True) if k)).decode(), int((~keep).sum())


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    got = [(None, 0) if t is None else cut(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([n for _, n in got], pa.int32())], names=["text", "removed"])


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, removed: str = "n_removed") -> DataFrame:
    """docs, all columns, with text replaced, and the number of words removed in a column of the name given."""
    gram, scratch = min(gram, window), []
    prepare(docs.sparkSession)
    base = keyed(docs)
    marks = written(base.mapInArrow(_marks(window, gram), "h long, __id long, __th long, start int, wins int"), "marks", scratch)
    counts = written(marks.groupBy("h").count().where("count > 1").select("h", (F.col("count") > hot).alias("hot")), "minimisers", scratch)

    def found(of: DataFrame) -> DataFrame:
        mine = looked_up(marks, "h", of.select(F.col("h").alias("__h")), "__h", F.col("h") == F.col("__h"), "left_semi")
        wanted = written(mine.groupBy(F.col("__id").alias("id"), F.col("__th").alias("th")).agg(F.collect_set(F.struct("start", "wins", "h")).alias("wanted")), "wanted", scratch)
        return looked_up(base, "__th", wanted, "th", F.col("__id").eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th")), "inner", 0).select("__id", "__th", "__text", "wanted")

    packed = found(counts.where("not hot")).mapInArrow(_packed(window), "h long, packed binary, none boolean, id long, th long, a int, b int")
    spans = packed.repartition("h").sortWithinPartitions("h", "packed", "none", "id", "th", "a").mapInArrow(_spans(window), "id long, th long, a int, b int")
    if not counts.where("hot").isEmpty():
        each = written(found(counts.where("hot")).mapInArrow(_windows(window), "digest binary, id long, th long, a int").distinct(), "windows", scratch)
        me = F.struct(F.col("id").isNull().alias("none"), "id", "th", "a")
        first = each.groupBy("digest").agg(F.min(me).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
        later = each.join(first, "digest").where(~me.eqNullSafe(F.col("first")))
        spans = spans.union(later.select("id", "th", "a", (F.col("a") + window).cast("int")))
    gone = written(spans.groupBy(F.col("id").alias("__gone_id"), F.col("th").alias("__gone_th")).agg(F.collect_set(F.struct("a", "b")).alias("__spans")), "spans")
    dropped(docs.sparkSession, scratch)
    mine = docs.select(F.struct("*").alias("__row"), text_hash("text").alias("__th"))
    fixed = looked_up(mine, "__th", gone, "__gone_th", F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__th") == F.col("__gone_th")), "left", 0)
    fixed = fixed.withColumn("__cut", _cut(F.when(F.col("__spans").isNotNull(), F.col("__row.text")), "__spans"))
    out = [F.when(F.col("__spans").isNotNull(), F.col("__cut.text")).otherwise(F.col("__row.text")).alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns if c != removed]
    return fixed.select(*out, F.coalesce("__cut.removed", F.lit(0)).alias(removed))


SQL = f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+[ \\t\\n\\r\\f\\v]*') AS toks, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS ws FROM documents),
n AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM t WHERE len(ws) >= {WINDOW}),
d AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + {WINDOW - 1}], ' ') ORDER BY doc_id, i) AS k FROM n),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM d WHERE k > 1) GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE regexp_extract(text, '^[ \\t\\n\\r\\f\\v]*') ||
  array_to_string(list_filter(toks, lambda x, i: NOT list_contains(gone, i)), '') END AS text, coalesce(len(gone), 0)::INTEGER AS n_removed
FROM t LEFT JOIN c USING (doc_id)
"""
