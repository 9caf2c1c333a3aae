"""What the operators of this subpackage share: row identity, shared storage, words, grouped batches, components.

Row identity. A document is named by ``(doc_id, xxhash64(text))``: rows that repeat both are one document and
always get the same decision; rows that share only the doc_id stay apart.

Column names. Whatever an operator needs is first selected under a name that starts with ``__``; the caller's other
columns are never read by name, so extra columns may have any name.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space (what ``bytes.split()`` cuts at).
WORD = r"[^ \t\n\r\f\x0B]+"
#: Rows of a checked side up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 400_000


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, as texts may be long and a worker holds one batch at a time. Lasts for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


_held: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gives, kept in the worker for later tasks until another key is asked for: one model at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Hand freed memory back to the system: waiting workers share the executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, which spark.checkpoint.dir names.

    Without one in the session, as in tests, a folder below the warehouse, but only if everything runs in one process;
    on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Whether Spark deletes the shuffle files of a query when it ends, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, into: list[str] | None = None, by: str | None = None) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage, and survives the loss of any executor.

    into: gets the table's path, for dropped() once what was made from it is written too. by: a column for folders.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    while paths:
        delete(spark, paths.pop())


def text_hash(text: Column | str = "text") -> Column:
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def keyed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(__id, __th, __text) of the rows that have a text."""
    return docs.select(F.col(doc_id).cast("long").alias("__id"), text_hash(text).alias("__th"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())


def sized(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small with a broadcast hint if it was counted to have few rows (it should be a written table)."""
    return F.broadcast(small) if (small.count() if rows is None else rows) <= BROADCAST_ROWS else small


#: Most rows of the bitmap that sieve() broadcasts, 4 KB each, and the bits of one.
SIEVE_ROWS, SIEVE_BITS = 4096, 32_768


def sieve(rows: DataFrame, hashed: str, keys: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose 64-bit hash may be among the n keys, and those whose hash surely isn't there.

    By a bitmap of 16 MB at most, so that a join need not shuffle all rows, which may hold long texts.
    """
    size = min(SIEVE_ROWS, 1 << (n // 1024).bit_length())
    bits = keys.groupBy(F.pmod(F.shiftright(key, 15), F.lit(size)).alias("__part")).agg(F.bitmap_construct_agg(F.pmod(key, F.lit(SIEVE_BITS))).alias("__bits"))
    place = F.pmod(hashed, F.lit(SIEVE_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << x) for x in range(8))), place % 8 + 1)) > 0, F.lit(False))
    tested = rows.join(F.broadcast(bits), F.pmod(F.shiftright(hashed, 15), F.lit(size)) == F.col("__part"), "left").withColumn("__known", known)
    return tuple(tested.where(F.col("__known") == x).select(*rows.columns) for x in (True, False))


def looked_up(rows: DataFrame, hashed: str, keys: DataFrame, key: str, on: Column, how: str, few: int | None = None) -> DataFrame:
    """rows joined with keys (a written table), on what implies hashed = key; only rows that may find a key are shuffled.

    few: keys up to which they are broadcast instead.
    """
    n = keys.count()
    if n <= (BROADCAST_ROWS if few is None else few):
        return rows.join(F.broadcast(keys), on, how)
    maybe, rest = sieve(rows, hashed, keys, key, n)
    found = maybe.join(keys, on, how)
    return found if how in ("inner", "left_semi") else found.unionByName(rest, allowMissingColumns=how == "left")


class WordHash(dict):
    """64-bit hash of a word, remembered; the memory is bounded, forgetting is harmless."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes; with fewer than n words, one hash of them all."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    size = len(hashes) - n + 1
    out = np.full(size, np.uint64(n))
    for i in range(n):
        out = (out ^ hashes[i : i + size]) * _MUL
        out ^= out >> _SHIFT
    return out


def bundles(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole groups of a sorted stream, many at once: a table and the bounds of its groups. A group is held whole."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in range(keys))

    def cut(table: pa.Table) -> tuple[pa.Table, list[int]]:
        change = np.zeros(len(table), bool)
        for k in range(keys):
            codes = table.column(k).combine_chunks().dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            c = np.asarray(codes.indices.fill_null(-1))
            change[1:] |= c[1:] != c[:-1]
        return table, [0, *np.flatnonzero(change).tolist(), len(table)]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if last is not None and key(batch, 0) != last:
            yield cut(pa.Table.from_batches(held))
            held = []
        first, end = key(batch, 0), key(batch, n - 1)
        if first != end:
            lo, hi = 0, n - 1  # the last group's start: the stream is sorted, so bisect
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if key(batch, mid) == end else (mid + 1, hi)
            held.append(batch.slice(0, lo))
            yield cut(pa.Table.from_batches(held))
            held = [batch.slice(lo)]
        else:
            held.append(batch)
        last = end
    if held:
        yield cut(pa.Table.from_batches(held))


def joined(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """up (each item's least fellow, itself a fellow of its own) after joining items i with items j."""
    while len(i):
        a, b = up[i], up[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        to = up.copy()
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        up = to[up]
    return up


#: Edges up to which the driver joins them; beyond, rounds of joins do.
DRIVER_EDGES = 400_000


def components(edges: DataFrame, a: str, b: str, into: list[str] | None = None) -> DataFrame:
    """(__node, __root) of an undirected graph, __root the least node of each component.

    Edges with a null end are left out. Few edges, as counted, are joined on the driver. More go through alternating
    stars: in each round every node hands its neighbours the least node it knows, by aggregation and join, so that no
    task holds a node's neighbours; rounds grow with the logarithm of the longest path and are written, and dropped
    after the next. into: gets the paths of tables that the result reads.
    """
    spark, kept = edges.sparkSession, []
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = written(e, "edges", kept)
    kind = e.schema["u"].dataType.simpleString()
    if e.count() <= DRIVER_EDGES:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        table = e.toArrow()
        dropped(spark, kept)
        for u, v in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        of = pa.from_numpy_dtype(np.int64) if kind == "bigint" else table.schema.field(0).type
        found = pa.table({"__node": pa.array(nodes, of), "__root": pa.array([root(x) for x in nodes], of)})
        return spark.createDataFrame(found) if nodes else spark.createDataFrame([], f"__node {kind}, __root {kind}")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = large.join(low, "u")
        small = ends.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, kept = kept, []
        small = written(small, "edges", kept)
        dropped(spark, last)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = small
        if tuple(now) == seen:
            break
        seen = tuple(now)
    if into is not None:
        into += kept
    return e.select(F.col("u").alias("__node"), F.col("v").alias("__root")).union(e.select(F.col("v"), F.col("v")).distinct())
