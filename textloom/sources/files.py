"""The files relation: from a directory tree, or from rows of a table as virtual files.

files(root, path, rel_path, parts, parent, name, ext, depth, is_dir, size, mod_time), and content where it was asked
for. Hidden, underscored and empty files are listed like all others; links are listed and not followed.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions.paths import ancestors, describe, parent

SCHEMA = "root string, path string, rel_path string, name string, ext string, is_dir boolean, size long, mod_time timestamp"


class _Part(InputPartition):
    def __init__(self, start: str, deep: bool):
        self.start, self.deep = start, deep


class FilesReader(DataSourceReader):
    """A partition for each directory of the first ``fan`` levels."""

    def __init__(self, root: str, fan: int = 2):
        self.root, self.fan, self.wanted = os.path.abspath(root), fan, {}
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"not a directory: {root}")

    def partitions(self):
        parts, level = [], [""]
        for _ in range(self.fan):
            below = []
            for d in level:
                parts.append(_Part(d, False))
                below += [posixpath.join(d, e.name) for e in _entries(os.path.join(self.root, d)) if e.is_dir(follow_symlinks=False)]
            level = below
        return parts + [_Part(d, True) for d in level]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        todo = [partition.start]
        while todo:
            here = todo.pop()
            for e in _entries(os.path.join(self.root, here)):
                rel, is_dir = posixpath.join(here, e.name), e.is_dir(follow_symlinks=False)
                if is_dir and partition.deep:
                    todo.append(rel)
                ext = "." + e.name.rpartition(".")[2] if "." in e.name else ""
                if all(v in s for v, k in ((e.name, "name"), (ext, "ext")) for s in self.wanted.get(k, ())):
                    st = e.stat(follow_symlinks=False)
                    rows.append((self.root, e.path, rel, e.name, ext, is_dir, 0 if is_dir else st.st_size, int(st.st_mtime * 1e6)))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), kinds, strict=True)], names=["root", "path", "rel_path", "name", "ext", "is_dir", "size", "mod_time"])


class PushingReader(FilesReader):
    """A reader that lists only what equality filters on name and ext want; Spark allows one only with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("name",), ("ext",)):
                self.wanted.setdefault(f.attribute[0], []).append({f.value})
            elif isinstance(f, In) and f.attribute in (("name",), ("ext",)):
                self.wanted.setdefault(f.attribute[0], []).append(set(f.value))
            else:
                yield f


def _entries(path: str) -> list[os.DirEntry]:
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except PermissionError:
        return []


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return (PushingReader if self.options.get("push") == "true" else FilesReader)(self.options["path"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The files relation of a directory tree (which every executor must see), without contents."""
    spark.dataSource.register(Files)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    listed = spark.read.format("textloom_files").option("path", root).option("push", push).load()
    return describe(listed).select("root", "path", "rel_path", "parts", "parent", "name", "ext", "depth", "is_dir", "size", "mod_time")


def with_content(files: DataFrame) -> DataFrame:
    """files with the bytes of each file; null for directories and for what can't be read. Filter first."""

    @F.arrow_udf("binary")
    def read(paths: pa.Array) -> pa.Array:
        out = []
        for p in paths.to_pylist():
            try:
                with open(p or "", "rb") as f:
                    out.append(f.read())
            except OSError:
                out.append(None)
        return pa.array(out, pa.binary())

    return files.withColumn("content", read(F.when(~F.col("is_dir"), F.col("path"))))


def virtual_files(rows: DataFrame, rel_path: Column, text: Column, root: str = "corpus") -> DataFrame:
    """The files relation of table rows: directories are those that the paths imply. Sizes are bytes of the text."""
    leaves = rows.select(rel_path.alias("rel_path"), text.alias("text")).where("rel_path is not null")
    files = leaves.select("rel_path", F.lit(False).alias("is_dir"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    dirs = leaves.select(parent(F.col("rel_path")).alias("leaf")).distinct().select(F.explode(F.concat(ancestors(F.concat("leaf", F.lit("/x"))))).alias("rel_path")).where("rel_path <> ''").distinct()
    dirs = dirs.select("rel_path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("text"))
    return describe(files.unionByName(dirs)).withColumns({"root": F.lit(root), "path": F.concat(F.lit(root + "/"), F.col("rel_path"))})
