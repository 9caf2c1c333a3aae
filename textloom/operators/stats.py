"""Statistics of a files relation, and single files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import language_of
from ..functions.text import newline_token


def counts(files: DataFrame) -> DataFrame:
    """(kind, key, n, bytes): totals, and files by language and by extension, in one aggregation over grouping sets.

    An empty relation has no rows.
    """
    f = files.select("is_dir", "size", language_of(F.col("rel_path")).alias("language"), "ext")
    grouped = f.groupingSets([[], [F.col("is_dir"), F.col("language")], [F.col("is_dir"), F.col("ext")]], "is_dir", "language", "ext").agg(
        F.grouping_id().alias("g"), F.count_if(~f["is_dir"]).alias("files"), F.count_if(f["is_dir"]).alias("dirs"), F.coalesce(F.sum(F.when(~f["is_dir"], f["size"])), F.lit(0)).alias("bytes")
    )
    total = F.array(F.struct(F.lit("files").alias("kind"), F.lit("").alias("key"), F.col("files").alias("n"), F.col("bytes").alias("bytes")), F.struct(F.lit("directories").alias("kind"), F.lit("").alias("key"), F.col("dirs").alias("n"), F.lit(0).cast("long").alias("bytes")))
    one = lambda kind, key: F.array(F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col("files").alias("n"), F.col("bytes").alias("bytes")))
    rows = grouped.select(F.explode(F.when(F.col("g") == 7, total).when(F.col("g") == 1, one("language", "language")).otherwise(one("extension", "ext"))).alias("r")).select("r.*")
    return rows.where("kind in ('files', 'directories') or (key <> '' and n > 0)")


def project_stats(files: DataFrame) -> DataFrame:
    """One row: total_files, total_directories, total_size, and the counts by language and by extension as maps."""
    c = counts(files)

    def table(kind: str):
        return F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n"))), lambda x: x.isNotNull())))

    def total(kind: str, of: str):
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(of))), F.lit(0))

    return c.agg(
        total("files", "n").alias("total_files"), total("directories", "n").alias("total_directories"), total("files", "bytes").alias("total_size"),
        table("language").alias("language_stats"), table("extension").alias("extension_stats"),
    )


def file_info(files: DataFrame) -> DataFrame:
    """(path, size, mod_time, is_dir, language, extension, basename) of every entry."""
    time = F.date_format("mod_time", "yyyy-MM-dd'T'HH:mm:ssXXX") if "mod_time" in files.columns else F.lit(None).cast("string")
    return files.select(F.col("rel_path").alias("path"), "size", time.alias("mod_time"), "is_dir", language_of(F.col("rel_path")).alias("language"), F.col("ext").alias("extension"), F.col("name").alias("basename"))


def by_list(spark: SparkSession, files: DataFrame, paths: Sequence[str], *, max_files: int | None = 10, text: str = "text", root: str = "") -> DataFrame:
    """(pos, path, body) of the listed files in the list's order; an error for those that aren't there."""
    wanted = spark.createDataFrame([(i, p) for i, p in enumerate(paths) if max_files is None or i < max_files], "pos int, path string")
    there = files.where(~F.col("is_dir")).select(F.col("rel_path").alias("__path"), F.col(text).alias("__text"))
    joined = wanted.join(there, F.col("path") == F.col("__path"), "left")
    return joined.select("pos", "path", F.coalesce(newline_token(F.col("__text")), F.concat(F.lit("Error: no such file: "), F.lit(root), F.col("path"))).alias("body"))
