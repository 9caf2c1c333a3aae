"""The lines relation, and searches in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import to_java
from ..functions.paths import parts
from ..functions.text import raw_lines, scanned_lines


def lines(files: DataFrame, *, text: str = "text", path: str = "rel_path", scanner: bool = False) -> DataFrame:
    """(path, parts, line_no, line) of each text, numbered from 1; every raw line, or as a line scanner reads."""
    cut = (scanned_lines if scanner else raw_lines)(F.col(text))
    return files.select(F.col(path).alias("path"), F.posexplode(cut).alias("pos", "line")).select("path", parts(F.col("path")).alias("parts"), (F.col("pos") + 1).alias("line_no"), "line")


def matches(line: Column, query: str, is_regex: bool = False) -> Column:
    return line.rlike(to_java(query)) if is_regex else F.contains(line, F.lit(query))


def search(files: DataFrame, query: str, *, is_regex: bool = False, max_results: int | None = 100, text: str = "text", path: str = "rel_path") -> DataFrame:
    """(path, line_no, line) of the lines that match, in the order of a walk; the first max_results, or all.

    Texts without any match are dropped before they are cut into lines.
    """
    some = files.where(F.contains(F.col(text), F.lit(query))) if not is_regex and "\n" not in query else files
    found = lines(some, text=text, path=path).where(matches(F.col("line"), query, is_regex))
    out = found
    if max_results is not None:
        out = found.orderBy("parts", "line_no").limit(max(0, max_results))
    return out.select("path", "line_no", "line")


def search_report(hits: DataFrame) -> DataFrame:
    """(path, line_no, hit) with hit as path:number:line."""
    return hits.select("path", "line_no", F.concat_ws(":", "path", F.col("line_no").cast("string"), "line").alias("hit"))
