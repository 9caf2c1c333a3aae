"""Filtering of the files relation, and secret scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charset, secrets
from ..functions.paths import allowed
from ..options import ScanOptions
from ..sources.ignore import IgnoreRule, ignored
from .lines import lines


def keep(files: DataFrame, options: ScanOptions | None = None, rules: Sequence[IgnoreRule] = ()) -> DataFrame:
    """The entries that a scan keeps; with skip_binary (which needs content) without binary files."""
    options = options or ScanOptions()
    out = files.where(allowed(F.col("rel_path"), F.col("is_dir"), options, (lambda p: ignored(p, rules)) if rules else None))
    if options.skip_binary and "content" in files.columns:
        out = out.where(F.col("is_dir") | ~charset.is_binary(F.col("content")))
    return out


def keep_only(files: DataFrame, allowed_paths: DataFrame) -> DataFrame:
    """The entries whose path is in a table of paths."""
    return files.join(allowed_paths.select(F.col("path").alias("__allowed")), F.col("path") == F.col("__allowed"), "left_semi")


def scan_secrets(files: DataFrame, rules: secrets.SecretRules = secrets.DEFAULT, *, text: str = "text", path: str = "rel_path") -> DataFrame:
    """(file, line, text, pattern) of each line with a secret: the first rule that matches, none on allowed lines."""
    found = lines(files, text=text, path=path, scanner=True).select("path", "line_no", "line", F.explode(F.array(secrets.matched_pattern(F.col("line"), rules))).alias("pattern"))  # matched once: no filter goes below a generator
    return found.where("pattern is not null").select(F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("line").alias("text"), "pattern")
