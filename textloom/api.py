"""The seven tools, each over a directory tree: functions that return DataFrames (or, for trees, ordered pieces)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import charset, secrets
from .functions.language import language_of
from .functions.paths import order_key
from .functions.text import numbered, strip_comments
from .operators import lines, scan, stats
from .options import ScanOptions, trim_dot_slash
from .plans import dumps, tree
from .sources.files import list_files, with_content
from .sources.ignore import RULE_FILES, IgnoreRule, discover


def _inside(path: str) -> str:
    path = trim_dot_slash(path).strip("/")
    if ".." in path.split("/"):
        raise ValueError(f"outside the root: {path}")
    return path


def listed(spark: SparkSession, root: str, path: str = "") -> DataFrame:
    below = _inside(path)
    return list_files(spark, f"{root}/{below}" if below else root)


def rules_of(files: DataFrame, names: Sequence[str] = RULE_FILES, extra: Sequence[Sequence[str]] = ()) -> list[IgnoreRule]:
    """The ignore rules that a listing's own rule files hold."""
    found = with_content(files.where(F.col("name").isin(*names) & ~F.col("is_dir")))
    return discover(found.withColumn("text", F.col("content").cast("string")), names=names, extra=extra)


def _rules(files: DataFrame, rules: Sequence[IgnoreRule], use_ignore_files: bool) -> Sequence[IgnoreRule]:
    return [*rules, *rules_of(files)] if use_ignore_files else rules


def get_directory_tree(spark: SparkSession, root: str, path: str = "", *, options: ScanOptions | None = None, rules: Sequence[IgnoreRule] = (), as_json: bool = True) -> DataFrame:
    """(ord, token) of the JSON tree, or (rel_path, parts, line) of the text tree."""
    files = listed(spark, root, path)
    kept = scan.keep(files, options or ScanOptions(skip_git=True), rules)
    name = (_inside(path) or root.rstrip("/")).rpartition("/")[2]
    return tree.tree_json_rows(kept, root_name=name) if as_json else tree.tree_rows(files, kept)


def get_file_content(spark: SparkSession, root: str, path: str, *, mask_secrets: bool = True, delete_comments: bool = False, with_line_numbers: bool = True, skip_binary: bool = False) -> DataFrame:
    """(path, text) of one file; no row if it isn't there, or is binary and skip_binary is set."""
    where = _inside(path)
    head, _, name = where.rpartition("/")
    one = with_content(listed(spark, root, head).where((F.col("rel_path") == name) & ~F.col("is_dir")))
    if skip_binary:
        one = one.where(~charset.is_binary(F.col("content")))
    text = charset.decode(F.col("content"))
    if delete_comments:
        text = strip_comments(text, language_of(F.col("rel_path")))
    if mask_secrets:
        text = secrets.mask_all(text)
    if with_line_numbers:
        text = numbered(text)
    return one.select(F.lit(where).alias("path"), text.alias("text"))


def list_tree_files(spark: SparkSession, root: str, path: str = "", *, options: ScanOptions | None = None, rules: Sequence[IgnoreRule] = (), use_ignore_files: bool = False) -> DataFrame:
    """(path) of the files that the options keep, in the order of a walk."""
    options, files = options or ScanOptions(), listed(spark, root, path)
    kept = scan.keep(files, options, _rules(files, rules, use_ignore_files)).where(~F.col("is_dir"))
    if options.skip_binary:
        kept = with_content(kept).where(~charset.is_binary(F.col("content")))
    return kept.orderBy(order_key(F.col("rel_path"), options.case_insensitive_order), "parts").select(F.col("rel_path").alias("path"))


def search_in_files(spark: SparkSession, root: str, query: str, path: str = "", *, is_regex: bool = False, max_results: int = 100, options: ScanOptions | None = None, rules: Sequence[IgnoreRule] = (), use_ignore_files: bool = False) -> DataFrame:
    """(path, line_no, line) of the first matches in the order of a walk; binary files aren't searched."""
    files = listed(spark, root, path)
    kept = with_content(scan.keep(files, options, _rules(files, rules, use_ignore_files)).where(~F.col("is_dir")))
    some = kept.where(~charset.is_binary(F.col("content"))).withColumn("text", F.col("content").cast("string"))
    return lines.search(some, query, is_regex=is_regex, max_results=max_results)


def get_file_info(spark: SparkSession, root: str, path: str) -> DataFrame:
    where = _inside(path)
    head, _, name = where.rpartition("/")
    return stats.file_info(listed(spark, root, head).where(F.col("rel_path") == name)).withColumn("path", F.lit(where))


def get_project_stats(spark: SparkSession, root: str, path: str = "", *, options: ScanOptions | None = None, rules: Sequence[IgnoreRule] = (), use_ignore_files: bool = False) -> DataFrame:
    files = listed(spark, root, path)
    return stats.project_stats(scan.keep(files, options, _rules(files, rules, use_ignore_files)))


def as_json(rows: DataFrame) -> DataFrame:
    """(json) of each row, in several indented lines, as statistics and file information are shown."""
    return rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def scan_directory(spark: SparkSession, root: str, path: str = "", *, options: ScanOptions | None = None, rules: Sequence[IgnoreRule] = (), secret_rules: secrets.SecretRules = secrets.DEFAULT) -> DataFrame:
    """(file, line, text, pattern) of the secrets in a directory's files; files that don't look like text are left out."""
    kept = with_content(scan.keep(listed(spark, root, path), options, rules).where(~F.col("is_dir")))
    some = kept.where(charset.looks_like_text(F.col("content"))).withColumn("text", F.col("content").cast("string"))
    return scan.scan_secrets(some, secret_rules)


DUMPS = {"txt": dumps.dump_text, "md": dumps.dump_markdown, "xml": dumps.dump_xml, "compact": dumps.dump_compact}


def dump_directory(spark: SparkSession, root: str, fmt: str = "txt", *, options: ScanOptions | None = None, rules: Sequence[IgnoreRule] = (), use_ignore_files: bool = True, **how) -> DataFrame:
    """The ordered chunks of a dump of a directory: what write_dump puts into one file. how: what the format's dump takes."""
    if fmt not in DUMPS:
        raise ValueError(f"no dump format: {fmt!r}; there are {', '.join(DUMPS)}")
    files = listed(spark, root)
    kept = scan.keep(files, options or ScanOptions(skip_git=True), _rules(files, rules, use_ignore_files))
    return DUMPS[fmt](files, with_content(kept), root=root, name=root.rstrip("/").rpartition("/")[2], **how)


def get_files_compact(spark: SparkSession, root: str, paths: Sequence[str], *, mask_secrets: bool = True, delete_comments: bool = False, max_files: int = 10) -> DataFrame:
    """(ord, chunk): the listed files in the list's order, an error for each that can't be read."""
    wanted = [_inside(p) for p in paths]
    files = list_files(spark, root).where(F.col("rel_path").isin(*wanted[:max_files]) & ~F.col("is_dir"))
    text = charset.decode(F.col("content"))
    if delete_comments:
        text = strip_comments(text, language_of(F.col("rel_path")))
    if mask_secrets:
        text = secrets.mask_all(text)
    bodies = stats.by_list(spark, with_content(files).withColumn("text", text), wanted, max_files=max_files)
    return dumps.multi_file_compact(bodies, wanted[0].rpartition("/")[0] or "." if wanted else "Multiple Files")


def read_resource(spark: SparkSession, root: str, uri: str) -> DataFrame:
    """file://PATH is the file's content as it is, directory://PATH the JSON tree."""
    kind, _, path = uri.partition("://")
    if kind == "file":
        return get_file_content(spark, root, path, mask_secrets=False, with_line_numbers=False)
    if kind == "directory":
        return get_directory_tree(spark, root, path)
    raise ValueError(f"unknown resource: {uri}")
