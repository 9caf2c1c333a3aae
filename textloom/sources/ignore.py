"""Layered ignore rules: compiled on the driver (rules are few), matched as one column expression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, parent
from ..functions.text import raw_lines

#: Of the rule files in a directory, the first of these names counts.
RULE_FILES = (".gitignore", ".corpusignore")


@dataclass(frozen=True)
class IgnoreRule:
    raw: str
    directory: str  # relative to the root, '' for the root itself
    line_no: int
    regex: str
    negate: bool
    anchored: bool


_GLOBS = ((r"/\*\*/", "(?:/[^/]*)*/"), (r"\*\*/", "(?:.*/)?"), (r"/\*\*", "(?:/.*)?"), (r"\*\*", ".*"), (r"\*", "[^/]*"), (r"\?", "[^/]"))


def _quoted(text: str) -> str:
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", text)


def unescape(line: str) -> str:
    line = line.replace("\\\\", "\\").replace("\\ ", " ")
    return line[1:] if line.startswith(("\\!", "\\#")) else line


def glob_regex(pattern: str, directory: str, anchored: bool) -> str:
    """The regular expression of a glob, on paths relative to the root. There are no character classes."""
    out = _quoted(pattern)
    for glob, regex in _GLOBS:
        out = out.replace(glob, regex)
    if not anchored:
        return rf"(^|/){out}(/|\z)"
    return rf"^{_quoted(directory) + '/' if directory else ''}{out}(/|\z)"


def compile_line(raw: str, directory: str = "", line_no: int = 1) -> IgnoreRule | None:
    """The rule of a line; None for blank lines and comments."""
    line = raw.rstrip("\r").strip()
    if not line or line.startswith("#"):
        return None
    negate = line.startswith("!") and not raw.startswith(("\\!", "\\#"))
    line = unescape(line[1:] if negate else line)
    anchored = line.startswith("/")
    line = line[1:] if anchored else line
    if line.endswith("/"):
        line += "**"
    return IgnoreRule(raw, directory, line_no, glob_regex(line, directory, anchored), negate, anchored)


def compile_lines(lines: Iterable[str], directory: str = "", first: int = 1) -> list[IgnoreRule]:
    found = (compile_line(x, directory, n) for n, x in enumerate(lines, first))
    return [r for r in found if r]


def _applies(path: Column, rule: IgnoreRule) -> Column:
    hit = path.rlike("(?d)" + rule.regex)
    return hit if not rule.directory else (path.startswith(rule.directory + "/") | (path == rule.directory)) & hit


def ignored(path: Column, rules: Sequence[IgnoreRule]) -> Column:
    """Whether the last rule that applies ignores a path."""
    if not rules:
        return F.lit(False)
    return F.coalesce(*[F.when(_applies(path, r), F.lit(not r.negate)) for r in reversed(rules)], F.lit(False))


def ignored_by(path: Column, rules: Sequence[IgnoreRule]) -> Column:
    """STRUCT(raw, directory, line_no) of the rule that decided; null if none did.

    A negated rule decides only if a path was ignored before it.
    """
    kind = "struct<raw:string,directory:string,line_no:int>"
    out = F.lit(None).cast(kind)
    was = F.lit(False)
    for r in rules:
        hit = _applies(path, r)
        decides = hit & was if r.negate else hit
        out = F.when(decides, F.struct(F.lit(r.raw).alias("raw"), F.lit(r.directory).alias("directory"), F.lit(r.line_no).alias("line_no")).cast(kind)).otherwise(out)
        was = F.when(hit, F.lit(not r.negate)).otherwise(was)
    return out


def rules_table(spark: SparkSession, rules: Sequence[IgnoreRule]) -> DataFrame:
    return spark.createDataFrame([(i, r.directory, r.line_no, r.raw, r.regex, r.negate, r.anchored) for i, r in enumerate(rules)], "seq int, directory string, line_no int, raw string, regex string, negate boolean, anchored boolean")


def discover(files: DataFrame, *, names: Sequence[str] = RULE_FILES, extra: Sequence[Iterable[str]] = (), text: str = "text") -> list[IgnoreRule]:
    """The rules of a files relation: in each directory the first rule file by name, from the root down; extra files last."""
    found = files.where(~F.col("is_dir") & base_name(F.col("rel_path")).isin(*names)).select(parent(F.col("rel_path")).alias("d"), base_name(F.col("rel_path")).alias("n"), F.posexplode(raw_lines(F.col(text))).alias("no", "line"))
    by_dir: dict[str, dict[str, list[tuple[int, str]]]] = {}
    for r in found.collect():  # rule files only
        by_dir.setdefault(r["d"], {}).setdefault(r["n"], []).append((r["no"] + 1, r["line"]))
    out: list[IgnoreRule] = []
    for d in sorted(by_dir, key=lambda x: x.split("/") if x else []):
        chosen = next(by_dir[d][n] for n in names if n in by_dir[d])
        out += [r for no, line in sorted(chosen) if (r := compile_line(line, d, no))]
    for lines in extra:
        out += compile_lines(lines)
    return out
