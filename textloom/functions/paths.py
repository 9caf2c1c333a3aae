"""Columns of a path relative to its root, and the predicates of a scan on them.

All are expressions of the path alone. A row is kept only if every directory above it is, which is a forall over the
path's own prefixes: no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import ScanOptions
from .dialect import to_java

IMAGE_EXT = (".png", ".jpg", ".jpeg", ".jpe", ".gif", ".webp", ".bmp", ".ico", ".svg", ".svgz", ".tif", ".tiff", ".avif", ".heic", ".jxl", ".psd")


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the name, case kept; '' without one."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)\z", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*\z", "")


def ancestors(path: Column) -> Column:
    """The directories above a path, the outermost first."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def describe(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """df with parts, parent, name, ext and depth of its path column."""
    p = F.col(path)
    return df.withColumns({"parts": parts(p), "parent": parent(p), "name": base_name(p), "ext": extension(p), "depth": F.size(parts(p))})


def is_dot(path: Column) -> Column:
    return base_name(path).startswith(".")


def under_git(path: Column) -> Column:
    return F.array_contains(parts(path), ".git")


def in_dirs(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a directory above is one of the names."""
    p = parts(path)
    return F.arrays_overlap(F.slice(p, F.lit(1), F.size(p) - 1), F.array(*map(F.lit, names)))


def is_image(path: Column) -> Column:
    return F.lower(extension(path)).isin(*IMAGE_EXT)


def _own(path: Column, is_dir: Column, o: ScanOptions) -> Column:
    """The conjunction of the path filters on one entry."""
    ok, spare = F.lit(True), is_dir & F.lit(not o.filter_dirs)
    if o.include_name:
        ok &= spare | base_name(path).rlike(to_java(o.include_name))
    if o.exclude_dirs:
        ok &= ~in_dirs(path, o.exclude_dirs)
    if o.include_ext:
        ok &= spare | extension(path).isin(*o.include_ext)
    if o.exclude_dir_regex:
        above = parent(path) if o.absolute_root is None else F.concat(F.lit(o.absolute_root.rstrip("/")), F.when(parent(path) == "", "").otherwise(F.concat(F.lit("/"), parent(path))))
        ok &= ~above.rlike(to_java(o.exclude_dir_regex))
    if o.exclude_name:
        ok &= ~base_name(path).rlike(to_java(o.exclude_name))
    if o.exclude_ext:
        ok &= spare | ~extension(path).isin(*o.exclude_ext)
    if o.skip_git:
        ok &= ~under_git(path)
    return ok


def allowed(path: Column, is_dir: Column, options: ScanOptions, ignored=None) -> Column:
    """Whether the scan keeps an entry: it and all directories above pass. ignored: path column -> boolean column."""

    def own(p: Column, d: Column) -> Column:
        ok = _own(p, d, options)
        return ok if ignored is None else ok & ~ignored(p)

    ok = own(path, is_dir) & F.forall(ancestors(path), lambda a: own(a, F.lit(True)))
    if options.ignore_dotfiles:
        ok &= ~is_dot(path)
        if options.prune_dot_dirs:
            ok &= F.forall(ancestors(path), lambda a: ~is_dot(a))
    return ok


def order_key(path: Column, case_insensitive: bool = False) -> Column:
    """Sorts as a walk visits: directory by directory, not as whole strings."""
    return F.transform(parts(path), lambda x: F.lower(x)) if case_insensitive else parts(path)
