"""Dumps of a corpus as ordered chunks of text, and a sink that writes them to one file.

A dump is a DataFrame (ord, chunk); chunks in the order of ord make the document. No step gathers a corpus in one cell.
"""

from __future__ import annotations

from typing import IO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charset, secrets
from ..functions.language import language_of
from ..functions.paths import is_image, under_git
from ..functions.text import NEWLINE, cdata, compact, scanned_lines, strip_comments, xml_attribute
from .tree import tree_json_rows, tree_rows

HEADERS = {
    "text": "Project: {name}\nRoot: {root}\nLayout: the tree of entries, then every text file below a line with its path\nLeft out: binary files and images\n\n",
    "markdown": "# Project: {name}\n\n- Root: `{root}`\n- Layout: the tree of entries, then a fenced section for every text file\n- Left out: binary files and images\n\n",
    "xml": "<Meta>\n<ProjectName>{name}</ProjectName>\n<RootDir>{root}</RootDir>\n<Note>Binary files and images are left out.</Note>\n</Meta>",
    "compact": "# Compact dump: {name}\nRoot: {root}\nEach file is a line with @ and its path, and one line with its text, where " + NEWLINE + " stands for a line feed.\n\n",
}


def prepared(files: DataFrame, *, delete_comments: bool = False, mask: bool = False, decode_first: bool = False, strict_utf8: bool = False) -> DataFrame:
    """Files (no directories) with a column body: decoded, stripped of comments and masked as asked.

    files has content or text. Binary files and images go, unless strict_utf8 asks for nothing but valid UTF-8.
    """
    out = files.where(~F.col("is_dir") & ~under_git(F.col("rel_path")))
    if "content" in files.columns:
        c = F.col("content")
        if strict_utf8:
            out = out.where(charset.valid_utf8(c))
        else:
            out = out.where(~is_image(F.col("rel_path")))
            out = out.where(~charset.is_binary(F.encode(charset.decode(c), "utf-8")) if decode_first else ~charset.is_binary(c))
        body = c.cast("string") if strict_utf8 else charset.decode(c)
    else:
        out, body = out.where(F.col("text").isNotNull() if strict_utf8 else F.col("text").isNotNull() & ~is_image(F.col("rel_path"))), F.col("text")
    if delete_comments:
        body = strip_comments(body, language_of(F.col("rel_path")))
    return out.withColumn("body", secrets.mask_all(body) if mask else body)


def _tree_text(files: DataFrame, kept: DataFrame, lead: str = "") -> DataFrame:
    return tree_rows(files, kept).select(F.struct(F.lit(1).alias("section"), F.col("parts").alias("parts"), F.lit(0).alias("sub")).alias("ord"), F.concat(F.lit(lead), "line", F.lit("\n")).alias("chunk"))


def _literal(df: DataFrame, section: int, text: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(text,)], "chunk string").select(F.struct(F.lit(section).alias("section"), F.array().cast("array<string>").alias("parts"), F.lit(0).alias("sub")).alias("ord"), "chunk")


def _section(df: DataFrame, section: int, chunk: Column, parts: str | Column = "parts", sub: int = 0) -> DataFrame:
    return df.select(F.struct(F.lit(section).alias("section"), (F.col(parts) if isinstance(parts, str) else parts).alias("parts"), F.lit(sub).alias("sub")).alias("ord"), chunk.alias("chunk"))


def file_chunk_text(path: Column, body: Column, number: bool = False) -> Column:
    lines = scanned_lines(body)
    lines = F.transform(lines, lambda x, i: F.format_string("%6d: %s\n", i + 1, x)) if number else F.transform(lines, lambda x: F.concat(x, F.lit("\n")))
    return F.concat(F.lit("\n=== "), path, F.lit(" ===\n"), F.array_join(lines, ""))


def file_chunk_markdown(path: Column, body: Column) -> Column:
    lines = F.transform(scanned_lines(body), lambda x: F.concat(x, F.lit("\n")))
    return F.concat(F.lit("\n---\n\n# File: "), path, F.lit("\n```"), language_of(path), F.lit("\n"), F.array_join(lines, ""), F.lit("```\n"))


def file_chunk_xml(path: Column, name: Column, body: Column) -> Column:
    return F.concat(F.lit('<file name="'), xml_attribute(name), F.lit('" language="'), xml_attribute(language_of(path)), F.lit('">\n<![CDATA[\n'), cdata(body), F.lit("\n]]>\n</file>\n"))


def file_chunk_compact(rel_path: Column, body: Column) -> Column:
    return F.concat(F.lit("@"), rel_path, F.lit("\n"), compact(body), F.lit("\n"))


def dump_text(files: DataFrame, kept: DataFrame, *, root: str, name: str, number: bool = False, **how) -> DataFrame:
    body = _section(prepared(kept, **how), 3, file_chunk_text(F.col("path"), F.col("body"), number))
    return _literal(files, 0, HEADERS["text"].format(name=name, root=root) + f"{root}\n").unionByName(_tree_text(files, kept)).unionByName(_literal(files, 2, "\n")).unionByName(body)


def dump_markdown(files: DataFrame, kept: DataFrame, *, root: str, name: str, **how) -> DataFrame:
    body = _section(prepared(kept, **how), 3, file_chunk_markdown(F.col("path"), F.col("body")))
    head = HEADERS["markdown"].format(name=name, root=root) + f"# Project Tree\n\n```\n{root}\n"
    return _literal(files, 0, head).unionByName(_tree_text(files, kept)).unionByName(_literal(files, 2, "\n```\n")).unionByName(body)


def xml_key(parts: Column, is_dir: Column) -> Column:
    """Directories first, then by lower-case name, at every level; the name itself breaks ties."""
    return F.transform(parts, lambda x, i: F.concat(F.when((i + 1 < F.size(parts)) | is_dir, "0").otherwise("1"), F.lower(x), F.lit("\x00"), x))


def dump_xml(files: DataFrame, kept: DataFrame, *, root: str, name: str, **how) -> DataFrame:
    import html

    esc = lambda s: html.escape(s, quote=False).replace('"', "&#34;").replace("'", "&#39;")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<ProjectDump>\n' + HEADERS["xml"].format(name=esc(name), root=esc(root)) + "\n<Tree>\n<![CDATA[\n"
    body = _section(prepared(kept, **how), 3, file_chunk_xml(F.col("path"), F.col("name"), F.col("body")), xml_key(F.col("parts"), F.lit(False)))
    dirs = kept.where("is_dir")
    opened = _section(dirs, 3, F.concat(F.lit('<directory name="'), xml_attribute(F.col("name")), F.lit('">\n')), xml_key(F.col("parts"), F.lit(True)))
    closed = _section(dirs, 3, F.lit("</directory>\n"), F.concat(xml_key(F.col("parts"), F.lit(True)), F.array(F.lit("\U0010ffff"))))
    out = _literal(files, 0, head).unionByName(_tree_text(files, kept)).unionByName(_literal(files, 2, "]]>\n</Tree>\n"))
    return out.unionByName(opened).unionByName(body).unionByName(closed).unionByName(_literal(files, 4, "</ProjectDump>\n"))


def dump_compact(files: DataFrame, kept: DataFrame, *, root: str, name: str, mask: bool = False) -> DataFrame:
    """Comments always go; only valid UTF-8 is admitted."""
    tree = tree_json_rows(kept, root_name=name).select(F.struct(F.lit(1).alias("section"), F.col("ord").alias("parts"), F.lit(0).alias("sub")).alias("ord"), F.col("token").alias("chunk"))
    body = _section(prepared(kept, delete_comments=True, mask=mask, strict_utf8=True), 3, file_chunk_compact(F.col("rel_path"), F.col("body")))
    head = HEADERS["compact"].format(name=name, root=root) + "## Directory Tree (JSON)\n"
    return _literal(files, 0, head).unionByName(tree).unionByName(_literal(files, 2, "\n\n## File Dump\n")).unionByName(body)


def compress_dump(dump: Column, name: str, fmt: str) -> Column:
    """A finished dump of another format as one compact pseudo-file."""
    head = HEADERS["compact"].format(name=name, root=fmt) + "## Directory Tree (JSON)\n" + '{ "type": "file", "name": "' + name + '" }' + "\n\n## File Dump\n"
    return F.concat(F.lit(head + f"@{name}\n"), compact(dump), F.lit("\n"))


def multi_file_compact(bodies: DataFrame, first_dir: str) -> DataFrame:
    """(ord, chunk) of files by a list, as by_list gives them."""
    rows = bodies.select(F.col("pos").alias("ord"), F.concat(F.lit("@"), "path", F.lit("\n"), "body", F.lit("\n")).alias("chunk"))
    return bodies.sparkSession.createDataFrame([(-1, f"# Compact dump: {first_dir}\n\n## File Dump\n")], "ord int, chunk string").unionByName(rows)


def write_dump(dump: DataFrame, out: IO[str]) -> int:
    """Write the chunks in order, one partition at a time on the driver; the number of characters."""
    n = 0
    for r in dump.orderBy("ord").select("chunk").toLocalIterator(prefetchPartitions=True):
        n += out.write(r["chunk"])
    return n
