"""Text scalars as column expressions: lines, comments, compact form, numbering, escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import GRAMMARS

NEWLINE = "␤"
_BLANK = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(_BLANK))


def raw_lines(text: Column) -> Column:
    """Cut at every line feed; carriage returns and a last empty line stay."""
    return F.split(text, "\n", -1)


def scanned_lines(text: Column) -> Column:
    """As a line scanner reads: no last empty line, one carriage return less at a line's end."""
    lines = raw_lines(text)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.transform(lines, lambda x: F.regexp_replace(x, r"\r\z", ""))


def quote(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal, flags=re.ASCII)


def strip_blocks(text: Column, start: str, end: str) -> Column:
    """Without block comments; one that isn't closed goes on to the end of the text."""
    return F.regexp_replace(text, rf"(?s){quote(start)}.*?(?:{quote(end)}|\z)", "")


def strip_comments_of(text: Column, prefixes: tuple[str, ...], blocks: tuple[tuple[str, str], ...]) -> Column:
    """Blocks first; then lines are trimmed, and blank ones and those that begin with a prefix go."""
    for start, end in blocks:
        text = strip_blocks(text, start, end)

    def keeps(x: Column) -> Column:
        ok = x != ""
        for p in prefixes:
            ok &= ~x.startswith(p)
        return ok

    return F.array_join(F.filter(F.transform(raw_lines(text), trim_space), keeps), "\n")


def strip_comments(text: Column, language: Column) -> Column:
    """By the language's grammar; without one, lines are still trimmed and blank ones dropped."""
    out = None
    for (prefixes, blocks), names in GRAMMARS.items():
        is_it, value = language.isin(*names.split()), strip_comments_of(text, prefixes, blocks)
        out = F.when(is_it, value) if out is None else out.when(is_it, value)
    return out.otherwise(strip_comments_of(text, (), ()))


def compact(text: Column) -> Column:
    """Trimmed lines that aren't blank, joined by the newline token."""
    return F.array_join(F.filter(F.transform(raw_lines(text), trim_space), lambda x: x != ""), NEWLINE)


def newline_token(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(NEWLINE))


def numbered(text: Column, pattern: str = "%d: %s") -> Column:
    """Every raw line after its number."""
    return F.array_join(F.transform(raw_lines(text), lambda x, i: F.format_string(pattern, i + 1, x)), "\n")


def xml_attribute(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&#34;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cdata(c: Column) -> Column:
    return F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def csv_items(c: Column) -> Column:
    """Comma-separated items, trimmed, without blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ",", -1), trim_space), lambda x: x != ""))


def byte_size(c: Column) -> Column:
    """Bytes of ``10M``, ``1.5K``; null if it is no size."""
    number, unit = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*([BbKkMmGgTtPp]?)\s*\z", 1), F.upper(F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*([BbKkMmGgTtPp]?)\s*\z", 2))
    power = F.when(unit == "", 0).otherwise(F.locate("K", unit) + 2 * F.locate("M", unit) + 3 * F.locate("G", unit) + 4 * F.locate("T", unit) + 5 * F.locate("P", unit))
    return F.when(number != "", (number.cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))
