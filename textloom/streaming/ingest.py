"""Row-wise operators on a stream of texts: an extension, all of it stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import secrets
from ..functions.language import language_of
from ..functions.text import compact, strip_comments
from ..operators.lines import lines, matches


def cleaned(stream: DataFrame, *, path: str = "rel_path", text: str = "text", delete_comments: bool = True, mask: bool = True) -> DataFrame:
    """(path, language, text) in compact form, of a batch or a stream."""
    body = F.col(text)
    if delete_comments:
        body = strip_comments(body, language_of(F.col(path)))
    if mask:
        body = secrets.mask_all(body)
    return stream.select(F.col(path).alias("path"), language_of(F.col(path)).alias("language"), compact(body).alias("text"))


def alerts(stream: DataFrame, query: str, *, is_regex: bool = False, path: str = "rel_path", text: str = "text") -> DataFrame:
    """(path, line_no, line) of the lines that match, as they come."""
    return lines(stream, path=path, text=text).where(matches(F.col("line"), query, is_regex)).select("path", "line_no", "line")
