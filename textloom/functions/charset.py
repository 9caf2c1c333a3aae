"""Charset detection from bytes, in built-in expressions, and decoding to UTF-8 text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 8192
ENCODINGS = ("UTF-8", "Shift-JIS", "EUC-JP", "CP932", "ISO-2022-JP", "ASCII")
_SJIS = r"[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]"
_EUC = r"\x8E[\xA1-\xDF]|\x8F[\xA1-\xFE][\xA1-\xFE]|[\xA1-\xFE][\xA1-\xFE]"
_ESCAPES = r"\x1B\$[B@]|\x1B\([BJ]"


def latin(content: Column) -> Column:
    """A character for each byte."""
    return F.decode(content, "ISO-8859-1")


def is_binary(content: Column) -> Column:
    """Has a NUL, isn't UTF-8, or more than a tenth of it are control bytes; empty content isn't binary."""
    text = latin(content)
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.when(F.octet_length(content) == 0, False).otherwise(F.contains(text, F.lit("\x00")) | ~valid_utf8(content) | (control / F.octet_length(content) > 0.1))


def valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def looks_like_text(content: Column) -> Column:
    """No control byte but white space among the first 800 bytes."""
    return ~latin(F.substring(content, 1, 800)).rlike(r"[\x00-\x08\x0E-\x1F]")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tier(valid: Column, total: Column) -> Column:
    r = valid / total
    return (
        F.when(valid == 0, 0.0).when((r > 0.95) & (valid > 10), 0.95).when((r > 0.9) & (valid > 5), 0.9).when(r > 0.8, 0.8).when(r > 0.7, 0.7).when(r > 0.5, 0.5).otherwise(r * 0.5)
    )


def _measures(part: Column) -> Column:
    """What the scores need, from one reading of the bytes."""

    def of(x: Column) -> Column:
        count = lambda pattern: F.regexp_count(x["text"], F.lit(pattern))
        return F.struct(
            F.octet_length(x["part"]).alias("size"), F.hex(F.substring(x["part"], 1, 3)).alias("head"), x["ok"].alias("ok"), F.char_length(x["chars"]).alias("chars"), F.regexp_count(x["chars"], F.lit(r"[^\x00-\x7F]")).alias("wide"),
            x["text"].rlike(r"[^\x00-\x7F]").alias("high"), count(_SJIS).alias("sjis"), count(_SJIS + r"|[\x80-\xFF]").alias("sjis_all"),
            # a three-byte sequence that is cut off counts once, whatever of it is there
            count(_EUC).alias("euc"), count(_EUC + r"|\x8F[\x80-\xFF]\z|[\x80-\xFF]").alias("euc_all"), count(_ESCAPES).alias("escapes"),
        )

    ok = valid_utf8(part)
    return _let(F.struct(part.alias("part"), latin(part).alias("text"), ok.alias("ok"), F.when(ok, part.cast("string")).alias("chars")), of)


def _scores(m: Column) -> Column:
    """The measures' score of each encoding, in the order that breaks ties."""
    ratio = m["wide"] / m["chars"]
    utf8 = F.when(~m["ok"] | (m["size"] == 0), 0.0).when(ratio > 0.3, 0.95).when(ratio > 0.1, 0.85).when(ratio > 0, 0.75).otherwise(0.6)
    sjis = _tier(m["sjis"], m["sjis_all"])
    iso = F.when(m["escapes"] >= 4, 1.0).when(m["escapes"] >= 2, 0.95).when(m["escapes"] == 1, 0.85).otherwise(0.0)
    return F.struct(m["size"].alias("size"), m["head"].alias("head"), m["high"].alias("high"), utf8.alias("UTF-8"), sjis.alias("Shift-JIS"), _tier(m["euc"], m["euc_all"]).alias("EUC-JP"), (sjis * 0.95).alias("CP932"), iso.alias("ISO-2022-JP"))


SCORED = ("UTF-8", "Shift-JIS", "EUC-JP", "CP932", "ISO-2022-JP")


def detect(content: Column, *, min_confidence: float = 0.0, sample: int = SAMPLE) -> Column:
    """STRUCT(encoding, confidence, language): byte-order mark, then pure ASCII, then the best score."""

    def result(encoding: Column | str, confidence: Column | float, language: Column | str) -> Column:
        return F.struct((F.lit(encoding) if isinstance(encoding, str) else encoding).alias("encoding"), F.lit(confidence).cast("double").alias("confidence"), F.lit(language).alias("language"))

    def decide(s: Column) -> Column:
        top = F.greatest(*[s[k] for k in SCORED])
        name = F.coalesce(*[F.when(s[k] == top, F.lit(k)) for k in SCORED])
        japanese = (name != "UTF-8") | (top > 0.7)
        return (
            F.when(s["size"] == 0, result("Unknown", 0.0, ""))
            .when((s["head"] == "EFBBBF") | s["head"].startswith("FFFE") | s["head"].startswith("FEFF"), result("UTF-8", 1.0, "ja"))
            .when(~s["high"], result("ASCII", 1.0, "en"))
            .when(s["ISO-2022-JP"] >= 0.85, result("ISO-2022-JP", s["ISO-2022-JP"], "ja"))
            .when((top <= 0) | (top < min_confidence), result("Unknown", top, ""))
            .otherwise(result(name, top, F.when(japanese, "ja").otherwise("")))
        )

    part = F.substring(content, 1, sample) if sample > 0 else content
    return F.when(content.isNotNull(), _let(_let(_measures(part), _scores), decide))


def detected(df: DataFrame, content: Column, **how) -> DataFrame:
    """df with columns encoding, confidence and language, from one detection a row."""
    kept = df.select("*", F.explode(F.array(detect(content, **how))).alias("__found"))  # a struct's fields taken apart would be computed each
    return kept.select(*df.columns, "__found.encoding", "__found.confidence", "__found.language")


def is_encoding(name: str) -> bool:
    """Whether detection knows an encoding of this name."""
    return name in ENCODINGS


_CODECS = {"Shift-JIS": "cp932", "CP932": "cp932", "EUC-JP": "euc_jp", "ISO-2022-JP": "iso2022_jp"}


@F.arrow_udf(T.StringType())
def _legacy(content: pa.Array, encoding: pa.Array) -> pa.Array:
    return pa.array([None if c is None else c.decode(_CODECS.get(e, "utf-8"), errors="replace") for c, e in zip(content.to_pylist(), encoding.to_pylist(), strict=True)], pa.string())


def decode(content: Column, *, escapes_first: bool = True, sample: int = 0) -> Column:
    """UTF-8 text. Valid UTF-8 is taken as it is; only other bytes, and pure ASCII with escape sequences if
    escapes_first, are decoded as what is detected, with U+FFFD for what fits nothing."""
    escaped = F.lit(escapes_first) & latin(content).rlike(_ESCAPES)
    plain = valid_utf8(content) & ~escaped
    rest = F.when(~plain, content)  # detection and decoding see nothing of what is taken as it is
    name = F.when(escaped, "ISO-2022-JP").otherwise(detect(rest, sample=sample)["encoding"])
    return F.when(plain, content.cast("string")).otherwise(_legacy(rest, name))
