"""Secrets: rules, scanning of lines and masking, as column expressions.

Rules are immutable and ordered: of several patterns that match a line, the first names the match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import to_java
from .text import raw_lines

MASK = "*****MASKED*****"
_UP, _ANY, _HEX = "[A-Z0-9]", "[0-9a-zA-Z]", "[a-f0-9]"
_DASHES = "-" * 5
_KEY_HEAD = _DASHES + "BEGIN {} KEY" + _DASHES
_TOKEN = "[a-zA-Z0-9_-]{10,}"


def _patterns() -> tuple[str, ...]:
    plain = _KEY_HEAD.format("PRIVATE")
    aws = ("AKIA[0-9A-Z]{16}", "ASIA[0-9A-Z]{16}", *(f"{p}{_UP}{{16}}" for p in ("A3T", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA")))
    account = ".*".join((r'"type":\s*"service_account"', rf'"private_key_id":\s*"{_HEX}+"', rf'"private_key":\s*"{plain}[^"]+"'))
    google = (account, r"AIza[0-9A-Za-z\-_]{35}", rf'private_key_id\s*=\s*"{_HEX}{{32}}"', rf'"private_key_id"\s*:\s*"{_HEX}{{32}}"', rf'"private_key"\s*:\s*"({plain}[^"]+)"')
    azure = ("AccountKey=([A-Za-z0-9+/=]{88})", "-".join(["[0-9a-f]{32}"] * 3))
    forges = (*(f"gh{x}_[A-Za-z0-9_]{{36,255}}" for x in "pus"), r"glpat-[0-9a-zA-Z\-\_]{20}")
    chat = (rf"xox[baprs]-({_ANY}{{10,48}})?",)
    payment = tuple(f"{x}_live_{_ANY}{{24}}" for x in ("sk", "pk"))
    mail = (r"SG\." + r"\.".join(f"[A-Za-z0-9_-]{{{n}}}" for n in (22, 43)),)
    oauth = (r"ya29\.[0-9A-Za-z\-_]+", r"[0-9]+-([0-9A-Za-z_]{32})" + "".join(r"\." + x for x in ("apps", "googleusercontent", "com")))
    kinds = "|".join(("RSA", "DSA", "EC", "OPENSSH", "PRIVATE", "ENCRYPTED"))
    return (*aws, *google, *azure, *forges, *chat, *payment, *mail, *oauth, _KEY_HEAD.format(f"({kinds}) PRIVATE"), "JWT_SECRET(.{0,10})?([=:])(.{0,100})", "eyJ" + r"\.".join([_TOKEN] * 3))


PATTERNS = _patterns()
ALLOWED = ("AKIAIOSFODNN7" + "EXAMPLE", "wJalrXUtnFEMI/K7MDENG/" + "bPxRfiCYEXAMPLEKEY")
KEYWORDS = ("secret", "password", "passwd", "pass", "pw", "token", r"api[_\-]?key", r"access[_\-]?key", r"private[_\-]?key")
_SIGNS = ":=|==|" + r"\|\|" + "|&&|=|:|-"
_WORD = r"[A-Za-z0-9_\-$]*"


def value_mask(keywords: tuple[str, ...] = KEYWORDS) -> tuple[str, str]:
    """(Java, RE2) pattern of a key, a sign and a value; groups 1 the key, 2 and 4 a quote, 3 and 5 its end."""
    keys = "|".join(keywords)
    java = rf"(?i)((?<![A-Za-z0-9_]){_WORD}(?:{keys})(?![A-Za-z0-9_])[\t\n\f\r ]*(?:{_SIGNS})[\t\n\f\r ]*)" + r"""(?:(")[^"\\]*+(?:\\.[^"\\]*+)*+(?:\\\z)?("?)|(')[^'\\]*+(?:\\.[^'\\]*+)*+(?:\\\z)?('?)|[^,; ]*)"""
    re2 = rf"(?i)(\b{_WORD}(?:{keys})\b\s*(?:{_SIGNS})\s*)" + r"""(?:(")(?:\\.|[^"\\])*("?)|(')(?:\\.|[^'\\])*('?)|[^,; ]*)"""
    return java, re2


BLOCK = r"(?ms)-----BEGIN (?:[A-Z ]+)PRIVATE KEY-----.*?-----END (?:[A-Z ]+)PRIVATE KEY-----"


@dataclass(frozen=True)
class SecretRules:
    patterns: tuple[str, ...] = PATTERNS
    allowed: tuple[str, ...] = ALLOWED
    value_masks: tuple[tuple[str, str], ...] = (value_mask(),)

    def with_pattern(self, pattern: str) -> SecretRules:
        to_java(pattern)
        return replace(self, patterns=(*self.patterns, pattern))

    def with_allowed(self, pattern: str) -> SecretRules:
        to_java(pattern)
        return replace(self, allowed=(*self.allowed, pattern))

    def with_keywords(self, *keywords: str) -> SecretRules:
        """Further keys whose values are found; what isn't a plain word is dropped."""
        words = [re.sub(r"([\-$])", r"\\\1", k) for k in keywords if re.fullmatch(r"[A-Za-z0-9_\-$]+", k)]
        if not words:
            return self
        return replace(self, patterns=(*self.patterns, rf"(?i)({'|'.join(words)})\s*([=:\-])\s*(['" + '"' + r"]?)([^'" + '"' + r"]+)(['" + '"' + "]?)"))


DEFAULT = SecretRules()


def is_allowed(line: Column, rules: SecretRules = DEFAULT) -> Column:
    ok = F.lit(False)
    for p in rules.allowed:
        ok |= line.rlike(to_java(p))
    return ok


def matched_pattern(line: Column, rules: SecretRules = DEFAULT) -> Column:
    """The first rule that a line matches, its value mask's name last; null if none or if the line is allowed."""
    first = F.coalesce(*[F.when(line.rlike(to_java(p)), F.lit(p)) for p in rules.patterns], *[F.when(line.rlike(java), F.lit(re2)) for java, re2 in rules.value_masks], F.lit(None).cast("string"))
    return F.when(~is_allowed(line, rules), first)


def mask_values(line: Column, rules: SecretRules = DEFAULT) -> Column:
    for java, _ in rules.value_masks:
        line = F.regexp_replace(line, java, f"$1$2$4{MASK}$3$5")
    return line


def mask_patterns(line: Column, rules: SecretRules = DEFAULT) -> Column:
    for p in rules.patterns:
        line = F.regexp_replace(line, to_java(p), MASK)
    return line


def mask_key_blocks(text: Column) -> Column:
    return F.regexp_replace(text, BLOCK, MASK)


def mask_all(text: Column, rules: SecretRules = DEFAULT) -> Column:
    """Key blocks over the whole text, then on each line values and patterns, in this order."""
    return F.array_join(F.transform(raw_lines(mask_key_blocks(text)), lambda x: mask_patterns(mask_values(x, rules), rules)), "\n")
