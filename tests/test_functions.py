from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import charset, dialect, paths, secrets, text
from textloom.functions.language import language_of


def column(spark, values, use, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", use(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


# dialect


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        (r"\bpass", ["épass", "x pass"], ["xpass"]), (r"a.c", ["a\rc", "a\u0085c"], ["a\nc"]), (r"c$", ["abc"], ["abc\n"]), (r"(?m)c$", ["abc\n", "c"], ["cb"]), (r"a\sb", ["a b", "a\tb"], ["a\x0bb"]),
        (r"(?i)k", ["K", "K"], ["c"]), (r"[[:alpha:]]+", ["q"], ["1"]), (r"(?P<n_1>a)b", ["ab"], ["b"]), (r"[]a]x", ["]x", "ax"], ["bx"]), (r"[a&&b]", ["&", "a"], ["c"]), (r"[[]", ["["], ["a"]),
        (r"\Qa.b\E", ["a.b"], ["axb"]), (r"[^\s]z", ["az"], [" z"]), (r"\x41", ["A"], ["B"]), (r"\Bb", ["ab"], ["b"]),
    ],
)
def test_dialect(spark, pattern, yes, no):
    got = column(spark, yes + no, lambda c: c.rlike(dialect.to_java(pattern)))
    assert got == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a++", r"(?U)a*", "[a", "a\\", r"\C", "[[:nope:]]", "(?>a)"])
def test_dialect_rejects(pattern):
    with pytest.raises(ValueError, match=".+"):
        dialect.to_java(pattern)


# paths and languages


def test_path_columns(spark):
    values = ["a/b.tar.gz", ".gitignore", "x/Makefile", "x/.env", "a.", "d/e/f.Py"]
    assert column(spark, values, paths.extension) == [".gz", ".gitignore", "", ".env", ".", ".Py"]
    assert column(spark, values, paths.base_name) == ["b.tar.gz", ".gitignore", "Makefile", ".env", "a.", "f.Py"]
    assert column(spark, values, paths.parent) == ["a", "", "x", "x", "", "d/e"]
    assert column(spark, values, paths.ancestors) == [["a"], [], ["x"], ["x"], [], ["d", "d/e"]]
    assert column(spark, ["a.PNG", "b.svg", "c.txt"], paths.is_image) == [True, True, False]
    order = ["a.txt", "a/b", "a-b/c", "B"]
    assert [order[i] for i in sorted(range(4), key=column(spark, order, paths.order_key).__getitem__)] == ["B", "a/b", "a-b/c", "a.txt"]


def test_languages(spark):
    names = {"x/Dockerfile": "dockerfile", "Makefile.am": "makefile", "CMakeLists.txt": "cmake", "build.gradle": "groovy", "Vagrantfile": "ruby", "a.GO": "go", "b.kts": "kotlin", "c.mm": "objectivec", "d.el": "emacs-lisp", "e": "", "f.unknown": "", "g.md": "markdown", "h.h": "c"}
    assert column(spark, list(names), language_of) == list(names.values())


# text


def test_comment_stripping(spark):
    cases = [
        ("go", "// gone\nkeep := 1 // stays\n  // gone too", "keep := 1 // stays"), ("go", "/* a\nb */x = 2\n/*/ y */z", "x = 2\nz"), ("css", "p{} /* open to the end\nq{}", "p{}"), ("python", "# no\n    indented = 4\n\n", "indented = 4"),
        ("html", "<!-- a --><b>x</b>", "<b>x</b>"), ("vim", '" gone\nlet a = 1', "let a = 1"), ("text", "# stays\n  // stays ", "# stays\n// stays"), ("php", "# a\n// b\n/* c */d", "d"), ("haskell", "-- a\n; b\nc", "c"), ("sql", "-- a\n; b", "; b"), ("emacs-lisp", "# stays", "# stays"),
        ("javascript", 's = "/* in */ a string"', 's = " a string"'),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, lang string, t string, want string").select("want", text.strip_comments(F.col("t"), F.col("lang")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_lines_and_compact(spark):
    values = ["a\nb\n", "a\r\nb", "", "\n", "x\r\r\n", None]
    assert column(spark, values, text.scanned_lines) == [["a", "b"], ["a", "b"], [], [""], ["x\r"], None]
    assert column(spark, values, text.raw_lines) == [["a", "b", ""], ["a\r", "b"], [""], ["", ""], ["x\r\r", ""], None]
    assert column(spark, [" a \n\n\t b　\n", ""], text.compact) == ["a␤b", ""]
    assert column(spark, ["a\nb", ""], text.numbered) == ["1: a\n2: b", "1: "]
    assert column(spark, ["x"] * 1, lambda c: text.numbered(c, "%6d: %s")) == ["     1: x"]


def test_escapes_and_lists(spark):
    assert column(spark, ["<a b=\"c\" d='e'>&\t\r\n"], text.xml_attribute) == ["&lt;a b=&#34;c&#34; d=&#39;e&#39;&gt;&amp;&#x9;&#xD;&#xA;"]
    assert column(spark, ["x]]>y]]>"], text.cdata) == ["x]]]]><![CDATA[>y]]]]><![CDATA[>"]
    assert column(spark, [" b, a,,b , c", ""], text.csv_items) == [["b", "a", "c"], []]
    assert column(spark, ["10M", "1.5K", "7", " 2 g ", "1X", ""], text.byte_size) == [10 << 20, 1536, 7, 2 << 30, None, None]


# secrets

_A = "abcdefghijklmnopqrstuvwxyz0123456789"
_HEX = "0123456789abcdef" * 2


def examples():
    dashes = "-" * 5
    up = [p + "Q7" * 8 for p in ("AKIA", "ASIA", "A3T", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA")]
    plain = f"{dashes}BEGIN PRIVATE KEY{dashes}"
    account = f'{{"type": "service_account", "private_key_id": "{_HEX}", "private_key": "{plain}zz"}}'
    google = [account, "AIza" + (_A * 2)[:35], f'private_key_id = "{_HEX}"', f'"private_key_id": "{_HEX}"', f'"private_key" : "{plain}zz"']
    rest = ["AccountKey=" + "A1+/" * 22, "-".join([_HEX] * 3), "ghp_" + _A, "ghu_" + _A, "ghs_" + _A, "glpat-" + _A[:20], "xoxb-" + _A[:12], "sk_live_" + _A[:24], "pk_live_" + _A[:24]]
    rest += ["SG." + _A[:22] + "." + (_A * 2)[:43], "ya29.x-y_z", "123-" + _A[:32] + ".apps.googleusercontent.com", f"{dashes}BEGIN EC PRIVATE KEY{dashes}", "JWT_SECRET = y", "eyJ" + ".".join([_A[:12]] * 3)]
    return [*up, *google, *rest]


def test_each_pattern_in_order(spark):
    lines = examples()
    assert len(lines) == len(secrets.PATTERNS) == 29
    assert column(spark, ["x " + x for x in lines], secrets.matched_pattern) == list(secrets.PATTERNS)


def test_masks(spark):
    m = secrets.MASK
    pem = "\n".join(("-" * 5 + "BEGIN OPENSSH PRIVATE KEY" + "-" * 5, "body", "-" * 5 + "END OPENSSH PRIVATE KEY" + "-" * 5))
    cases = {
        'db_password = "a\\"b" # x': f'db_password = "{m}" # x', "token := 'q'": f"token := '{m}'", "pw=1, passwd=2; x": f"pw={m}, passwd={m}; x", "secret == v": f"secret == {m}", "api-key||v w": f"api-key||{m} w",
        "password:": f"password:{m}", '"password": "x"': '"password": "x"', "tokens=x": "tokens=x", "épassword=x": f"épassword={m}", 'pass="open': f'pass="{m}', "plain text": "plain text", pem: m, "id ghp_" + _A: f"id {m}",
        "JWT_SECRET=x": m, "-----BEGIN PRIVATE KEY-----": "-----BEGIN PRIVATE KEY-----", "a\n" + pem + "\nb": f"a\n{m}\nb", "AKIAIOSFODNN7" + "EXAMPLE": m,
    }
    assert column(spark, list(cases), secrets.mask_all) == list(cases.values())


def test_rules_can_be_extended(spark):
    rules = secrets.DEFAULT.with_pattern(r"CORP-\d{4}").with_allowed("CORP-0000").with_keywords("pin$code", "bad key!", "zip")
    assert len(rules.patterns) == 31 and secrets.DEFAULT.patterns == secrets.PATTERNS
    got = column(spark, ["CORP-1234", "CORP-0000 CORP-1234", "pin$code = 'x'", "bad key! = 1", "ZIP: y", "nothing"], lambda c: secrets.matched_pattern(c, rules))
    assert got == [rules.patterns[29], None, rules.patterns[30], None, rules.patterns[30], None]
    assert secrets.DEFAULT.with_keywords("not ok") == secrets.DEFAULT


# charset


def machine(data: bytes, euc: bool) -> float:
    """The sequence score by a walk over the bytes."""
    i = good = bad = 0
    while i < len(data):
        b = data[i]
        rest = data[i + 1 : i + 3]
        if b < 0x80:
            i += 1
        elif euc and b == 0x8F:
            if i + 2 >= len(data):
                bad += 1
                break
            ok = all(0xA1 <= x <= 0xFE for x in rest)
            good, bad, i = good + ok, bad + (not ok), i + (3 if ok else 1)
        elif (euc and (b == 0x8E or 0xA1 <= b <= 0xFE)) or (not euc and (0x81 <= b <= 0x9F or 0xE0 <= b <= 0xFC)):
            if i + 1 >= len(data):
                bad += 1
                break
            t = rest[0]
            ok = (0xA1 <= t <= (0xDF if b == 0x8E else 0xFE)) if euc else (0x40 <= t <= 0x7E or 0x80 <= t <= 0xFC)
            good, bad, i = good + ok, bad + (not ok), i + (2 if ok else 1)
        else:
            bad, i = bad + 1, i + 1
    if not good:
        return 0.0
    r = good / (good + bad)
    for limit, least, score in ((0.95, 10, 0.95), (0.9, 5, 0.9), (0.8, 0, 0.8), (0.7, 0, 0.7), (0.5, 0, 0.5)):
        if r > limit and good > least:
            return score
    return r * 0.5


JAPANESE = "これは日本語の文章です。漢字とかなが混ざっています。"


def test_scores_equal_a_byte_walk(spark):
    rng = random.Random(1)
    data = [bytes(rng.choice([0x41, 0x8E, 0x8F, 0xA1, 0xC3, 0xDF, 0xE0, 0xFC, 0xFE, 0xFF, 0x40, 0x80]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    data += [JAPANESE.encode(c)[:n] for c in ("cp932", "euc_jp", "utf-8") for n in (9, 20, 33, 99)]
    got = column(spark, data, lambda c: charset._scores(charset._measures(c)), "binary")
    assert [(g["Shift-JIS"], g["EUC-JP"]) for g in got] == [(pytest.approx(machine(d, False)), pytest.approx(machine(d, True))) for d in data]


def test_detect(spark):
    cases = [
        (b"", "Unknown", 0.0, ""), (b"plain", "ASCII", 1.0, "en"), (b"\xef\xbb\xbfx", "UTF-8", 1.0, "ja"), (b"\xff\xfea\x00", "UTF-8", 1.0, "ja"), (JAPANESE.encode(), "UTF-8", 0.95, "ja"), (JAPANESE.encode("cp932"), "Shift-JIS", 0.95, "ja"),
        (JAPANESE.encode("euc_jp"), "EUC-JP", 0.95, "ja"), (JAPANESE.encode("iso2022_jp"), "ASCII", 1.0, "en"), (JAPANESE.encode("iso2022_jp") + b"\xff", "ISO-2022-JP", 0.95, "ja"), (b"\xff\xff", "Unknown", 0.0, ""),
    ]
    got = column(spark, [c[0] for c in cases], lambda c: charset.detect(c), "binary")
    assert [(g.encoding, g.confidence, g.language) for g in got[:8]] == [c[1:] for c in cases[:8]]
    assert got[8].encoding == "ISO-2022-JP" and got[9].encoding == "Unknown"
    assert column(spark, ["é".encode() * 20], lambda c: charset.detect(c, min_confidence=0.99), "binary")[0].encoding == "Unknown"
    assert column(spark, [None], lambda c: charset.detect(c), "binary") == [None]


@pytest.mark.parametrize("codec", ["utf-8", "cp932", "euc_jp", "iso2022_jp"])
def test_decode_round_trips(spark, codec):
    for sample in (JAPANESE, JAPANESE * 400, "ascii only", "", "mixed " + JAPANESE):
        assert column(spark, [sample.encode(codec)], lambda c: charset.decode(c), "binary") == [sample]


def test_accented_utf8_is_left_alone(spark):
    sample = "déjà été ça où être Noël años mañana"
    assert column(spark, [sample.encode()], lambda c: charset.decode(c), "binary") == [sample]


def test_binary_and_sniff(spark):
    data = [b"", b"text\n\t", b"a\x00", b"\xff", b"\x01" * 2 + b"a" * 8, b"\x01" + b"a" * 10, "é".encode(), b"a" * 800 + b"\x01", b"\xc0\x80", b"\xed\xa0\x80"]
    assert column(spark, data, charset.is_binary, "binary") == [False, False, True, True, True, False, False, False, True, True]
    assert column(spark, data, charset.looks_like_text, "binary") == [True, True, False, True, False, False, True, True, True, True]
    assert column(spark, data, charset.valid_utf8, "binary") == [True, True, True, False, True, True, True, True, False, False]


def test_no_pattern_needs_more_than_the_linear_dialect():
    for p in secrets.PATTERNS:
        assert re.compile(p) and dialect.to_java(p)
