"""License scans by canonical digest lookup.

A text is put in canonical form: lower case; lines that begin with a copyright statement dropped (but not those that
go on with a sentence about copyright, as after a line break); everything but letters and digits a single space;
equivalent spellings made one. Its SHA-256 is looked up among known licences by a
hash join. Two kinds of text are looked up entire: the document (full licence texts), and each of its lines (notices
such as "Released under the ... License.").

Distribution. Canonical forms are built-in expressions. A digest is only taken of texts as long as some known text,
which drops nothing that could match. The known digests are a fixed list and are broadcast; matches by line are few and
are joined back by document without moving any text.

Defined results. Null texts: license and notices are null. Empty texts match nothing: license null, notices "". Long
texts are read whole. Rows that repeat doc_id and text are one document and each get its result; a null doc_id is a
document like any other. Several licences: license is the least identifier that the digest is known under, notices all
identifiers of the lines, sorted, each once. Other columns are carried and never read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, text_hash, written

#: Made one after punctuation has become spaces, in this order.
SPELLINGS = (
    ("licenc", "licens"), ("sub license", "sublicense"), ("artefact", "artifact"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
    ("behaviour", "behavior"), ("favour", "favor"), ("organisation", "organization"), ("centre", "center"), ("wilful", "willful"), ("fulfilment", "fulfillment"),
    ("whilst", "while"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https", "http"),
)
#: (identifier, characters, SHA-256) of canonical full texts, with and without their title.
TEXTS = (
    ("MIT", 1000, "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", 988, "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("ISC", 691, "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", 679, "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("0BSD", 590, "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", 606, "53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe"),
    ("Zlib", 797, "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
    ("Zlib", 784, "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("BSD-2-Clause", 1197, "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", 1193, "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", 1218, "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", 1214, "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-3-Clause", 1386, "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", 1380, "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", 1407, "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", 1401, "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
)
#: The same of longer texts, with and without their title, and the notices after their terms. The SQL doesn't know these.
LONG_TEXTS = (
    ("Apache-2.0", 9886, "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", 8870, "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", 8842, "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Apache-2.0", 9817, "97bb151359ca7824a239b0d881e1a58ad4d423d5b5c39e5c7b235fd47c1d52f7"),
    ("Apache-2.0", 8801, "fc9db7a0164e7200da89e02c3227560cc6bf5b50226261135c541f76ac8098f9"),
    ("Apache-2.0", 8773, "dd6b373e28950376ea177a601b11ba7f0238e579d5802f43e69921c313c82549"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", 14455, "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", 17070, "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3"),
    ("GPL-2.0", 14436, "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2"),
    ("GPL-2.0", 14408, "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1"),
    ("GPL-3.0", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", 30940, "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", 33356, "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3"),
    ("GPL-3.0", 30918, "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19"),
    ("GPL-3.0", 30890, "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", 23337, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", 25157, "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f"),
    ("LGPL-2.1", 23305, "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4"),
    ("LGPL-2.1", 23277, "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0", 7047, "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("MPL-2.0", 14342, "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("MPL-2.0", 13661, "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("MPL-2.0", 14307, "61525901247b1a7c093fc10f73de8260d1d1a1a8b3bc78f417119ee4fcfb0979"),
    ("MPL-2.0", 13626, "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3"),
    ("CC0-1.0", 6691, "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("CC0-1.0", 6663, "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a"),
    ("CC0-1.0", 6181, "bb878d68e2bd11ce5ffb0510fa88413b5dfd6d8fe1de780da66de6f74cf984af"),
    ("CC-BY-4.0", 16200, "a37db6abfebdcf1a88f17ff1fdf86f19ab1f0aab8d23838bd00ef30bdfade752"),
    ("CC-BY-4.0", 13555, "4af66050f22b07782cda9ad4b6ffe1004eedd2ee517c323d4a206f1e42d18b92"),
)
NOTICES = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)
#: What a sentence goes on with after "copyright", or after "(c)" as the number of an item, where a statement has a sign, a year or a name.
SENTENCE = "notice|notices|holder|holders|owner|owners|ownership|owned|law|laws|license|licenses|licence|licences|statement|statements|permission|permissions|treaty|treaties|disclaimer|disclaimers|doctrine|doctrines|interest|interests|right|rights|protection|status|infringement|infringements|claim|claims|material|materials|work|works|act|term|terms|information|line|lines|legend|legends|header|headers|and|or|on|in|is|are|as|if|to|for|of|but|also|that|those|which|under|with|may|shall|will|must"
ITEM = "you|your|we|it|its|the|a|an|any|all|each|every|no|not|this|that|these|those|such|to|in|on|of|for|from|by|with|without|under|if|when|where|and|or|as|at|is|are|be|must|may|shall|will|do|does|make|give|provide|include|use|keep|cause|prohibit|accompany|require"
#: A year, or a place for one or for a name.
YEAR = r"[ \t:,.-]*(?:\(c\)|©|[0-9]{2}|[\[<{])"
DROPPED = rf"^[ \t]*(?:copyright(?:s|ed)?{YEAR}|copyright[ \t:]+(?!(?:{SENTENCE})(?![\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}]|\(c\)(?![ \t]*(?:$|(?:{ITEM})(?![\p{{L}}\p{{N}}])))|©|all rights reserved)[^\n]*"
SIGNS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "(?md)" + DROPPED, ""), SIGNS, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_text(text: str) -> str:
    """The same for one string, as the known texts are put in canonical form."""
    out = re.sub(r"[\W_]+", " ", re.sub("(?m)" + DROPPED.replace(r"[\p{L}\p{N}]", r"[^\W_]"), "", text.lower())).strip(" ")
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def known(extra: tuple[tuple[str, str], ...] = (), texts: tuple[tuple[str, int, str], ...] = TEXTS + LONG_TEXTS) -> list[tuple[str, int, str]]:
    """(identifier, characters, digest), one row a digest: of those that share it, the least identifier."""
    rows = [*texts, *((i, len(c), hashlib.sha256(c.encode()).hexdigest()) for i, t in (*NOTICES, *extra) if (c := canonical_text(t)))]
    return sorted({d: (i, n, d) for i, n, d in sorted(rows, reverse=True)}.values())


def license_scan(docs: DataFrame, *, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(doc_id, license, notices) of every document. extra: further (identifier, text) to know."""
    spark, rows = docs.sparkSession, known(extra)
    table = F.broadcast(spark.createDataFrame(rows, "__license string, __n int, __digest string").select("__license", "__digest"))
    lengths = sorted({n for _, n, _ in rows})
    base = docs.select(F.col("doc_id").alias("__doc"), F.col("doc_id").cast("long").alias("__id"), text_hash("text").alias("__th"), F.col("text").alias("__text"))

    def digest(form: Column) -> Column:
        return F.when(F.length(form).isin(lengths), F.sha2(form, 256))

    lines = base.where("__text is not null").select("__id", "__th", F.explode(F.split("__text", "\n", -1)).alias("__line"))
    lines = lines.select("__id", "__th", canonical(F.col("__line")).alias("__form"))
    hits = lines.select("__id", "__th", digest(F.col("__form")).alias("__digest")).where("__digest is not null").join(table, "__digest")
    hits = written(hits.groupBy(F.col("__id").alias("__hit_id"), F.col("__th").alias("__hit_th")).agg(F.array_join(F.array_sort(F.collect_set("__license")), ",").alias("__notices")), "notices")
    whole = base.select("__doc", "__id", "__th", F.col("__text").isNotNull().alias("__some"), canonical(F.col("__text")).alias("__form")).select("__doc", "__id", "__th", "__some", digest(F.col("__form")).alias("__digest")).join(table, "__digest", "left")
    out = whole.join(sized(hits), F.col("__id").eqNullSafe(F.col("__hit_id")) & (F.col("__th") == F.col("__hit_th")), "left")
    return out.select(F.col("__doc").alias("doc_id"), F.col("__license").alias("license"), F.when(F.col("__some"), F.coalesce("__notices", F.lit(""))).alias("notices"))


def _sql() -> str:
    # the SQL has the rule by the first word only; it has no lookahead
    dropped = r"^[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"

    def form(x: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(lower({x}), '(?m){dropped}', '', 'g'), '{SIGNS}', ' ', 'g'), ' ')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return out

    values = ", ".join(f"('{i}', '{d}')" for i, _, d in known(texts=TEXTS))
    return f"""
WITH k(license, digest) AS (VALUES {values}),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) JOIN k ON sha256({form("line")}) = digest GROUP BY doc_id)
SELECT doc_id, license, CASE WHEN text IS NOT NULL THEN coalesce(notices, '') END AS notices
FROM documents LEFT JOIN k ON sha256({form("text")}) = digest LEFT JOIN n USING (doc_id)
"""


SQL = _sql()
