"""Language identification by multilingual mixture inference.

A language model gives each word the likelihood of its letters, each given the two before (trigrams, smoothed by
bigrams, single letters and a uniform rest). A document is a mixture: expectation-maximisation estimates the share of
each language, and of an "und" component that draws letters uniformly, from its words' likelihoods. Of the sets of
languages, nested by share, that with the largest penalised log-likelihood is selected; a further language must raise
it by PENALTY * ln(words). A document whose largest share is und, or that has no letter, is rejected.

Distribution. Row by row, no shuffle. The models are fitted on the driver on about SAMPLE labelled documents a
language, chosen by a hash of doc_id (a documented bound; less labelled text than that is used whole); what is
broadcast has their trigrams and doesn't grow with the data.

Defined results. Null, empty and letterless texts: lang is null, languages and shares are empty, accepted is false.
Long texts are read whole. Ties go to the language first in alphabetical order, und last. Repeated rows get the same
result. Rows with null lang or text don't serve for fitting; without any labelled row every document is rejected.
Other columns are carried; output columns replace ones of the same name.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, prepare, remembered

SAMPLE, PENALTY, ROUNDS, UND = 300, 4.0, 12, "und"
CHUNK_CHARS, CACHE_WORDS = 1 << 18, 200_000
#: ASCII but letters becomes a space; bytes above stay, whatever they are.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
WEIGHTS = (0.7, 0.2, 0.09, 0.01)


def letters(text: str) -> list[bytes]:
    """The words of a text, lower case, without ASCII digits and signs."""
    return text.lower().encode().translate(_LETTERS).split()


class Model:
    """ln p(letter | two letters before) by language, a row for each trigram, bigram and letter that was seen."""

    def __init__(self, texts: Iterable[tuple[str, str]]):
        self.key = uuid.uuid4().hex  # names the model in the workers' memory
        words: dict[str, Counter] = {}
        for lang, text in texts:
            words.setdefault(lang, Counter()).update(letters(text))
        self.languages = sorted(words)
        counts: list[list[Counter]] = [[Counter() for _ in self.languages] for _ in range(4)]  # trigrams, their first two, bigrams, letters
        for x, lang in enumerate(self.languages):
            tri, two, bi, one = (c[x] for c in counts)
            for raw, n in words[lang].items():
                w = f"  {raw.decode()} "
                for i in range(2, len(w)):
                    tri[w[i - 2 : i + 1]] += n
                    two[w[i - 2 : i]] += n
                    bi[w[i - 1 : i + 1]] += n
                    one[w[i]] += n
        seen = [sorted(set().union(*c)) for c in (counts[0], counts[2], counts[3])]
        first = [Counter() for _ in self.languages]
        for x in range(len(self.languages)):
            for g, n in counts[2][x].items():
                first[x][g[0]] += n
        alphabet = max(2, len(seen[2]))
        total = [sum(c.values()) or 1 for c in counts[3]]
        a3, a2, a1, a0 = WEIGHTS

        def row(g: str) -> list[float]:
            out = []
            for x in range(len(self.languages)):
                p = a0 / alphabet + a1 * counts[3][x][g[-1]] / total[x]
                if len(g) > 1 and (n := first[x][g[-2]]):
                    p += a2 * counts[2][x][g[-2:]] / n
                if len(g) > 2 and (n := counts[1][x][g[:2]]):
                    p += a3 * counts[0][x][g] / n
                out.append(math.log(p))
            return [*out, -math.log(alphabet)]

        self.at: dict[str, int] = {}
        rows = [[math.log(a0 / alphabet)] * len(self.languages) + [-math.log(alphabet)]]  # row 0: a letter never seen
        for grams in seen:
            for g in grams:
                self.at[g] = len(rows)
                rows.append(row(g))
        self.rows = np.array(rows)


class Identifier:
    def __init__(self, model: Model, penalty: float = PENALTY, rounds: int = ROUNDS):
        self.model, self.penalty, self.rounds = model, penalty, rounds
        self.names = [*model.languages, UND]
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, len(self.names)), np.float32)

    def learn(self, new: list[bytes]) -> None:
        at = self.model.at.get
        rows, lens = [], []
        for raw in new:
            w = f"  {raw.decode()} "
            rows += [at(w[i - 2 : i + 1]) or at(w[i - 1 : i + 1]) or at(w[i]) or 0 for i in range(2, len(w))]
            lens.append(len(w) - 2)
        first = len(self.index) - len(new)
        while len(self.index) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        begin = np.cumsum(lens) - lens
        self.table[first : len(self.index)] = np.add.reduceat(self.model.rows[rows], begin, axis=0)

    def mix(self, like: np.ndarray, best: np.ndarray, begin: np.ndarray, counts: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares, log-likelihood) of each document's words under the languages that it may have, by EM."""
        doc = np.repeat(np.arange(len(counts)), counts)
        pi = may / may.sum(1, keepdims=True)
        for _ in range(self.rounds):
            g = like * pi.astype(np.float32)[doc]
            g /= g.sum(1, keepdims=True)
            pi = np.add.reduceat(g, begin, axis=0, dtype=np.float64) / counts[:, None]
        total = (like * pi.astype(np.float32)[doc]).sum(1)
        return pi, np.add.reduceat(np.log(total, dtype=np.float64) + best, begin)

    def identify(self, texts: Sequence[str]) -> list[list[tuple[str, float]]]:
        """For each text its languages with their shares, the largest first; [] without letters."""
        out: list[list[tuple[str, float]]] = []
        a = 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and (b == a or chars + len(texts[b]) <= CHUNK_CHARS):
                chars += len(texts[b])
                b += 1
            out += self._chunk(texts[a:b])
            a = b
        return out

    def _chunk(self, texts: Sequence[str]) -> list[list[tuple[str, float]]]:
        if not self.model.languages:
            return [[] for _ in texts]
        if len(self.index) > CACHE_WORDS:
            self.forget()
        words = [letters(t) for t in texts]
        known, index = len(self.index), self.index
        codes = np.array([index.setdefault(w, len(index)) for ws in words for w in ws], np.int64)
        if len(index) > known:
            new = []
            for w in reversed(index):
                if len(new) == len(index) - known:
                    break
                new.append(w)
            self.learn(new[::-1])
        counts = np.fromiter(map(len, words), np.int64, len(words))
        some = np.flatnonzero(counts)
        result: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not len(some):
            return result
        counts = counts[some]
        logs = self.table[codes].astype(np.float64)
        best = logs.max(1)
        like = np.maximum(np.exp(logs - best[:, None]), 1e-30).astype(np.float32)
        begin = np.cumsum(counts) - counts
        price = self.penalty * np.log(counts + 1.0)
        full, most = self.mix(like, best, begin, counts, np.ones((len(some), len(self.names))))
        alone = np.add.reduceat(logs, begin, axis=0)
        alone[:, -1] -= price  # und must win clearly
        lone = alone.argmax(1)
        chosen = [[(self.names[x], 1.0)] for x in lone.tolist()]
        single = alone[np.arange(len(some)), lone]
        # no set's likelihood is above that of all languages: where that isn't worth one more language, the best one stays
        open_ = np.flatnonzero(most - price > single)
        if len(open_):
            order = np.argsort(-full[open_], axis=1, kind="stable")
            part = np.zeros(len(some), bool)
            part[open_] = True
            inside = np.repeat(part, counts)
            like, best, counts_, price_ = like[inside], best[inside], counts[open_], price[open_]
            begin_ = np.cumsum(counts_) - counts_
            top = single[open_].copy()
            may = np.zeros((len(open_), len(self.names)))
            for m in range(1, len(self.names) + 1):
                may[np.arange(len(open_)), order[:, m - 1]] = 1
                if m == 1:
                    continue
                pi, ll = self.mix(like, best, begin_, counts_, may)
                score = ll - (m - 1) * price_
                for d in np.flatnonzero(score > top + 1e-9).tolist():
                    top[d] = score[d]
                    by = sorted((-pi[d, x], x) for x in order[d, :m].tolist())
                    chosen[open_[d]] = [(self.names[x], -p) for p, x in by]
        for d, x in enumerate(some.tolist()):
            result[x] = chosen[d]
        return result


def fit(docs: DataFrame, *, sample: int = SAMPLE) -> Model:
    """The models of the languages in docs.lang, from about ``sample`` documents of each."""
    labelled = docs.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("text").alias("__text")).where("__lang is not null and __text is not null")
    counts = {r["__lang"]: r["n"] for r in labelled.groupBy("__lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([])
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, sample / n))])
    drawn = labelled.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < share[F.col("__lang")] * 1_000_003)
    return Model((r["__lang"], r["__text"]) for r in drawn.select("__lang", "__text").collect())


RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("accepted", T.BooleanType())])


def identified(spark: SparkSession, text: Column, model: Model, *, penalty: float = PENALTY) -> Column:
    """A struct (lang, languages, shares, accepted) for a column of texts."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        own = remembered((shared.value.key, penalty), lambda: Identifier(shared.value, penalty))
        found = own.identify([t or "" for t in texts.to_pylist()])
        give_back()
        lang = [f[0][0] if f and f[0][0] != UND else None for f in found]
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string())), pa.array([[round(s, 6) for _, s in f] for f in found], pa.list_(pa.float64())), pa.array([x is not None for x in lang], pa.bool_())],
            names=["lang", "languages", "shares", "accepted"],
        )

    # not to be evaluated once for a filter and again for its columns
    return run.asNondeterministic()(text)


def language_mixtures(docs: DataFrame, *, sample: int = SAMPLE, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang, languages, shares, accepted) of every document; models fitted on docs.lang."""
    out = docs.select("doc_id", identified(docs.sparkSession, F.col("text"), fit(docs, sample=sample), penalty=penalty).alias("__r"))
    return out.select("doc_id", "__r.lang", "__r.languages", "__r.shares", "__r.accepted")


def keep_identified(docs: DataFrame, *, sample: int = SAMPLE, penalty: float = PENALTY) -> DataFrame:
    """docs, all columns, without the rejected ones; lang becomes the language with the largest share."""
    found = docs.select(F.struct("*").alias("__row"), identified(docs.sparkSession, F.col("text"), fit(docs, sample=sample), penalty=penalty).alias("__r")).where("__r.accepted")
    return found.select(*[F.col("__r.lang").alias("lang") if c == "lang" else F.col("__row").getField(c).alias(c) for c in docs.columns])
