"""Language identification with word-first backoff.

Learning counts words and character n-grams per language in Spark. A word that the model knows is scored by its
log frequency in each language; an unknown word falls back to its longest known character n-grams, then to shorter
ones. A document's score vector is the sum over its words, and `score` the softmax share of the best language.

A word is a run of letters; runs of over LONG_WORD letters, as of scripts without spaces, are cut into words of that
length. Frequencies are kept as evidence over FLOOR, the frequency of what a language never showed, so a word or n-gram
costs an entry only for the languages that have it.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.text import Cache, map_texts
from corpusgrid.session import broadcast_if_small, stage, unstage

#: Bound of learning: labelled documents used per language, picked by hash. All their words and n-grams are learned.
TRAIN_DOCS, LENGTHS = 2_000, (4, 3, 2, 1)
#: Frequency of the unseen, weight of each shorter length of n-grams, bytes of word vectors that a task remembers.
FLOOR, BACKOFF, CACHE = 1e-7, 0.5, 64 << 20
LONG_WORD = 64
#: Letters, in any script; everything else separates words.
LETTERS = r"[\p{L}\p{M}]{1,64}"


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """Model from text and lang of the documents that are not held out; rows with a null in either are left out.

    Of each language about train_docs documents, picked by a hash of doc_id, are read (all, if it has fewer); Spark counts
    all their words and n-grams. The model that reaches the driver is bounded by languages * train_docs documents.
    """
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null").where(F.coalesce(~held_out(), F.lit(True)))
    share = rows.groupBy("lang").agg((F.lit(1_000_000.0 * train_docs) / F.count(F.lit(1))).alias("_share"))
    picked = rows.join(broadcast_if_small(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < F.col("_share"))
    words = picked.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("w"))
    words = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    # n-grams are counted over the distinct words, each weighted by its count, with blanks as borders
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))

    def grams_of(k: int):
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - k + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)))
        return F.when(F.length(padded) >= k, cut)

    lists = F.flatten(F.array_compact(F.array(*map(grams_of, LENGTHS))))
    grams = words.select("lang", "n", F.explode(lists).alias("w"))
    grams = grams.groupBy("lang", F.length("w").alias("k"), "w").agg(F.sum("n").alias("n"))
    every = words.select("lang", F.lit(0).alias("k"), "w", "n").unionByName(grams)
    every = stage(every, "counts")
    totals = every.groupBy("lang", "k").agg(F.sum("n").alias("total"))
    found = every.join(broadcast_if_small(totals), ["lang", "k"]).select("lang", "k", "w", (F.col("n") / F.col("total")).alias("p"))
    found = found.toArrow()
    unstage(every)
    langs = sorted(found.column("lang").unique().to_pylist())
    number = {x: i for i, x in enumerate(langs)}
    table: dict[int, dict[str, tuple]] = {k: {} for k in (0, *LENGTHS)}
    for b in found.to_batches(max_chunksize=4096):
        for lang, k, w, p in zip(*(b.column(c).to_pylist() for c in ("lang", "k", "w", "p"))):
            table[k][w] = (*table[k].get(w, ()), number[lang], max(0.0, math.log(p / FLOOR)))
    return {"langs": langs, "table": table}


class Scorer:
    """Scores one text at a time with a model; remembers the vectors of words that it has met."""

    def __init__(self, model: dict):
        import regex

        self.langs, self.table, self.cache = model["langs"], model["table"], Cache(CACHE)
        self.find = regex.compile(LETTERS).findall
        self.letter = regex.compile(r"\p{L}").search

    def word(self, w: str) -> tuple:
        """Evidence of a word as (language, evidence, language, evidence ...)."""
        known = self.table[0].get(w)
        if known:
            return known
        padded = f" {w} "
        for depth, k in enumerate(LENGTHS):  # the longest n-grams that the model knows decide
            t = self.table[k]
            hits = [t[g] for g in (padded[i : i + k] for i in range(len(padded) - k + 1)) if g in t]
            if hits:
                total: dict[int, float] = {}
                for h in hits:
                    for i, x in zip(h[::2], h[1::2]):
                        total[i] = total.get(i, 0.0) + x
                return tuple(y for i, x in sorted(total.items()) for y in (i, BACKOFF**depth * x / len(hits)))
        return ()

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not self.letter(text):
            return "und", 0.0
        total, n, cache = [0.0] * len(self.langs), 0, self.cache
        for w, c in Counter(self.find(text.lower())).items():
            v = cache.get(w)
            if v is None:
                v = cache.keep(w, self.word(w), 120 + len(w) + 20 * len(self.langs))
            n += c
            for j in range(0, len(v), 2):
                total[v[j]] += c * v[j + 1]
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        # over the square root of the words: neighbouring words are not independent evidence
        shift = [(x - total[best]) / math.sqrt(max(n, 1)) for x in total]
        return self.langs[best], 1 / sum(math.exp(max(x, -700.0)) for x in shift)

    def close(self) -> None:
        self.cache.clear()


def predict(docs: DataFrame, model: dict, keep=("doc_id",)) -> DataFrame:
    """Adds held_out, lang_pred and score to the keep columns; one row per row, any doc_id.

    Whole texts are read. A null text, or one without a letter, gives und with score 0, as does a model that learned
    from nothing. Ties go to the first language by name. The prediction uses the text alone. Empty tables, repeated
    rows and extra columns are fine.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    rows = docs.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return map_texts(rows, [*keep, "held_out"], "text", lambda: Scorer(shared.value), [("lang_pred", "string"), ("score", "double")])


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through predict, with a model of its documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
