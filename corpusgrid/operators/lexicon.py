"""Vocabulary and lexicon jobs (L1-L6; L7-L9 are in grammar). Phrase lists, cues and aliases are the caller's."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusgrid.functions.expr import deletion_keys, dropped, phrase_pattern, swaps, within_one_edit
from corpusgrid.session import stage


def vocabulary(tokens: DataFrame, least: int = 8, dominance: int = 10, protected: list[str] = ()) -> DataFrame:
    """L1: words (w, n) of at least `least` occurrences, without those one edit from a kept word `dominance` times as frequent.

    Dominators must themselves be kept. A word's dominators are strictly more frequent, so the graph has no cycle and the
    decision settles in as many rounds as the longest chain of dominance.
    """
    v = stage(tokens.where(F.col("w").rlike(r"^\p{L}+$")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "vocabulary")
    k = v.select("w", "n", F.explode(deletion_keys(F.col("w"))).alias("k"))
    pairs = k.join(k.select("k", F.col("w").alias("big"), F.col("n").alias("bn")), "k").where((F.col("bn") >= dominance * F.col("n")) & (F.col("w") != F.col("big"))).select("w", "big").distinct()
    pairs = stage(pairs.where(within_one_edit(F.col("w"), F.col("big")) & ~F.col("w").isin(list(protected))), "dominance")
    kept = v.select("w")
    while True:
        out = pairs.join(kept.select(F.col("w").alias("big")), "big", "left_semi").select("w").distinct()
        new = stage(v.select("w").join(out, "w", "left_anti"), "kept")
        if new.join(kept, "w", "left_anti").isEmpty() and kept.join(new, "w", "left_anti").isEmpty():
            return v.join(new, "w", "left_semi")
        kept = new


def bigrams(words: DataFrame, kept: DataFrame, row: str, least: int = 3) -> DataFrame:
    """L2: adjacent pairs (a, b, n) of kept words; words has row, pos, w."""
    nxt = F.lead("w").over(Window.partitionBy(row).orderBy("pos"))
    return _counted(words.select(F.col("w").alias("a"), nxt.alias("b")), kept, least)


def text_bigrams(texts: DataFrame, kept: DataFrame, words: str, least: int = 3) -> DataFrame:
    """L2 of texts that are arrays of words: a text's pairs are made in its own row, so only counts of pairs are shuffled."""
    pairs = F.arrays_zip(F.col(words).alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(0))).alias("b"))
    return _counted(texts.select(F.explode(pairs).alias("x")).select("x.a", "x.b"), kept, least)


def _counted(pairs: DataFrame, kept: DataFrame, least: int) -> DataFrame:
    x = pairs.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    k = kept.select("w")
    return x.join(k.withColumnRenamed("w", "a"), "a", "left_semi").join(k.withColumnRenamed("w", "b"), "b", "left_semi")


def corruptions(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """W, cand, n: vocabulary words (w, n) that lost one letter, or had two neighbours swapped, to become w."""
    known = vocab.select(F.col("w").alias("cand"), "n")
    lost = words.select("w").join(known.select("cand", "n", F.explode(dropped(F.col("cand"))).alias("w")), "w")
    crossed = words.select("w", F.explode(swaps(F.col("w"))).alias("cand")).join(known, "cand")
    return lost.select("w", "cand", "n").unionByName(crossed.select("w", "cand", "n")).distinct()


def correct(words: DataFrame, vocab: DataFrame, pairs: DataFrame, row: str, least: int = 10, ratio: int = 10, letters: int = 3) -> DataFrame:
    """L3: row, pos, w, fixed: words replaced by the vocabulary word that best explains them as a corruption.

    Words are decided from left to right: the left neighbour is the decided one, the right one as written. The best
    candidate has the most support (bigrams with both neighbours), then count, then is the greater word. It replaces an
    unknown word of two letters or more; a known one of `letters` or more only if it has `least` bigrams with a neighbour
    that is a word, and with each such neighbour `ratio` times those of the present word.

    All that a decision can ask is joined to the words beforehand, on distinct words and distinct written pairs: the
    candidates, their bigrams with each form that the left neighbour can take, and those with the right one. Then each
    row is folded once, in order.
    """
    known = vocab.select("w", F.lit(True).alias("_known"))
    w = Window.partitionBy(row).orderBy("pos")
    said = stage(words.select(row, "pos", "w").withColumns({"_prev": F.lag("w").over(w), "_next": F.lead("w").over(w)}), "said")
    each = said.select("w").distinct().where(F.col("w").rlike(r"^\p{L}{2,}$")).join(known, "w", "left").where(F.col("_known").isNull() | (F.length("w") >= letters))
    options = stage(corruptions(each, vocab).join(each, "w"), "options")
    forms = options.select("w", F.col("cand").alias("form")).unionByName(options.select("w", F.col("w").alias("form")).distinct())
    able = options.select("w").distinct()
    counted = pairs.select("a", "b", "n")
    # a neighbour without options has one form, its own
    before = said.where(F.col("_prev").rlike(r"^\p{L}+$")).select("_prev", "w").distinct().join(able, "w", "left_semi")
    before = before.join(forms.select(F.col("w").alias("_prev"), F.col("form").alias("_a")), "_prev", "left").withColumn("a", F.coalesce("_a", "_prev"))
    before = before.join(forms.select("w", F.col("form").alias("b")), "w").join(counted, ["a", "b"]).groupBy("_prev", "w").agg(F.collect_list(F.struct("a", "b", "n")).alias("_left"))
    after = said.where(F.col("_next").rlike(r"^\p{L}+$")).select("w", "_next").distinct().join(forms.select("w", F.col("form").alias("a")), "w")
    after = after.join(counted.withColumnRenamed("b", "_next"), ["a", "_next"]).groupBy("w", "_next").agg(F.collect_list(F.struct("a", "n")).alias("_right"))
    own = options.groupBy("w").agg(F.collect_list(F.struct("cand", "n")).alias("_cands"), F.first("_known").alias("_known"))
    x = said.join(own, "w", "left").join(before, ["_prev", "w"], "left").join(after, ["w", "_next"], "left")
    x = x.select(row, "pos", "w", "_next", F.col("_known").isNotNull().alias("_known"), "_cands", "_left", "_right").repartition(row).sortWithinPartitions(row, "pos")
    schema = StructType([*(x.schema[c] for c in (row, "pos", "w")), StructField("fixed", StringType())])
    return x.mapInArrow(lambda batches: _decided(batches, row, least, ratio), schema)


def _decided(batches, row: str, least: int, ratio: int):
    """The words of each row with their decisions; batches are in order of row and position."""
    at, prev = None, None
    for whole in batches:
        for low in range(0, whole.num_rows, 1024):
            b, fixed = whole.slice(low, 1024), []
            for r in b.to_pylist():
                if r[row] != at:
                    at, prev = r[row], None
                new = r["w"]
                if r["_cands"]:
                    left = {x["b"]: x["n"] for x in r["_left"] or () if x["a"] == prev}
                    right = {x["a"]: x["n"] for x in r["_right"] or ()}
                    best = max(((left.get(c["cand"], 0) + right.get(c["cand"], 0), c["n"], c["cand"]) for c in r["_cands"]))[2]
                    sides = [(n.get(best, 0), n.get(new, 0)) for n, word in ((left, prev), (right, r["_next"])) if word and word.isalpha()]
                    if not r["_known"] or (any(good >= least for good, _ in sides) and all(good >= ratio * bad for good, bad in sides)):
                        new = best
                fixed.append(new)
                prev = new
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (row, "pos", "w")), pa.array(fixed, pa.string())], [row, "pos", "w", "fixed"])


def mentions(text: Column, kinds: dict[str, list[str]]) -> Column:
    """L4: array of (kind, phrase) found left to right, longest phrase first over all kinds."""
    kind_of = {p: k for k, ps in kinds.items() for p in ps}
    names = F.create_map(*[F.lit(x) for kv in kind_of.items() for x in kv])
    return F.transform(F.regexp_extract_all(text, F.lit(phrase_pattern(list(kind_of))), F.lit(0)), lambda p: F.struct(F.element_at(names, p).alias("kind"), p.alias("phrase")))


def described(text: Column, heads: list[str], keywords: dict[str, str], stops: list[str], gap: int = 5) -> Column:
    """Meaning of the first head noun that a keyword follows within `gap` words with no stop word between; else null."""
    stop = r"(?:(?!\b(?:" + "|".join(stops) + r")\b)\w+\s+)" if stops else r"(?:\w+\s+)"
    pattern = r"\b(?:" + "|".join(heads) + r")\s+" + stop + "{0,%d}" % (gap - 1) + r"(" + "|".join(sorted(keywords, key=len, reverse=True)) + r")\b"
    return F.element_at(F.create_map(*[F.lit(x) for kv in keywords.items() for x in kv]), F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def read_flag(sentences: Column, force_true: str, force_false: str, word: str, negators: str) -> Column:
    """Flag of the last sentence that speaks of it, false if none does: forced values first, then the word unless negated."""

    def one(s: Column) -> Column:
        return F.when(s.rlike(force_true), True).when(s.rlike(force_false), False).when(s.rlike(rf"\b(?:{negators})\s+(?:\w+\s+){{0,2}}(?:{word})\b"), False).when(s.rlike(rf"\b(?:{word})\b"), True)

    said = F.filter(F.transform(sentences, one), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit(False))
