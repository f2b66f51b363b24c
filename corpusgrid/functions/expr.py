"""Text expressions (T1-T11): folding, tokens, sentences, n-grams, one-edit keys, hashed pieces, phrase patterns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDS = r"[.!?;()\[\]]"
TOKEN = r"[a-z0-9]+|[.,!?;:()\[\]]"


#: Hangul syllables by Unicode's arithmetic: lead, vowel and tail (the first stands for none) of the syllable's number.
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, 19, 21, 28


@cache
def _bases() -> tuple[str, str, dict[str, str]]:
    """Letters that decompose, by Unicode, to one base letter and marks, with that letter; those with several, as a map."""
    one, several = {"đ": "d"}, {}
    for cp in range(0xC0, 0x30000):
        ch = chr(cp)
        if HANGUL <= cp < HANGUL + LEADS * VOWELS * TAILS or 0xD800 <= cp < 0xE000 or ch != ch.lower():
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base != ch and len(base) == 1:
            one[ch] = base
        elif base != ch and base:
            several[ch] = base
    return "".join(one), "".join(one.values()), several


def _spread(text: Column) -> Column:
    """Text with syllables and letters that decompose to several letters written as these."""
    _, _, several = _bases()
    jamo = lambda first, n: F.array(*[F.lit(chr(first + i)) for i in range(n)])
    leads, vowels, tails = jamo(0x1100, LEADS), jamo(0x1161, VOWELS), F.array(F.lit(""), *[F.lit(chr(0x11A8 + i)) for i in range(TAILS - 1)])
    table = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])

    def one(c: Column) -> Column:
        i = F.ascii(c) - HANGUL
        syllable = F.concat(F.get(leads, F.floor(i / (VOWELS * TAILS)).cast("int")), F.get(vowels, F.floor(i / TAILS).cast("int") % VOWELS), F.get(tails, i % TAILS))
        return F.when((i >= 0) & (i < LEADS * VOWELS * TAILS), syllable).otherwise(F.coalesce(F.try_element_at(table, c), c))

    there = "[" + chr(HANGUL) + "-" + chr(HANGUL + LEADS * VOWELS * TAILS - 1) + "".join(several) + "]"
    return F.when((F.octet_length(text) > F.length(text)) & text.rlike(there), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def fold(text: Column) -> Column:
    """Lower case, đ as d, canonically decomposed and without combining marks, for every script."""
    letters, plain, _ = _bases()
    return F.regexp_replace(F.translate(F.lower(_spread(text)), letters, plain), r"\p{Mn}", "")


def tokenize(text: Column) -> Column:
    """Alphanumeric runs and single punctuation marks of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def normalize(text: Column) -> Column:
    """Alphanumeric runs of the folded text, joined by one space."""
    return F.array_join(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def squash(text: Column) -> Column:
    """Lower case with white space collapsed; punctuation stays. The key of exact and labelled dedup."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def sentences(text: Column) -> Column:
    """T4: pieces between sentence ends, trimmed, without empty ones."""
    return F.array_remove(F.transform(F.split(text, ENDS), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), "")


def clauses(text: Column, openers: list[str], known: list[str] = ()) -> Column:
    """T4: sentences cut again before an opening phrase, except inside a known phrase."""
    for phrase in sorted(known, key=len, reverse=True):
        text = F.replace(text, F.lit(phrase), F.lit(phrase.replace(" ", "\x01")))
    pattern = r"\s+(?=(?:" + "|".join(sorted(openers, key=len, reverse=True)) + r")(?![\p{L}\p{N}\x01]))"
    parts = F.flatten(F.transform(sentences(text), lambda s: F.split(s, pattern)))
    return F.array_remove(F.transform(parts, lambda s: F.trim(F.translate(s, "\x01", " "))), "")


def capital_break(text: Column, protected: list[str] = ()) -> Column:
    """T5: in text without sentence ends, a capitalised word starts a sentence unless a protected word precedes it."""
    behind = "".join(rf"(?<!\b{w})" for w in protected)
    return F.when(~text.rlike("[.!?;]"), F.regexp_replace(text, rf"(?<=\S){behind}\s+(?=\p{{Lu}}\p{{Ll}})", ". ")).otherwise(text)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row, however often later steps use it: the optimizer writes a column out
    again wherever it is used in the projections that follow, but not across a generator (here of one row)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def word_grams(words: Column, n: int) -> Column:
    """Distinct n-grams of an array of words, joined by spaces."""

    def made(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return let(words, made)


def uni_and_bigrams(words: Column) -> Column:
    """Distinct words and word pairs of a row."""
    return let(words, lambda w: F.concat(F.array_distinct(w), word_grams(w, 2)))


def prefix_words(words: Column, n: int = 8) -> Column:
    """The first n words, joined."""
    return F.array_join(F.slice(words, 1, n), " ")


def accented(text: Column) -> Column:
    """Whether the text holds a character outside ASCII."""
    return text.rlike(r"[^\x00-\x7F]")


def swapped(a: Column, b: Column) -> Column:
    """Whether b is a with one pair of neighbouring letters swapped."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i, j = F.element_at(at, 1), F.element_at(at, 2)
    cross = (F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))) & (F.substring(a, j, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.when((F.length(a) == F.length(b)) & (F.size(at) == 2), (j == i + 1) & cross).otherwise(False)


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    return (F.levenshtein(a, b, 1) >= 0) | swapped(a, b)


def dropped(word: Column) -> Column:
    """The distinct words that a word becomes by losing one letter."""
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(less)


def swaps(word: Column) -> Column:
    """The other words that a word becomes by swapping two neighbouring letters."""
    n = F.length(word)
    cross = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, n))
    return F.when(n >= 2, F.array_remove(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), cross)), word)).otherwise(F.array().cast("array<string>"))


def deletion_keys(word: Column) -> Column:
    """The word and the word without each of its letters; two words one edit apart share a key."""
    return F.array_distinct(F.array_union(F.array(word), dropped(word)))


def hashed_pieces(tokens: Column, buckets: int = 65535, most: int = 24, limit: int = 160) -> Column:
    """Per token the buckets (1..buckets) of the word and its letter trigrams, `most` at most; `limit` tokens."""

    def pieces(t: Column) -> Column:
        edge = F.concat(F.lit("<"), t, F.lit(">"))
        tri = F.transform(F.sequence(F.lit(1), F.greatest(F.length(edge) - 2, F.lit(1))), lambda i: F.substring(edge, i, F.lit(3)))
        return F.transform(F.slice(F.concat(F.array(t), tri), 1, most), lambda p: F.pmod(F.crc32(p.cast("binary")), F.lit(buckets)) + 1)

    return F.transform(F.slice(tokens, 1, limit), pieces)


def phrase_pattern(phrases: list[str]) -> str:
    """An alternation with word borders in which longer phrases win."""
    special = set(r"\.[]{}()*+?^$|")
    quoted = ["".join("\\" + c if c in special else c for c in p) for p in sorted(phrases, key=lambda p: (-len(p), p))]
    return r"\b(?:" + "|".join(quoted) + r")\b"
