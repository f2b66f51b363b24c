"""Quality rules with risk-controlled cutoffs, all in DataFrame expressions.

Each rule is a ratio of a document; a rule rejects a document whose ratio exceeds the cutoff of the document's stratum.
A cutoff may be used only if the labelled documents certify it: with n good labelled documents in the stratum, k of
them above the cutoff, and alpha the false rejections allowed to the rule, the exact binomial tail
P(Bin(n, alpha) <= k) must not exceed delta divided by the number of hypotheses (Bonferroni over strata, rules and
cutoffs). So, with probability 1 - delta, no stratum loses more than alpha of its good documents to all rules together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.text import let, words
from corpusgrid.session import broadcast_if_small, stage

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "capital_ratio")
#: Candidate cutoffs of every rule: fixed before any label is seen, so that the correction covers the search.
CUTOFFS = tuple(round(0.02 * 1.25**j, 6) for j in range(18))
ALPHA, DELTA, GOOD_WEIGHT = 0.05, 0.05, 4.0
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice in the array of window hashes."""

    def covered(pairs: Column) -> Column:
        twice = F.transform(
            pairs,
            lambda x, k: F.when(
                F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        )
        return F.aggregate(
            F.sort_array(F.filter(twice, lambda i: i.isNotNull())),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts of every whole text, in one pass without a shuffle.

    Windows of five words are compared inside the row: as a set of 64-bit hashes first, and sorted only in rows where
    that set is smaller than the list. A text with fewer than five words has no window. Null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, text.alias("_t"))
    df = df.withColumns({"_w": words(F.col("_t")), "_l": lines})
    df = df.withColumn("n_words", F.size("_w"))
    grams = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(WINDOW)]),
    )
    df = df.withColumn("_h", F.when(F.col("n_words") >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")))
    has = F.size(F.array_distinct("_h")) < F.size("_h")
    return df.select(
        *keep,
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _without(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(has, _repeated(F.col("_h"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _without(F.col("_t"), CAPITALS).cast("long").alias("n_capitals"),
    )


def ratios() -> dict[str, Column]:
    """The rules' ratios over the columns of features()."""
    c = F.col
    return {
        "symbol_ratio": c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
        "dup_line_ratio": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "repeat_ratio": c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
        "capital_ratio": c("n_capitals") / F.greatest(c("word_chars"), F.lit(1)),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below n * p, summed term by term in logarithms; 1 where k is not below it."""
    odds = F.log(F.lit(p / (1 - p)))
    start = n * F.log(F.lit(1 - p))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(start.alias("t"), F.lit(0.0).alias("s")),
        lambda acc, j: let(
            F.when(j == 0, start).otherwise(acc["t"] + F.log((n - j + 1).cast("double")) - F.log(F.greatest(j, F.lit(1)).cast("double")) + odds),
            lambda t: F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s")),
        ),
        lambda acc: acc["s"],
    )
    return F.when(k < n * F.lit(p), tail).otherwise(F.lit(1.0))


def select_cutoffs(
    scored: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA,
    cutoffs: tuple[float, ...] = CUTOFFS, good_weight: float = GOOD_WEIGHT,
) -> DataFrame:
    """Certified cutoff of each (stratum, rule); no row where none is certified or none rejects more bad than good.

    A label with a null quality or doc_id is ignored; of several labels of a document the lowest counts. Among
    certified cutoffs the one with the largest (bad rejected - good_weight * good rejected) wins, ties go to the
    larger cutoff. Returns stratum, rule, cutoff.
    """
    labelled = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    grid = F.array(*[F.lit(c) for c in cutoffs])
    above = lambda v: F.size(F.filter(grid, lambda c: v > c))
    rows = scored.join(labelled, "doc_id").select(
        F.col(stratum).alias("stratum"),
        (F.col("quality") > 0).alias("good"),
        F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), above(F.col(r)))])).alias("rule", "level"),
    )
    counts = rows.groupBy("stratum", "rule", "level").agg(
        F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    # cutoff j rejects what lies above it: levels j + 1 and more
    each = counts.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("level", "good", "bad")).alias("at")
    )
    hypotheses = each.groupBy().agg((F.count_distinct(F.struct(F.coalesce("stratum", F.lit("")), F.col("stratum").isNull())) * len(RULES) * len(cutoffs)).alias("m"))
    tests = each.join(F.broadcast(hypotheses)).select("stratum", "rule", "n", "m", "at", F.posexplode(grid).alias("j", "cutoff"))
    total = lambda field: F.aggregate(
        F.filter("at", lambda x: x["level"] > F.col("j")), F.lit(0).cast("long"), lambda a, x: a + x[field]
    )
    tests = tests.withColumns({"k": total("good"), "b": total("bad")})
    tests = tests.withColumn("p", binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)))
    net = F.col("b") - F.lit(good_weight) * F.col("k")
    best = Window.partitionBy("stratum", "rule").orderBy(net.desc(), F.col("cutoff").desc())
    return (
        tests.where((F.col("p") <= F.lit(delta) / F.col("m")) & (net > 0))
        .withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .select("stratum", "rule", "cutoff")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **params) -> DataFrame:
    """One row per document: its counts, base_failed, rejected_by (sorted rule names) and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated five-word windows. kept: not base_failed
    and above no certified cutoff of its stratum. Null text counts as empty (so it fails); a null stratum is a stratum
    of its own; repeated rows each give a row; empty tables give no rows; other columns are ignored.
    """
    scored = stage(features(docs, tuple(dict.fromkeys(("doc_id", stratum)))).withColumns(ratios()), "quality")
    chosen = stage(select_cutoffs(scored, labels, stratum, **params).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")), "cutoffs")
    out = scored.join(broadcast_if_small(chosen), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    rejected = F.array_sort(F.filter(F.array(*[F.when(F.col(r) > F.col("cut")[r], F.lit(r)) for r in RULES]), lambda x: x.isNotNull()))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size(rejected) == 0)).alias("kept"), rejected.alias("rejected_by"),
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through quality_rules with the labels' rows; nulls, ties, repeats and empty tables as told there."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, labels).withColumn("rejected_by", F.array_join("rejected_by", ","))


def _oracle() -> str:
    ratio = {"symbol_ratio": "n_symbols / greatest(word_chars, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)", "capital_ratio": "n_capitals / greatest(word_chars, 1)"}
    long = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {x} AS v FROM q" for r, x in ratio.items())
    p = ALPHA / len(RULES)
    return rf"""
WITH f AS (SELECT doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM f)),
c AS (SELECT doc_id, count(DISTINCT i + k) n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1), (SELECT unnest(range(5)) k) GROUP BY doc_id),
q AS (SELECT f.doc_id, lang, len(w) n_words, length(array_to_string(w, '')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
  coalesce(c.n, 0) n_repeat_words, len(l) n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) n_capitals FROM f LEFT JOIN c USING (doc_id)),
ratios AS MATERIALIZED ({long}),
labelled AS (SELECT doc_id, min(quality) > 0 good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
r AS (SELECT lang, rule, v, good FROM ratios JOIN labelled USING (doc_id)),
k AS (SELECT lang, rule, cutoff, count(*) FILTER (good) n, count(*) FILTER (good AND v > cutoff) k, count(*) FILTER (NOT good AND v > cutoff) b FROM r, (SELECT unnest({list(CUTOFFS)}) cutoff) GROUP BY ALL),
t AS (SELECT *, CASE WHEN k < n * {p} THEN list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln({1 - p})) for j in range(0, k + 1)]) ELSE 1 END p FROM k),
h AS (SELECT lang, rule, cutoff FROM t WHERE p <= {DELTA} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM r)) * {len(RULES) * len(CUTOFFS)}) AND b > {GOOD_WEIGHT} * k
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY b - {GOOD_WEIGHT} * k DESC, cutoff DESC) = 1),
x AS (SELECT doc_id, string_agg(DISTINCT a.rule, ',' ORDER BY a.rule) rejected_by FROM ratios a JOIN h ON h.lang IS NOT DISTINCT FROM a.lang AND h.rule = a.rule AND a.v > h.cutoff GROUP BY doc_id),
y AS (SELECT q.*, coalesce(rejected_by, '') rejected_by, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM q LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM y"""


ORACLE_SQL = _oracle()
