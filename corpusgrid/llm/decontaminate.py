"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Index: the postings (term, document, position) of every training word that some test item has, staged once with a header
row for each document. Words of no item can be in no match, so they are not stored.

Search: a phrase (a window of item words) starts at the postings of its rarest term; its start in the document is the
posting's position less the term's offset. The offset-adjusted list of its second rarest term is intersected with these
candidates by an equi-join on (document, position, term), and what is left meets the other terms' lists, restricted to
the documents that still have a candidate. With slop, a term may stand up to that many places from where the rarest term
puts it: candidates then meet the places around, which gives proximity matches. Joins have (document, position) in their
keys, so neither a frequent term nor a frequent passage meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.text import lowered
from corpusgrid.session import broadcast_if_small, stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; an item of fewer is one window. Places that a word may stand off in a proximity match.
WINDOW, NEAR = 10, 2


def _words(text):
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, words: the distinct windows of each item. Items without words have none; a null item_id counts as ''."""
    n = F.size("_w")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)))
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), _words(F.col("text")).alias("_w"))
    return cut.select("item_id", "_w", F.explode(starts).alias("_s")).select("item_id", F.slice("_w", F.col("_s"), size).alias("words")).distinct()


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, doc_id, pos, t: a posting for each word of the vocabulary (term, t); a row with null t and the number of
    words as pos for each document, the only one that has its doc_id. Null text has no words."""
    words = F.concat(_words(F.col("text")), F.array(F.lit(None).cast("string")))
    df = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # numbered before the words are dealt out
    df = df.select("row", "doc_id", F.posexplode(words).alias("pos", "term"))
    df = df.join(broadcast_if_small(vocabulary), "term", "left").where("term is null or t is not null")
    return df.select("row", F.when(F.col("t").isNull(), F.col("doc_id")).alias("doc_id"), "pos", "t")


def search(postings: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """row, phrase, start, size: where the words of a phrase (phrase, terms: ids in order) stand, each within slop places
    of where the phrase's rarest term puts it; exact phrases for slop 0. postings: row, pos, t."""
    found = postings.where("t is not null").select("row", "pos", "t")
    counts = stage(found.groupBy("t").agg(F.count(F.lit(1)).alias("_n")), "counts")
    each = phrases.select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "t"))
    by_rarity = F.row_number().over(Window.partitionBy("phrase").orderBy("_n", "off"))
    each = each.join(broadcast_if_small(counts), "t", "left").withColumn("rarity", by_rarity)  # a term without postings comes first
    each = stage(each.select("phrase", "size", "off", "t", "rarity"), "phrase_terms")
    reach = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    term = lambda low, high: broadcast_if_small(each.where(F.col("rarity").between(low, high)).drop("rarity", "size"))

    def meet(candidates: DataFrame, low: int, high: int, lists: DataFrame) -> DataFrame:
        """Candidates for which every one of their terms of these rarities stands where it should."""
        wanted = candidates.join(term(low, high), "phrase").withColumn("_d", reach).withColumn("pos", F.col("start") + F.col("off") + F.col("_d"))
        kept = wanted.join(lists, ["row", "pos", "t"]).groupBy("row", "phrase", "start", "size").agg(F.count_distinct("off").alias("_k"))
        return kept.where(F.col("_k") == F.least(F.col("size"), F.lit(high)) - low + 1).drop("_k")

    first = found.join(broadcast_if_small(each.where("rarity = 1").drop("rarity")), "t")
    first = first.select("row", "phrase", (F.col("pos") - F.col("off")).alias("start"), "size").where(F.col("start") >= -slop)
    second = broadcast_if_small(stage(each.where("rarity = 2").select("t").distinct(), "second"))
    some = stage(meet(first.where("size > 1"), 2, 2, found.join(second, "t", "left_semi")).unionByName(first.where("size = 1")), "candidates")
    rows = broadcast_if_small(stage(some.where("size > 2").select("row").distinct(), "rows"))
    rest = meet(some.where("size > 2"), 3, 1 << 30, found.join(rows, "row", "left_semi"))
    return rest.unionByName(some.where("size <= 2"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: int = NEAR) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near: a row for each row of docs.

    A word inside any occurrence of a window of an item is hit. n_near counts the items of which a window stands exactly
    or nearly, each word within `near` places of where the window's rarest one puts it; it decides nothing else. Null texts have no words; rows that repeat a doc_id are
    documents of their own; repeated items are one, a null item_id counts as ''; empty tables give no rows or no hits;
    other columns are not read.
    """
    cut = stage(windows(items, size), "windows")
    vocabulary = stage(cut.select(F.explode("words").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "vocabulary")
    phrases = stage(cut.groupBy("words").agg(F.collect_set("item_id").alias("ids")).withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    numbered = phrases.select("phrase", F.posexplode("words").alias("off", "term")).join(broadcast_if_small(vocabulary), "term")
    numbered = numbered.groupBy("phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "t"))), lambda x: x["t"]).alias("terms"))
    postings = stage(index(docs, vocabulary), "postings")
    numbered = stage(numbered, "numbered")
    matches = stage(search(postings, numbered), "matches")
    close = search(postings, numbered, near).select("row", "phrase").distinct()
    hit = matches.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = broadcast_if_small(phrases.select("phrase", "ids"))
    items_of = lambda df: df.join(ids, "phrase").select("row", F.explode("ids").alias("item_id")).distinct()
    about = items_of(close).groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    named = items_of(matches.select("row", "phrase").distinct())
    named = named.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("_ids"))
    found = postings.where("t is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words")).join(hit.join(named, "row"), "row", "left").join(about, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_words", none("n_hit"), none("n_items"), F.sha2(F.coalesce("_ids", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), none("n_near"))


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every row of documents against every item of benchmark through decontaminate; edge cases as told there."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () id, doc_id, {_CUT} w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') item_id, {_CUT} w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) size, array_to_string(list_slice(w, s, s + {WINDOW} - 1), ' ') phrase FROM (SELECT *, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) s FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM x),
g AS (SELECT id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') phrase FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) s FROM d, z)),
m AS (SELECT id, size, s, item_id FROM g JOIN x USING (size, phrase)),
h AS (SELECT id, count(DISTINCT p) n_hit FROM (SELECT id, unnest(range(s, s + size)) p FROM m) GROUP BY id),
wt AS (SELECT phrase, size, o - 1 off, string_split(phrase, ' ')[o] word FROM (SELECT *, unnest(range(1, size + 1)) o FROM (SELECT DISTINCT phrase, size FROM x))),
po AS (SELECT id, i - 1 pos, w[i] word FROM (SELECT id, w, unnest(range(1, len(w) + 1)) i FROM d)), vp AS (SELECT * FROM po SEMI JOIN wt USING (word)), cn AS (SELECT word, count(*) n FROM vp GROUP BY word),
an AS (SELECT phrase, size, off, word FROM wt LEFT JOIN cn USING (word) QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY n NULLS FIRST, off) = 1),
ca AS (SELECT id, phrase, size, pos - off start, off a FROM vp JOIN an USING (word) WHERE pos - off >= -{NEAR}),
ok AS (SELECT ca.id, ca.phrase FROM ca JOIN wt ON wt.phrase = ca.phrase AND wt.off <> a JOIN vp ON vp.id = ca.id AND vp.word = wt.word AND vp.pos BETWEEN start + wt.off - {NEAR} AND start + wt.off + {NEAR}
  GROUP BY ca.id, ca.phrase, start, ca.size HAVING count(DISTINCT wt.off) = ca.size - 1 UNION ALL SELECT id, phrase FROM ca WHERE size = 1),
nr AS (SELECT id, count(DISTINCT item_id) n_near FROM ok JOIN x USING (phrase) GROUP BY id),
n AS (SELECT id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) ids FROM m GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (id) LEFT JOIN n USING (id) LEFT JOIN nr USING (id)"""
