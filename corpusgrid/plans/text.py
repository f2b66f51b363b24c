"""Queries over text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgrid.functions import expr as T
from corpusgrid.plans.registry import query

FOLD = "strip_accents(replace(lower(text), 'đ', 'd'))"
WORDS = f"regexp_extract_all({FOLD}, '[a-z0-9]+')"


@query(f"SELECT doc_id, md5({FOLD}) AS folded FROM documents")
def t1_fold(t):
    return t.documents.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query(rf"SELECT doc_id, len(x) AS n, md5(array_to_string(x, '|')) AS tokens FROM (SELECT doc_id, regexp_extract_all({FOLD}, '[a-z0-9]+|[.,!?;:()\[\]]') x FROM documents)")
def t2_tokenize(t):
    x = t.documents.select("doc_id", T.tokenize(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "|")).alias("tokens"))


@query(f"SELECT doc_id, md5(array_to_string({WORDS}, ' ')) AS normal FROM documents")
def t3_normalize(t):
    return t.documents.select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal"))


@query(r"""
SELECT doc_id, i AS pos, s AS sentence FROM (
  SELECT doc_id, [y for y in [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split_regex(text, '[.!?;()\[\]]')] if y <> ''] l FROM documents
), LATERAL (SELECT unnest(l) s, generate_subscripts(l, 1) i)""")
def t4_sentences(t):
    return t.documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "sentence")


@query(r"""
WITH s AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.!?;()\[\]]')) x FROM documents),
c AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(replace(x, 'and the', 'and' || chr(1) || 'the'), '\s+(and|or|und|et)([^\p{L}\p{N}\x01]|$)', chr(2) || '\1\2', 'g'), '\s+(and|or|und|et)([^\p{L}\p{N}\x01]|$)', chr(2) || '\1\2', 'g'), chr(2))) y FROM s)
SELECT doc_id, count(*) AS clauses FROM c WHERE trim(regexp_replace(y, '\s+', ' ', 'g')) <> '' GROUP BY doc_id""")
def t4_clauses(t):
    return t.documents.select("doc_id", F.explode(T.clauses(F.lower("text"), ["and", "or", "und", "et"], ["and the"]))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"))


@query(r"""
WITH p AS (SELECT p_partkey, p_name || ' Made In Europe by Dr Smith' x FROM part)
SELECT p_partkey, regexp_replace(replace(x, 'Dr Smith', 'Dr' || chr(1) || 'Smith'), '\s+([A-Z][a-z])', '. \1', 'g').replace(chr(1), ' ') AS broken FROM p""")
def t5_capital_break(t):
    x = t.part.select("p_partkey", F.concat("p_name", F.lit(" Made In Europe by Dr Smith")).alias("x"))
    return x.select("p_partkey", T.capital_break(F.col("x"), ["Dr"]).alias("broken"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(w)) g FROM w UNION ALL SELECT doc_id, unnest(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) FROM w WHERE len(w) > 1)
SELECT g AS gram, count(*) AS support FROM g GROUP BY g HAVING count(*) >= 20""")
def t6_ngrams(t):
    g = t.documents.select(F.explode(T.uni_and_bigrams(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("support")).where("support >= 20")


@query(rf"SELECT doc_id, array_to_string(w[1:8], ' ') AS prefix, a AS accented, len(w) AS n FROM (SELECT doc_id, {WORDS} w, regexp_matches(text, '[^\x00-\x7F]') a FROM documents)")
def t7_prefix(t):
    w = t.documents.select("doc_id", F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"), T.accented(F.col("text")).alias("accented"))
    return w.select("doc_id", T.prefix_words(F.col("w")).alias("prefix"), "accented", F.size("w").cast("long").alias("n"))


@query(f"""
WITH w AS (SELECT unnest({WORDS}) w FROM documents), v AS (SELECT w, count(*) n FROM w WHERE length(w) BETWEEN 3 AND 6 GROUP BY w HAVING count(*) >= 20),
k AS (SELECT DISTINCT w, n, unnest(list_append([w[1:i - 1] || w[i + 1:] for i in range(1, length(w) + 1)], w)) k FROM v)
SELECT DISTINCT a.w AS left_word, b.w AS right_word FROM k a JOIN k b ON a.k = b.k AND a.w < b.w WHERE damerau_levenshtein(a.w, b.w) <= 1""")
def t9_one_edit_pairs(t):
    """Frequent words one edit apart, by shared deletion keys."""
    w = t.documents.select(F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    v = w.where("length(w) between 3 and 6").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    k = v.select("w", F.explode(T.deletion_keys(F.col("w"))).alias("k"))
    pairs = k.join(k.withColumnRenamed("w", "v"), "k").where("w < v").select("w", "v").distinct()
    return pairs.where(T.within_one_edit(F.col("w"), F.col("v"))).select(F.col("w").alias("left_word"), F.col("v").alias("right_word"))


@query(rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLD}, '[a-z0-9]+|[.,!?;:()\[\]]')[1:160] x FROM documents), t AS (SELECT doc_id, i - 1 token, x[i] w FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) i FROM d)),
k AS MATERIALIZED (SELECT w, list_concat([w], [('<' || w || '>')[j:j + 2] for j in range(1, greatest(length(w), 1) + 1)])[1:24] l FROM (SELECT DISTINCT w FROM t)),
p AS (SELECT DISTINCT unnest(l) p FROM k),
c AS MATERIALIZED (SELECT p, xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(p[j])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for j in range(1, length(p) + 1)])), lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295) % 65535 + 1 h FROM p),
h AS (SELECT w, count(*) n, sum(h) s, sum(h * i) u FROM (SELECT w, unnest(l) p, unnest(range(1, len(l) + 1)) i FROM k) JOIN c USING (p) GROUP BY w)
SELECT doc_id, count(*) AS tokens, sum(n)::BIGINT AS pieces, sum(s)::BIGINT AS buckets, sum(u * (token + 1))::BIGINT AS digest FROM t JOIN h USING (w) GROUP BY doc_id""")
def t10_hashed_pieces(t):
    """Buckets of the pieces, summed, and summed by their places."""
    pieces = t.documents.select("doc_id", F.posexplode(T.hashed_pieces(T.tokenize(F.col("text")))).alias("token", "pieces"))
    total = lambda f: F.aggregate(F.transform("pieces", f), F.lit(0).cast("long"), lambda a, x: a + x)
    x = pieces.select("doc_id", "token", F.size("pieces").alias("n"), total(lambda b, i: b.cast("long")).alias("s"), total(lambda b, i: b.cast("long") * (i + 1)).alias("u"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("pieces"), F.sum("s").alias("buckets"), F.sum(F.col("u") * (F.col("token") + 1)).alias("digest"))


@query(r"""
SELECT doc_id, len(m) AS n, array_to_string(m, '|') AS found FROM (
  SELECT doc_id, regexp_extract_all(lower(text), '\b(?:gnu general public license|general public license|apache license|license|cc by)\b') m FROM documents) WHERE len(m) > 0""")
def t11_phrases(t):
    pattern = T.phrase_pattern(["license", "general public license", "gnu general public license", "apache license", "cc by"])
    m = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)).alias("m"))
    return m.where("size(m) > 0").select("doc_id", F.size("m").cast("long").alias("n"), F.array_join("m", "|").alias("found"))
