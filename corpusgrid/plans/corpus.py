"""Queries of validation, contracts and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgrid.functions import expr as T
from corpusgrid.operators import contracts as V
from corpusgrid.operators import dedup as D
from corpusgrid.plans.registry import query

SQUASH = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
#: Rules of the driver tables: labels stand for the flags of the corpus rows.
POSITIVE, NEGATIVE = r"worthless|trash|stupid", r"not worthless|no trash"

CORPUS_SQL = rf"""
WITH corpus AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT doc_id, {SQUASH} k, coalesce(quality::VARCHAR, '-') || '/' || coalesce(toxic::VARCHAR, '-') l FROM corpus),
s AS (SELECT doc_id, k, l, min(doc_id) OVER (PARTITION BY k) first_at, arg_min(l, doc_id) OVER (PARTITION BY k) first_l FROM f),
rules AS (
  SELECT doc_id, 'empty_text' AS rule FROM corpus WHERE trim(text) = '' UNION ALL
  SELECT doc_id, 'bad_language' FROM corpus WHERE lang NOT IN ('en', 'de', 'fr', 'es') UNION ALL
  SELECT doc_id, 'too_short' FROM corpus WHERE length(text) < 60 UNION ALL
  SELECT doc_id, CASE WHEN l IS NOT DISTINCT FROM first_l THEN 'duplicate_text' ELSE 'duplicate_text_conflicting_labels' END FROM s WHERE doc_id > first_at)"""


def corpus(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "quality", "toxic")


def triaged(t):
    df = corpus(t)
    hard = {"empty_text": F.trim("text") == "", "bad_language": ~F.col("lang").isin("en", "de", "fr", "es"), "too_short": F.length("text") < 60}
    dup = D.labelled_duplicates(df, T.squash(F.col("text")), F.struct("quality", "toxic"), "doc_id").select("doc_id", "rule")
    return df.withColumn("hard", V.failing(hard)).join(dup, "doc_id", "left").select("doc_id", "hard", F.array_compact(F.array("rule")).alias("suspect"))


@query(CORPUS_SQL + """, n AS (SELECT rule, doc_id, row_number() OVER (PARTITION BY rule ORDER BY doc_id) r FROM rules)
SELECT rule, count(*) AS rows, string_agg(CASE WHEN r <= 5 THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS examples FROM n GROUP BY rule""")
def triage_rule_counts(t):
    """T1, V3, D2, V7 end to end: rule counts with the first examples."""
    x = triaged(t).select("doc_id", F.concat("hard", "suspect").alias("rules"))
    return V.rule_counts(x, "rules", "doc_id")


@query(CORPUS_SQL + """, h AS (SELECT doc_id, count(*) FILTER (rule NOT LIKE 'dup%') h, count(*) FILTER (rule LIKE 'dup%') s FROM rules GROUP BY doc_id)
SELECT CASE WHEN coalesce(h, 0) > 0 THEN 'rejected' WHEN coalesce(s, 0) > 0 THEN 'review' ELSE 'retained' END AS status, count(*) AS n FROM corpus LEFT JOIN h USING (doc_id) GROUP BY 1""")
def v6_triage_status(t):
    return triaged(t).groupBy(V.triage(F.col("hard"), F.col("suspect")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, n, members, low, high FROM (SELECT conv_id, count(*) n, count(DISTINCT turn) members, min(turn) low, max(turn) high FROM conversations GROUP BY conv_id) WHERE members <> n OR low <> 0 OR high <> n - 1 OR n <> 4")
def v1_group_shape(t):
    return V.group_shape(t.conversations, "conv_id", "turn", size=4).select("conv_id", "n", "members", "low", "high")


@query(rf"""
SELECT doc_id, CASE WHEN len(p) > 0 AND len(n) > 0 THEN 'contradictory_cues' WHEN len(p) > 0 AND toxic = 0 THEN 'positive_cue_false_label' WHEN len(n) > 0 AND toxic = 1 THEN 'negative_cue_true_label' END AS rule
FROM (SELECT doc_id, toxic, regexp_extract_all(x, '{NEGATIVE}') n, regexp_extract_all(regexp_replace(x, '{NEGATIVE}', ' ~ ', 'g'), '{POSITIVE}') p FROM (SELECT doc_id, toxic, lower(text) x FROM documents JOIN labels USING (doc_id)))
WHERE (len(p) > 0 AND (len(n) > 0 OR toxic = 0)) OR (len(n) > 0 AND toxic = 1)""")
def v4_cue_suspects(t):
    x = corpus(t).where("toxic is not null").select("doc_id", V.cue_suspects(F.lower("text"), F.col("toxic") == 1, POSITIVE, NEGATIVE).alias("rule"))
    return x.where("rule is not null")


@query(r"SELECT doc_id, regexp_extract(lower(text), '\b(of|to) (is|was|are|be)\b') AS evidence FROM documents WHERE regexp_matches(lower(text), '\b(of|to) (is|was|are|be)\b')")
def v5_awkward(t):
    e = F.regexp_extract(F.lower("text"), r"\b(of|to) (is|was|are|be)\b", 0)
    return t.documents.select("doc_id", e.alias("evidence")).where("evidence <> ''")


@query(r"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' {W}' WHEN 1 THEN ' ' || p_name || ' {W} {L}' WHEN 2 THEN upper(p_name) || ' {Q}' ELSE p_name END x FROM part)
SELECT p_partkey, array_to_string([y for y in [CASE WHEN x <> trim(x) THEN 'not_trimmed' END, CASE WHEN b <> lower(b) THEN 'not_lower_ascii' END,
  CASE WHEN x LIKE '%{Q}%' THEN 'unexpected_placeholder' END, CASE WHEN x NOT LIKE '%{W}%' THEN 'missing_placeholder' END] if y IS NOT NULL], ',') AS problems
FROM (SELECT *, regexp_replace(x, '\{\w+\}', '', 'g') b FROM p)""")
def v8_phrases(t):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.concat("p_name", F.lit(" {W}"))).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(" {W} {L}"))).when(k == 2, F.concat(F.upper("p_name"), F.lit(" {Q}"))).otherwise(F.col("p_name"))
    df = t.part.select("p_partkey", x.alias("x"))
    return df.select("p_partkey", F.array_join(V.phrase_problems(F.col("x"), F.array(F.lit("W"), F.lit("L")), F.array(F.lit("W"))), ",").alias("problems"))


@query("""
WITH b AS (SELECT p_brand, count(*) cur, count(*) FILTER (p_size <= 20) AS added FROM part GROUP BY p_brand)
SELECT p_brand, added, greatest(1, ceil(cur * 0.3))::BIGINT AS least, floor(cur * 0.5)::BIGINT AS most, added BETWEEN greatest(1, ceil(cur * 0.3)) AND floor(cur * 0.5) AS ok FROM b""")
def v9_growth(t):
    b = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("cur"), F.count_if(F.col("p_size") <= 20).alias("added"))
    return V.growth_band(b, "cur", "added").drop("cur")


@query(f"""
WITH d AS (SELECT doc_id, {SQUASH} k FROM documents), e AS (SELECT DISTINCT k FROM d WHERE doc_id % 10 = 0), c AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY k) f FROM d WHERE doc_id % 10 <> 0)
SELECT doc_id, f AS first_at, CASE WHEN k IN (SELECT k FROM e) THEN 'existing' ELSE 'earlier_candidate' END AS problem FROM c WHERE k IN (SELECT k FROM e) OR doc_id > f""")
def v10_candidate_duplicates(t):
    """Two lists from one table: every tenth document is the existing bank, the others are candidates."""
    d = t.documents.select("doc_id", F.sha2(T.squash(F.col("text")), 256).alias("k"))
    return V.candidate_duplicates(d.where("doc_id % 10 <> 0"), d.where("doc_id % 10 = 0"), "k", "doc_id").select("doc_id", "first_at", "problem")


@query("""
WITH h AS (SELECT DISTINCT c_nationkey k FROM customer WHERE c_acctbal > 9000), w AS (SELECT DISTINCT s_nationkey k FROM supplier)
SELECT coalesce(h.k, w.k) AS nationkey, CASE WHEN w.k IS NULL THEN 'unknown' ELSE 'missing' END AS problem FROM h FULL JOIN w ON h.k = w.k WHERE h.k IS NULL OR w.k IS NULL""")
def v11_key_coverage(t):
    return V.key_coverage(t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")), t.supplier.select(F.col("s_nationkey").alias("nationkey")), "nationkey")


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def v12_inventory(t):
    return V.inventory(t.part, "p_brand", "p_type")


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, array_to_string([y for y in [CASE WHEN l.doc_id IS NULL THEN 'no_side' END, CASE WHEN d.doc_id IS NULL THEN 'no_row' END,
  CASE WHEN toxic = 1 AND NOT regexp_matches(lower(text), 'worthless|trash|stupid|idiot|scum|disgusting|moron|clown') THEN 'toxic_without_cue' END] if y IS NOT NULL], ',') AS issues
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR (toxic = 1 AND NOT regexp_matches(lower(text), 'worthless|trash|stupid|idiot|scum|disgusting|moron|clown'))""")
def v13_row_side_contract(t):
    rule = (F.col("toxic") == 1) & ~F.lower("text").rlike("worthless|trash|stupid|idiot|scum|disgusting|moron|clown")
    return V.paired_contract(t.documents.select("doc_id", "text"), t.labels, "doc_id", {"toxic_without_cue": rule}).withColumn("issues", F.array_join("issues", ","))


@query("""
WITH g AS (SELECT l_partkey, count(*) n, count(DISTINCT (l_returnflag = 'R')::INT * 4 + (l_linestatus = 'O')::INT * 2 + (l_quantity > 25)::INT) c, count(DISTINCT l_suppkey) v FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, n, c AS combinations, v AS values FROM g WHERE n <> 8 OR c <> 8 OR v <> 1""")
def v14_factorial(t):
    x = t.lineitem.select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("a"), (F.col("l_linestatus") == "O").alias("b"), (F.col("l_quantity") > 25).alias("c"))
    return V.factorial_groups(x, "l_partkey", ["a", "b", "c"], "l_suppkey")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND NOT (contains(lower(text), 'trash') OR contains(lower(text), 'scum') OR contains(lower(text), 'stupid'))")
def v15_ungrounded(t):
    return corpus(t).where(F.col("toxic") == 1).where(~V.grounded(F.lower("text"), ["trash", "scum", "stupid"])).select("doc_id")


@query("""
WITH m AS (SELECT l_returnflag metric, avg(l_quantity) AS value FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT 'A_low' AS gate, 'A' AS metric, value, value <= 30 AS ok FROM m WHERE metric = 'A' UNION ALL
SELECT 'N_near_A', 'N', n.value, abs(n.value - a.value) <= 0.2 * abs(a.value) FROM m n, m a WHERE n.metric = 'N' AND a.metric = 'A' UNION ALL
SELECT 'R_high', 'R', value, value >= 60 FROM m WHERE metric = 'R' UNION ALL SELECT 'Z_any', 'Z', NULL, false)""")
def v16_gates(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("metric")).agg(F.avg("l_quantity").alias("value"))
    g = t.spark.createDataFrame([("A_low", "A", "<=", 30.0, None), ("N_near_A", "N", "within", 0.2, "A"), ("R_high", "R", ">=", 60.0, None), ("Z_any", "Z", ">=", 0.0, None)], "gate string, metric string, op string, bound double, relative_to string")
    return V.gates(m, g)


@query("""
WITH p AS (SELECT p_partkey, p_size - 2 AS step, p_partkey % 7 - 3 AS crowded, p_partkey % 5 - 2 AS covered, p_partkey % 3 AS stairs, p_partkey % 4 - 1 AS turn, p_partkey % 6 - 2 AS left_turn, p_partkey % 9 - 3 AS right_turn, 1 AS u_turn FROM part)
SELECT p_partkey FROM p WHERE step + least(0, crowded, covered, stairs) + least(0, left_turn, right_turn, u_turn) + least(0, turn) <= 0""")
def v17_profiles(t):
    k = F.col("p_partkey")
    p = t.part.select("p_partkey", (F.col("p_size") - 2).alias("step"), (k % 7 - 3).alias("crowded"), (k % 5 - 2).alias("covered"), (k % 3).alias("stairs"), (k % 4 - 1).alias("turn"), (k % 6 - 2).alias("left_turn"), (k % 9 - 3).alias("right_turn"), F.lit(1).alias("u_turn"))
    return V.positive_profiles(p).select("p_partkey")


@query(r"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), 'all rights reserved') THEN 'known_bad' WHEN n < 8 THEN 'short' WHEN n > 160 THEN 'long' END AS reason
FROM (SELECT text, len(regexp_extract_all(text, '\S+')) n FROM documents)) WHERE reason IS NOT NULL GROUP BY reason""")
def v18_reasons(t):
    x = t.documents.select("text", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    r = V.first_reason({"known_bad": F.lower("text").rlike("all rights reserved"), "short": F.col("n") < 8, "long": F.col("n") > 160})
    return x.select(r.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {SQUASH}")
def d1_keep_first(t):
    return D.keep_first(t.documents.select("doc_id", "text"), T.squash(F.col("text")), "doc_id").select("doc_id")


@query(CORPUS_SQL + " SELECT doc_id, first_at, CASE WHEN l IS NOT DISTINCT FROM first_l THEN 'duplicate_text' ELSE 'duplicate_text_conflicting_labels' END AS rule FROM s WHERE doc_id > first_at")
def d2_labelled_duplicates(t):
    return D.labelled_duplicates(corpus(t), T.squash(F.col("text")), F.struct("quality", "toxic"), "doc_id")


@query("SELECT c_nationkey, c_custkey, 'duplicate_id' AS problem FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) r FROM customer) WHERE r > 1")
def d3_id_problems(t):
    return D.id_problems(t.customer, "c_nationkey", "c_custkey")


@query(f"WITH k AS (SELECT {SQUASH} k FROM documents WHERE source IN ('src1', 'src2') UNION SELECT {SQUASH} FROM benchmark) SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') AND {SQUASH} NOT IN (SELECT k FROM k)")
def d4_exclude_known(t):
    """Two sources and the benchmark are the reference corpora."""
    d = t.documents.select("doc_id", "text", "source")
    h = F.sha2(T.squash(F.col("text")), 256).alias("_k")
    return D.exclude_known(d.where(~F.col("source").isin("src1", "src2")), T.squash(F.col("text")), [d.where(F.col("source").isin("src1", "src2")).select(h), t.benchmark.select(h)]).select("doc_id")


@query(f"""
WITH d AS (SELECT DISTINCT source, {SQUASH} k FROM documents), p AS (SELECT DISTINCT lang probe, {SQUASH} k FROM documents UNION SELECT 'benchmark', {SQUASH} FROM benchmark),
h AS (SELECT probe, source corpus, count(*) n FROM p JOIN d USING (k) GROUP BY ALL)
SELECT probe, corpus, coalesce(n, 0) AS overlap FROM (SELECT DISTINCT probe FROM p) CROSS JOIN (SELECT DISTINCT source corpus FROM d) LEFT JOIN h USING (probe, corpus)""")
def d5_overlap_report(t):
    k = F.sha2(T.squash(F.col("text")), 256).alias("k")
    probes = t.documents.select(F.col("lang").alias("probe"), k).unionByName(t.benchmark.select(F.lit("benchmark").alias("probe"), k))
    return D.overlap_report(probes, t.documents.select(F.col("source").alias("corpus"), k))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY string_split(lower(text), ' ')[1] ORDER BY doc_id) r FROM documents) WHERE r <= 5")
def d6_prefix_cap(t):
    return D.prefix_cap(t.documents.select("doc_id", "text"), F.element_at(F.split(F.lower("text"), " "), 1), "doc_id", 5).select("doc_id")


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END s FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'quarantined' WHEN a.s = o.o_orderstatus THEN 'retained' ELSE 'altered' END AS state FROM orders o LEFT JOIN a ON a.o_orderkey = o.o_orderkey""")
def d7_reconcile(t):
    """The subset is derived from the orders: a third left out, some altered."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    sub = o.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return D.reconcile(sub, o, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("""
WITH x AS (SELECT s_suppkey, s_nationkey k, s_nationkey % 5 g, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) n FROM supplier),
y AS (SELECT c_custkey, c_nationkey k, c_nationkey % 5 g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) n FROM customer WHERE c_acctbal < 200),
e AS (SELECT s_suppkey, c_custkey FROM x JOIN y USING (k, n)),
l AS (SELECT s_suppkey, g, row_number() OVER (PARTITION BY g ORDER BY s_suppkey) n FROM x WHERE s_suppkey NOT IN (SELECT s_suppkey FROM e)),
m AS (SELECT c_custkey, g, row_number() OVER (PARTITION BY g ORDER BY c_custkey) n FROM y WHERE c_custkey NOT IN (SELECT c_custkey FROM e))
SELECT s_suppkey, c_custkey, 'exact' AS how FROM e UNION ALL SELECT s_suppkey, c_custkey, CASE WHEN c_custkey IS NULL THEN 'quarantined' ELSE 'fallback' END FROM l LEFT JOIN m USING (g, n)""")
def d8_swap_replace(t):
    new = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_nationkey") % 5).alias("g"))
    old = t.customer.where("c_acctbal < 200").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_nationkey") % 5).alias("g"))
    return D.swap_replace(old, new, "k", "g", "c_custkey", "s_suppkey")
