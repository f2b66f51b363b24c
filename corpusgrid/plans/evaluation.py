"""Queries of metrics. lineitem stands for predictions: group l_linenumber, truth l_returnflag, prediction by arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgrid.functions import expr as T
from corpusgrid.operators import metrics as A
from corpusgrid.plans.registry import query
from corpusgrid.plans.text import WORDS

PRED = "CASE (l_partkey + l_suppkey) % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'R' ELSE 'A' END"
P = f"WITH p AS (SELECT *, {PRED} AS pred, l_returnflag = {PRED} AS ok, l_returnflag = (CASE l_orderkey % 2 WHEN 0 THEN 'N' ELSE 'R' END) AS ok2 FROM lineitem) "
C = "WITH c AS (SELECT d.*, l.quality, l.toxic, regexp_matches(lower(text), 'trash|scum|stupid') cue, len(string_split(text, ' ')) n FROM documents d JOIN labels l USING (doc_id)) "


def predictions(t):
    k = (F.col("l_partkey") + F.col("l_suppkey")) % 3
    pred = F.when(k == 0, "N").when(k == 1, "R").otherwise("A")
    second = F.when(F.col("l_orderkey") % 2 == 0, "N").otherwise("R")
    return t.lineitem.withColumns({"pred": pred, "ok": F.col("l_returnflag") == pred, "ok2": F.col("l_returnflag") == second})


def labelled(t):
    d = t.documents.join(t.labels, "doc_id")
    return d.withColumns({"cue": F.lower("text").rlike("trash|scum|stupid"), "n": F.size(F.split("text", " ")).cast("long")})


@query(P + "SELECT avg(a) AS macro, count(*) AS groups FROM (SELECT avg(ok::INT) a FROM p GROUP BY l_linenumber)")
def a1_macro_accuracy(t):
    return A.macro_accuracy(predictions(t), "l_linenumber", F.col("ok"))


@query("""
WITH n AS (SELECT l_linenumber, l_returnflag, count(*) n, min(l_orderkey) f FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY ALL),
m AS (SELECT l_linenumber, l_returnflag majority FROM n QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY n DESC, f) = 1)
SELECT l_linenumber, any_value(majority) AS majority, avg((l_returnflag = majority)::INT) AS accuracy FROM lineitem JOIN m USING (l_linenumber) WHERE l_orderkey % 4 = 0 GROUP BY l_linenumber""")
def a2_majority_baseline(t):
    """A quarter of the orders is the validation set."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return A.majority_baseline(li.where("l_orderkey % 4 <> 0"), li.where("l_orderkey % 4 = 0"), "l_linenumber", "l_returnflag", "l_orderkey")


@query(P + "SELECT l_linestatus AS scenario, l_linenumber AS member, l_quantity > 25 AS exact, avg(ok::INT) AS accuracy, count(*) AS n FROM p GROUP BY GROUPING SETS ((l_linestatus), (l_linestatus, l_linenumber), (l_linestatus, l_quantity > 25))")
def a3_ablation(t):
    return A.ablation(predictions(t).withColumn("big", F.col("l_quantity") > 25), "l_linestatus", "l_linenumber", "big", F.col("ok"))


@query(P + """SELECT s AS slice, count(ok) AS n, avg(ok::INT) AS accuracy FROM (VALUES ('all'), ('open'), ('cheap'), ('none')) v(s)
LEFT JOIN p ON s = 'all' OR (s = 'open' AND l_linestatus = 'O') OR (s = 'cheap' AND l_extendedprice < 2000) OR (s = 'none' AND l_quantity < 0) GROUP BY s""")
def a4_slices(t):
    return A.slices(predictions(t), {"all": F.lit(True), "open": F.col("l_linestatus") == "O", "cheap": F.col("l_extendedprice") < 2000, "none": F.col("l_quantity") < 0}, F.col("ok"))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey g, l_partkey k FROM lineitem WHERE l_linenumber <> 2), b AS (SELECT DISTINCT l_orderkey g, l_partkey k FROM lineitem WHERE l_quantity > 5),
j AS (SELECT coalesce(a.g, b.g) g, a.k IS NOT NULL p, b.k IS NOT NULL t FROM a FULL JOIN b ON a.g = b.g AND a.k = b.k)
SELECT count(*) AS groups, avg((e)::INT) AS exact_rate, sum(b) / sum(p) AS precision, sum(b) / sum(t) AS recall FROM (SELECT g, bool_and(p AND t) e, count(*) FILTER (p AND t) b, count(*) FILTER (p) p, count(*) FILTER (t) t FROM j GROUP BY g)""")
def a5_set_report(t):
    """Predicted against true sets of parts of an order."""
    li = t.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("k"), "l_linenumber", "l_quantity")
    m = A.set_match(li.where("l_linenumber <> 2"), li.where("l_quantity > 5"), ["k"], "g", 2 * t.lineitem.count())
    return m.agg(F.count(F.lit(1)).alias("groups"), A.rate(F.col("exact")).alias("exact_rate"), (F.sum("both") / F.sum("pred")).alias("precision"), (F.sum("both") / F.sum("true")).alias("recall"))


@query(P + "SELECT l_linestatus AS style, avg(ok::INT) AS accuracy, count(*) AS n, quantile_cont(l_quantity, 0.95) AS p95 FROM p GROUP BY ROLLUP (l_linestatus)")
def a6_by_style(t):
    return predictions(t).rollup(F.col("l_linestatus").alias("style")).agg(A.rate(F.col("ok")).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.percentile("l_quantity", 0.95).alias("p95"))


@query("""
SELECT avg((quality IS NULL OR quality IS NOT DISTINCT FROM q)::INT) AS quality, avg((toxic IS NULL OR toxic IS NOT DISTINCT FROM x)::INT) AS toxic,
avg(((quality IS NULL OR quality IS NOT DISTINCT FROM q) AND (toxic IS NULL OR toxic IS NOT DISTINCT FROM x))::INT) AS all_fields, count(*) AS n
FROM (SELECT quality, toxic, (length(text) > 500)::INT q, regexp_matches(lower(text), 'trash|scum|stupid')::INT x FROM documents LEFT JOIN labels USING (doc_id))""")
def a7_field_match(t):
    x = t.documents.join(t.labels, "doc_id", "left").withColumns({"q": (F.length("text") > 500).cast("int"), "x": F.lower("text").rlike("trash|scum|stupid").cast("int")})
    return A.field_match(x, [("quality", "q"), ("toxic", "x")])


@query(C + """SELECT lang, tp, fp, fn, tn, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced,
1 - tn / nullif(tn + fp, 0) AS fp_rate, 1 - tp / nullif(tp + fn, 0) AS miss_rate FROM (SELECT lang, count(*) FILTER (toxic = 1 AND cue) tp, count(*) FILTER (toxic = 0 AND cue) fp, count(*) FILTER (toxic = 1 AND NOT cue) fn, count(*) FILTER (toxic = 0 AND NOT cue) tn FROM c GROUP BY lang)""")
def a8_confusion(t):
    """A8 and A9 of a cue rule against the toxic label, per language."""
    return A.confusion(labelled(t), F.col("toxic") == 1, F.col("cue"), "lang")


@query(P + "SELECT b AS bucket, count(*) AS n, avg(ok::INT) AS accuracy FROM (SELECT ok, unnest([x for x in [CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount > 0.05 THEN 'discount' END, 'line' || l_linenumber] if x IS NOT NULL]) b FROM p) GROUP BY b HAVING count(*) >= 25")
def a10_subgroups(t):
    b = F.array_compact(F.array(F.when(F.col("l_quantity") > 40, "large"), F.when(F.col("l_discount") > 0.05, "discount"), F.concat(F.lit("line"), "l_linenumber")))
    return predictions(t).select("ok", F.explode(b).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), A.rate(F.col("ok")).alias("accuracy")).where("n >= 25")


@query(P + """SELECT l_linenumber, n, wins, losses, d AS delta, d - 1.96 * se AS low, d + 1.96 * se AS high FROM (SELECT *, sqrt(greatest(0, (wins + losses) / n - d * d) / n) se FROM (SELECT *, (wins - losses) / n d FROM
(SELECT l_linenumber, count(*) n, count(*) FILTER (NOT ok AND ok2) wins, count(*) FILTER (ok AND NOT ok2) losses FROM p GROUP BY l_linenumber)))""")
def a11_paired(t):
    return A.paired(predictions(t), F.col("ok"), F.col("ok2"), "l_linenumber")


@query("""WITH d AS (SELECT p_partkey, p_partkey % 12 AS b, p_size % 9 AS c FROM part)
SELECT p_partkey, round(1048576 * CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) for i in range(0, least(b, c) + 1)])) END)::BIGINT AS p_scaled FROM d""")
def a12_mcnemar(t):
    """p in units of 2 ** -20, in which it is whole for up to 20 discordant rows."""
    x = t.part.select("p_partkey", (F.col("p_partkey") % 12).alias("b"), (F.col("p_size") % 9).alias("c"))
    return x.select("p_partkey", F.round(A.mcnemar(F.col("b"), F.col("c")) * 1048576).cast("long").alias("p_scaled"))


@query(P + "SELECT outcome, n, rows FROM (SELECT outcome, count(*) n, string_agg(CASE WHEN r <= 20 THEN l_orderkey || '-' || l_linenumber END, ',' ORDER BY l_orderkey, l_linenumber) AS rows FROM (SELECT *, CASE WHEN ok2 THEN 'fixed' ELSE 'regressed' END outcome, row_number() OVER (PARTITION BY ok2 ORDER BY l_orderkey, l_linenumber) r FROM p WHERE ok <> ok2) GROUP BY outcome)")
def a13_discordant(t):
    from pyspark.sql import Window

    x = predictions(t).where("ok <> ok2").select(F.when(F.col("ok2"), "fixed").otherwise("regressed").alias("outcome"), "l_orderkey", "l_linenumber")
    n = x.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    top = x.withColumn("r", F.row_number().over(Window.partitionBy("outcome").orderBy("l_orderkey", "l_linenumber"))).where("r <= 20")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda s: F.concat(s["l_orderkey"], F.lit("-"), s["l_linenumber"])), ",")
    return n.join(top.groupBy("outcome").agg(rows.alias("rows")), "outcome")


@query(P + "SELECT count(*) AS groups, avg(e::INT) AS all_right, avg(s) AS mean_share FROM (SELECT bool_and(ok) e, avg(ok::INT) s FROM p GROUP BY l_orderkey)")
def a14_all_of_group(t):
    """A14 and A15 over the lines of an order."""
    return A.all_of_group(predictions(t), "l_orderkey", F.col("ok"))


@query("SELECT l_linenumber, count(*) AS n, avg(v) AS mean, min(v) AS low, max(v) AS high, stddev_samp(v) AS sd, count(*) FILTER (v > 0) AS positive, count(*) FILTER (v < 0) AS negative FROM (SELECT l_linenumber, l_suppkey, avg(l_quantity) - 25 v FROM lineitem GROUP BY ALL) GROUP BY l_linenumber")
def a16_stability(t):
    x = t.lineitem.groupBy("l_linenumber", "l_suppkey").agg((F.avg("l_quantity") - 25).alias("v"))
    return A.stability(x, "l_linenumber", "v")


@query("""WITH c AS (SELECT l_orderkey g, l_linenumber a, (l_partkey * 7 + l_linenumber) % 5 cost, l_orderkey % 4 + 1 label FROM lineitem), m AS (SELECT *, min(cost) OVER (PARTITION BY g) m FROM c)
SELECT g AS row, count(*) > 1 AS tied, max((a = label)::INT)::DOUBLE / count(*) AS score FROM m WHERE cost = m GROUP BY g""")
def a17_tie_scores(t):
    x = t.lineitem.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("a"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 5).alias("cost"), (F.col("l_orderkey") % 4 + 1).alias("label"))
    return A.tie_scores(x, "row", "cost", "a", "label")


@query("""WITH c AS (SELECT l_orderkey g, l_suppkey % 6 pr, l_linenumber a, (l_partkey * 7 + l_linenumber) % 5 cost, l_orderkey % 4 + 1 label FROM lineitem), m AS (SELECT *, min(cost) OVER (PARTITION BY g, pr) m FROM c)
SELECT count(*) AS rows, avg(covered::INT) AS coverage FROM (SELECT g, bool_or(cost = m AND a = label) covered FROM m GROUP BY g)""")
def a18_profile_coverage(t):
    from pyspark.sql import Window

    x = t.lineitem.select(F.col("l_orderkey").alias("g"), (F.col("l_suppkey") % 6).alias("pr"), F.col("l_linenumber").alias("a"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 5).alias("cost"), (F.col("l_orderkey") % 4 + 1).alias("label"))
    x = x.withColumn("m", F.min("cost").over(Window.partitionBy("g", "pr")))
    return x.groupBy("g").agg(F.bool_or((F.col("cost") == F.col("m")) & (F.col("a") == F.col("label"))).alias("c")).agg(F.count(F.lit(1)).alias("rows"), A.rate(F.col("c")).alias("coverage"))


def submissions(t):
    o = t.orders.select((F.col("o_orderkey") - 1).alias("pos"), "o_orderkey")
    return o.select("pos", (F.col("o_orderkey") % 4).alias("action")), o.select("pos", F.when(F.col("o_orderkey") % 13 == 0, (F.col("o_orderkey") + 1) % 4).otherwise(F.col("o_orderkey") % 4).alias("action"))


S = "WITH s AS (SELECT o_orderkey - 1 pos, (o_orderkey - 1) // 10 scene, o_orderkey % 13 = 0 c FROM orders) "


@query(S + "SELECT pos % 10 AS robot, count(*) AS n, count(*) FILTER (c) AS changed, count(DISTINCT CASE WHEN c THEN scene END) AS scenes FROM s GROUP BY ROLLUP (pos % 10)")
def a19_submission_diff(t):
    return A.submission_diff(*submissions(t), "pos", "action")


@query(S + "SELECT b AS bound, greatest(0, 70.0 - b) AS low, least(100, 70.0 + b) AS high FROM (SELECT 100.0 * sum(n) / 500 b FROM (SELECT count(*) FILTER (c) n FROM s GROUP BY scene ORDER BY n DESC, scene LIMIT 50))")
def a20_score_bound(t):
    return A.score_bound(t.orders, F.floor((F.col("o_orderkey") - 1) / 10), F.col("o_orderkey") % 13 == 0, 50, 70.0)


@query("SELECT event_type, user_id % 10 AS robot, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), (event_type, user_id % 10), ())")
def a21_fallback_summary(t):
    return t.events.select("event_type", (F.col("user_id") % 10).alias("robot")).cube("event_type", "robot").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def a22_label_counts(t):
    return A.label_counts(t.documents, "lang", "source")


@query(C + "SELECT source, count(*) AS n, avg(toxic) AS toxic_rate, avg(cue::INT) AS cue_rate, avg(toxic) FILTER (cue) AS p_with, avg(toxic) FILTER (NOT cue) AS p_without, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, count(DISTINCT array_to_string(string_split(lower(text), ' ')[1:8], ' ')) / count(*) AS distinct_prefix FROM c GROUP BY source")
def a23_corpus_profile(t):
    """Label and cue rates, lengths and prefix diversity per source."""
    x = labelled(t).withColumn("prefix", F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 8), " "))
    return x.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("toxic_rate"), A.rate(F.col("cue")).alias("cue_rate"), F.avg(F.when(F.col("cue"), F.col("toxic"))).alias("p_with"), F.avg(F.when(~F.col("cue"), F.col("toxic"))).alias("p_without"),
        F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"), (F.count_distinct("prefix") / F.count(F.lit(1))).alias("distinct_prefix"),
    )


@query("SELECT source, lang, toxic = 1 AS toxic, cue, count(*) AS n FROM (" + C + "SELECT * FROM c) GROUP BY ALL")
def a23_joint_flags(t):
    """Joint table of label and cue."""
    return labelled(t).groupBy("source", "lang", (F.col("toxic") == 1).alias("toxic"), "cue").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT source, unnest({WORDS}) w FROM documents) SELECT source, w, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) r FROM (SELECT source, w, count(*) n FROM w GROUP BY source, w)) WHERE r <= 40""")
def a23_top_tokens(t):
    """The forty most frequent tokens of each source. The rank filter keeps forty of a source in each task."""
    w = t.documents.select("source", F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "w"))).where("rank <= 40")


@query(f"""WITH w AS (SELECT unnest({WORDS}) w, source = 'src3' h FROM documents), v AS (SELECT w, count(*) FILTER (h) n, bool_or(NOT h) known FROM w GROUP BY w HAVING count(*) FILTER (h) > 0)
SELECT w, n FROM v WHERE NOT known ORDER BY n DESC, w LIMIT 25""")
def a25_oov_examples(t):
    """The most frequent tokens of one source that the others do not have."""
    w = t.documents.select((F.col("source") == "src3").alias("h"), F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    v = w.groupBy("w").agg(F.count_if("h").alias("n"), F.bool_or(~F.col("h")).alias("known")).where("n > 0 and not known")
    return v.orderBy(F.desc("n"), "w").limit(25).select("w", "n")


@query(f"""WITH w AS (SELECT unnest({WORDS}) w, source = 'src3' h FROM documents), v AS (SELECT w, count(*) FILTER (h) n, bool_or(NOT h) known FROM w GROUP BY w HAVING count(*) FILTER (h) > 0)
SELECT count(*) AS types, sum(n)::BIGINT AS tokens, count(*) FILTER (NOT known) / count(*) AS oov_types, sum(n) FILTER (NOT known) / sum(n) AS oov_tokens FROM v""")
def a25_oov(t):
    """One source against the vocabulary of the others."""
    w = t.documents.select((F.col("source") == "src3").alias("h"), F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    v = w.groupBy("w").agg(F.count_if("h").alias("n"), F.bool_or(~F.col("h")).alias("known")).where("n > 0")
    return v.agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), A.rate(~F.col("known")).alias("oov_types"), (F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0)) / F.sum("n")).alias("oov_tokens"))


@query(C + """SELECT lang, k AS cue, count(*) FILTER (h) AS with_cue, count(*) FILTER (NOT h) AS without, avg(toxic) FILTER (h) AS p_with, avg(toxic) FILTER (NOT h) AS p_without, avg(toxic) FILTER (h) - avg(toxic) FILTER (NOT h) AS difference
FROM (SELECT lang, toxic, 'insult' k, cue h FROM c UNION ALL SELECT lang, toxic, 'long', n > 300 FROM c) GROUP BY lang, k""")
def a26_cue_table(t):
    return A.cue_table(labelled(t), {"insult": F.col("cue"), "long": F.col("n") > 300}, F.col("toxic"), "lang")


@query(f"""WITH c AS (SELECT quality, toxic, list_distinct({WORDS}) || list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) g FROM (SELECT *, {WORDS} w FROM documents JOIN labels USING (doc_id))),
e AS (SELECT quality, toxic, unnest(g) gram FROM c), n AS (SELECT count(*) n FROM c), s AS (SELECT gram, count(*) support, sum(quality) q, sum(toxic) t FROM e GROUP BY gram HAVING count(*) >= greatest(64, 0.03 * (SELECT n FROM n)) AND count(*) <= 0.97 * (SELECT n FROM n)),
l AS (SELECT gram, support, 'quality' AS label, q / support AS p FROM s UNION ALL SELECT gram, support, 'toxic', t / support FROM s),
r AS (SELECT *, CASE WHEN support >= 0.2 * (SELECT n FROM n) THEN 'large' ELSE 'medium' END AS size FROM l)
SELECT gram, support, label, p, size, row_number() OVER (PARTITION BY label, size ORDER BY abs(p - 0.5) DESC, gram) AS rank, count(*) FILTER (abs(p - 0.5) >= 0.1) OVER (PARTITION BY label, size) AS over_10, count(*) FILTER (abs(p - 0.5) >= 0.2) OVER (PARTITION BY label, size) AS over_20 FROM r QUALIFY rank <= 20""")
def a27_shortcuts(t):
    x = t.documents.join(t.labels, "doc_id").select("quality", "toxic", T.uni_and_bigrams(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("g"))
    return A.shortcuts(x, F.col("g"), ["quality", "toxic"])


@query("SELECT clause, lang, source, count(*) AS n, min(doc_id) AS example FROM documents JOIN (VALUES ('all rights reserved'), ('licensed under'), ('the the')) v(clause) ON contains(lower(text), clause) GROUP BY ALL")
def a28_clause_counts(t):
    c = t.spark.createDataFrame([("all rights reserved",), ("licensed under",), ("the the",)], "clause string")
    x = t.documents.select("doc_id", "lang", "source", F.lower("text").alias("x"))
    return x.join(F.broadcast(c), F.contains("x", "clause")).groupBy("clause", "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("example"))


@query("""SELECT corpus, count(*) AS n, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, avg((n >= 70)::INT) AS long_share, avg((n <= 25)::INT) AS short_share, avg(cue::INT) AS cue_share
FROM (SELECT source AS corpus, len(string_split(text, ' ')) n, regexp_matches(lower(text), 'trash|scum') cue FROM documents UNION ALL SELECT 'benchmark', len(string_split(text, ' ')), regexp_matches(lower(text), 'trash|scum') FROM benchmark UNION ALL SELECT 'conversations', len(string_split(text, ' ')), regexp_matches(lower(text), 'trash|scum') FROM conversations) GROUP BY corpus""")
def a29_drift(t):
    n = F.struct(F.size(F.split("text", " ")).alias("n"), F.lower("text").rlike("trash|scum").alias("cue")).alias("x")
    x = t.documents.select(F.col("source").alias("corpus"), n).unionByName(t.benchmark.select(F.lit("benchmark").alias("corpus"), n)).unionByName(t.conversations.select(F.lit("conversations").alias("corpus"), n)).select("corpus", "x.*")
    return x.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.percentile("n", 0.1).alias("p10"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"), A.rate(F.col("n") >= 70).alias("long_share"), A.rate(F.col("n") <= 25).alias("short_share"), A.rate(F.col("cue")).alias("cue_share"))


@query("""WITH p AS (SELECT source AS corpus, array_to_string(string_split(lower(text), ' ')[1:8], ' ') p FROM documents UNION ALL SELECT 'benchmark', array_to_string(string_split(lower(text), ' ')[1:8], ' ') FROM benchmark UNION ALL SELECT 'conversations', array_to_string(string_split(lower(text), ' ')[1:8], ' ') FROM conversations)
SELECT corpus, p AS prefix, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, p) r FROM (SELECT corpus, p, count(*) n FROM p GROUP BY corpus, p)) WHERE r <= 8""")
def a29_top_prefixes(t):
    """The eight most frequent openings of each corpus."""
    p = F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 8), " ").alias("prefix")
    x = t.documents.select(F.col("source").alias("corpus"), p).unionByName(t.benchmark.select(F.lit("benchmark").alias("corpus"), p)).unionByName(t.conversations.select(F.lit("conversations").alias("corpus"), p))
    n = x.groupBy("corpus", "prefix").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("n"), "prefix"))).where("rank <= 8")


@query(C + r"SELECT source, avg(regexp_matches(text, '\d')::INT) AS digits, avg(regexp_matches(text, '[A-Z]{4}')::INT) AS shouting, avg((toxic = 1 AND NOT cue)::INT) AS label_without_cue, avg((toxic = 0 AND cue)::INT) AS cue_without_label FROM c GROUP BY source")
def a30_regex_rates(t):
    return labelled(t).groupBy("source").agg(A.rate(F.col("text").rlike(r"\d")).alias("digits"), A.rate(F.col("text").rlike("[A-Z]{4}")).alias("shouting"), A.rate((F.col("toxic") == 1) & ~F.col("cue")).alias("label_without_cue"), A.rate((F.col("toxic") == 0) & F.col("cue")).alias("cue_without_label"))


@query("""SELECT l_suppkey, median(l_quantity) AS median, s[least(floor(0.9 * (count(*) - 1))::INT, count(*)::INT - 1) + 1] AS lower_index, s[least(floor(0.9 * count(*))::INT, count(*)::INT - 1) + 1] AS upper_index, quantile_cont(l_quantity, 0.9) AS linear
FROM (SELECT l_suppkey, l_quantity, list_sort(list(l_quantity) OVER (PARTITION BY l_suppkey)) s FROM lineitem) GROUP BY l_suppkey, s""")
def a31_quantiles(t):
    return A.quantiles(t.lineitem, "l_suppkey", "l_quantity")


@query("SELECT l_linenumber AS chunk, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def a32_verdict_rollup(t):
    x = t.lineitem.groupBy(F.col("l_linenumber").alias("chunk")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return x.select("chunk", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("A", "N", "R")])


@query(r"SELECT source, count(*) AS n, count(DISTINCT k) AS texts, count(DISTINCT p) AS prefixes, (SELECT max(m) FROM (SELECT count(*) m FROM documents z WHERE z.source = x.source GROUP BY array_to_string(string_split(lower(text), ' ')[1:8], ' '))) AS most_of_a_prefix FROM (SELECT source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) k, array_to_string(string_split(lower(text), ' ')[1:8], ' ') p FROM documents) x GROUP BY source")
def a33_diversity(t):
    x = t.documents.select("source", T.squash(F.col("text")).alias("k"), F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 8), " ").alias("p"))
    most = x.groupBy("source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("source").agg(F.max("m").alias("most_of_a_prefix"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("k")).alias("texts"), F.count_distinct("p").alias("prefixes")).join(most, "source")


@query(P + "SELECT l_linenumber, count(*) FILTER (NOT ok AND l_discount >= 0.09) AS confident_errors, count(*) FILTER (l_returnflag = 'R' AND pred <> 'R') AS named_missed, count(*) FILTER (l_returnflag = 'R' AND ok) AS named_right FROM p GROUP BY l_linenumber")
def a34_confident_errors(t):
    flag = F.col("l_returnflag") == "R"
    return predictions(t).groupBy("l_linenumber").agg(F.count_if(~F.col("ok") & (F.col("l_discount") >= 0.09)).alias("confident_errors"), F.count_if(flag & (F.col("pred") != "R")).alias("named_missed"), F.count_if(flag & F.col("ok")).alias("named_right"))
