"""Queries of sampling, quotas and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgrid.operators import sample as M
from corpusgrid.plans.registry import query


def coin_sql(k: str, seed: int = 0) -> str:
    return f"('0x' || md5(concat_ws(':', '{seed}', {k}))[1:15])::BIGINT"


@query(f"SELECT doc_id FROM documents ORDER BY {coin_sql('doc_id')}, doc_id LIMIT 50")
def m1_exact_sample(t):
    return M.exact_sample(t.documents.select("doc_id"), "doc_id", 50)


@query(f"SELECT o_orderkey, c AS chunk, (r - 1) // 10 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {coin_sql('o_orderkey + 1')}, o_orderkey) r FROM (SELECT o_orderkey, o_orderkey // 1000 c FROM orders)) WHERE r <= 100")
def m2_chunk_sample(t):
    x = t.orders.select("o_orderkey", (F.col("o_orderkey") + 1).alias("pos"))
    return M.chunk_sample(x, "pos", 1000, 100, 10).drop("pos")


@query(f"""WITH e AS (SELECT doc_id, 1 o, 'long' s FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 2, 'german' FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 3, 'any' FROM documents UNION ALL SELECT doc_id, 4, 'uniform' FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {coin_sql('doc_id')}, doc_id) r, count(*) OVER (PARTITION BY s) n FROM e)
SELECT doc_id, arg_min(s, o) AS stratum, arg_min(n, o) AS population FROM r WHERE r <= CASE s WHEN 'uniform' THEN 60 ELSE 25 END GROUP BY doc_id""")
def m3_strata_sample(t):
    """M3, and M4: a uniform reservoir of 60 beside the strata."""
    return M.strata_sample(t.documents, "doc_id", {"long": F.col("n_chars") > 3000, "german": F.col("lang") == "de", "any": F.lit(True)}, 25, 60)


@query(f"""WITH q AS (SELECT stratum, w * 100 / sum(w) OVER () sh FROM (VALUES ('AIR', 0.42), ('A', 0.18), ('N', 0.15), ('R', 0.25)) v(stratum, w)),
f AS (SELECT *, floor(sh + 1e-9) fl, round(sh - floor(sh + 1e-9), 9) d FROM q), z AS (SELECT stratum, fl + (row_number() OVER (ORDER BY d DESC, stratum) <= 100 - sum(fl) OVER ())::INT quota FROM f),
r AS (SELECT l_orderkey * 8 + l_linenumber k, l_returnflag stratum, row_number() OVER (PARTITION BY l_returnflag ORDER BY {coin_sql('l_orderkey * 8 + l_linenumber')}, l_orderkey * 8 + l_linenumber) r, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem)
SELECT k, stratum, quota::BIGINT AS quota, n < quota AS short FROM r JOIN z USING (stratum) WHERE r <= quota""")
def m5_quota_sample(t):
    w = t.spark.createDataFrame([("AIR", 0.42), ("A", 0.18), ("N", 0.15), ("R", 0.25)], "stratum string, w double")
    li = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_returnflag")
    return M.quota_sample(li, "k", "l_returnflag", M.largest_remainder(w, "w", 100)).select("k", "stratum", "quota", "short")


_PLAN = ", ".join(f"({s}, '{r}', {i})" for s, r, i in M.fair_schedule({"A": 42, "N": 33, "R": 25}))


@query(f"""WITH p(s, r, i) AS (VALUES {_PLAN}), w(r, w) AS (VALUES ('A', 42), ('N', 33), ('R', 25)),
k AS (SELECT l_orderkey * 8 + l_linenumber id, l_returnflag r, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) - 1 k FROM lineitem)
SELECT id, r, (k // w) * 100 + s AS slot FROM k JOIN w USING (r) JOIN p ON p.r = k.r AND p.i = k % w""")
def m6_interleave(t):
    li = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("r"))
    return M.interleave(li, "r", "id", {"A": 42, "N": 33, "R": 25})


@query("""WITH a AS (SELECT c_custkey k, row_number() OVER (ORDER BY c_custkey) - 1 r FROM customer), b AS (SELECT s_suppkey k, row_number() OVER (ORDER BY s_suppkey) - 1 r FROM supplier)
SELECT k, (r // 5) * 6 + r % 5 AS pos, false AS from_b FROM a UNION ALL SELECT k, r * 6 + 5, true FROM b""")
def m7_ratio_interleave(t):
    return M.ratio_interleave(t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), "k")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {coin_sql('o_orderkey')}, o_orderkey) AS pos FROM orders")
def m8_shuffle(t):
    return M.shuffle(t.orders.select("o_orderkey"), "o_orderkey")


@query("SELECT p_partkey, c AS copy FROM part, LATERAL (SELECT unnest(range(1, p_partkey % 4 + 1)) c)")
def m9_repeat(t):
    return M.repeat(t.part.select("p_partkey"), F.col("p_partkey") % 4)


@query(f"SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY {coin_sql('o_orderkey')}, o_orderkey) - 1) % 5 AS fold FROM orders")
def m10_folds(t):
    return M.folds(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


@query(f"SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY {coin_sql('conv_id')}, conv_id LIMIT 20)")
def m11_group_sample(t):
    return M.group_sample(t.conversations.select("conv_id", "turn"), "conv_id", 20)


@query(f"""WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) pos FROM customer), d AS (SELECT unnest(range(1, 501)) draw)
SELECT draw, c_custkey FROM d JOIN p ON pos = ({coin_sql('draw', 7)}) % (SELECT count(*) FROM customer) + 1""")
def m12_bootstrap(t):
    return M.bootstrap(t.customer.select("c_custkey"), "c_custkey", 500, 7)


@query("SELECT event_id, value FROM events WHERE event_id % 37 = 0")
def m13_every_kth(t):
    return M.every_kth(t.events.select("event_id", "value"), "event_id", 37)


@query(f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY {coin_sql('doc_id')}, doc_id) r FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY {coin_sql('item_id')}, item_id) r FROM benchmark)
SELECT doc_id, CASE WHEN r <= 30 THEN item_id END AS replaced_by FROM a LEFT JOIN b USING (r)""")
def m14_matched_arms(t):
    return M.matched_arms(t.documents.select("doc_id"), t.benchmark.select("item_id"), "doc_id", "item_id", 30)
