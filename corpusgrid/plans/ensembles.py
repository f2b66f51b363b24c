"""Queries of ensembles. Class probabilities of three models come from arithmetic on quantity, discount and tax."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgrid.operators import ensemble as E
from corpusgrid.operators import metrics as A
from corpusgrid.plans.registry import query
from corpusgrid.session import dealt

MODELS = """
WITH li AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey k, l_suppkey s, l_linenumber % 4 AS label FROM lineitem),
m AS (SELECT id, label, model, cls, (1 + (k * (model + 3) + s * (cls + 1) + cls * 5 + model) % 17) w FROM li, (VALUES (0), (1), (2)) a(model), (VALUES (0), (1), (2), (3)) b(cls)),
p AS (SELECT id, label, model, cls, w / sum(w) OVER (PARTITION BY id, model) p FROM m),
v AS (SELECT id, label, cls, avg(p) p FROM p GROUP BY ALL), best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, cls) = 1) """


def models(t):
    """Rows of three models and four classes. Lines of an order can share an id, so weights are summed by id, one row a line,
    before the twelve rows of a line are made."""
    from pyspark.sql import Window

    li = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), (F.col("l_linenumber") % 4).alias("label"))
    weight = lambda model, cls: 1 + (F.col("k") * (model + 3) + F.col("s") * (cls + 1) + cls * 5 + model) % 17
    by = Window.partitionBy("id")
    li = dealt(li, t.lineitem.count(), "id").select("*", *[F.sum(sum(weight(m, c) for c in range(4))).over(by).alias(f"_t{m}") for m in range(3)])
    rows = [F.struct(F.lit(m).alias("model"), F.lit(c).alias("cls"), (weight(m, c) / F.col(f"_t{m}")).alias("p")) for m in range(3) for c in range(4)]
    return li.select("id", "label", F.explode(F.array(*rows)).alias("x")).select("id", "label", "x.model", "x.cls", "x.p")


@query(MODELS + "SELECT id, cls, p FROM best")
def e1_soft_vote(t):
    return E.soft_vote(models(t), "id", "cls", "p")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS kind, CASE WHEN p_size % 3 = 2 THEN p_type END AS anchor,
round(CASE p_size % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 * (p_partkey % 10) / 10 ELSE 0.9 * (p_partkey % 10) / 10 * 0.8 END, 9) AS confidence FROM part""")
def e2_decode(t):
    mode = F.when(F.col("p_size") % 3 == 0, "none").when(F.col("p_size") % 3 == 1, "plain").otherwise("anchored")
    d = E.decode(mode, F.col("p_brand"), F.col("p_type"), F.lit(0.9), (F.col("p_partkey") % 10) / 10, F.lit(0.8))
    return t.part.select("p_partkey", d.alias("d")).select("p_partkey", "d.kind", "d.anchor", F.round("d.confidence", 9).alias("confidence"))


GATE = "WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 4 END AS rule, o_custkey % 3 AS model, (o_orderkey * 7 % 100) / 100.0 AS conf, o_orderkey % 4 AS truth FROM orders) "


def gate_rows(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.when(k % 5 != 0, F.col("o_custkey") % 4).alias("rule"), (F.col("o_custkey") % 3).alias("model"), ((k * 7 % 100) / 100).alias("conf"), (k % 4).alias("truth"))


@query(GATE + "SELECT o_orderkey, CASE WHEN k THEN model ELSE rule END AS value, CASE WHEN k THEN 'model' ELSE 'rule' END AS source FROM (SELECT *, rule IS NULL OR (model <> rule AND conf >= 0.6) k FROM g)")
def e3_gated(t):
    g = gate_rows(t).withColumn("x", E.gated(F.col("rule"), F.col("model"), F.col("conf"), 0.6))
    return g.select("o_orderkey", "x.value", "x.source")


@query(GATE + """, s AS (SELECT t / 10.0 AS threshold, avg(ok) FILTER (o_orderkey % 2 = 0) AS guard, avg(b) FILTER (o_orderkey % 2 = 0) AS guard_rule, avg(ok) FILTER (o_orderkey % 2 = 1) AS score FROM (
SELECT *, (CASE WHEN rule IS NULL OR (model <> rule AND conf >= t / 10.0) THEN model ELSE rule END = truth)::INT ok, coalesce(rule = truth, false)::INT b FROM g, (SELECT unnest(range(1, 10)) t)) GROUP BY t)
SELECT threshold::DOUBLE AS threshold, guard, guard_rule, score FROM s WHERE guard >= guard_rule ORDER BY round(score, 9) DESC, threshold DESC LIMIT 1""")
def e4_grid_search(t):
    return E.grid_search(gate_rows(t), "rule", "model", "conf", "truth", F.col("o_orderkey") % 2 == 0, [i / 10 for i in range(1, 10)])


GRID = {"goal": [0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 2.0], "via": [0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 2.0], "flags": [0.99, 0.999, 2.0]}
_FIELD = "CASE WHEN (k * {a}) % {n} <> 0 THEN (k * {b} + c) % 3 END AS {f}_rule, (k * {d} + c) % 3 AS {f}_model, (1 - ((k * {e} + c) % 1000 / 1000.0::DOUBLE) ^ 2) AS {f}_conf, CASE WHEN k % 4 = 0 THEN (k * {b} + c) % 3 ELSE (k * {d} + c) % 3 END AS {f}_truth"
_SPEC = {"goal": (3, 7, 5, 2, 37), "via": (5, 5, 1, 7, 91), "flags": (1, 6, 4, 5, 113)}
GATES = "WITH q AS (SELECT o_orderkey k, o_custkey c, ['validation', 'holdout', 'challenge'][o_orderkey % 3 + 1] part FROM orders), h AS (SELECT part, " + ", ".join(_FIELD.format(f=f, a=a, n=n, b=b, d=d, e=e) for f, (a, n, b, d, e) in _SPEC.items()) + """ FROM q),
gr AS (SELECT part, goal, via, flags, sum((""" + " AND ".join(f"CASE WHEN {f}_rule IS NULL OR ({f}_model <> {f}_rule AND {f}_conf >= {f}) THEN {f}_model ELSE {f}_rule END = {f}_truth" for f in GRID) + ")::INT) AS right_, count(*) AS n FROM h, " + ", ".join(f"(SELECT unnest({g}::DOUBLE[]) {f})" for f, g in GRID.items()) + " GROUP BY ALL)"


def three_gates(t):
    """Rule and model answers of three fields of each order, with confidences."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    part = F.element_at(F.array(*map(F.lit, ("validation", "holdout", "challenge"))), (k % 3 + 1).cast("int"))
    fields = [part.alias("part")]
    for f, (a, n, b, d, e) in _SPEC.items():
        rule, model = (k * b + c) % 3, (k * d + c) % 3
        x = ((k * e + c) % 1000) / 1000.0
        fields += [F.when((k * a) % n != 0, rule).alias(f"{f}_rule"), model.alias(f"{f}_model"), (1 - x * x).alias(f"{f}_conf"), F.when(k % 4 == 0, rule).otherwise(model).alias(f"{f}_truth")]
    return t.orders.select(*fields)


def threshold_grid(t):
    return E.threshold_grid(three_gates(t), {f: tuple(f"{f}_{x}" for x in ("rule", "model", "conf", "truth")) for f in GRID}, GRID, "part")


@query(GATES + " SELECT part, goal, via, flags, right_::BIGINT AS right, n AS rows FROM gr")
def e4_threshold_grid(t):
    """243 combinations of thresholds on three parts, from one aggregate."""
    return threshold_grid(t)


@query(GATES + """, s AS (SELECT goal, via, flags, max(right_ / n) FILTER (part = 'validation') guard, sum(right_ / n) FILTER (part <> 'validation') score FROM gr GROUP BY ALL)
SELECT goal, via, flags, guard, score, (SELECT guard FROM s WHERE goal = 2 AND via = 2 AND flags = 2) AS guard_rule FROM s WHERE guard >= guard_rule ORDER BY round(score, 9) DESC, round(goal + via + flags, 9) DESC, goal, via, flags LIMIT 1""")
def e4_guarded_thresholds(t):
    return E.guarded_thresholds(threshold_grid(t), list(GRID), "validation")


_ORDERS = ", ".join(f"('{''.join(map(str, p))}')" for p in E.permutations(range(4)))


@query(f"""WITH c AS (SELECT l_orderkey r, l_linenumber % 4 a, min((l_partkey * 7 + l_linenumber) % 5) cost FROM lineitem GROUP BY ALL), o AS (SELECT r, a, r % 4 l FROM c QUALIFY cost = min(cost) OVER (PARTITION BY r)),
k AS (SELECT name, r, arg_min(a, position(a::VARCHAR IN name)) a, any_value(l) l FROM o, (VALUES {_ORDERS}) v(name) GROUP BY ALL)
SELECT name, avg((a = l)::INT) FILTER (r % 5 <> 0) AS train, avg((a = l)::INT) FILTER (r % 5 = 0) AS test FROM k GROUP BY name ORDER BY round(train, 9) DESC, name LIMIT 1""")
def e5_tie_priority(t):
    from pyspark.sql import Window

    c = t.lineitem.groupBy(F.col("l_orderkey").alias("r"), (F.col("l_linenumber") % 4).alias("a")).agg(F.min((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 5).alias("cost"))
    o = c.withColumn("m", F.min("cost").over(Window.partitionBy("r"))).where("cost = m").withColumn("l", F.col("r") % 4)
    return E.tie_priority(o, "r", "a", "l", F.col("r") % 5 != 0, [0, 1, 2, 3])


@query(MODELS + ", f AS (SELECT label, model, avg((cls = label)::INT) accuracy FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id, model ORDER BY round(p, 9) DESC, cls) = 1) GROUP BY ALL) SELECT label, model, accuracy FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(accuracy, 9) DESC, model DESC) = 1")
def e8_best_family(t):
    m = models(t).groupBy("id", "label", "model").agg(F.max_by("cls", F.struct(F.round("p", 9), -F.col("cls"))).alias("cls"))
    return E.best_by_fold(m, "label", "model", F.col("cls") == F.col("label"))


_PERM = ", ".join(f"('{''.join(map(str, p))}', {', '.join(map(str, p))})" for p in E.permutations(range(3)))


@query(f"""WITH s AS (SELECT l_orderkey g, l_linenumber % 3 a, l_suppkey % 3 b, max(l_quantity) p FROM lineitem GROUP BY ALL), w AS (SELECT g, count(*) = 9 f FROM s GROUP BY g),
t AS (SELECT g, n, sum(p) t FROM s JOIN (SELECT n, unnest([0, 1, 2]) a, unnest([x, y, z]) b FROM (VALUES {_PERM}) v(n, x, y, z)) q USING (a, b) GROUP BY ALL HAVING count(*) = 3),
k AS (SELECT g, n FROM t QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(t, 9) DESC, n::INT) = 1)
SELECT g, CASE WHEN f THEN n ELSE '012' END AS assignment FROM w LEFT JOIN k USING (g)""")
def e9_assignment(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") % 3).alias("a"), (F.col("l_suppkey") % 3).alias("b"), F.col("l_quantity").alias("p"))
    s = dealt(li, t.lineitem.count(), "g").groupBy("g", "a", "b").agg(F.max("p").alias("p"))
    return E.best_assignment(s, "g", "a", "b", "p")


@query("SELECT o.o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN coalesce(s, o_orderstatus) ELSE o_orderstatus END AS o_orderstatus FROM orders o LEFT JOIN (SELECT o_orderkey, 'S' s FROM orders WHERE o_orderkey % 2 = 0) x ON x.o_orderkey = o.o_orderkey")
def e10_routed(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    special = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("S").alias("o_orderstatus"))
    return E.routed(o, special, "o_orderkey", "o_orderstatus", F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_orderstatus")


@query(GATE + "SELECT avg((rule IS NOT DISTINCT FROM truth)::INT) AS a, avg((model = truth)::INT) AS b, avg((CASE WHEN o_orderkey % 2 = 0 THEN rule ELSE model END IS NOT DISTINCT FROM truth)::INT) AS composed FROM g")
def e11_composition(t):
    """One field from system A, the other from B, against both parents."""
    g = gate_rows(t).withColumn("c", F.when(F.col("o_orderkey") % 2 == 0, F.col("rule")).otherwise(F.col("model")))
    return g.agg(*[A.rate(F.col(c).eqNullSafe(F.col("truth"))).alias(n) for c, n in (("rule", "a"), ("model", "b"), ("c", "composed"))])


@query(MODELS + ", k AS (SELECT v.* FROM v JOIN best USING (id) WHERE best.cls = v.label) SELECT id, cls, sqrt(p) / sum(sqrt(p)) OVER (PARTITION BY id) AS q FROM k")
def e12_soft_labels(t):
    return E.agreement_soft_labels(models(t), "id", "cls", "p", "label")
