"""Queries over the lattices of plans.fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgrid.operators import graph as G
from corpusgrid.plans import fixtures as X
from corpusgrid.plans.registry import query

REACH = ", reach AS (SELECT g, robot_r::BIGINT r, robot_c::BIGINT c FROM scenes UNION SELECT a.g, a.r2, a.c2 FROM reach x JOIN arcs a ON a.g = x.g AND a.r = x.r AND a.c = x.c)"


@query(X.SQL + """, p AS (SELECT g, 'grid_size' AS problem FROM scenes WHERE grid_rows NOT BETWEEN 5 AND 9 OR grid_cols NOT BETWEEN 5 AND 9
UNION SELECT g, 'node_outside' FROM nodes JOIN scenes USING (g) WHERE r >= grid_rows OR c >= grid_cols
UNION SELECT g, 'robot_off_node' FROM scenes s WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.g = s.g AND n.r = s.robot_r AND n.c = s.robot_c)
UNION SELECT g, 'landmark_off_node' FROM landmarks s WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.g = s.g AND n.r = s.r AND n.c = s.c)
UNION SELECT g, 'landmark_on_robot' FROM landmarks JOIN scenes USING (g) WHERE r = robot_r AND c = robot_c) SELECT * FROM p""")
def v2_graph_problems(t):
    return G.problems(X.scenes(t), X.nodes(t), X.edges(t), X.landmarks(t))


@query(X.SQL + " SELECT g, false AS legged, r, c, r2, c2, action FROM arcs UNION ALL SELECT g, true, r, c, r2, c2, action FROM legs")
def g1_arcs(t):
    e = X.edges(t).withColumn("legged", F.explode(F.array(F.lit(False), F.lit(True))))
    return G.arcs(e, F.col("legged")).select("g", "legged", "r", "c", "r2", "c2", "action")


_TURN = "['straight', 'right_turn', 'u_turn', 'left_turn'][(([0, 2, 3, 1][action + 1] - [0, 2, 3, 1][heading + 1]) % 4 + 4) % 4 + 1]"


def _costs(profiles: dict) -> str:
    values = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in profiles.items())
    return f""", prof(profile, step, crowded, covered, stairs_w, turn, left_turn, right_turn, u_turn) AS (VALUES {values}),
turned AS (SELECT *, {_TURN} t FROM arcs, (SELECT unnest(range(4)) heading)),
priced AS (SELECT g, profile, r, c, heading, r2, c2, action, step + CASE status WHEN 'crowded' THEN crowded WHEN 'covered' THEN covered ELSE 0 END + CASE WHEN stairs THEN stairs_w ELSE 0 END + CASE WHEN t <> 'straight' THEN turn ELSE 0 END
 + CASE t WHEN 'left_turn' THEN left_turn WHEN 'right_turn' THEN right_turn WHEN 'u_turn' THEN u_turn ELSE 0 END cost FROM turned, prof)"""


COSTS = _costs(X.PROFILES)


@query(X.SQL + COSTS + " SELECT profile, t AS turn, count(*) AS n, sum(cost)::BIGINT AS cost FROM (SELECT p.*, " + _TURN + " t FROM priced p) GROUP BY ALL")
def g3_arc_costs(t):
    """All arcs, headings and profiles."""
    turn = G.turn_kind(F.col("heading"), F.col("action"))
    a = G.arcs(X.edges(t)).join(F.broadcast(X.profiles(t).withColumnRenamed("stairs", "stairs_w"))).withColumn("heading", F.explode(F.array(*map(F.lit, range(4)))))
    w = {c: F.col("stairs_w" if c == "stairs" else c) for c in X.PROFILE_COLUMNS}
    x = a.select("profile", turn.alias("kind"), G.arc_cost(F.col("status"), F.col("stairs"), turn, w).alias("cost"))
    return x.groupBy("profile", F.col("kind").alias("turn")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


def _rounds(n: int) -> str:
    """Backward relaxation, unrolled: n rounds are enough for the lattices of plans.fixtures."""
    sql = """, moves AS (SELECT p.*, d.done, d.done OR EXISTS (SELECT 1 FROM vias v WHERE v.g = p.g AND v.r = p.r2 AND v.c = p.c2) done2 FROM priced p, (VALUES (false), (true)) d(done)),
s0 AS MATERIALIZED (SELECT g, profile, r, c, heading, true done, 0::BIGINT l FROM goals, (SELECT DISTINCT profile FROM prof), (SELECT unnest(range(4)) heading))"""
    for i in range(1, n + 1):
        sql += f""", s{i} AS MATERIALIZED (SELECT g, profile, r, c, heading, done, min(l) l FROM (SELECT * FROM s{i - 1} UNION ALL
SELECT m.g, m.profile, m.r, m.c, m.heading, m.done, m.cost + s.l FROM moves m JOIN s{i - 1} s ON s.g = m.g AND s.profile = m.profile AND s.r = m.r2 AND s.c = m.c2 AND s.heading = m.action AND s.done = m.done2) GROUP BY ALL)"""
    return sql + f""", st AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM vias v WHERE v.g = s.g) OR EXISTS (SELECT 1 FROM vias v WHERE v.g = s.g AND v.r = s.robot_r AND v.c = s.robot_c) done FROM scenes s),
routes AS (SELECT m.g, m.profile, m.action, min(m.cost + s.l) AS cost FROM moves m JOIN st ON st.g = m.g AND st.robot_r = m.r AND st.robot_c = m.c AND st.heading = m.heading AND st.done = m.done
JOIN s{n} s ON s.g = m.g AND s.profile = m.profile AND s.r = m.r2 AND s.c = m.c2 AND s.heading = m.action AND s.done = m.done2 GROUP BY ALL)"""


ROUTES, FEW_ROUTES = (X.SQL + _costs(p) + _rounds(26) for p in (X.PROFILES, X.FEW))


def routes(t, of=None):
    return G.route_costs(G.arcs(X.edges(t)), X.profiles(t, of), X.starts(t), X.vias(t), X.goals(t))


@query(ROUTES + " SELECT g, profile, action, cost::BIGINT AS cost FROM routes")
def g4_route_costs(t):
    return routes(t)


@query(ROUTES + " SELECT g, profile, arg_min(action, cost * 10 + [2, 4, 3, 1][action + 1]) AS action, min(cost)::BIGINT AS cost FROM routes GROUP BY ALL")
def g5_best_action(t):
    return G.best_action(routes(t), ["g", "profile"], [3, 0, 2, 1])


@query(X.SQL + REACH + " SELECT g, r, c FROM reach")
def g6_reachable(t):
    return G.reachable(G.arcs(X.edges(t)), X.starts(t))


MISSION = """, second AS (SELECT g, r, c FROM (SELECT x.* FROM reach x JOIN vias v ON v.g = x.g AND v.r = x.r AND v.c = x.c UNION SELECT g, robot_r, robot_c FROM scenes WHERE g NOT IN (SELECT g FROM vias))
UNION SELECT a.g, a.r2, a.c2 FROM second x JOIN arcs a ON a.g = x.g AND a.r = x.r AND a.c = x.c)"""


@query(X.SQL + REACH + MISSION + " SELECT DISTINCT g FROM second JOIN goals USING (g, r, c)")
def g7_mission_reachable(t):
    return G.mission_reachable(G.arcs(X.edges(t)), X.starts(t), X.vias(t), X.goals(t))


WEAK = ", both_ways AS (SELECT g, r, c, r2, c2 FROM arcs UNION SELECT g, r2, c2, r, c FROM arcs), weak AS (SELECT g, robot_r::BIGINT r, robot_c::BIGINT c FROM scenes UNION SELECT a.g, a.r2, a.c2 FROM weak x JOIN both_ways a ON a.g = x.g AND a.r = x.r AND a.c = x.c)"


@query(X.SQL + WEAK + " SELECT g, r, c FROM weak")
def g8_weakly_reachable(t):
    return G.weakly_reachable(G.arcs(X.edges(t)), X.starts(t))


#: The ladder in SQL: edges of the five steps, legal arcs, and reachability over all steps at once.
_REPAIR = """, e0 AS (SELECT g, ar, ac, br, bc, status, stairs, oneway_r, oneway_c FROM edges),
grid AS (SELECT g, r, c FROM scenes, (SELECT unnest(range(9))::INT r), (SELECT unnest(range(9))::INT c) WHERE r < grid_rows AND c < grid_cols UNION SELECT g, robot_r, robot_c FROM scenes UNION SELECT g, r, c FROM landmarks),
near2 AS (SELECT a.g, a.r ar, a.c ac, b.r br, b.c bc FROM nodes a JOIN nodes b ON a.g = b.g AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1))),
near4 AS (SELECT a.g, a.r ar, a.c ac, b.r br, b.c bc FROM grid a JOIN grid b ON a.g = b.g AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1))),
add2 AS (SELECT n.* FROM near2 n ANTI JOIN e0 e ON n.g = e.g AND n.ar = e.ar AND n.ac = e.ac AND n.br = e.br AND n.bc = e.bc), add4 AS (SELECT n.* FROM near4 n ANTI JOIN e0 e ON n.g = e.g AND n.ar = e.ar AND n.ac = e.ac AND n.br = e.br AND n.bc = e.bc),
se AS (SELECT 0 step, * FROM e0 UNION ALL SELECT 1, g, ar, ac, br, bc, status, stairs, NULL, NULL FROM e0 UNION ALL SELECT 2, g, ar, ac, br, bc, status, stairs, NULL, NULL FROM e0 UNION ALL SELECT 2, g, ar, ac, br, bc, 'normal', false, NULL, NULL FROM add2
UNION ALL SELECT s, g, ar, ac, br, bc, CASE status WHEN 'closed' THEN 'normal' ELSE status END, stairs, NULL, NULL FROM e0, (VALUES (3), (4)) v(s) UNION ALL SELECT 3, g, ar, ac, br, bc, 'normal', false, NULL, NULL FROM add2 UNION ALL SELECT 4, g, ar, ac, br, bc, 'normal', false, NULL, NULL FROM add4),
sw AS (SELECT step, g, ar r, ac c, br r2, bc c2, status, stairs, oneway_r o1, oneway_c o2 FROM se UNION ALL SELECT step, g, br, bc, ar, ac, status, stairs, oneway_r, oneway_c FROM se),
sa AS (SELECT DISTINCT step, g, r, c, r2, c2 FROM sw WHERE status <> 'closed' AND NOT stairs AND (o1 IS NULL OR (o1 = r2 AND o2 = c2))),
ra AS (SELECT step, g, robot_r::BIGINT r, robot_c::BIGINT c FROM scenes, (SELECT unnest(range(5))::INT step) UNION SELECT x.step, x.g, a.r2, a.c2 FROM ra x JOIN sa a ON a.step = x.step AND a.g = x.g AND a.r = x.r AND a.c = x.c),
rb AS (SELECT step, g, r, c FROM (SELECT x.* FROM ra x JOIN vias v ON v.g = x.g AND v.r = x.r AND v.c = x.c UNION SELECT step, g, robot_r, robot_c FROM scenes, (SELECT unnest(range(5))::INT step) WHERE g NOT IN (SELECT g FROM vias))
UNION SELECT x.step, x.g, a.r2, a.c2 FROM rb x JOIN sa a ON a.step = x.step AND a.g = x.g AND a.r = x.r AND a.c = x.c),
ok AS (SELECT g, min(step) step FROM rb JOIN goals USING (g, r, c) GROUP BY g)"""


@query(X.SQL + _REPAIR + " SELECT s.g, step FROM scenes s LEFT JOIN ok USING (g)")
def g9_repair(t):
    """First repair step of each graph on its own grid."""
    return G.repair(X.edges(t), X.nodes(t), X.starts(t), X.vias(t), X.goals(t), X.scenes(t).select("g", "grid_rows", "grid_cols"), X.landmarks(t))


@query(X.SQL + """, d AS (SELECT a.g, a.action, min(abs(a.r2 - q.r) + abs(a.c2 - q.c)) d, any_value(s.heading) h FROM arcs a JOIN scenes s ON s.g = a.g AND s.robot_r = a.r AND s.robot_c = a.c JOIN goals q ON q.g = a.g GROUP BY a.g, a.action)
SELECT g, action, d FROM d QUALIFY row_number() OVER (PARTITION BY g ORDER BY d, action <> h, action) = 1""")
def g10_greedy_action(t):
    legal = G.arcs(X.edges(t)).join(X.starts(t), ["g", "r", "c"])
    return G.greedy_action(legal, X.goals(t))


@query(X.SQL + REACH + WEAK + """ SELECT s.g, CASE WHEN NOT EXISTS (SELECT 1 FROM arcs a WHERE a.g = s.g AND a.r = s.robot_r AND a.c = s.robot_c) THEN 'no_legal_action'
WHEN s.g IN (SELECT g FROM vias) AND s.g NOT IN (SELECT g FROM reach JOIN vias USING (g, r, c)) THEN 'via_unreachable' WHEN s.g NOT IN (SELECT g FROM reach JOIN goals USING (g, r, c)) THEN 'goal_unreachable' ELSE 'other' END AS category,
s.g IN (SELECT g FROM weak JOIN goals USING (g, r, c)) AS weak_route, (SELECT count(*) FROM reach x WHERE x.g = s.g) AS reached FROM scenes s""")
def g11_fallback_category(t):
    return G.fallback_category(X.starts(t), G.arcs(X.edges(t)), X.vias(t), X.goals(t))


@query(X.SQL + """ SELECT s.g, CASE WHEN list_contains(l, s.heading) THEN s.heading ELSE coalesce(list_min(l), s.heading) END AS action FROM scenes s LEFT JOIN (SELECT a.g, list(a.action) l FROM arcs a JOIN scenes s ON s.g = a.g AND s.robot_r = a.r AND s.robot_c = a.c GROUP BY a.g) x ON x.g = s.g""")
def g12_emergency_action(t):
    legal = G.arcs(X.edges(t)).join(X.starts(t), ["g", "r", "c"]).groupBy("g").agg(F.collect_list("action").alias("legal"))
    return X.starts(t).join(legal, "g", "left").select("g", G.emergency_action(F.col("legal"), F.col("heading")).alias("action"))


_LEVELS = """, lv AS (SELECT g, robot_r::BIGINT r, robot_c::BIGINT c, 0 step FROM scenes UNION SELECT a.g, a.r2, a.c2, x.step + 1 FROM lv x JOIN arcs a ON a.g = x.g AND a.r = x.r AND a.c = x.c WHERE x.step < 26),
far AS (SELECT g, r, c, min(step) step FROM lv GROUP BY ALL), hit AS (SELECT g, min(step) steps FROM far JOIN goals USING (g, r, c) GROUP BY g)"""


@query(X.SQL + _LEVELS + " SELECT g, steps, steps + 1 AS nodes, true AS connected FROM hit")
def g13_shortest_path(t):
    """Length of each path, and whether it is one: which of several shortest paths is taken is left open."""
    arcs = G.arcs(X.edges(t))
    p = G.shortest_path(arcs, X.starts(t), X.goals(t)).select("g", "step", "r", "c")
    nxt = p.select("g", (F.col("step") - 1).alias("step"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    ok = p.join(nxt, ["g", "step"]).join(arcs.select("g", "r", "c", "r2", "c2").distinct(), ["g", "r", "c", "r2", "c2"]).groupBy("g").agg(F.count(F.lit(1)).alias("arcs"))
    x = p.groupBy("g").agg(F.max("step").alias("steps"), F.count(F.lit(1)).cast("int").alias("nodes")).join(ok, "g", "left")
    return x.select("g", "steps", "nodes", (F.coalesce("arcs", F.lit(0)) == F.col("steps")).alias("connected"))
