"""Queries of resolution, features and geometry over the fixtures and the embeddings' first two dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgrid.operators import features as P
from corpusgrid.operators import graph as G
from corpusgrid.operators import resolve as J
from corpusgrid.plans import fixtures as X
from corpusgrid.plans.graphs import FEW_ROUTES, ROUTES, routes
from corpusgrid.plans.registry import query

REFS = ("north", "near", "far", "west_most", "anchor_near", None, "east")
_R = "['north', 'near', 'far', 'west_most', 'anchor_near', NULL, 'east']"
SPECS = X.SQL + f""", specs AS (SELECT g, {X._T}[g % 4 + 1] AS type, {_R}[g % 7 + 1] AS ref, CASE WHEN {_R}[g % 7 + 1] IN ('near', 'far', 'anchor_near') THEN {X._T}[(g // 4) % 4 + 1] END AS anchor FROM graphs)"""


def specs(t):
    g = F.col("g")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    s = X.graphs(t).select("g", pick(X.TYPES, g % 4).alias("type"), pick(REFS, g % 7).alias("ref"))
    return s.select("*", F.when(F.col("ref").isin("near", "far", "anchor_near"), pick(X.TYPES, F.floor(g / 4) % 4)).alias("anchor"))


#: Follows a table expression specs (g, type, ref, anchor).
J1_SQL = """x AS (SELECT s.*, a.r ar, a.c ac, n FROM specs s LEFT JOIN (SELECT g, type anchor, arg_min(r, ord) r, arg_min(c, ord) c FROM landmarks GROUP BY ALL) a USING (g, anchor) LEFT JOIN (SELECT g, type, count(*) n FROM landmarks GROUP BY ALL) USING (g, type)),
u AS (SELECT *, CASE WHEN ref IN ('near', 'far', 'anchor_near') AND ar IS NULL THEN NULL WHEN ref NOT LIKE '%_most' AND ref <> 'anchor_near' AND n = 1 THEN NULL ELSE ref END used_ref FROM x),
j AS (SELECT u.g, u.type, u.ref, u.anchor, used_ref, l.r, l.c, l.ord, abs(l.r - ar) + abs(l.c - ac) m, (l.r - ar) * (l.r - ar) + (l.c - ac) * (l.c - ac) e FROM u JOIN landmarks l ON l.g = u.g AND CASE WHEN used_ref LIKE '%_most' THEN true WHEN used_ref = 'anchor_near' THEN NOT (l.r = ar AND l.c = ac) ELSE l.type = u.type END)
SELECT g, type, ref, anchor, used_ref, r, c FROM j QUALIFY row_number() OVER (PARTITION BY g ORDER BY CASE WHEN used_ref = 'anchor_near' THEN m WHEN used_ref = 'near' THEN e WHEN used_ref = 'far' THEN -e WHEN used_ref LIKE 'north%' THEN r WHEN used_ref LIKE 'west%' THEN c WHEN used_ref LIKE 'east%' THEN -c ELSE 0 END, CASE WHEN used_ref = 'anchor_near' THEN e ELSE 0 END, ord) = 1"""


@query(f"{SPECS}, {J1_SQL}")
def j1_resolve(t):
    return J.resolve_targets(specs(t), X.landmarks(t))


@query(X.SQL + """, m AS (SELECT g, CASE g % 5 WHEN 0 THEN 'pool' ELSE ['gate', 'library', 'canteen', 'store'][g % 4 + 1] END AS goal, CASE g % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'pool' END AS via FROM graphs)
SELECT g, CASE WHEN ok THEN goal ELSE f END AS goal, CASE WHEN vok THEN via END AS via, NOT ok AS goal_replaced, via IS NOT NULL AND NOT vok AS via_dropped FROM (SELECT m.*, EXISTS (SELECT 1 FROM landmarks l WHERE l.g = m.g AND l.type = m.goal) ok, EXISTS (SELECT 1 FROM landmarks l WHERE l.g = m.g AND l.type = m.via) vok, (SELECT arg_min(type, ord) FROM landmarks l WHERE l.g = m.g) f FROM m)""")
def j2_fallback(t):
    g = F.col("g")
    goal = F.when(g % 5 == 0, "pool").otherwise(F.element_at(F.array(*map(F.lit, X.TYPES)), (g % 4 + 1).cast("int")))
    m = X.graphs(t).select("g", goal.alias("goal"), F.when(g % 3 == 0, "store").when(g % 3 == 1, "pool").alias("via"))
    return J.resolve_with_fallback(m, X.landmarks(t))


@query(X.SQL + """, ty AS (SELECT DISTINCT g, type FROM landmarks), r AS (SELECT g, CASE g % 3 WHEN 0 THEN 'pool' ELSE 'gate' END AS type FROM graphs), p AS (SELECT g, t AS type, (g * 7 + i * 13) % 29 / 29 p FROM graphs, (VALUES ('gate', 0), ('library', 1), ('canteen', 2), ('store', 3), ('pool', 4)) v(t, i)),
k AS (SELECT g, type FROM p SEMI JOIN ty USING (g, type) QUALIFY row_number() OVER (PARTITION BY g ORDER BY p DESC, type DESC) = 1)
SELECT r.g, coalesce(ty.type, k.type) AS type, CASE WHEN ty.type IS NOT NULL THEN 'rule' WHEN k.type IS NOT NULL THEN 'model' ELSE 'none' END AS source FROM r LEFT JOIN ty ON ty.g = r.g AND ty.type = r.type LEFT JOIN k ON k.g = r.g""")
def j3_map_aware(t):
    rule = X.graphs(t).select("g", F.when(F.col("g") % 3 == 0, "pool").otherwise("gate").alias("type"))
    ps = F.array(*[F.struct(F.lit(k).alias("type"), ((F.col("g") * 7 + i * 13) % 29 / 29).alias("p")) for i, k in enumerate((*X.TYPES, "pool"))])
    return J.map_aware(rule, X.graphs(t).select("g", F.explode(ps).alias("x")).select("g", "x.*"), X.landmarks(t))


@query(X.SQL + ", al AS (SELECT a.g, a.r ar, a.c ac, b.r br, b.c bc FROM nodes a JOIN nodes b ON a.g = b.g AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1))) SELECT g, ar, ac, br, bc FROM al ANTI JOIN (SELECT * FROM edges WHERE status <> 'closed') USING (g, ar, ac, br, bc)")
def j5_missing_edges(t):
    """Lattice pairs without an open edge."""
    at = ["g", "ar", "ac", "br", "bc"]
    return G.lattice_edges(X.nodes(t)).join(X.edges(t).where("status <> 'closed'").select(*at), at, "left_anti").select(*at)


@query("SELECT doc_id, 'no_side' AS problem FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'no_row' FROM labels ANTI JOIN documents USING (doc_id)")
def j6_unmatched(t):
    return J.enrich(t.documents.select("doc_id", "lang"), t.labels, "doc_id")[1]


@query(X.SQL + """, al AS (SELECT a.g, a.r ar, a.c ac, b.r br, b.c bc FROM nodes a JOIN nodes b ON a.g = b.g AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1)))
SELECT al.g, al.ar, al.ac, al.br, al.bc, CASE status WHEN 'closed' THEN 'red' WHEN 'crowded' THEN 'orange' WHEN 'covered' THEN 'green' WHEN 'normal' THEN 'grey' ELSE 'none' END AS look, coalesce(stairs, false) AS stairs,
CASE WHEN status IS NULL THEN 'none' WHEN oneway_r IS NULL THEN 'both' WHEN oneway_r = al.br AND oneway_c = al.bc THEN 'forward' ELSE 'backward' END AS way FROM al LEFT JOIN edges e ON e.g = al.g AND e.ar = al.ar AND e.ac = al.ac AND e.br = al.br AND e.bc = al.bc""")
def j8_edge_labels(t):
    return J.edge_labels(G.lattice_edges(X.nodes(t)), X.edges(t).drop("ord"), {"closed": "red", "crowded": "orange", "covered": "green", "normal": "grey"})


_CTX = """, ctx AS (SELECT s.g, n_nodes, n_edges, n_edges / n_nodes AS density, n_closed, n_stairs, robot_r / (grid_rows - 1) AS row, robot_c / (grid_cols - 1) AS col, n_gate, n_library, n_canteen, n_store, (heading = 0)::INT AS heading_0, (heading = 1)::INT AS heading_1, (heading = 2)::INT AS heading_2, (heading = 3)::INT AS heading_3
FROM scenes s JOIN (SELECT g, count(*) n_nodes FROM nodes GROUP BY g) USING (g) JOIN (SELECT g, count(*) n_edges, count(*) FILTER (status = 'closed') n_closed, count(*) FILTER (stairs) n_stairs FROM edges GROUP BY g) USING (g)
JOIN (SELECT g, count(*) FILTER (type = 'gate') n_gate, count(*) FILTER (type = 'library') n_library, count(*) FILTER (type = 'canteen') n_canteen, count(*) FILTER (type = 'store') n_store FROM landmarks GROUP BY g) USING (g))"""
_ACT = """, turned2 AS (SELECT s.g, s.heading, x.action, a.r2, a.c2, a.status, a.stairs, ['straight', 'right_turn', 'u_turn', 'left_turn'][(([0, 2, 3, 1][x.action + 1] - [0, 2, 3, 1][heading + 1]) % 4 + 4) % 4 + 1] t FROM scenes s, (SELECT unnest(range(4)) action) x LEFT JOIN arcs a ON a.g = s.g AND a.r = s.robot_r AND a.c = s.robot_c AND a.action = x.action),
acts AS (SELECT g, action, r2 IS NOT NULL AS legal, coalesce(status, 'none') AS status, coalesce(stairs, false) AS stairs, CASE WHEN r2 IS NULL THEN 'none' ELSE t END AS turn, CASE WHEN r2 IS NULL THEN 0 ELSE (SELECT count(*) FROM arcs b WHERE b.g = z.g AND b.r = z.r2 AND b.c = z.c2) END AS exits,
coalesce((SELECT min(abs(z.r2 - q.r) + abs(z.c2 - q.c)) FROM goals q WHERE q.g = z.g), 0) AS distance FROM turned2 z)"""


def context(t):
    return P.context(X.scenes(t), X.nodes(t), X.edges(t), X.landmarks(t), X.TYPES)


def actions(t):
    return P.action_features(X.starts(t), G.arcs(X.edges(t)), X.goals(t), G.turn_kind)


@query(X.SQL + _CTX + " SELECT * FROM ctx")
def f1_context(t):
    return context(t)


@query(X.SQL + _ACT + " SELECT * FROM acts")
def f2_action_features(t):
    return actions(t)


_FEATS = """, feats AS (SELECT x.g, x.profile, x.action, coalesce(cost, 100000) AS cost, coalesce(cost - min(cost) OVER w, 100000) AS regret, CASE WHEN cost IS NULL THEN 4 ELSE dense_rank() OVER (PARTITION BY x.g, x.profile ORDER BY cost NULLS LAST) - 1 END AS rank, CASE WHEN cost = min(cost) OVER w THEN 1 ELSE 0 END AS best
FROM (SELECT g, profile, action FROM graphs, (SELECT DISTINCT profile FROM prof), (SELECT unnest(range(4)) action)) x LEFT JOIN routes r ON r.g = x.g AND r.profile = x.profile AND r.action = x.action WINDOW w AS (PARTITION BY x.g, x.profile))"""
FEATURES, FEW_FEATURES = ROUTES + _FEATS, FEW_ROUTES + _FEATS


def features(t, of=None):
    return P.cost_features(X.graphs(t), X.profiles(t, of), routes(t, of))


@query(FEATURES + " SELECT g, profile, action, cost::BIGINT AS cost, regret::BIGINT AS regret, rank, best FROM feats")
def f3_cost_features(t):
    """F3 and F4."""
    return features(t)


@query(X.SQL + _CTX + _ACT + " SELECT a.g, a.action, count(*) OVER w AS n_legal, distance - min(distance) OVER w AS excess, n_nodes, heading_0, a.action = a.g % 4 AS positive FROM acts a JOIN ctx USING (g) WHERE legal WINDOW w AS (PARTITION BY a.g)")
def f5_candidates(t):
    """F5 and F6; the label of a graph is g % 4."""
    labels = X.graphs(t).select("g", (F.col("g") % 4).alias("action"))
    return P.labelled(P.candidates(actions(t), context(t)), labels).select("g", "action", "n_legal", "excess", "n_nodes", "heading_0", "positive")


@query(X.SQL + _CTX + _ACT + " SELECT g, action, action = g % 4 AS positive FROM acts WHERE legal AND g % 2 = 0")
def f6_labelled(t):
    """Candidates of the graphs with a label (those of even number): which of them is the label."""
    labels = X.graphs(t).where("g % 2 = 0").select("g", (F.col("g") % 4).alias("action"))
    return P.labelled(P.candidates(actions(t), context(t)), labels).select("g", "action", "positive")


_WIDE = ", ".join(f"max({v}) FILTER (profile = '{p}' AND action = {a})::BIGINT AS {p}_{a}_{v}" for p in X.PROFILES for a in range(4) for v in ("cost", "rank"))


@query(FEATURES + f" SELECT g, {_WIDE} FROM feats GROUP BY g")
def f7_wide(t):
    """All 48 profiles: 384 columns in fixed order."""
    return P.wide(features(t), list(X.PROFILES), ("cost", "rank"))


_SCORE = ", sc AS (SELECT g, action, ((g * 7 + action * 11) % 5 / 5) p FROM arcs a JOIN scenes s USING (g) WHERE a.r = s.robot_r AND a.c = s.robot_c)"


def scores(t):
    legal = G.arcs(X.edges(t)).join(X.starts(t), ["g", "r", "c"])
    return legal.select("g", "action", ((F.col("g") * 7 + F.col("action") * 11) % 5 / 5).alias("p"))


@query(X.SQL + _SCORE + " SELECT g, coalesce(action, -1) AS action FROM graphs LEFT JOIN (SELECT g, action FROM sc QUALIFY row_number() OVER (PARTITION BY g ORDER BY p DESC, action) = 1) USING (g)")
def f8_argmax(t):
    return P.argmax(scores(t), X.graphs(t), "g", "action", "p")


@query(X.SQL + ", al AS (SELECT g, a action, ((g * 7 + a * 11) % 5 / 5) p FROM graphs, (SELECT unnest(range(4)) a)), le AS (SELECT al.* FROM al JOIN scenes s USING (g) JOIN arcs k ON k.g = al.g AND k.r = s.robot_r AND k.c = s.robot_c AND k.action = al.action) SELECT g, action, p / nullif(sum(p) OVER (PARTITION BY g), 0) AS confidence FROM le QUALIFY row_number() OVER (PARTITION BY g ORDER BY p DESC, action) = 1")
def f9_masked_argmax(t):
    every = X.graphs(t).select("g", F.explode(F.array(*map(F.lit, range(4)))).alias("action")).select("g", "action", ((F.col("g") * 7 + F.col("action") * 11) % 5 / 5).alias("p"))
    return P.masked_argmax(every, scores(t), "g", "action", "p")


@query("SELECT user_id, count(DISTINCT c) AS clusters, max(n) AS largest FROM (SELECT user_id, c, count(*) n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY value RANGE UNBOUNDED PRECEDING) c FROM (SELECT user_id, value, coalesce((value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 2)::INT, 0) f FROM events)) GROUP BY ALL) GROUP BY user_id")
def p1_gap_clusters(t):
    x = P.gap_clusters(t.events.select("user_id", "value"), ["user_id"], "value", 2.0)
    return x.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"))


def points(t):
    """Nodes of the lattices as slightly turned image points, with a score."""
    g, r, c = F.col("g"), F.col("r"), F.col("c")
    return X.nodes(t).select("g", (r * 10 + c).alias("k"), "r", "c", (c * 40 + r * 2 + (g + r + c) % 3).cast("double").alias("x"), (r * 40 - c * 2 + (g + r * 2 + c) % 3).cast("double").alias("y"), ((g + r * 3 + c * 7) % 20 / 20).alias("score"))


POINTS = X.SQL + ", pts AS (SELECT g, r * 10 + c k, r, c, (c * 40 + r * 2 + (g + r + c) % 3)::DOUBLE x, (r * 40 - c * 2 + (g + r * 2 + c) % 3)::DOUBLE y, (g + r * 3 + c * 7) % 20 / 20 score FROM nodes)"
ANGLE = """, nn AS (SELECT * FROM (SELECT a.g, a.k, a.x, a.y, b.x x2, b.y y2, (a.x - b.x)^2 + (a.y - b.y)^2 d2, b.k k2 FROM pts a JOIN pts b ON a.g = b.g AND a.k <> b.k) QUALIFY row_number() OVER (PARTITION BY g, k ORDER BY d2, k2) <= 2),
ang AS (SELECT g, quantile_cont(((atan2(y2 - y, x2 - x) + pi() / 4) % (pi() / 2) + pi() / 2) % (pi() / 2) - pi() / 4, 0.5) angle FROM nn GROUP BY g)"""


@query(POINTS + ANGLE + " SELECT g, round(angle, 6) AS angle FROM ang")
def p2_dominant_angle(t):
    return P.dominant_angle(points(t), ["g"], "k").select("g", F.round("angle", 6).alias("angle"))


def _grid_sql(pts: str) -> str:
    """Fitted cells of points (t, g, k, x, y, score), t a further key."""
    near = "row_number() OVER (PARTITION BY t, g, k ORDER BY d2, k2)"
    return f""", q AS (SELECT a.t, a.g, a.k, a.x, a.y, b.x x2, b.y y2, (a.x - b.x)^2 + (a.y - b.y)^2 d2, b.k k2 FROM {pts} a JOIN {pts} b ON a.t = b.t AND a.g = b.g AND a.k <> b.k), q2 AS MATERIALIZED (SELECT *, {near} rk FROM q QUALIFY rk <= 2),
an AS (SELECT t, g, quantile_cont(((atan2(y2 - y, x2 - x) + pi() / 4) % (pi() / 2) + pi() / 2) % (pi() / 2) - pi() / 4, 0.5) angle FROM q2 GROUP BY t, g), sp AS (SELECT t, g, quantile_cont(sqrt(d2), 0.5) spacing FROM q2 WHERE rk = 1 GROUP BY t, g),
uv AS (SELECT p.*, spacing, x * cos(angle) + y * sin(angle) u, y * cos(angle) - x * sin(angle) v FROM {pts} p JOIN an USING (t, g) JOIN sp USING (t, g)),
ul AS (SELECT *, coalesce(v - lag(v) OVER (PARTITION BY t, g ORDER BY v) > spacing / 2, false)::INT fv, coalesce(u - lag(u) OVER (PARTITION BY t, g ORDER BY u) > spacing / 2, false)::INT fu FROM uv),
rc AS (SELECT *, sum(fv) OVER (PARTITION BY t, g ORDER BY v RANGE UNBOUNDED PRECEDING) AS row_, sum(fu) OVER (PARTITION BY t, g ORDER BY u RANGE UNBOUNDED PRECEDING) AS col_ FROM ul),
fits AS (SELECT t, g, row_, col_, arg_max(k, score * 1000000 - k) k, count(*) OVER (PARTITION BY t, g) m FROM rc GROUP BY t, g, row_, col_), fitted AS (SELECT * FROM fits WHERE m >= 4)"""


@query(POINTS + ", pt AS (SELECT 0 t, * FROM pts)" + _grid_sql("pt") + " SELECT g, row_::BIGINT AS row, col_::BIGINT AS col, k FROM fitted")
def p3_fit_grid(t):
    """Cells of the fitted grids; tests compare them with the lattice that the points come from."""
    return P.fit_grid(points(t), ["g"], "k", "score")


@query(POINTS + " SELECT p.g, coalesce(d, 0) AS spacing FROM (SELECT DISTINCT g FROM pts) p LEFT JOIN (SELECT a.g, quantile_cont(sqrt((a.x - b.x)^2 + (a.y - b.y)^2), 0.5) d FROM pts a JOIN pts b ON a.g = b.g AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1)) GROUP BY a.g) x USING (g)")
def p4_spacing(t):
    return P.spacing(points(t), "g")


_SHAPES = POINTS + ", pt AS (SELECT v.t, p.* FROM pts p JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5)) v(t) ON score >= v.t)" + _grid_sql("pt") + ", shapes AS (SELECT g, t AS threshold, count(DISTINCT row_) AS rows, count(DISTINCT col_) AS cols, count(*) AS cells FROM fitted GROUP BY ALL)"


@query(_SHAPES + " SELECT g, threshold, rows, cols, cells FROM shapes")
def p6_threshold_sweep(t):
    return P.threshold_shapes(points(t), "g", "k", "score", [0.1, 0.3, 0.5])


@query(_SHAPES + ", ok AS (SELECT g, min(threshold) threshold FROM shapes WHERE rows BETWEEN 3 AND 5 AND cols BETWEEN 3 AND 5 GROUP BY g) SELECT g, coalesce(threshold, 0.1) AS threshold FROM graphs LEFT JOIN ok USING (g)")
def p5_threshold_retry(t):
    """The first good threshold of each graph."""
    shapes = P.threshold_shapes(points(t), "g", "k", "score", [0.1, 0.3, 0.5])
    return P.first_good_threshold(shapes, X.graphs(t), "g", 0.1, 3, 5)


@query()
def e6_coordinate_search(t):
    """Weights of two fields that explain the labels g % 4 best when ties are broken at random."""
    from corpusgrid.operators import ensemble as E
    from corpusgrid.operators import metrics as A

    search = G.RouteSearch(G.arcs(X.edges(t)), X.starts(t), X.vias(t), X.goals(t), staged=True)

    def score(profiles):
        costs = search.costs(profiles).withColumns({"label": F.col("g") % 4, "row": F.struct("g", "profile")})
        return A.tie_scores(costs, "row", "cost", "action", "label").groupBy("row.profile").agg(F.avg("score").alias("score"))

    base = dict(zip(X.PROFILE_COLUMNS, X.PROFILES["unit"]))
    best, value = E.coordinate_search(t.spark, base, {"crowded": [0, 80], "turn": [0, 40]}, score, rounds=1)
    return t.spark.createDataFrame([(k, v, value) for k, v in best.items()], "field string, weight long, score double")


@query()
def e6_search_by_condition(t):
    """Weights of four fields for four conditions, searched in step, against unit costs."""
    from corpusgrid.operators import ensemble as E
    from corpusgrid.operators import metrics as A
    from corpusgrid.session import stage

    search = G.RouteSearch(G.arcs(X.edges(t)), X.starts(t), X.vias(t), X.goals(t), staged=True)
    kinds = {"all": F.lit(True), "rain": F.col("g") % 3 == 0, "urgent": F.col("g") % 5 == 1, "fragile": F.col("g") % 7 < 3}
    named = F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in kinds.items()])))
    conditions = stage(X.graphs(t).select("g", named.alias("condition")), "conditions")

    def score(profiles):
        costs = search.costs(profiles).withColumns({"label": F.col("g") % 4, "row": F.struct("g", "profile")})
        return A.tie_scores(costs, "row", "cost", "action", "label").select("row.g", "row.profile", "score")

    base = dict(zip(X.PROFILE_COLUMNS, X.PROFILES["unit"]))
    return E.coordinate_search_by(conditions, base, {"crowded": [50, 100, 200], "covered": [-20, 20], "turn": [20, 50], "u_turn": [50, 100]}, score)


ROBOTS = tuple(X.PROFILES)[::5][:10]
RANKED = ["excess", "n_legal", "exits", "distance", "n_nodes", "density", "row", "col", *X.FEW]


def robot_candidates(t):
    """A row for each robot and candidate action of a graph; positive: the robot's own costs make it the best."""
    from corpusgrid.session import stage

    costs = stage(routes(t, {k: X.PROFILES[k] for k in dict.fromkeys([*ROBOTS, *X.FEW])}), "costs")
    best = G.best_action(costs.where(F.col("profile").isin(*ROBOTS)), ["g", "profile"], [3, 0, 2, 1]).select("g", F.col("profile").alias("robot"), F.col("action").alias("_best"))
    shown = costs.groupBy("g", "action").pivot("profile", list(X.FEW)).agg(F.first("cost"))
    c = P.candidates(actions(t), context(t)).select("g", F.col("action").cast("int").alias("action"), *RANKED[:-3]).join(shown, ["g", "action"], "left").join(best, "g")
    return stage(c.withColumn("positive", F.col("action") == F.col("_best")).drop("_best"), "robot_candidates")


@query()
def e7_robot_rankers(t):
    """A ranker for each of ten robots, all trained in one pass on even graphs, picks the robot's action of every graph."""
    from corpusgrid.operators import ensemble as E

    return E.rankers(robot_candidates(t), "robot", "g", "action", "positive", RANKED, F.col("g") % 2 == 0)


@query()
def e8_family_selection(t):
    """Boosting, forest or extra trees for each of ten robots, by accuracy on folds that the models have not seen."""
    from corpusgrid.operators import ensemble as E

    return E.select_family(robot_candidates(t), "robot", "g", "action", "positive", RANKED).select("robot", "family", F.round("accuracy", 9).alias("accuracy"))


@query()
def e7_ranker(t):
    """A model over the candidate rows of even graphs picks the action of every graph."""
    from corpusgrid.operators import ensemble as E
    from corpusgrid.session import stage

    names = ["excess", "n_legal", "exits", "distance", "n_nodes", "density", "row", "col"]
    labels = X.graphs(t).select("g", (F.col("g") % 4).alias("action"))
    c = stage(P.labelled(P.candidates(actions(t), context(t)), labels).select("g", "action", "positive", *names), "candidates")
    model = E.ranker(c.where("g % 2 = 0"), names, "positive")
    return P.argmax(E.rank_scores(model, c, names).withColumn("p", F.round("p", 9)), X.graphs(t), "g", "action", "p")


_STYLED = POINTS + """, tn AS (SELECT g, r, c, x, y FROM pts), pn AS (SELECT g, r, c, x + (g + r) % 4 x, y + (g + c) % 3 y FROM pts WHERE (g * 5 + r * 7 + c * 3) % 29 <> 0),
te AS (SELECT g, ar, ac, br, bc, status, stairs, oneway_r o1, oneway_c o2 FROM edges),
pe AS (SELECT g, ar, ac, br, bc, CASE WHEN (g * 3 + ar + ac * 7) % 17 = 0 THEN 'crowded' ELSE status END status, stairs <> ((g + ar * 5 + ac) % 23 = 0) stairs, CASE WHEN (g * 7 + ar + ac * 3) % 19 <> 0 THEN oneway_r END o1, CASE WHEN (g * 7 + ar + ac * 3) % 19 <> 0 THEN oneway_c END o2
 FROM edges WHERE (g + ar * 3 + ac * 5 + br + bc) % 31 <> 0),
tl AS (SELECT DISTINCT g, type, r, c FROM landmarks), pl AS (SELECT DISTINCT g, CASE WHEN (g + ord * 5) % 13 = 0 THEN 'store' ELSE type END AS type, r, c FROM landmarks),
sc AS (SELECT g, g % 4 AS style, true grid, g % 11 <> 0 robot, g % 9 <> 0 head, g % 10 <> 0 weather FROM scenes),
jn AS (SELECT coalesce(t.g, p.g) g, t.g IS NOT NULL t, p.g IS NOT NULL p, sqrt((t.x - p.x)^2 + (t.y - p.y)^2) e FROM tn t FULL JOIN pn p ON t.g = p.g AND t.r = p.r AND t.c = p.c),
ad AS (SELECT a.g, a.r ar, a.c ac, b.r br, b.c bc FROM nodes a JOIN nodes b ON a.g = b.g AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1))),
ky AS (SELECT g, ar, ac, br, bc FROM ad UNION SELECT g, ar, ac, br, bc FROM te UNION SELECT g, ar, ac, br, bc FROM pe),
je AS (SELECT k.g, t.g IS NOT NULL t, p.g IS NOT NULL p, t.status = p.status s1, t.stairs = p.stairs s2, t.o1 IS NOT DISTINCT FROM p.o1 AND t.o2 IS NOT DISTINCT FROM p.o2 s3, t.stairs ts, p.stairs ps, t.o1 IS NOT NULL tw FROM ky k LEFT JOIN te t USING (g, ar, ac, br, bc) LEFT JOIN pe p USING (g, ar, ac, br, bc)),
jl AS (SELECT coalesce(t.g, p.g) g, t.g IS NOT NULL t, p.g IS NOT NULL p FROM tl t FULL JOIN pl p ON t.g = p.g AND t.type = p.type AND t.r = p.r AND t.c = p.c),
ev AS (SELECT sc.*, coalesce((SELECT bool_and(t AND p) FROM jn WHERE jn.g = sc.g), true) n, coalesce((SELECT bool_and((NOT t AND NOT p) OR (t AND p AND s1 AND s2 AND s3)) FROM je WHERE je.g = sc.g), true) e, coalesce((SELECT bool_and(t AND p) FROM jl WHERE jl.g = sc.g), true) l FROM sc),
rw AS (SELECT g, 'node_recall' AS metric, p ok FROM jn WHERE t UNION ALL SELECT g, 'node_precision', t FROM jn WHERE p UNION ALL SELECT g, 'edge_exists', t = p FROM je UNION ALL SELECT g, 'edge_status', s1 FROM je WHERE t AND p UNION ALL SELECT g, 'edge_stairs', s2 FROM je WHERE t AND p
UNION ALL SELECT g, 'edge_oneway', s3 FROM je WHERE t AND p UNION ALL SELECT g, 'edge_stairs_recall', ps FROM je WHERE t AND p AND ts UNION ALL SELECT g, 'edge_oneway_recall', s3 FROM je WHERE t AND p AND tw UNION ALL SELECT g, 'landmark_recall', p FROM jl WHERE t UNION ALL SELECT g, 'landmark_precision', t FROM jl WHERE p
UNION ALL SELECT g, 'grid_shape', grid FROM ev UNION ALL SELECT g, 'node_set', grid AND n FROM ev UNION ALL SELECT g, 'edge_set', e FROM ev UNION ALL SELECT g, 'landmark_set', l FROM ev UNION ALL SELECT g, 'robot_rc', robot FROM ev UNION ALL SELECT g, 'robot_heading', robot AND head FROM ev
UNION ALL SELECT g, 'weather', weather FROM ev UNION ALL SELECT g, 'scene_exact', grid AND n AND e AND l AND robot AND head AND weather FROM ev),
er AS (SELECT style, avg(e) mean, quantile_cont(e, 0.95) p95, count(e) n FROM jn JOIN sc USING (g) WHERE t AND p GROUP BY ROLLUP (style)),
rp AS (SELECT metric, style, avg(ok::INT) AS value, count(ok) AS n FROM rw JOIN sc USING (g) GROUP BY GROUPING SETS ((metric, style), (metric)) UNION ALL SELECT 'node_err_px_mean', style, mean, n FROM er UNION ALL SELECT 'node_err_px_p95', style, p95, n FROM er)"""


def extraction(t):
    """(predicted, true) scenes: the lattices, and the lattices with a few wrong nodes, edges, landmarks and fields."""
    g, r, c, ar, ac = (F.col(x) for x in ("g", "r", "c", "ar", "ac"))
    n, e, lm = points(t).select("g", "r", "c", "x", "y"), X.edges(t), X.landmarks(t)
    s = X.scenes(t).withColumns({"weather": F.when(g % 3 == 0, "rain").otherwise("dry"), "style": g % 4})
    way = (g * 7 + ar + ac * 3) % 19 != 0
    pred = {
        "scenes": s.withColumns({"robot_r": F.col("robot_r") + (g % 11 == 0).cast("int"), "heading": (F.col("heading") + (g % 9 == 0).cast("int")) % 4, "weather": F.when(g % 10 == 0, "fog").otherwise(F.col("weather"))}),
        "nodes": n.where((g * 5 + r * 7 + c * 3) % 29 != 0).withColumns({"x": F.col("x") + (g + r) % 4, "y": F.col("y") + (g + c) % 3}),
        "edges": e.where((g + ar * 3 + ac * 5 + F.col("br") + F.col("bc")) % 31 != 0).withColumns({
            "status": F.when((g * 3 + ar + ac * 7) % 17 == 0, "crowded").otherwise(F.col("status")), "stairs": F.col("stairs") != ((g + ar * 5 + ac) % 23 == 0),
            "oneway_r": F.when(way, F.col("oneway_r")), "oneway_c": F.when(way, F.col("oneway_c")),
        }),
        "landmarks": lm.withColumn("type", F.when((g + F.col("ord") * 5) % 13 == 0, "store").otherwise(F.col("type"))),
    }
    return pred, {"scenes": s, "nodes": n, "edges": e, "landmarks": lm}


@query(_STYLED + " SELECT metric, value, n FROM rp WHERE style IS NULL")
def a5_extraction_report(t):
    from corpusgrid.operators import metrics as A

    return A.extraction_report(*extraction(t)).select("metric", "value", "n")


@query(_STYLED + " SELECT metric, style, value, n FROM rp")
def a6_report_by_style(t):
    from corpusgrid.operators import metrics as A

    return A.extraction_report(*extraction(t), "style").select("metric", "style", "value", "n")


@query(POINTS + """, ps AS (SELECT g, g % 4 AS style, robot_r + (g % 11 = 0)::INT rr, robot_c rc, grid_rows, grid_cols FROM scenes), pn AS (SELECT g, r, c FROM pts WHERE (g * 5 + r * 7 + c * 3) % 29 <> 0), bad AS (SELECT g FROM ps WHERE NOT EXISTS (SELECT 1 FROM pn WHERE pn.g = ps.g AND pn.r = rr AND pn.c = rc)
UNION SELECT g FROM pn JOIN ps USING (g) WHERE r >= grid_rows OR c >= grid_cols UNION SELECT g FROM ps WHERE grid_rows NOT BETWEEN 5 AND 9 OR grid_cols NOT BETWEEN 5 AND 9)
SELECT style, count(*) AS scenes, count(*) FILTER (g IN (SELECT g FROM bad)) AS invalid_graphs FROM ps GROUP BY style""")
def a6_invalid_graphs(t):
    """Predicted graphs by style that break a rule of the grid, their nodes or the robot's place."""
    pred, _ = extraction(t)
    none = pred["edges"].limit(0)
    bad = G.problems(pred["scenes"], pred["nodes"].select("g", "r", "c"), none, pred["landmarks"].limit(0)).select("g").distinct().withColumn("bad", F.lit(True))
    return pred["scenes"].join(bad, "g", "left").groupBy("style").agg(F.count(F.lit(1)).alias("scenes"), F.count("bad").alias("invalid_graphs"))
