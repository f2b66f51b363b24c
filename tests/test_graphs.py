"""Hand-made graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from corpusgrid.operators import features as P
from corpusgrid.operators import graph as G
from corpusgrid.operators import resolve as J
from corpusgrid.plans import fixtures as X

EDGE = "g long, ord int, ar int, ac int, br int, bc int, status string, stairs boolean, oneway_r int, oneway_c int"


def edges(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], EDGE)


def plain(*ends):
    return [(*e, "normal", False, None, None) for e in ends]


def at(spark, *rc):
    return spark.createDataFrame([(1, *x) for x in rc], "g long, r int, c int")


def start(spark, r, c, h):
    return spark.createDataFrame([(1, r, c, h)], "g long, r int, c int, heading int")


def profile(spark):
    return spark.createDataFrame([("p", *X.PROFILES["unit"])], "profile string, " + ", ".join(f"{c} long" for c in X.PROFILE_COLUMNS))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_arc_rules(spark):
    e = edges(spark, [(0, 0, 0, 1, "closed", False, None, None), (0, 0, 1, 0, "normal", True, None, None), (0, 1, 1, 1, "normal", False, 1, 1)])
    assert rows(G.arcs(e), "r", "c", "r2", "c2") == [(0, 1, 1, 1)]
    assert rows(G.arcs(e, True), "r", "c", "r2", "c2") == [(0, 0, 1, 0), (0, 1, 1, 1), (1, 0, 0, 0)]


def test_via_first(spark):
    ring = edges(spark, plain((0, 0, 0, 1), (0, 0, 1, 0), (0, 1, 1, 1), (1, 0, 1, 1)))
    costs = G.route_costs(G.arcs(ring), profile(spark), start(spark, 0, 0, 3), at(spark, (1, 0)), at(spark, (0, 1)))
    best = G.best_action(costs, ["g"], [3, 0, 2, 1]).first()
    assert (best["action"], best["cost"]) == (1, 300)


def test_via_at_start_costs_one_step(spark):
    e = edges(spark, [(0, 0, 0, 1, "normal", False, 0, 1)])
    costs = G.route_costs(G.arcs(e), profile(spark), start(spark, 0, 0, 3), at(spark, (0, 0)), at(spark, (0, 1)))
    assert rows(costs, "action", "cost") == [(3, 100)]


def test_first_step_is_forced(spark):
    costs = G.route_costs(G.arcs(edges(spark, plain((0, 0, 0, 1)))), profile(spark), start(spark, 0, 0, 3), at(spark).limit(0), at(spark, (0, 0)))
    assert rows(costs, "action", "cost") == [(3, 200)]


def test_no_route(spark):
    e = edges(spark, [(0, 0, 0, 1, "closed", False, None, None)])
    assert G.route_costs(G.arcs(e), profile(spark), start(spark, 0, 0, 3), at(spark).limit(0), at(spark, (0, 1))).count() == 0


@pytest.mark.parametrize(
    "rows_, vias, want",
    [
        ([(0, 0, 0, 1, "normal", False, None, None), (0, 1, 0, 2, "normal", False, 0, 1)], [], ("goal_unreachable", True)),
        ([(0, 0, 0, 1, "normal", False, None, None)], [(0, 2)], ("via_unreachable", False)),
        ([(0, 0, 0, 1, "normal", False, None, None), (0, 1, 0, 2, "normal", False, None, None)], [], ("other", True)),
        ([(0, 0, 0, 1, "closed", False, None, None)], [], ("no_legal_action", False)),
    ],
)
def test_fallback_category(spark, rows_, vias, want):
    via = at(spark, *vias) if vias else at(spark, (9, 9)).limit(0)
    got = G.fallback_category(start(spark, 0, 0, 3), G.arcs(edges(spark, rows_)), via, at(spark, (0, 2))).first()
    assert (got["category"], got["weak_route"]) == want


def test_repair_takes_the_first_step_that_helps(spark):
    nodes = at(spark, (0, 0), (0, 1), (0, 2))
    none = at(spark, (9, 9)).limit(0)
    reversed_ = edges(spark, [(0, 0, 0, 1, "normal", False, 0, 0), (0, 1, 0, 2, "normal", False, 0, 1)])
    closed = edges(spark, [(0, 0, 0, 1, "closed", False, None, None), (0, 1, 0, 2, "normal", False, None, None)])
    missing = edges(spark, plain((0, 0, 0, 1)))
    grids = spark.createDataFrame([(1, 1, 3), (2, 1, 2)], "g long, grid_rows int, grid_cols int")
    for e, step in ((reversed_, 1), (missing, 2), (closed, 3)):
        assert G.repair(e, nodes, at(spark, (0, 0)), none, at(spark, (0, 2)), grids, none).first()["step"] == step
    # a node is missing: only the last step has it, in a graph's own grid or as a landmark
    two = at(spark, (0, 0), (0, 2))
    assert G.repair(missing, two, at(spark, (0, 0)), none, at(spark, (0, 2)), grids, none).first()["step"] == 4
    narrow = spark.createDataFrame([(1, 1, 1)], "g long, grid_rows int, grid_cols int")
    assert G.repair(missing, two, at(spark, (0, 0)), none, at(spark, (0, 2)), narrow, none).first()["step"] is None
    assert G.repair(missing, two, at(spark, (0, 0)), none, at(spark, (0, 2)), narrow, at(spark, (0, 1), (0, 2))).first()["step"] == 4


def test_routes_by_group_and_by_rounds_agree(spark):
    class T:
        pass

    t = T()
    t.spark, t.supplier = spark, spark.range(1, 8).withColumnRenamed("id", "s_suppkey")
    few = X.profiles(t).where("profile in ('unit', 'p07', 'p13', 'p40')")
    args = (G.arcs(X.edges(t)), few, X.starts(t), X.vias(t), X.goals(t))
    group, rounds = (sorted(map(tuple, G.route_costs(*args, group_arcs=n).select("g", "profile", "action", "cost").collect())) for n in (10_000, 0))
    assert group == rounds and len(group) > 20 and len(X.PROFILES) == 48


def test_shortest_path(spark):
    e = edges(spark, plain((0, 0, 0, 1), (0, 1, 1, 1), (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 1, 2)))
    path = sorted(map(tuple, G.shortest_path(G.arcs(e), at(spark, (0, 0)), at(spark, (1, 2))).select("step", "r", "c").collect()))
    assert [p[0] for p in path] == [0, 1, 2, 3] and path[0][1:] == (0, 0) and path[-1][1:] == (1, 2)
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(path, path[1:]))


def test_resolver(spark):
    lm = spark.createDataFrame([(1, 0, "canteen", 0, 1), (1, 1, "canteen", 4, 3), (1, 2, "library", 3, 3), (1, 3, "gate", 2, 0)], "g long, ord int, type string, r int, c int")
    cases = [("canteen", "north", None, (0, 1)), ("canteen", "near", "library", (4, 3)), ("canteen", "far", "library", (0, 1)), ("canteen", "west_most", None, (2, 0)), ("x", "anchor_near", "library", (4, 3)), ("gate", "north", None, (2, 0))]
    for type_, ref, anchor, want in cases:
        s = spark.createDataFrame([(1, type_, ref, anchor)], "g long, type string, ref string, anchor string")
        got = J.resolve_targets(s, lm).first()
        assert (got["r"], got["c"]) == want, (type_, ref)
    assert got["used_ref"] is None


def test_argmax_ties_take_the_lower(spark):
    s = spark.createDataFrame([(0, 3, 0.5), (0, 1, 0.5), (1, 2, 0.2)], "g int, a int, p double")
    groups = spark.createDataFrame([(0,), (1,), (2,)], "g int")
    assert rows(P.argmax(s, groups, "g", "a", "p"), "g", "a") == [(0, 1), (1, 2), (2, -1)]


def test_fitted_grid_is_the_lattice(spark):
    pts = spark.createDataFrame([(1, r * 10 + c, 40.0 * c + 3 * r, 40.0 * r - 3 * c, 0.5) for r in range(4) for c in range(5)], "g int, k int, x double, y double, score double")
    got = {x["k"]: (x["row"], x["col"]) for x in P.fit_grid(pts, ["g"], "k", "score").collect()}
    assert got == {r * 10 + c: (r, c) for r in range(4) for c in range(5)}


def test_problems_of_a_broken_graph(spark):
    scenes = spark.createDataFrame([(1, 5, 5, 0, 0)], "g long, grid_rows int, grid_cols int, robot_r int, robot_c int")
    e = edges(spark, [(0, 0, 0, 1, "normal", False, 3, 3), (0, 1, 0, 0, "normal", False, None, None), (0, 0, 2, 2, "normal", False, None, None)])
    lm = spark.createDataFrame([(1, 0, "gate", 0, 0)], "g long, ord int, type string, r int, c int")
    got = {r["problem"] for r in G.problems(scenes, at(spark, (0, 0), (0, 1)), e, lm).collect()}
    assert got == {"duplicate_edge", "edge_end_missing", "not_adjacent", "oneway_target", "landmark_on_robot"}
