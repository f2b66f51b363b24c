"""Trees by key, families, thresholds and searches against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusgrid.operators import ensemble as E
from corpusgrid.operators import trees
from corpusgrid.session import stage


def rows_of(seed, n=120):
    """Two keys with opposite rules on two features; a third feature says nothing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randrange(20), rng.randrange(20), rng.randrange(3)
        out += [("up", i, a, b, c, a > 11), ("down", i, a, b, c, a <= 11 and b > 4)]
    return out


def frame(spark, rows, features=("a", "b", "c")):
    df = spark.createDataFrame(rows, "k string, i int, a int, b int, c int, y boolean").repartition(3)
    return stage(trees.binned(df, list(features), trees.cut_points(df, list(features), 64)), "rows")


def best_stump(rows, penalty):
    """(feature, value below which rows go left, left leaf, right leaf) by trying every cut."""
    found = []
    for f, values in ((2, range(20)), (3, range(20)), (4, range(3))):
        for v in values:
            left, right = [r for r in rows if r[f] <= v], [r for r in rows if r[f] > v]
            if min(len(left), len(right)) >= 5:
                g = [sum(0.5 - r[5] for r in side) for side in (left, right)]
                h = [0.25 * len(side) for side in (left, right)]
                gain = sum(x * x / (y + penalty) for x, y in zip(g, h)) - sum(g) ** 2 / (sum(h) + penalty)
                found.append((round(gain, 9), -f, -v, [-x / (y + penalty) for x, y in zip(g, h)]))
    gain, f, v, leaves = max(found)
    return -f, -v, leaves


def test_stump_of_each_key_by_hand(spark):
    rows = rows_of(1)
    family = trees.Family(trees=1, depth=1, rate=1.0)
    df = frame(spark, rows)
    got = {(r["k"], r["i"]): r["p"] for r in trees.score(df, trees.fit(df, "k", "y", family), "k", family).collect()}
    for k in ("up", "down"):
        own = [r for r in rows if r[0] == k]
        f, v, leaves = best_stump(own, 1.0)
        for r in own:
            assert got[k, r[1]] == pytest.approx(1 / (1 + math.exp(-leaves[r[f] > v])))


@pytest.mark.parametrize("name", sorted(trees.FAMILIES))
def test_each_family_learns_each_key(spark, name):
    family, df, new = trees.FAMILIES[name], frame(spark, rows_of(2, 300)), rows_of(3, 60)
    model = trees.fit(df, "k", "y", family, "i")
    cuts = trees.cut_points(spark.createDataFrame(rows_of(2, 300), "k string, i int, a int, b int, c int, y boolean"), ["a", "b", "c"], 64)
    held = trees.binned(spark.createDataFrame(new, "k string, i int, a int, b int, c int, y boolean"), ["a", "b", "c"], cuts)
    right = [(r["p"] > 0.5) == r["y"] for r in trees.score(held, model, "k", family).collect()]
    assert len(right) == len(new) and sum(right) > 0.93 * len(right)


def test_keys_do_not_touch_each_other(spark):
    family = trees.Family(trees=2, depth=2)
    both = {r["k"]: r["trees"] for r in trees.fit(frame(spark, rows_of(4)), "k", "y", family).collect()}
    for k in both:
        df = stage(frame(spark, rows_of(4)).where(F.col("k") == k), "one")
        assert repr(trees.fit(df, "k", "y", family).first()["trees"])[:200] == repr(both[k])[:200]


@pytest.mark.parametrize("name", sorted(trees.FAMILIES))
def test_rows_are_added_up_in_their_task(spark, monkeypatch, name):
    """No row is repeated by tree or feature, and it is the same however many rows and cells a task takes at a time."""
    df = frame(spark, rows_of(6, 200))
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or collect(x))
    model = lambda: {(r["k"], i): t for r in trees.fit(df, "k", "y", trees.FAMILIES[name], "i").collect() for i, t in enumerate(r["trees"])}
    want = model()
    assert plans and not any("Generate" in p or p.count("Exchange hash") > 1 for p in plans)
    monkeypatch.setattr(trees, "TASK_ROWS", 40)
    monkeypatch.setattr(trees, "TASK_CELLS", 10)
    got = model()
    assert set(got) == set(want) and {k for k, _ in want} == {"up", "down"}
    for k, t in want.items():
        assert (got[k]["feats"], got[k]["cuts"], got[k]["leaf"]) == (t["feats"], t["cuts"], pytest.approx(t["leaf"]))


def test_degenerate_tables(spark):
    df = frame(spark, [("only", i, 1, None, 2, True) for i in range(9)])
    got = trees.score(df, trees.fit(df, "k", "y"), "k").collect()
    assert len(got) == 9 and len({r["p"] for r in got}) == 1 and got[0]["p"] > 0.5
    empty = df.where("false")
    assert trees.score(empty, trees.fit(stage(empty, "none"), "k", "y"), "k").collect() == []


def candidates(spark, n=150):
    """Robot "near" goes to the smallest a, "far" to the largest; of "luck" nothing is to be learned."""
    rng = random.Random(5)
    rows = []
    for g in range(n):
        a = [rng.random() for _ in range(4)]
        for robot, best in (("near", min(range(4), key=a.__getitem__)), ("far", max(range(4), key=a.__getitem__)), ("luck", rng.randrange(4))):
            rows += [(robot, g, i, a[i], a[i] - min(a), max(a) - a[i], i == best) for i in range(4)]
    return stage(spark.createDataFrame(rows, "robot string, g int, item int, a double, low double, high double, y boolean"), "cands")


def test_rankers_by_robot(spark):
    c = candidates(spark)
    got = E.rankers(c, "robot", "g", "item", "y", ["a", "low", "high"], F.col("g") % 2 == 0).join(c.where("y").select("robot", "g", F.col("item").alias("want")), ["robot", "g"])
    share = {r["robot"]: r["s"] for r in got.where("g % 2 = 1").groupBy("robot").agg(F.avg((F.col("item") == F.col("want")).cast("int")).alias("s")).collect()}
    assert share["near"] > 0.95 and share["far"] > 0.95 and share["luck"] < 0.5


def test_families_are_chosen_on_unseen_folds(spark):
    c = candidates(spark, 90)
    families = {"blind": trees.Family(trees=1, depth=1, boosted=False, subset=0), "boosting": trees.Family(trees=2, depth=2)}
    oof = E.out_of_fold(c, "robot", "g", "item", "y", ["a", "low", "high"], families).collect()
    assert len(oof) == 90 * 3 * 2 and all(r["item"] == 0 for r in oof if r["family"] == "blind")
    got = {r["robot"]: r for r in E.select_family(c, "robot", "g", "item", "y", ["a", "low", "high"], families).collect()}
    assert got["near"]["family"] == got["far"]["family"] == "boosting" and got["near"]["accuracy"] > 0.9
    for robot, r in got.items():
        share = {n: sum(x["right"] for x in oof if (x["robot"], x["family"]) == (robot, n)) / 90 for n in families}
        assert {x["family"]: x["accuracy"] for x in r["accuracies"]} == pytest.approx(share) and r["accuracy"] == pytest.approx(max(share.values()))


def test_equal_families_go_to_the_greater_name(spark):
    df = spark.createDataFrame([("r", f, True) for f in ("ab", "b", "aa")], "robot string, family string, ok boolean")
    assert E.best_by_fold(df, "robot", "family", F.col("ok")).first()["family"] == "b"


def gate(rule, model, confidence, threshold):
    return model if rule is None or (model != rule and confidence >= threshold) else rule


def test_threshold_grid_by_hand(spark):
    rng = random.Random(6)
    some = lambda: rng.choice([0, 1, None])
    rows = [(rng.choice("vht"), *[x for _ in range(2) for x in (some(), rng.randrange(2), rng.choice([0.1, 0.5, 0.7, 0.99]), rng.randrange(2))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, r1 int, m1 int, c1 double, t1 int, r2 int, m2 int, c2 double, t2 int").repartition(4)
    grids = {"x": [0.5, 2.0, 0.1], "y": [0.7, 2.0]}
    grid = E.threshold_grid(df, {"x": ("r1", "m1", "c1", "t1"), "y": ("r2", "m2", "c2", "t2")}, grids, "part")
    want = {
        (p, a, b): (sum(gate(*r[1:4], a) == r[4] and gate(*r[5:8], b) == r[8] for r in rows if r[0] == p), sum(r[0] == p for r in rows))
        for p in "vht" for a in grids["x"] for b in grids["y"]
    }
    assert {(r["part"], r["x"], r["y"]): (r["right"], r["rows"]) for r in grid.collect()} == want
    share = lambda p, a, b: want[p, a, b][0] / want[p, a, b][1]
    ok = [(a, b) for a in grids["x"] for b in grids["y"] if share("v", a, b) >= share("v", 2.0, 2.0)]
    best = min(ok, key=lambda t: (-round(share("h", *t) + share("t", *t), 9), -sum(t), t))
    got = E.guarded_thresholds(grid, ["x", "y"], "v").first()
    assert (got["x"], got["y"], got["guard_rule"]) == (*best, pytest.approx(share("v", 2.0, 2.0)))


def test_search_by_condition_by_hand(spark):
    """Every condition ends where a search of its own over a table of all combinations ends."""
    rng = random.Random(8)
    grid = {"a": [1, 2, 3], "b": [1, 2], "c": [5]}
    table = {(g, *w): rng.random() for g in range(12) for w in itertools.product((0, 1, 2, 3), (0, 1, 2), (0, 5))}
    scores = stage(spark.createDataFrame([(*k, v) for k, v in table.items()], "g int, a long, b long, c long, score double"), "scores")
    rows = [(g, c) for g in range(12) for c, test in (("all", True), ("even", g % 2 == 0), ("last", g == 11)) if test]
    conditions = spark.createDataFrame(rows, "g int, condition string")
    jobs = []

    def score(profiles):
        jobs.append(profiles.count())
        return scores.join(profiles, ["a", "b", "c"]).select("g", "profile", "score")

    valid = lambda w: w["a"] + w["b"] < 5
    got = {r["condition"]: r for r in E.coordinate_search_by(conditions, {"a": 0, "b": 0, "c": 0}, grid, score, valid=valid).collect()}
    for name in ("all", "even", "last"):
        own = [g for g, c in rows if c == name]
        mean = lambda w: sum(table[(g, *w)] for g in own) / len(own)  # noqa: E731, B023
        now = [0, 0, 0]
        for _ in range(3):
            start = list(now)
            for i, f in enumerate("abc"):
                for v in grid[f]:
                    new = [*now[:i], v, *now[i + 1 :]]
                    if valid(dict(zip("abc", new))) and mean(new) > mean(now) + 1e-12:
                        now = new
            if now == start:
                break
        r = got[name]
        assert ([r["a"], r["b"], r["c"]], r["n"]) == (now, len(own))
        assert (r["score"], r["unit"]) == (pytest.approx(mean(now)), pytest.approx(mean([0, 0, 0])))
    assert len(jobs) <= 10  # one for the start, one a field and round, whatever the number of conditions
