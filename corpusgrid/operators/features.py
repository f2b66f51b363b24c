"""Ranking features over graphs (F1-F9) and point-grid geometry."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.session import broadcast_if_small, dealt, stage

#: Points of a group that are compared in one row.
GROUP_POINTS = 256
MISSING = (100_000, 100_000, 4, 0)  # cost, regret (hundredths), rank, best of an action without a route


def context(scenes: DataFrame, nodes: DataFrame, edges: DataFrame, landmarks: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """sizes, edge density, position of the robot, landmark counts and one-hots of the heading."""
    n = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("g").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("status") == "closed").alias("n_closed"), F.count_if("stairs").alias("n_stairs"))
    lm = landmarks.groupBy("g").agg(*[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in types])
    x = scenes.join(n, "g", "left").join(e, "g", "left").join(lm, "g", "left")
    one_hot = [(F.col("heading") == h).cast("int").alias(f"heading_{h}") for h in range(4)]
    return x.select("g", "n_nodes", "n_edges", (F.col("n_edges") / F.col("n_nodes")).alias("density"), "n_closed", "n_stairs", (F.col("robot_r") / (F.col("grid_rows") - 1)).alias("row"), (F.col("robot_c") / (F.col("grid_cols") - 1)).alias("col"), *[f"n_{k}" for k in types], *one_hot)


def action_features(starts: DataFrame, arcs: DataFrame, waypoints: DataFrame, turn) -> DataFrame:
    """per graph and action: legal, status, stairs, turn, exits of the next node, least Manhattan distance; zeros if illegal."""
    four = starts.withColumn("action", F.explode(F.array(*map(F.lit, range(4)))))
    out = arcs.groupBy("g", F.col("r").alias("r2"), F.col("c").alias("c2")).agg(F.count(F.lit(1)).alias("exits"))
    a = arcs.select("g", "r", "c", "action", "r2", "c2", "status", "stairs").join(out, ["g", "r2", "c2"], "left")
    x = four.join(a, ["g", "r", "c", "action"], "left")
    near = x.where("r2 is not null").join(waypoints.select("g", F.col("r").alias("wr"), F.col("c").alias("wc")), "g").groupBy("g", "action").agg(F.min(F.abs(F.col("r2") - F.col("wr")) + F.abs(F.col("c2") - F.col("wc"))).alias("distance"))
    x = x.join(near, ["g", "action"], "left")
    legal = F.col("r2").isNotNull()
    return x.select("g", "action", legal.alias("legal"), F.when(legal, F.col("status")).otherwise("none").alias("status"), F.coalesce("stairs", F.lit(False)).alias("stairs"), F.when(legal, turn(F.col("heading"), F.col("action"))).otherwise("none").alias("turn"), F.coalesce("exits", F.lit(0)).alias("exits"), F.coalesce("distance", F.lit(0)).alias("distance"))


def cost_features(graphs: DataFrame, profiles: DataFrame, costs: DataFrame) -> DataFrame:
    """cost, regret, dense rank and best flag for every graph, profile and action; sentinels without a route."""
    w = Window.partitionBy("g", "profile")
    ranked = costs.withColumns({"regret": F.col("cost") - F.min("cost").over(w), "rank": F.dense_rank().over(w.orderBy("cost")) - 1})
    every = graphs.crossJoin(broadcast_if_small(profiles.select("profile"))).withColumn("action", F.explode(F.array(*map(F.lit, range(4)))))
    x = every.join(ranked, ["g", "profile", "action"], "left")
    fill = lambda c, v: F.coalesce(c, F.lit(v)).cast("long").alias(c)
    return x.select("g", "profile", "action", fill("cost", MISSING[0]), fill("regret", MISSING[1]), fill("rank", MISSING[2]), F.coalesce((F.col("regret") == 0).cast("long"), F.lit(MISSING[3])).alias("best"))


def candidates(actions: DataFrame, ctx: DataFrame) -> DataFrame:
    """a row per legal action: context, own features, number of legal actions, distance over the least."""
    w = Window.partitionBy("g")
    x = actions.where("legal").withColumns({"n_legal": F.count(F.lit(1)).over(w), "excess": F.col("distance") - F.min("distance").over(w)})
    return x.join(ctx, "g")


def labelled(cands: DataFrame, labels: DataFrame) -> DataFrame:
    """positive marks the candidate that is the label; groups without a label go."""
    return cands.join(labels.select("g", F.col("action").alias("_l")), "g").withColumn("positive", F.col("action") == F.col("_l")).drop("_l")


def wide(features: DataFrame, profiles: list[str], values: tuple[str, ...] = ("cost", "regret", "rank", "best")) -> DataFrame:
    """one row per graph with columns profile_action_value in fixed order."""
    named = features.withColumn("name", F.concat_ws("_", "profile", "action"))
    names = [f"{p}_{a}" for p in profiles for a in range(4)]
    return named.groupBy("g").pivot("name", names).agg(*[F.first(v).alias(v) for v in values])


def argmax(scores: DataFrame, groups: DataFrame, group: str, item: str, p: str) -> DataFrame:
    """F8: item with the largest p per group, ties to the lower item; -1 for a group without rows."""
    best = scores.groupBy(group).agg(F.max_by(item, F.struct(p, -F.col(item))).alias(item))
    return groups.select(group).join(best, group, "left").select(group, F.coalesce(item, F.lit(-1)).alias(item))


def masked_argmax(scores: DataFrame, legal: DataFrame, group: str, item: str, p: str) -> DataFrame:
    """argmax among legal items, and its probability renormalised over them (null if they hold none)."""
    ok = scores.join(legal.select(group, item), [group, item], "left_semi")
    g = ok.groupBy(group).agg(F.max_by(F.struct(item, p), F.struct(p, -F.col(item))).alias("b"), F.sum(p).alias("s"))
    return g.select(group, f"b.{item}", F.try_divide(F.col("b")[p], F.col("s")).alias("confidence"))


def gap_clusters(df: DataFrame, group: list[str], value: str, gap: Column | float, name: str = "cluster") -> DataFrame:
    """Number of the cluster of each value, from 0; a step over `gap` in sorted order starts a new one."""
    w = Window.partitionBy(*group).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def neighbours(points: DataFrame, group: list[str], key: str, n: int) -> DataFrame:
    """The n nearest other points of every point of a group, ties to the lower key: key, x, y, k2, x2, y2, d2, rank.

    A group of up to GROUP_POINTS points is compared inside its own row, an array, and no pair of points becomes a row;
    larger groups are compared cell by cell.
    """
    at = [*group, key]
    p = points.select(*at, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=[*at, "x", "y"])
    sizes = p.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))
    found = sizes.agg(F.sum("_m").alias("n"), F.max("_m").alias("most")).first()
    inside = lambda df: _neighbours_by_group(dealt(df, found["n"] or 0, *group), group, key, n)
    if (found["most"] or 0) <= GROUP_POINTS:
        return inside(p)
    large = stage(sizes.where(F.col("_m") > GROUP_POINTS).select(*group), "large")
    small, rest = (p.join(large, group, how) for how in ("left_anti", "left_semi"))
    return inside(small).unionByName(_neighbours_by_cells(rest, group, key, n))


def _neighbours_by_group(points: DataFrame, group: list[str], key: str, n: int) -> DataFrame:
    each = points.groupBy(*group).agg(F.collect_list(F.struct(F.col(key).alias("k"), "x", "y")).alias("_ps"))

    def nearest(p: Column) -> Column:
        others = F.filter("_ps", lambda q: q["k"] != p["k"])
        d2 = lambda q: (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2
        return F.slice(F.array_sort(F.transform(others, lambda q: F.struct(d2(q).alias("d2"), q["k"].alias("k2"), q["x"].alias("x2"), q["y"].alias("y2")))), 1, n)

    x = each.select(*group, F.explode("_ps").alias("_p"), "_ps").select(*group, "_p", F.posexplode(nearest(F.col("_p"))).alias("_i", "_q"))
    return x.select(*group, F.col("_p.k").alias(key), "_p.x", "_p.y", "_q.k2", "_q.x2", "_q.y2", "_q.d2", (F.col("_i") + 1).alias("rank"))


def _neighbours_by_cells(points: DataFrame, group: list[str], key: str, n: int) -> DataFrame:
    """neighbours() for groups of any size.

    Points meet those of their cell and the eight around it, of a side that puts about four points in a cell. Whatever
    lies outside is farther away than the side, so a point is settled once its n-th neighbour is not; the few others are
    tried again with cells twice as wide, until a cell spans the group.
    """
    at = [*group, key]
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    box = points.groupBy(*group).agg(span.alias("_span"), (2 * span / F.sqrt(F.count(F.lit(1)))).alias("_side"))
    every = stage(points.join(box, group).select(*at, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "_span", F.when(F.col("_side") > 0, F.col("_side")).otherwise(1.0).alias("_side")), "points")
    cell = lambda c, d=0: (F.floor(F.col(c) / F.col("_side")) + d).alias(f"_c{c}")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    pending, wide, parts = every, 1, []
    while True:
        cells = lambda df, wide=wide: df.withColumn("_side", F.col("_side") * wide)
        a = cells(pending).withColumn("_d", around).select(*at, "x", "y", "_span", "_side", cell("x", F.col("_d.i")), cell("y", F.col("_d.j")))
        b = cells(every).select(*group, F.col(key).alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x"), cell("y"))
        d = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2
        met = a.join(b, [*group, "_cx", "_cy"]).where(F.col(key) != F.col("k2")).withColumn("d2", d)
        near = met.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy("d2", "k2"))).where(F.col("rank") <= n)
        last = Window.partitionBy(*at)
        sure = (F.col("_side") >= F.col("_span")) | ((F.count(F.lit(1)).over(last) == n) & (F.max("d2").over(last) <= F.col("_side") * F.col("_side")))
        found = stage(near.withColumn("_sure", sure), "near")
        parts.append(found.where("_sure").select(*at, "x", "y", "k2", "x2", "y2", "d2", "rank"))
        pending = stage(pending.where(F.col("_side") * wide < F.col("_span")).join(found.where("_sure").select(*at), at, "left_anti"), "pending")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        wide *= 2


def dominant_angle(points: DataFrame, group: list[str], key: str) -> DataFrame:
    """Median direction to the two nearest neighbours, folded to [-pi/4, pi/4)."""
    return _angle(neighbours(points, group, key, 2), group)


def _angle(near: DataFrame, group: list[str], *more: Column) -> DataFrame:
    angle = F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))
    quarter = math.pi / 2
    folded = F.pmod(angle + quarter / 2, F.lit(quarter)) - quarter / 2
    return near.groupBy(*group).agg(F.percentile(folded, 0.5).alias("angle"), *more)


def fit_grid(points: DataFrame, group: list[str], key: str, score: str, least: int = 4) -> DataFrame:
    """Points turned by the dominant angle, clustered to rows and columns at half the spacing; the best point a cell."""
    near = neighbours(points, group, key, 2)
    spacing = F.percentile(F.when(F.col("rank") == 1, F.sqrt("d2")), 0.5).alias("spacing")
    x = points.join(_angle(near, group, spacing), group)
    c, s = F.cos("angle"), F.sin("angle")
    x = x.withColumns({"u": F.col("x") * c + F.col("y") * s, "v": F.col("y") * c - F.col("x") * s})
    for axis, name in (("v", "row"), ("u", "col")):
        x = gap_clusters(x, group, axis, F.col("spacing") / 2, name)
    cells = x.groupBy(*group, "row", "col").agg(F.max_by(key, F.struct(score, -F.col(key))).alias(key))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return cells.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def spacing(nodes: DataFrame, group: str) -> DataFrame:
    """Median distance of nodes side by side, 0 if there are none."""
    a = nodes.select(group, "r", "c", "x", "y")
    b = nodes.select(group, F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    step = lambda dr, dc: a.withColumns({"r2": F.col("r") + dr, "c2": F.col("c") + dc}).join(b, [group, "r2", "c2"])
    d = step(0, 1).unionByName(step(1, 0)).groupBy(group).agg(F.percentile(F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2), 0.5).alias("spacing"))
    return nodes.select(group).distinct().join(d, group, "left").select(group, F.coalesce("spacing", F.lit(0.0)).alias("spacing"))


def threshold_shapes(points: DataFrame, group: str, key: str, score: str, thresholds: list[float]) -> DataFrame:
    """Grid shape at every threshold, in one job: group, threshold, rows, cols, cells."""
    ts = points.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    x = points.join(F.broadcast(ts), F.col(score) >= F.col("threshold"))
    g = fit_grid(x, [group, "threshold"], key, score)
    return g.groupBy(group, "threshold").agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"), F.count(F.lit(1)).alias("cells"))


def first_good_threshold(shapes: DataFrame, groups: DataFrame, group: str, base: float, low: int, high: int) -> DataFrame:
    """P5: lowest threshold whose grid has low..high rows and columns, else base."""
    ok = shapes.where(F.col("rows").between(low, high) & F.col("cols").between(low, high)).groupBy(group).agg(F.min("threshold").alias("threshold"))
    return groups.select(group).distinct().join(ok, group, "left").select(group, F.coalesce("threshold", F.lit(base)).alias("threshold"))
