"""Aggregations and evaluation metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.operators.graph import lattice_edges
from corpusgrid.operators.sample import numbered
from corpusgrid.session import dealt, stage


def rate(ok: Column) -> Column:
    """Share of true rows; nulls do not count."""
    return F.avg(ok.cast("int"))


def macro_accuracy(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """A1: mean over the groups of their accuracies."""
    return df.groupBy(group).agg(rate(ok).alias("a")).agg(F.avg("a").alias("macro"), F.count(F.lit(1)).alias("groups"))


def majority_baseline(train: DataFrame, test: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """A2: most frequent label per group of train (ties: first seen), and its accuracy on test."""
    n = train.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    top = n.groupBy(group).agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), "first")).alias("majority"))
    return test.join(top, group, "left").groupBy(group).agg(F.first("majority").alias("majority"), rate(F.coalesce(F.col(label) == F.col("majority"), F.lit(False))).alias("accuracy"))


def ablation(df: DataFrame, scenario: str, member: str, exact: str, ok: Column) -> DataFrame:
    """A3: accuracy per scenario, per scenario and member, per scenario and exactness, in one pass."""
    x = df.withColumn("_ok", ok.cast("int"))
    return df.sparkSession.sql(
        f"SELECT {scenario} AS scenario, {member} AS member, {exact} AS exact, avg(_ok) AS accuracy, count(*) AS n FROM {{x}} "
        f"GROUP BY GROUPING SETS (({scenario}), ({scenario}, {member}), ({scenario}, {exact}))", x=x,
    )


def slices(df: DataFrame, named: dict[str, Column], ok: Column) -> DataFrame:
    """A4, A10: overlapping slices of rows; an empty slice keeps a row with a null accuracy."""
    each = df.select(ok.cast("int").alias("_ok"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))).alias("slice"))
    every = df.sparkSession.createDataFrame([(n,) for n in named], "slice string")
    got = each.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg("_ok").alias("accuracy"))
    return every.join(got, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def set_match(pred: DataFrame, truth: DataFrame, keys: list[str], group: str, rows: int = 0) -> DataFrame:
    """Per group whether the sets are equal, with precision and recall. A null in a key equals nothing.

    Both sides are one table with marks, dealt out by group once; rows, if given, is about how many there are."""
    side = lambda df, p, t: df.select(group, *keys, F.lit(p).alias("_p"), F.lit(t).alias("_t"))
    known = F.lit(True)
    for c in (group, *keys):
        known = known & F.col(c).isNotNull()
    each = dealt(side(pred, 1, 0).unionByName(side(truth, 0, 1)), rows, group).groupBy(group, *keys).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    both = each.groupBy(group).agg(F.sum(F.when(known, F.col("_p") * F.col("_t")).otherwise(0)).alias("both"), F.sum("_p").alias("pred"), F.sum("_t").alias("true"))
    return both.select(group, ((F.col("both") == F.col("pred")) & (F.col("both") == F.col("true"))).alias("exact"), "both", "pred", "true")


def extraction_report(pred: dict[str, DataFrame], truth: dict[str, DataFrame], *by: str) -> DataFrame:
    """Metric, value and n, in all and for each value of the columns `by` of truth's scenes (null: all).

    Both sides are scenes (g, grid_rows, grid_cols, robot_r, robot_c, heading, weather), nodes (g, r, c, x, y), edges and
    landmarks (g, type, r, c). Every comparison is a row (g, metric, ok): recall and precision of nodes and landmarks,
    existence over all pairs that stand side by side or have an edge, attributes of shared edges, equal sets, and whole
    scenes. node_err_px is the distance of shared nodes (mean, and 95th percentile by linear interpolation).
    """
    one, t_, p_ = F.lit(True), F.coalesce("_t", F.lit(False)), F.coalesce("_p", F.lit(False))
    both = lambda a, b, on: a.withColumn("_t", one).join(b.withColumn("_p", one), on, "full")
    listed = lambda df, *rows: df.select("g", F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(m).alias("metric"), ok.alias("ok"))) for m, c, ok in rows]))).alias("x")).select("g", "x.*")
    same = lambda df, ok, name: df.groupBy("g").agg(F.bool_and(ok).alias(name))

    n = both(truth["nodes"].select("g", "r", "c", "x", "y"), pred["nodes"].select("g", "r", "c", F.col("x").alias("x2"), F.col("y").alias("y2")), ["g", "r", "c"])
    rows = listed(n, ("node_recall", t_, p_), ("node_precision", p_, t_))
    errors = n.where(t_ & p_).select("g", F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2).alias("e"))

    def keyed(e: DataFrame, end: str = "") -> DataFrame:
        a, b = F.struct(F.col("ar").alias("r"), F.col("ac").alias("c")), F.struct(F.col("br").alias("r"), F.col("bc").alias("c"))
        rest = [F.col(c).alias(c + end) for c in ("status", "stairs", "oneway_r", "oneway_c") if c in e.columns]
        return e.select("g", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *rest)

    e = both(keyed(truth["edges"]), keyed(pred["edges"], "2"), ["g", "a", "b"])
    e = e.join(keyed(lattice_edges(truth["nodes"].select("g", "r", "c"))).distinct(), ["g", "a", "b"], "full")
    status, stairs = F.col("status") == F.col("status2"), F.col("stairs") == F.col("stairs2")
    way = F.col("oneway_r").eqNullSafe(F.col("oneway_r2")) & F.col("oneway_c").eqNullSafe(F.col("oneway_c2"))
    shared = t_ & p_
    rows = rows.unionByName(listed(
        e, ("edge_exists", one, t_ == p_), ("edge_status", shared, status), ("edge_stairs", shared, stairs), ("edge_oneway", shared, way),
        ("edge_stairs_recall", shared & F.col("stairs"), F.col("stairs2")), ("edge_oneway_recall", shared & F.col("oneway_r").isNotNull(), way),
    ))
    m = both(truth["landmarks"].select("g", "type", "r", "c").distinct(), pred["landmarks"].select("g", "type", "r", "c").distinct(), ["g", "type", "r", "c"])
    rows = rows.unionByName(listed(m, ("landmark_recall", t_, p_), ("landmark_precision", p_, t_)))

    fields = ("grid_rows", "grid_cols", "robot_r", "robot_c", "heading", "weather")
    x = truth["scenes"].select("g", *fields).join(pred["scenes"].select("g", *[F.col(c).alias(c + "2") for c in fields]), "g", "left")
    for df, ok, name in ((n, t_ & p_, "_nodes"), (e, (~t_ & ~p_) | (shared & status & stairs & way), "_edges"), (m, t_ & p_, "_landmarks")):
        x = x.join(same(df, F.coalesce(ok, F.lit(False)), name), "g", "left").withColumn(name, F.coalesce(name, one))
    eq = lambda *cs: F.coalesce(reduce(lambda u, v: u & v, [F.col(c).eqNullSafe(F.col(c + "2")) for c in cs]), F.lit(False))
    grid, robot, heading, weather = eq("grid_rows", "grid_cols"), eq("robot_r", "robot_c"), eq("heading"), eq("weather")
    every = grid & F.col("_nodes") & F.col("_edges") & F.col("_landmarks") & robot & heading & weather
    rows = rows.unionByName(listed(
        x, ("grid_shape", one, grid), ("node_set", one, grid & F.col("_nodes")), ("edge_set", one, F.col("_edges")), ("landmark_set", one, F.col("_landmarks")),
        ("robot_rc", one, robot), ("robot_heading", one, robot & heading), ("weather", one, weather), ("scene_exact", one, every),
    ))
    named = truth["scenes"].select("g", *by)
    total = lambda df, *cs: df.rollup(*by) if by else df.groupBy()  # noqa: E731, ARG005
    rates = rows.join(named, "g", "left").select("metric", "ok", *by)
    rates = rates.cube("metric", *by).agg(F.avg(F.col("ok").cast("int")).alias("value"), F.count("ok").alias("n")).where("metric is not null")
    err = total(errors.join(named, "g", "left")).agg(F.avg("e").alias("mean"), F.percentile("e", 0.95).alias("p95"), F.count("e").alias("n"))
    err = err.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(f"node_err_px_{c}").alias("metric"), F.col(c).alias("value")) for c in ("mean", "p95")])).alias("x")).select("x.metric", *by, "x.value", "n")
    return rates.unionByName(err)


def field_match(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Share of rows right per (truth, prediction) field and in all; an unknown truth counts as right."""
    ok = {t: F.col(t).isNull() | F.col(t).eqNullSafe(F.col(p)) for t, p in fields}
    every = F.lit(True)
    for c in ok.values():
        every = every & c
    return df.agg(*[rate(c).alias(t) for t, c in ok.items()], rate(every).alias("all_fields"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: Column, pred: Column, *by: str) -> DataFrame:
    """Counts, sensitivity, specificity, balanced accuracy, false positive and miss rates."""
    c = df.groupBy(*by).agg(F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"), F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn"))
    sens, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return c.select("*", sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced"), (1 - spec).alias("fp_rate"), (1 - sens).alias("miss_rate"))


def paired(df: DataFrame, a: Column, b: Column, *by: str) -> DataFrame:
    """Wins and losses of b over a on the same rows, delta and its 95 % normal interval."""
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~a & b).alias("wins"), F.count_if(a & ~b).alias("losses"))
    d = (F.col("wins") - F.col("losses")) / F.col("n")
    se = F.sqrt(F.greatest(F.lit(0.0), (F.col("wins") + F.col("losses")) / F.col("n") - d * d) / F.col("n"))
    return c.select("*", d.alias("delta"), (d - 1.96 * se).alias("low"), (d + 1.96 * se).alias("high"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant rows; 1 without any."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("long")
    step = lambda acc, i: F.struct((acc["t"] + F.log((n - i + 1) / i)).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1) / i))).alias("s"))
    start = -n * F.log(F.lit(2.0))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(start.alias("t"), F.exp(start).alias("s")), step, lambda acc: acc["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def all_of_group(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """Share of groups that are right in every row, and the mean of the groups' shares."""
    g = df.groupBy(group).agg(F.bool_and(ok).alias("every"), rate(ok).alias("share"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), rate(F.col("every")).alias("all_right"), F.avg("share").alias("mean_share"))


def stability(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, extremes and deviation over replicates, and how many are positive and negative."""
    v = F.col(value)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("sd"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"))


def tie_scores(df: DataFrame, row: str, cost: str, action: str, label: str) -> DataFrame:
    """Per row whether the cheapest action is tied, and the expected score of a random choice among the cheapest."""
    x = df.withColumn("_m", F.min(cost).over(Window.partitionBy(row))).where(F.col(cost) == F.col("_m"))
    return x.groupBy(row).agg((F.count(F.lit(1)) > 1).alias("tied"), F.max((F.col(action) == F.col(label)).cast("double")).alias("_h"), F.count(F.lit(1)).alias("_n")).select(row, "tied", (F.col("_h") / F.col("_n")).alias("score"))


def submission_diff(a: DataFrame, b: DataFrame, pos: str, action: str, per_scene: int = 10) -> DataFrame:
    """Changed rows, share, and changed scenes per robot, with a total row (robot null)."""
    x = a.select(pos, F.col(action).alias("_a")).join(b.select(pos, F.col(action).alias("_b")), pos)
    x = x.select((F.col(pos) % per_scene).alias("robot"), F.floor(F.col(pos) / per_scene).alias("scene"), (F.col("_a") != F.col("_b")).alias("c"))
    return x.rollup("robot").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("changed"), F.count_distinct(F.when(F.col("c"), F.col("scene"))).alias("scenes"))


def score_bound(df: DataFrame, scene: Column, changed: Column, k: int, score: float) -> DataFrame:
    """Most points a public subset of k scenes can move, and the interval around score; k must be 1..scenes."""
    g = df.groupBy(scene.alias("scene")).agg(F.count_if(changed).alias("c"))
    top = g.orderBy(F.desc("c"), "scene").limit(k)
    bound = 100 * F.sum("c") / (10 * k)
    out = top.agg(bound.alias("bound"), F.count(F.lit(1)).alias("scenes"))
    ok = F.col("scenes") == k if k >= 1 else F.lit(False)
    return out.where(ok).select("bound", F.greatest(F.lit(0.0), score - F.col("bound")).alias("low"), F.least(F.lit(100.0), score + F.col("bound")).alias("high"))


def label_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of every value of several columns in one pass."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return each.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median (mean of the middles), sorted[int(q * (n - 1))], sorted[int(q * n)] and linear, at 0.9.

    Values are counted, then ranked by range partitions, and only those at the wanted places are gathered; nulls are left out.
    """
    v = df.select(by, value).where(F.col(value).isNotNull())
    n = v.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(v, [by], value)
    place = lambda c: F.floor(c).cast("long") + 1
    at = {"m0": place((F.col("_n") - 1) / 2), "m1": place(F.col("_n") / 2), "lower_index": place(0.9 * (F.col("_n") - 1)), "upper_index": F.least(place(0.9 * F.col("_n")), F.col("_n")), "l1": F.least(place(0.9 * (F.col("_n") - 1)) + 1, F.col("_n"))}
    x = ranked.join(n, ranked[by].eqNullSafe(n[by])).select(ranked[by], value, "n", "_n")
    x = x.where(F.col("n").isin(*at.values())).groupBy(by, "_n").agg(*[F.max(F.when(F.col("n") == p, F.col(value))).alias(k) for k, p in at.items()])
    part = 0.9 * (F.col("_n") - 1) - F.floor(0.9 * (F.col("_n") - 1))
    return x.select(by, ((F.col("m0") + F.col("m1")) / 2).alias("median"), "lower_index", "upper_index", (F.col("lower_index") + (F.col("l1") - F.col("lower_index")) * part).alias("linear"))


def cue_table(df: DataFrame, cues: dict[str, Column], label: Column, *by: str) -> DataFrame:
    """2 x 2 counts of cue and label, both conditional rates and their difference."""
    each = df.select(*by, label.cast("int").alias("_l"), F.explode(F.array(*[F.struct(F.lit(n).alias("cue"), c.alias("has")) for n, c in cues.items()])).alias("x"))
    g = each.groupBy(*by, F.col("x.cue").alias("cue")).agg(F.count_if("x.has").alias("with_cue"), F.count_if(~F.col("x.has")).alias("without"), F.avg(F.when(F.col("x.has"), F.col("_l"))).alias("p_with"), F.avg(F.when(~F.col("x.has"), F.col("_l"))).alias("p_without"))
    return g.withColumn("difference", F.col("p_with") - F.col("p_without"))


def shortcuts(df: DataFrame, grams: Column, labels: list[str], least: int = 64, low: float = 0.03, high: float = 0.97, large: float = 0.2, top: int = 20) -> DataFrame:
    """Grams whose presence tells a label: largest |P(label | gram) - 0.5| among those of enough support.

    Support is at least `least` rows and the share `low`, at most the share `high`; from the share `large` on it is a list
    of its own. Each list has its `top` grams, and how many of it are 10 and 20 points off. All labels are summed in one
    aggregate over the exploded grams (distinct per row); a null gram of every row counts the rows in the same pass, and
    grams without support go before ranking.
    """
    each = df.select(*labels, F.explode(F.concat(grams, F.array(F.lit(None).cast("string")))).alias("gram"))
    g = each.groupBy("gram").agg(F.count(F.lit(1)).alias("support"), *[F.sum(F.col(x).cast("int")).alias(x) for x in labels]).where((F.col("support") >= least) | F.col("gram").isNull())
    g = stage(g, "grams")
    total = (g.where("gram is null").agg(F.max("support")).first()[0] or 0)
    g = g.where("gram is not null").where((F.col("support") >= low * total) & (F.col("support") <= high * total))
    long = g.select("gram", "support", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (F.col(x) / F.col("support")).alias("p")) for x in labels])).alias("x")).select("gram", "support", "x.label", "x.p")
    long = long.withColumn("size", F.when(F.col("support") >= large * total, "large").otherwise("medium"))
    off = F.abs(F.col("p") - 0.5)
    counts = long.groupBy("label", "size").agg(F.count_if(off >= 0.1).alias("over_10"), F.count_if(off >= 0.2).alias("over_20"))
    w = Window.partitionBy("label", "size").orderBy(F.desc(off), "gram")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(F.broadcast(counts), ["label", "size"])
