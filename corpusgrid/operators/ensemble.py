"""Ensembles, gates and search."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import permutations

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.operators import trees
from corpusgrid.operators.sample import folds
from corpusgrid.session import dealt, stage


def soft_vote(df: DataFrame, row: str, cls: str, p: str) -> DataFrame:
    """Class with the largest mean probability over the models, ties to the lower class."""
    m = df.groupBy(row, cls).agg(F.avg(p).alias("p"))
    return m.groupBy(row).agg(F.max_by(F.struct(cls, "p"), F.struct(F.round("p", 9), -F.col(cls))).alias("b")).select(row, f"b.{cls}", "b.p")


def decode(mode: Column, kind: Column, anchor: Column, p_mode: Column, p_kind: Column, p_anchor: Column) -> Column:
    """Spec of the heads that apply, with the product of their confidences."""
    return (
        F.when(mode == "none", F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("anchor"), p_mode.alias("confidence")))
        .when(mode == "plain", F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("anchor"), (p_mode * p_kind).alias("confidence")))
        .otherwise(F.struct(kind.alias("kind"), anchor.alias("anchor"), (p_mode * p_kind * p_anchor).alias("confidence")))
    )


def gated(rule: Column, model: Column, confidence: Column, threshold: float | Column) -> Column:
    """The model fills a missing rule value, and overrides a different one if confident enough."""
    take = rule.isNull() | (~model.eqNullSafe(rule) & (confidence >= threshold))
    return F.struct(F.when(take, model).otherwise(rule).alias("value"), F.when(take & model.isNotNull(), "model").when(rule.isNotNull(), "rule").otherwise("none").alias("source"))


def grid_search(df: DataFrame, rule: str, model: str, confidence: str, truth: str, guard: Column, steps: list[float]) -> DataFrame:
    """Every threshold scored in one job; those that lose against the rule alone on guard rows go; the best on the
    rest, ties to the most conservative."""
    grid = df.sparkSession.createDataFrame([(s,) for s in steps], "threshold double")
    x = df.withColumn("_g", guard).join(F.broadcast(grid))
    ok = gated(F.col(rule), F.col(model), F.col(confidence), F.col("threshold"))["value"].eqNullSafe(F.col(truth)).cast("int")
    base = F.col(rule).eqNullSafe(F.col(truth)).cast("int")
    s = x.groupBy("threshold").agg(F.avg(F.when(F.col("_g"), ok)).alias("guard"), F.avg(F.when(F.col("_g"), base)).alias("guard_rule"), F.avg(F.when(~F.col("_g"), ok)).alias("score"))
    return s.where("guard >= guard_rule").orderBy(F.desc(F.round("score", 9)), F.desc("threshold")).limit(1)


def threshold_grid(df: DataFrame, fields: dict[str, tuple[str, str, str, str]], grids: dict[str, list[float]], part: str) -> DataFrame:
    """Part, a threshold column for each field, right, rows: how many rows have every field right after gating (E3),
    for every combination of thresholds. fields: name -> (rule, model, confidence, truth).

    A field of a row is right as a step function of its threshold: the model's answer below its confidence, the rule's
    above. So a row adds a few corner points to an array of differences, which one aggregate sums to the size of the grid;
    prefix sums along every field then read off all combinations. Rows never meet the grid.
    """
    spark, at = df.sparkSession, {f: sorted(g) for f, g in grids.items()}
    x = df.select(F.col(part).alias("part"), *[
        F.struct(
            F.when(F.col(rule).isNull(), len(at[f])).otherwise(F.size(F.filter(F.array(*map(F.lit, at[f])), lambda t: t <= F.col(conf)))).alias("upto"),
            F.col(model).eqNullSafe(F.col(truth)).cast("int").alias("model"), F.col(rule).eqNullSafe(F.col(truth)).cast("int").alias("rule"),
        ).alias(f) for f, (rule, model, conf, truth) in fields.items()
    ])
    rows = x.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    point = lambda k, w: F.struct(k.cast("int").alias("k"), w.alias("w"))
    x = x.withColumn("_w", F.lit(1))
    for f in fields:
        c, end = F.col(f), F.lit(len(at[f]))
        start = F.when(c["upto"] > 0, c["model"]).otherwise(c["rule"])
        corners = F.array(point(F.lit(0), start), point(F.when(c["upto"] > 0, c["upto"]).otherwise(end), c["rule"] - c["model"]))
        # a step at the end of the grid, or of no height, is none
        x = x.withColumn("_c", F.explode(F.filter(corners, lambda p: (p["k"] < end) & (p["w"] != 0)))).withColumn("_w", F.col("_w") * F.col("_c.w")).withColumn(f, F.col("_c.k")).drop("_c")
    sums = x.groupBy("part", *fields).agg(F.sum("_w").alias("right"))
    grid = rows
    for f in fields:
        grid = grid.join(F.broadcast(spark.createDataFrame([(i, float(t)) for i, t in enumerate(at[f])], f"`{f}` int, `_{f}` double")))
    grid = grid.join(sums, ["part", *fields], "left").na.fill(0, ["right"])
    for f in fields:
        along = Window.partitionBy("part", *[o for o in fields if o != f]).orderBy(f).rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumn("right", F.sum("right").over(along))
    return grid.select("part", *[F.col(f"_{f}").alias(f) for f in fields], "right", "rows")


def guarded_thresholds(grid: DataFrame, fields: list[str], guard: str) -> DataFrame:
    """One row of a threshold_grid: thresholds, guard, guard_rule, score. Combinations that are less accurate on the
    guard part than the highest thresholds (the rule alone) go; then the sum of the other parts' accuracies decides,
    then the most conservative (the sum of the thresholds), then the lower thresholds of the fields in order."""
    share = F.col("right") / F.col("rows")
    x = grid.groupBy(*fields).agg(F.max(F.when(F.col("part") == guard, share)).alias("guard"), F.sum(F.when(F.col("part") != guard, share)).alias("score"))
    rule = x.agg(F.max_by("guard", F.struct(*fields)).alias("guard_rule"))
    x = x.join(F.broadcast(rule)).where("guard >= guard_rule")
    return x.orderBy(F.desc(F.round("score", 9)), F.desc(F.round(sum((F.col(f) for f in fields), F.lit(0.0)), 9)), *fields).limit(1)


def tie_priority(optimal: DataFrame, row: str, action: str, label: str, train: Column, actions: list[int]) -> DataFrame:
    """E5: order of the actions that scores best on train rows when optimal actions tie, and its score on the others."""
    orders = df_orders(optimal.sparkSession, actions)
    x = optimal.withColumn("_t", train).join(F.broadcast(orders)).withColumn("_r", F.array_position("priority", F.col(action).cast("int")))
    pick = x.groupBy("name", row).agg(F.min_by(action, "_r").alias("a"), F.first(label).alias("l"), F.first("_t").alias("t"))
    s = pick.groupBy("name").agg(F.avg(F.when(F.col("t"), (F.col("a") == F.col("l")).cast("int"))).alias("train"), F.avg(F.when(~F.col("t"), (F.col("a") == F.col("l")).cast("int"))).alias("test"))
    return s.orderBy(F.desc(F.round("train", 9)), "name").limit(1)


def df_orders(spark, actions: list[int]) -> DataFrame:
    """All orders of the actions: name and priority."""
    return spark.createDataFrame([("".join(map(str, p)), list(p)) for p in permutations(actions)], "name string, priority array<int>")


def best_by_fold(scores: DataFrame, by: str, family: str, ok: Column) -> DataFrame:
    """Family with the best out-of-fold accuracy per group, ties to the greater name."""
    s = scores.groupBy(by, family).agg(F.avg(ok.cast("int")).alias("accuracy"))
    return s.groupBy(by).agg(F.max_by(F.struct(family, "accuracy"), F.struct(F.round("accuracy", 9), family)).alias("b")).select(by, f"b.{family}", "b.accuracy")


def out_of_fold(cands: DataFrame, key: str, group: str, item: str, positive: str, features: list[str], families: dict[str, trees.Family] | None = None, k: int = 3) -> DataFrame:
    """Key, group, family, item, right: the item that each family picks for each group of each key by models that have
    not seen the group. cands: a row for each item of a group, features and positive (the item is the right one).

    Folds are stratified by the right item (M10). All keys and folds of a family are fitted together; families are
    independent jobs, run at the same time. Read cands from files.
    """
    spark, families = cands.sparkSession, families or trees.FAMILIES
    right = cands.where(positive).select(F.struct(key, group).alias("_id"), F.struct(F.col(key).alias("key"), F.col(item).alias("item")).alias("_label"))
    fold = folds(right, "_id", "_label", k).select(F.col("_id")[key].alias(key), F.col("_id")[group].alias(group), F.col("fold").cast("int").alias("fold"))
    dealt_out = dealt(cands, cands.count(), key, group, per_task=trees.TASK_ROWS // (2 * max(k - 1, 1)))
    rows = trees.binned(dealt_out.join(fold, [key, group]), features, trees.cut_points(cands, features)).withColumn("_row", F.struct(group, item))
    rows = stage(rows.select(key, group, item, positive, "fold", "_row", "_b"), "folds")
    other = F.explode(F.filter(F.array(*map(F.lit, range(k))), lambda f: f != F.col("fold")))
    train = stage(rows.withColumn("_of", other).withColumn("_key", F.concat_ws("/", F.col(key).cast("string"), "_of")), "training")
    held = rows.withColumn("_key", F.concat_ws("/", F.col(key).cast("string"), "fold"))

    def picked(name: str) -> DataFrame:
        p = trees.score(held, trees.fit(train, "_key", positive, families[name], "_row"), "_key", families[name])
        best = F.max_by(F.struct(F.col(item), F.col(positive).alias("right")), F.struct(F.round("p", 9), -F.col(item)))
        return p.groupBy(key, group).agg(best.alias("b")).select(key, group, F.lit(name).alias("family"), F.col(f"b.{item}").alias(item), "b.right")

    with ThreadPoolExecutor(len(families)) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(picked), families))


def select_family(cands: DataFrame, key: str, group: str, item: str, positive: str, features: list[str], families: dict[str, trees.Family] | None = None, k: int = 3) -> DataFrame:
    """Key, family, accuracy: the family with the best out-of-fold accuracy of each key, and (accuracies) all of them."""
    tried = stage(out_of_fold(cands, key, group, item, positive, features, families, k), "out_of_fold")
    every = tried.groupBy(key, "family").agg(F.avg(F.col("right").cast("int")).alias("accuracy")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("family", "accuracy"))).alias("accuracies"))
    return best_by_fold(tried, key, "family", F.col("right")).join(every, key)


def best_assignment(scores: DataFrame, group: str, a: str, b: str, logp: str, n: int = 3) -> DataFrame:
    """Permutation of n slots to n values with the largest sum; identity where a score is missing.

    One aggregate keeps a sum and a count for each of the n * n cells; the permutations are compared in the group's row."""
    cell = lambda i, j: F.when((F.col(a) == i) & (F.col(b) == j), F.col(logp))
    cells = [(i, j) for i in range(n) for j in range(n)]
    x = scores.groupBy(group).agg(F.count(logp).alias("_all"), *[f(cell(i, j)).alias(f"_{c}{i}{j}") for i, j in cells for f, c in ((F.sum, "s"), (F.count, "n"))])
    tried = []
    for order in permutations(range(n)):
        total = reduce(Column.__add__, [F.coalesce(F.col(f"_s{i}{j}"), F.lit(0)) for i, j in enumerate(order)])
        held = reduce(Column.__add__, [F.col(f"_n{i}{j}") for i, j in enumerate(order)]) == n
        name = "".join(map(str, order))
        tried.append(F.when(held, F.struct(F.round(total, 9).alias("t"), F.lit(-int(name)).alias("o"), F.lit(name).alias("name"))))
    best = F.array_max(F.array(*tried))["name"]
    return x.select(group, F.when(F.col("_all") == n * n, best).otherwise("".join(map(str, range(n)))).alias("assignment"))


def routed(default: DataFrame, special: DataFrame, key: str, value: str, route: Column) -> DataFrame:
    """Rows that match route take the special system's value, where it has one."""
    s = special.select(key, F.col(value).alias("_v"))
    return default.withColumn("_go", route).join(s, key, "left").withColumn(value, F.when(F.col("_go"), F.coalesce("_v", value)).otherwise(F.col(value))).drop("_go", "_v")


def agreement_soft_labels(df: DataFrame, row: str, cls: str, p: str, label: str, temperature: float = 2.0) -> DataFrame:
    """Mean teacher probabilities of rows whose argmax is the label, sharpened by temperature and renormalised."""
    m = df.groupBy(row, cls).agg(F.avg(p).alias("p"), F.first(label).alias("label"))
    w = Window.partitionBy(row)
    m = m.withColumn("_best", F.max_by(cls, F.struct(F.round("p", 9), -F.col(cls))).over(w)).where(F.col("_best") == F.col("label"))
    q = F.pow("p", 1 / temperature)
    return m.withColumn("q", q / F.sum(q).over(w)).select(row, cls, "q")


def coordinate_search(spark, base: dict[str, int], grid: dict[str, list[int]], score, rounds: int = 3) -> tuple[dict[str, int], float]:
    """Field after field, the value of the best score; all values of a field are profiles of one job.

    score takes a table of profiles and returns (profile, score) rows, one a profile. Ties keep the present value, then
    the earlier one. Ends when a round changes nothing.
    """
    now, best = dict(base), float("-inf")
    for _ in range(rounds):
        before = dict(now)
        for field, values in grid.items():
            tried = [now[field], *[v for v in values if v != now[field]]]
            rows = [(str(i), *{**now, field: v}.values()) for i, v in enumerate(tried)]
            got = {r["profile"]: r["score"] for r in score(spark.createDataFrame(rows, "profile string, " + ", ".join(f"{k} long" for k in now))).collect()}
            top = max(range(len(tried)), key=lambda i: (round(got.get(str(i), 0.0), 9), -i))
            now[field], best = tried[top], got.get(str(top), 0.0)
        if now == before:
            break
    return now, best


def coordinate_search_by(conditions: DataFrame, base: dict[str, int], grid: dict[str, list[int]], score, rounds: int = 3, valid=lambda weights: True) -> DataFrame:
    """Condition, n, the fields' weights, score and unit (the score of base): a search for every condition, in step.

    conditions: g, condition (a graph may be in several). score takes a table of profiles and returns g, profile, score.
    A field takes the first of its values that scores best, if that is better than the present score; the fields follow
    each other, up to `rounds` times or until nothing changes. What all conditions try for a field is one job, in which
    equal weights count once; only sums by condition and profile come back.
    """
    spark, fields = conditions.sparkSession, list(base)
    sizes = {r["condition"]: r["n"] for r in conditions.groupBy("condition").agg(F.count_distinct("g").alias("n")).collect()}
    known: dict = {}

    def look(wanted: set) -> None:
        new = sorted({w for c, w in wanted if (c, w) not in known})
        if new:
            profiles = spark.createDataFrame([(str(i), *w) for i, w in enumerate(new)], "profile string, " + ", ".join(f"{f} long" for f in fields))
            sums = score(profiles).join(conditions.select("g", "condition").distinct(), "g").groupBy("condition", "profile").agg(F.sum("score").alias("s"))
            found = {(r["condition"], new[int(r["profile"])]): r["s"] for r in sums.collect()}
            for c, n in sizes.items():
                known.update({(c, w): (found.get((c, w)) or 0.0) / n for w in new})

    now = {c: tuple(base.values()) for c in sizes}
    look(set(now.items()))
    unit, moving = {c: known[c, w] for c, w in now.items()}, set(sizes)
    for _ in range(rounds):
        before = dict(now)
        for i, field in enumerate(fields):
            tried = {c: [w for v in grid.get(field, ()) if valid(dict(zip(fields, w := now[c][:i] + (v,) + now[c][i + 1 :])))] for c in moving}
            look({(c, w) for c, ws in tried.items() for w in ws})
            for c, ws in tried.items():
                for w in ws:
                    if known[c, w] > known[c, now[c]] + 1e-12:
                        now[c] = w
        moving = {c for c in moving if now[c] != before[c]}
        if not moving:
            break
    rows = [(c, n, *now[c], known[c, now[c]], unit[c]) for c, n in sizes.items()]
    return spark.createDataFrame(rows, "condition string, n long, " + ", ".join(f"{f} long" for f in fields) + ", score double, unit double")


def rankers(cands: DataFrame, key: str, group: str, item: str, positive: str, features: list[str], train: Column, family: trees.Family = trees.FAMILIES["boosting"]) -> DataFrame:
    """Key, group, item, p: the item that each key's own model ranks first in each group, fitted on the rows of train.

    The models of all keys are trained in one pass; a row is scored by the model of its key."""
    rows = trees.binned(cands, features, trees.cut_points(cands.where(train), features)).withColumn("_row", F.struct(group, item))
    rows = stage(rows.withColumn("_train", train).select(key, group, item, positive, "_row", "_b", "_train"), "candidates")
    p = trees.score(rows, trees.fit(rows.where("_train"), key, positive, family, "_row"), key, family).withColumn("p", F.round("p", 9))
    return p.groupBy(key, group).agg(F.max_by(F.struct(item, "p"), F.struct("p", -F.col(item))).alias("b")).select(key, group, f"b.{item}", "b.p")


def ranker(cands: DataFrame, features: list[str], positive: str, trees: int = 5, seed: int = 7):
    """Gradient-boosted trees that tell the positive candidate of a group; score with `rank_scores`."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(cands.withColumn("label", F.col(positive).cast("double")))
    return GBTClassifier(maxIter=trees, maxDepth=3, seed=seed).fit(x.select("features", "label"))


def rank_scores(model, cands: DataFrame, features: list[str]) -> DataFrame:
    """Adds p, the probability of being the positive candidate."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(cands)
    return model.transform(x).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
