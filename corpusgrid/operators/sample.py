"""Sampling, quotas, ordering and folds (M1-M14). Draws are decided by hashes of ids, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.session import broadcast_if_small, stage



def coin(key: Column, seed: int = 0) -> Column:
    """60-bit number from the seed and an id of any type, by a digest that SQL engines share: the order of all draws."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """M1: exactly n rows (all, if fewer), those of the smallest coins. Tasks keep n rows each before they meet."""
    return df.orderBy(coin(F.col(key), seed), key).limit(n)


def chunk_sample(df: DataFrame, pos: str, chunk: int = 10_000, take: int = 1_000, batch: int = 50) -> DataFrame:
    """M2: of every `chunk` consecutive rows exactly `take`, in batches; adds chunk and batch."""
    c = F.floor((F.col(pos) - 1) / chunk)
    r = F.row_number().over(Window.partitionBy("chunk").orderBy(coin(F.col(pos)), pos))
    return df.withColumn("chunk", c).withColumn("_r", r).where(F.col("_r") <= take).withColumn("batch", F.floor((F.col("_r") - 1) / batch)).drop("_r")


def strata_sample(df: DataFrame, key: str, strata: dict[str, Column], n: int, uniform: int = 0) -> DataFrame:
    """M3, M4: n rows of every stratum by coin; a row drawn in several counts for the first. Adds stratum and population.

    uniform adds that many rows of the whole table beside the strata, as the last stratum, `uniform`. The rank filter
    keeps n rows of a stratum in each task before they meet.
    """
    last = len(strata)
    named = [F.when(c, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("stratum"))) for i, (name, c) in enumerate(strata.items())]
    if uniform:
        named.append(F.struct(F.lit(last).alias("ord"), F.lit("uniform").alias("stratum")))
    each = df.select(key, F.explode(F.array_compact(F.array(*named))).alias("s")).select(key, "s.ord", "s.stratum")
    size = each.groupBy("stratum").agg(F.count(F.lit(1)).alias("population"))
    r = F.row_number().over(Window.partitionBy("stratum").orderBy(coin(F.col(key)), key))
    drawn = each.withColumn("_r", r).where(F.col("_r") <= max(n, uniform)).where(F.col("_r") <= F.when(F.col("ord") == last, uniform).otherwise(n))
    return drawn.groupBy(key).agg(F.min_by("stratum", "ord").alias("stratum")).join(size, "stratum")


def largest_remainder(strata: DataFrame, weight: str, total: int) -> DataFrame:
    """M5: integer quotas that add up to total, in proportion to the weights; ties of remainders by stratum."""
    every = Window.partitionBy()
    share = F.col(weight) * total / F.sum(weight).over(every)
    x = strata.withColumn("_f", F.floor(share + 1e-9).cast("long")).withColumn("_d", F.round(share - F.col("_f"), 9))
    rank = F.row_number().over(Window.orderBy(F.desc("_d"), "stratum"))
    return x.withColumn("quota", F.col("_f") + (rank <= total - F.sum("_f").over(every)).cast("long")).drop("_f", "_d")


def quota_sample(df: DataFrame, key: str, stratum: str, quotas: DataFrame) -> DataFrame:
    """M5: as many rows of each stratum as its quota, by coin; adds short where a stratum has too few."""
    x = df.withColumn("stratum", F.col(stratum)).withColumn("_c", coin(F.col(key)))
    n = x.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    small = broadcast_if_small(stage(quotas.join(n, "stratum"), "quotas"))
    x = numbered(x, ["stratum"], "_c", key).join(small, "stratum")
    return x.withColumn("short", F.col("_n") < F.col("quota")).where(F.col("n") <= F.col("quota")).drop("n", "_c", "_n")


def fair_schedule(weights: dict[str, int]) -> list[tuple[int, str, int]]:
    """M6: smooth weighted round robin over one period: (slot, recipe, how many of the recipe before it)."""
    total, credit, seen, out = sum(weights.values()), dict.fromkeys(weights, 0), dict.fromkeys(weights, 0), []
    for slot in range(total):
        for r, w in weights.items():
            credit[r] += w
        best = max(weights, key=lambda r: credit[r])  # the earlier recipe on ties
        credit[best] -= total
        out.append((slot, best, seen[best]))
        seen[best] += 1
    return out


def interleave(df: DataFrame, recipe: str, order: str, weights: dict[str, int]) -> DataFrame:
    """M6: adds slot: the k-th row of a recipe takes the recipe's k-th slot of the repeated schedule."""
    total = sum(weights.values())
    plan = df.sparkSession.createDataFrame(fair_schedule(weights), f"_s int, {recipe} string, _i int")
    per = df.sparkSession.createDataFrame(list(weights.items()), f"{recipe} string, _w int")
    x = numbered(df, [recipe], order).withColumn("_k", F.col("n") - 1).drop("n").join(F.broadcast(per), recipe).withColumn("_i", (F.col("_k") % F.col("_w")).cast("int"))
    x = x.join(F.broadcast(plan), [recipe, "_i"])
    return x.withColumn("slot", F.floor(F.col("_k") / F.col("_w")) * total + F.col("_s")).drop("_k", "_w", "_i", "_s")


def ratio_interleave(a: DataFrame, b: DataFrame, order: str, ratio: int = 5) -> DataFrame:
    """M7: ratio rows of a, then one of b, and so on; adds pos and from_b. Order within a source is by `order`."""
    one = lambda df: positions(df, order).withColumn("_k", F.col("pos") - 1).drop("pos")
    x = one(a).withColumn("pos", F.floor(F.col("_k") / ratio) * (ratio + 1) + F.col("_k") % ratio).withColumn("from_b", F.lit(False))
    y = one(b).withColumn("pos", F.col("_k") * (ratio + 1) + ratio).withColumn("from_b", F.lit(True))
    return x.unionByName(y).drop("_k")


def positions(df: DataFrame, *order) -> DataFrame:
    """Adds pos 1.. in a total order without a window over all rows: range partitions, then sizes of those before."""
    at = F.monotonically_increasing_id()
    x = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.shiftright(at, 33), "_i": at.bitwiseAND(F.lit((1 << 33) - 1))}), "positions")
    sizes = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.join(broadcast_if_small(sizes.select("_p", before.alias("_b"))), "_p").withColumn("pos", F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")


def _ranged(df: DataFrame, keys: list[str], order: tuple, size, name: str) -> DataFrame:
    """df in range partitions of keys and order, with _p (partition), _i (place in it), and _b: sum of size, an aggregate
    of rows, over what the partitions before hold of the key; _f is the first place of the key in the partition."""
    at = F.monotonically_increasing_id()
    x = stage(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumns({"_p": F.shiftright(at, 33), "_i": at.bitwiseAND(F.lit((1 << 33) - 1))}), name)
    sizes = x.groupBy("_p", *keys).agg(size.alias("_n"), F.min("_i").alias("_f"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_f", before.alias("_b"))
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return x.join(broadcast_if_small(sizes), same)


def numbered(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Adds n 1.. in the order within each key (null is a key), for keys of any size: range partitions of key and order,
    then the rows that the partitions before hold of the key. Every row of a hot key is in one of many tasks."""
    x = _ranged(df, keys, order, F.count(F.lit(1)), "numbered")
    return x.withColumn("n", F.col("_b") + F.col("_i") - F.col("_f") + 1).select(*df.columns, "n")


def running_sum(df: DataFrame, keys: list[str], value: str, *order) -> DataFrame:
    """Adds upto: the sum of value up to the row in the order within each key, for keys of any size, as in numbered()."""
    x = _ranged(df, keys, order, F.sum(value), "running")
    inside = F.sum(value).over(Window.partitionBy("_p", *keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("upto", F.col("_b") + inside).select(*df.columns, "upto")


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """M8: pos 1.. in the order of the coins."""
    return positions(df.withColumn("_c", coin(F.col(key), seed)), "_c", key).drop("_c")


def repeat(df: DataFrame, times: Column) -> DataFrame:
    """M9: every row `times` times, with its copy number from 1; none for 0."""
    return df.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int")))))


def folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Stratified fold 0..k-1: rows of a label in coin order, dealt in turn."""
    x = numbered(df.withColumn("_c", coin(F.col(key))), [label], "_c", key)
    return x.withColumn("fold", F.pmod(F.col("n") - 1, F.lit(k))).drop("n", "_c")


def group_sample(df: DataFrame, group: str, n: int) -> DataFrame:
    """All rows of n groups, drawn by coin."""
    return df.join(exact_sample(df.select(group).distinct(), group, n), group, "left_semi")


def bootstrap(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N draws with replacement: adds draw. Row numbers come from range partitions, draws from hashed indices."""
    numbered = positions(df, key)
    total = numbered.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    draws = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw").join(F.broadcast(total))
    draws = draws.select("draw", (F.pmod(coin(F.col("draw"), seed), F.col("_n")) + 1).alias("pos"))
    return draws.join(numbered, "pos").drop("pos")


def every_kth(df: DataFrame, pos: str, k: int) -> DataFrame:
    """Rows whose position is a multiple of k."""
    return df.where(F.pmod(F.col(pos), F.lit(k)) == 0)


def matched_arms(base: DataFrame, candidates: DataFrame, pos: str, cand: str, n: int) -> DataFrame:
    """Arm B: base with n positions, drawn by coin, replaced one to one by n candidates; replaced_by is null elsewhere."""
    number = lambda df, c: positions(df.withColumn("_c", coin(F.col(c))), "_c", c).drop("_c").withColumnRenamed("pos", "_r")
    a = number(exact_sample(base.select(F.col(pos).alias("_pos")), "_pos", n), "_pos")
    b = number(exact_sample(candidates.select(F.col(cand).alias("replaced_by")), "replaced_by", n), "replaced_by")
    return base.join(a.join(b, "_r").drop("_r").withColumnRenamed("_pos", pos), pos, "left")
