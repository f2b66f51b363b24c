"""Mixing sources to target weights, all in DataFrame expressions.

1. Targets by water filling over the per-source sums.
2. Every source is cut into hashed blocks of about DOCS_A_BLOCK documents; its draws are its blocks once for every full
   pass, plus a random part of them for the rest, so that the drawn words meet the target.
3. A splitting tree hands the exact numbers of draws to the output shards: at each node the left child's counts are a
   multivariate hypergeometric draw from the node's counts, source after source. There are as many shards as it takes
   for DRAWS_A_SHARD draws each.
4. Each shard takes its counts from the source's permuted draws (disjoint ranges) and orders its documents by hash.

Blocks and draws of a source are summed and numbered over range partitions, so that a hot source is in many tasks. Only
the table of sources, a row each, is folded in order in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.text import let, unit, words
from corpusgrid.operators.sample import numbered, running_sum
from corpusgrid.session import broadcast_if_small, stage

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents in a block and draws in an output shard, about; the least levels of the tree; draws that are matched together.
DOCS_A_BLOCK, DRAWS_A_SHARD, LEVELS, CELL, SEED = 16, 4096, 3, 256, 17


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, docs, source_size -> adds weight and target.

    Sources in code-point order, null last, take the weights in turn. Targets are proportional to the weights, none
    above most times its source's size, and add up to share times all sizes: with sources by cap / weight, the level
    is the first (budget - caps before) / (weights from here on) that the source's own cap does not undercut.
    """
    code = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(code) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    df = df.withColumn("level", level)
    # from that source on levels only fall, so it is the highest level that its own cap does not undercut
    first = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return df.withColumn("target", F.coalesce(F.least("cap", first * F.col("weight")), F.col("cap")).cast("double")).drop("cap", "level")


def ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series seven steps up, good to about 1e-10."""
    z = n.cast("double") + 8
    lower = F.lit(0.0)
    for j in range(1, 8):
        lower = lower + F.log(n.cast("double") + j)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - lower


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked items among drawn ones of total, by inversion of u over mean +- 12 deviations."""
    total, marked, drawn = (x.cast("long") for x in (total, marked, drawn))
    choose = lambda n, k: ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    share = marked.cast("double") / F.greatest(total, F.lit(1))
    mean = drawn * share
    reach = 12 * F.sqrt(mean * (1 - share)) + 2
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), F.floor(mean - reach))
    high = F.greatest(low, F.least(drawn, marked, F.ceil(mean + reach)))
    found = F.aggregate(
        F.sequence(low, high),
        F.struct(F.lit(0.0).alias("sum"), high.alias("k"), F.lit(False).alias("done")),
        lambda acc, k: let(
            acc["sum"] + F.exp(choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn)),
            lambda s: F.struct(s.alias("sum"), F.when(~acc["done"] & (s >= u), k).otherwise(acc["k"]).alias("k"), (acc["done"] | (s >= u)).alias("done")),
        ),
        lambda acc: acc["k"],
    )
    return F.when((marked <= 0) | (drawn <= 0), F.lit(0).cast("long")).otherwise(found)


def split_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """source, draws -> source, shard, first, last: the range of the source's permuted draws that each shard takes.

    Counts per source add up exactly; shards differ by at most `levels` draws. The table has a row for each source.
    """
    null_safe = F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("source"), F.col("draws").cast("long").alias("q"))
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(null_safe)).alias("counts")).select(F.lit(0).alias("shard"), "counts")
    for level in range(levels):

        def halves(counts: Column, level=level) -> Column:
            total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["q"])
            start = let(total, lambda n: F.struct(n.alias("rest"), F.ceil(n / 2).cast("long").alias("left"), F.array().cast("array<bigint>").alias("out")))

            def take(acc: Column, x: Column) -> Column:
                u = unit(F.lit(seed), F.lit(level), F.col("shard"), x["source"], x["none"])
                return let(
                    hypergeometric(acc["rest"], x["q"], acc["left"], u),
                    lambda k: F.struct((acc["rest"] - x["q"]).alias("rest"), (acc["left"] - k).alias("left"), F.concat(acc["out"], F.array(k)).alias("out")),
                )

            return F.aggregate(counts, start, take, lambda acc: acc["out"])

        if level and level % 5 == 0:  # keeps the plan short, and deals deep levels to many tasks
            node = stage(node.repartition("shard"), "tree")
        node = node.withColumn("taken", halves(F.col("counts")))
        side = lambda f: F.zip_with("counts", "taken", lambda x, k: F.struct(x["none"].alias("none"), x["source"].alias("source"), f(x, k).alias("q")))
        both = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), side(lambda x, k: k).alias("counts")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), side(lambda x, k: x["q"] - k).alias("counts")),
        )
        node = node.select(F.inline(both))
    flat = node.select("shard", F.inline("counts")).withColumn("last", F.sum("q").over(Window.partitionBy("none", "source").orderBy("shard")))
    return flat.where("q > 0").select("source", "shard", (F.col("last") - F.col("q") + 1).alias("first"), "last")


def mix(docs: DataFrame, levels: int | None = None, seed: int = SEED, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, copies) of the mix.

    documents: doc_id, size, source, source_size, target, taken, n_copies, shards (comma-joined). copies: a row for each
    taken copy with its shard and its place in the shard's shuffled order. Sizes are words; null text has size 0; a null
    source is a source, the last one; rows that are equal in doc_id, source and size are interchangeable; no rows in, no
    rows out. No document is taken more than twice. The same input gives the same mix.
    """
    sized = stage(docs.select(F.col(key).alias("doc_id"), "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    per = targets(sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int")
    per = stage(
        per.withColumn("passes", passes)
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / DOCS_A_BLOCK)).cast("long")),
        "targets",
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    small = broadcast_if_small(per)
    placed = sized.join(small, same(sized, per), "left").select(
        "doc_id", sized["source"], "size", "source_size", "target", "passes", "rest",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")).alias("block"),
        F.xxhash64(F.lit(seed + 1), "doc_id").alias("place"),
    )
    blocks = placed.groupBy("source", "block", "passes", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    blocks = running_sum(blocks.withColumn("_o", F.xxhash64(F.lit(seed + 2), "block")), ["source"], "words", "_o", "block").drop("_o")
    blocks = blocks.withColumn("left", F.col("rest") - (F.col("upto") - F.col("words")))
    # left: words still wanted when the block's turn comes. All of it, a part of it, or nothing is drawn once more.
    state = F.when(F.col("left") >= F.col("words"), 2).when(F.col("left") > 0, 1).otherwise(0)
    blocks = stage(blocks.withColumn("state", state), "blocks")
    draws = blocks.select(
        "source", "block", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("copy"), "passes", "state"
    ).where((F.col("copy") <= F.col("passes")) | ((F.col("copy") == F.col("passes") + 1) & (F.col("state") > 0)))
    draws = numbered(draws.select("source", "block", "copy").withColumn("_o", F.xxhash64(F.lit(seed + 3), "block", "copy")), ["source"], "_o", "block", "copy")
    draws = stage(draws.select("source", "block", "copy", F.col("n").alias("draw"), F.floor(F.col("n") / CELL).alias("cell")), "draws")
    if levels is None:
        levels = max(LEVELS, math.ceil(math.log2(max(1, draws.count() / DRAWS_A_SHARD))))
    ranges = split_tree(draws.groupBy("source").agg(F.count(F.lit(1)).alias("draws")), levels, seed)
    # ranges meet draws by cells of numbers, not each with each
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))))
    given = draws.join(ranges, same(draws, ranges) & (draws["cell"] == ranges["cell"]) & F.col("draw").between(F.col("first"), F.col("last")), "left").groupBy(draws["source"], "block").agg(
        F.map_from_entries(F.collect_list(F.struct("copy", "shard"))).alias("shard_of")
    )
    given = given.withColumnRenamed("source", "_s").withColumnRenamed("block", "_b")
    plan = blocks.join(given, blocks["source"].eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), "state", "left", "shard_of"
    )
    plan = broadcast_if_small(stage(plan, "plan"))
    full = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").drop("_s", "_b")
    # only the one block of a source that is drawn in part needs its documents in order
    cut = Window.partitionBy("source").orderBy("place", "doc_id", "size")
    part = full.where("state = 1").withColumn("upto", F.sum("size").over(cut.rowsBetween(Window.unboundedPreceding, 0)))
    part = part.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("left")).cast("int")).drop("upto")
    rest = full.where("state <> 1").withColumn("extra", (F.col("state") == 2).cast("int"))
    taken = part.unionByName(rest).withColumn("n_copies", F.when(F.col("size") > 0, F.least(F.lit(2), F.col("passes") + F.col("extra"))).otherwise(0))
    shards = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda c: F.when(c <= F.col("n_copies"), F.col("shard_of")[c]))
    documents = taken.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies",
        F.filter(shards, lambda s: s.isNotNull()).alias("shards"), "place",
    )
    copies = documents.select("doc_id", F.posexplode("shards").alias("copy", "shard")).withColumn("place", F.xxhash64(F.lit(seed + 4), "doc_id", "copy"))
    return documents.drop("place"), copies


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through mix; nulls, repeated ids and empty tables as told there."""
    documents, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))
