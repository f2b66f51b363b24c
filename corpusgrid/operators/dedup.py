"""Deduplication and decontamination (D1-D8). Keys are hashes of folded text; order columns decide what is first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.operators.sample import numbered
from corpusgrid.session import broadcast_if_small, stage


def keep_first(df: DataFrame, key, order: str) -> DataFrame:
    """The first row by order of every key.

    The first place of a key is a partial aggregate and a join, so a key with very many rows is not sorted in one task.
    """
    keyed = df.withColumn("_k", F.sha2(key, 256))
    first = keyed.groupBy("_k").agg(F.min(order).alias("_first"))
    return keyed.join(first, (keyed["_k"].eqNullSafe(first["_k"])) & (F.col(order) == F.col("_first"))).drop("_k", "_first")


def labelled_duplicates(df: DataFrame, key, label, order: str) -> DataFrame:
    """Later rows of a key, as duplicate_text or duplicate_text_conflicting_labels against the first row's label."""
    keyed = df.select(order, F.sha2(key, 256).alias("_k"), label.alias("_l"))
    first = keyed.groupBy("_k").agg(F.min(F.struct(F.col(order).alias("at"), F.col("_l").alias("l"))).alias("_f"))
    x = keyed.join(first, "_k").where(F.col(order) > F.col("_f.at"))
    rule = F.when(F.col("_l").eqNullSafe(F.col("_f.l")), "duplicate_text").otherwise("duplicate_text_conflicting_labels")
    return x.select(order, F.col("_f.at").alias("first_at"), rule.alias("rule"))


def id_problems(df: DataFrame, key: str, order: str) -> DataFrame:
    """D3: missing ids, and later occurrences of an id."""
    ids = df.select(key, order)
    first = ids.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = ids.join(first, key).where(F.col(order) > F.col("_first")).select(key, order, F.lit("duplicate_id").alias("problem"))
    return later.unionByName(ids.where(F.col(key).isNull()).withColumn("problem", F.lit("missing_id")))


def exclude_known(df: DataFrame, key, corpora: list) -> DataFrame:
    """Rows whose key is in none of the corpora (DataFrames with a column _k of hashes)."""
    known = corpora[0].select("_k")
    for c in corpora[1:]:
        known = known.unionByName(c.select("_k"))
    return df.withColumn("_k", F.sha2(key, 256)).join(known.distinct(), "_k", "left_anti").drop("_k")


def overlap_report(probes: DataFrame, corpora: DataFrame) -> DataFrame:
    """Probes (probe, k) and corpora (corpus, k): distinct keys in common for every pair, 0 included."""
    p, c = stage(probes.select("probe", "k").distinct(), "probes"), stage(corpora.select("corpus", "k").distinct(), "corpora")  # each is read twice
    hits = p.join(c, "k").groupBy("probe", "corpus").agg(F.count(F.lit(1)).alias("overlap"))
    pairs = p.select("probe").distinct().crossJoin(broadcast_if_small(c.select("corpus").distinct()))
    return pairs.join(hits, ["probe", "corpus"], "left").select("probe", "corpus", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def prefix_cap(df: DataFrame, prefix, order: str, cap: int = 35) -> DataFrame:
    """At most cap rows of a prefix, the first by order. A rank filter, so tasks keep cap rows a prefix before the shuffle."""
    n = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return df.withColumn("_p", prefix).withColumn("_n", n).where(F.col("_n") <= cap).drop("_p", "_n")


def reconcile(subset: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Key and state: retained (equal), altered, quarantined (source only), foreign (subset only)."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    a, b = subset.select(key, digest.alias("_a")), source.select(key, digest.alias("_b"))
    state = F.when(F.col("_a").isNull(), "quarantined").when(F.col("_b").isNull(), "foreign").when(F.col("_a") == F.col("_b"), "retained").otherwise("altered")
    return a.join(b, key, "full").select(key, state.alias("state"))


def swap_replace(old: DataFrame, new: DataFrame, stratum: str, fallback: str, old_id: str, new_id: str) -> DataFrame:
    """New rows take the place of old ones of the same stratum one to one, then of the same fallback; the rest is quarantined.

    Returns new_id, old_id (null if quarantined) and how.
    """

    def match(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
        x, y = numbered(a, [by], new_id), numbered(b, [by], old_id).select(by, "n", old_id)
        return x.join(y, [by, "n"], "left").drop("n")

    exact = match(new, old, stratum)
    done = exact.where(F.col(old_id).isNotNull())
    left = exact.where(F.col(old_id).isNull()).drop(old_id)
    second = match(left, old.join(done.select(old_id), old_id, "left_anti"), fallback)
    how = F.when(F.col(old_id).isNull(), "quarantined").otherwise("fallback")
    return done.select(new_id, old_id, F.lit("exact").alias("how")).unionByName(second.select(new_id, old_id, how.alias("how")))
