"""Reference resolution and joins over scenes (J1-J8). landmarks carry ord; ties go to the lowest ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXIS = {"north": -1, "south": 1, "west": -2, "east": 2}


def _key(kind: Column, r: Column, c: Column) -> Column:
    """Smaller is further in the direction of kind."""
    return F.when(kind.startswith("north"), r).when(kind.startswith("south"), -r).when(kind.startswith("west"), c).when(kind.startswith("east"), -c)


def resolve_targets(specs: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Specs (g, type, ref, anchor) -> r, c of the landmark meant, and used_ref.

    *_most: extreme over all landmarks. anchor_near: nearest (Manhattan, then squared Euclid) to the anchor, not on its
    node. One copy of the type, or no ref: the first of the type. A direction: the extreme copy. near, far: the copy
    nearest or furthest from the first anchor. A missing anchor counts as no ref.
    """
    lm = landmarks.select("g", F.col("type").alias("lt"), "ord", "r", "c")
    anchors = lm.groupBy("g", F.col("lt").alias("anchor")).agg(F.min_by(F.struct("r", "c"), "ord").alias("a"))
    copies = lm.groupBy("g", F.col("lt").alias("type")).agg(F.count(F.lit(1)).alias("copies"))
    x = specs.join(anchors, ["g", "anchor"], "left").join(copies, ["g", "type"], "left")
    needs = F.col("ref").isin("near", "far", "anchor_near")
    ref = F.when(needs & F.col("a").isNull(), None).when(~F.col("ref").endswith("_most") & (F.col("ref") != "anchor_near") & (F.col("copies") == 1), None).otherwise(F.col("ref"))
    x = x.withColumn("used_ref", ref)
    far = F.col("used_ref").isin("anchor_near") | F.coalesce(F.col("used_ref").endswith("_most"), F.lit(False))
    off = (F.col("r") - F.col("a.r"), F.col("c") - F.col("a.c"))
    euclid = off[0] * off[0] + off[1] * off[1]
    j = x.join(lm, "g").where(F.when(far, (F.col("used_ref") != "anchor_near") | (euclid > 0)).otherwise(F.col("lt") == F.col("type")))
    first = F.when(F.col("used_ref") == "anchor_near", F.abs(off[0]) + F.abs(off[1])).when(F.col("used_ref") == "near", euclid).when(F.col("used_ref") == "far", -euclid).otherwise(F.coalesce(_key(F.col("used_ref"), F.col("r"), F.col("c")), F.lit(0)))
    second = F.when(F.col("used_ref") == "anchor_near", euclid).otherwise(0)
    keys = ["g", "type", "ref", "anchor", "used_ref"]
    best = j.groupBy(*keys).agg(F.min_by(F.struct("r", "c"), F.struct(first, second, "ord")).alias("at"))
    return best.select("g", "type", "ref", "anchor", "used_ref", "at.r", "at.c")


def resolve_with_fallback(specs: DataFrame, landmarks: DataFrame, default: str = "gate") -> DataFrame:
    """Goals and vias: an unusable goal falls back to the first landmark, else default; an unusable via is dropped."""
    present = landmarks.groupBy("g", F.col("type").alias("_t")).agg(F.min("ord").alias("_o"))
    first = landmarks.groupBy("g").agg(F.min_by("type", "ord").alias("first"))
    x = specs.join(present.select("g", F.col("_t").alias("goal"), F.lit(True).alias("g_ok")), ["g", "goal"], "left")
    x = x.join(present.select("g", F.col("_t").alias("via"), F.lit(True).alias("v_ok")), ["g", "via"], "left").join(first, "g", "left")
    return x.select(
        "g", F.when(F.col("g_ok"), F.col("goal")).otherwise(F.coalesce("first", F.lit(default))).alias("goal"), F.when(F.col("v_ok"), F.col("via")).alias("via"),
        F.col("g_ok").isNull().alias("goal_replaced"), (F.col("via").isNotNull() & F.col("v_ok").isNull()).alias("via_dropped"),
    )


def map_aware(rule: DataFrame, probabilities: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Rule goal if its type is on the map, else the most probable type that is; with the source."""
    types = landmarks.select("g", "type").distinct()
    ok = rule.join(types, ["g", "type"], "left_semi").select("g", F.col("type").alias("rule"))
    likely = probabilities.join(types, ["g", "type"], "left_semi").groupBy("g").agg(F.max_by("type", F.struct("p", "type")).alias("model"))
    x = rule.select("g").join(ok, "g", "left").join(likely, "g", "left")
    return x.select("g", F.coalesce("rule", "model").alias("type"), F.when(F.col("rule").isNotNull(), "rule").when(F.col("model").isNotNull(), "model").otherwise("none").alias("source"))


def enrich(rows: DataFrame, side: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their side columns, and the ids that only one of the two has."""
    both = rows.join(side, key)
    a, b = rows.select(key, F.lit("no_side").alias("problem")), side.select(key, F.lit("no_row").alias("problem"))
    lone = a.join(side.select(key), key, "left_anti").unionByName(b.join(rows.select(key), key, "left_anti"))
    return both, lone


def edge_labels(pairs: DataFrame, edges: DataFrame, look: dict[str, str]) -> DataFrame:
    """Every adjacent pair with the look of its status, stairs and the one-way direction relative to the pair's order."""
    looks = F.create_map(*[F.lit(x) for kv in look.items() for x in kv])
    x = pairs.join(edges, ["g", "ar", "ac", "br", "bc"], "left")
    way = F.when(F.col("oneway_r").isNull(), "both").when((F.col("oneway_r") == F.col("br")) & (F.col("oneway_c") == F.col("bc")), "forward").otherwise("backward")
    none = F.col("status").isNull()
    return x.select("g", "ar", "ac", "br", "bc", F.when(none, "none").otherwise(F.element_at(looks, F.col("status"))).alias("look"), F.coalesce("stairs", F.lit(False)).alias("stairs"), F.when(none, "none").otherwise(way).alias("way"))
