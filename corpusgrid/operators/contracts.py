"""Validation and contracts (V1-V18). Violations are rows; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_shape(df: DataFrame, group: str, member: str, size: int | None = None, constant: str | None = None, first: int = 0) -> DataFrame:
    """V1: groups whose members are not first, first + 1, ... without gaps or repeats, or are not `size`, or differ in `constant`."""
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(member).alias("members"), F.min(member).alias("low"), F.max(member).alias("high"),
        F.count_distinct(F.col(constant) if constant else F.lit(1)).alias("values"),
    )
    wrong = (F.col("members") != F.col("n")) | (F.col("low") != first) | (F.col("high") != first + F.col("n") - 1) | (F.col("values") > 1)
    return g.where(wrong | (F.col("n") != size) if size is not None else wrong)


def failing(rules: dict[str, Column]) -> Column:
    """V3: names of the rules whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def cue_suspects(text: Column, label: Column, positive: str, negative: str) -> Column:
    """V4: negated cues are blanked before positive ones are searched; null when text and label agree."""
    neg = F.regexp_extract_all(text, F.lit(negative), F.lit(0))
    pos = F.regexp_extract_all(F.regexp_replace(text, negative, " ~ "), F.lit(positive), F.lit(0))
    return (
        F.when((F.size(pos) > 0) & (F.size(neg) > 0), "contradictory_cues")
        .when((F.size(pos) > 0) & ~label, "positive_cue_false_label")
        .when((F.size(neg) > 0) & label, "negative_cue_true_label")
    )


def triage(hard: Column, suspect: Column) -> Column:
    """V6: rejected if any hard rule, review if any suspect, else retained."""
    return F.when(F.size(hard) > 0, "rejected").when(F.size(suspect) > 0, "review").otherwise("retained")


def rule_counts(df: DataFrame, rules: str, order: str, examples: int = 5) -> DataFrame:
    """V7: rule, rows, and the first examples by order (joined by commas)."""
    each = df.select(F.explode(rules).alias("rule"), order)
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy(order))).where(F.col("r") <= examples)
    first = top.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.cast("string")), ",").alias("examples"))
    return each.groupBy("rule").agg(F.count(F.lit(1)).alias("rows")).join(first, "rule")


def phrase_problems(phrase: Column, allowed: Column, required: Column, most: int = 180) -> Column:
    """V8: problems of a template phrase: trimming, letters, length, unexpected and missing {placeholders}."""
    found = F.array_distinct(F.regexp_extract_all(phrase, F.lit(r"\{(\w+)\}"), F.lit(1)))
    bare = F.regexp_replace(phrase, r"\{\w+\}", "")
    return failing({
        "not_trimmed": phrase != F.trim(phrase), "not_lower_ascii": bare.rlike(r"[^\x00-\x7F]") | (bare != F.lower(bare)), "too_long": F.length(phrase) > most,
        "unexpected_placeholder": F.size(F.array_except(found, allowed)) > 0, "missing_placeholder": F.size(F.array_except(required, found)) > 0,
    })


def growth_band(df: DataFrame, current: str, added: str, low: float = 0.3, high: float = 0.5) -> DataFrame:
    """V9: additions per bank must lie between ceil(low * current), at least 1, and floor(high * current)."""
    least, most = F.greatest(F.lit(1), F.ceil(F.col(current) * low)), F.floor(F.col(current) * high)
    return df.withColumns({"least": least.cast("long"), "most": most.cast("long"), "ok": F.col(added).between(least, most)})


def candidate_duplicates(df: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates whose key is in `existing`, or earlier in the list (with the place of the first)."""
    first = F.min(order).over(Window.partitionBy(key))
    known = existing.select(F.col(key)).distinct().withColumn("_known", F.lit(True))
    out = df.withColumn("first_at", first).join(known, key, "left")
    return out.select("*", F.when(F.col("_known"), "existing").when(F.col(order) > F.col("first_at"), "earlier_candidate").alias("problem")).drop("_known").where("problem is not null")


def key_coverage(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Unknown keys (had, not wanted) and missing ones."""
    a, b = have.select(key).distinct().withColumn("_h", F.lit(True)), want.select(key).distinct().withColumn("_w", F.lit(True))
    return a.join(b, key, "full").where("_h is null or _w is null").select(key, F.when(F.col("_w").isNull(), "unknown").otherwise("missing").alias("problem"))


def inventory(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per bank and key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def paired_contract(rows: DataFrame, side: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Issues per joined row; ids on one side only are issues too."""
    a, b = rows.withColumn("_row", F.lit(True)), side.withColumn("_side", F.lit(True))
    both = a.join(b, key, "full")
    lone = {"no_side": F.col("_side").isNull(), "no_row": F.col("_row").isNull()}
    return both.select(key, failing(lone | rules).alias("issues")).where("size(issues) > 0")


def factorial_groups(df: DataFrame, group: str, flags: list[str], constant: str) -> DataFrame:
    """Groups that do not hold every combination of the flags exactly once, with one value of `constant`."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*flags)).alias("combinations"), F.count_distinct(constant).alias("values"))
    return g.where((F.col("n") != 2 ** len(flags)) | (F.col("combinations") != 2 ** len(flags)) | (F.col("values") != 1))


def grounded(text: Column, phrases: list[str]) -> Column:
    """Whether the text holds one of the evidence phrases."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def gates(metrics: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """Metrics (metric, value) against gates (gate, metric, op, bound, relative_to): value, limit and ok of each.

    op is one of <=, >=, =, within (relative band around the other metric), near (absolute band). A missing metric fails.
    """
    m = metrics.select("metric", "value")
    ref = m.select(F.col("metric").alias("relative_to"), F.col("value").alias("ref"))
    x = gate_rows.join(m, "metric", "left").join(ref, "relative_to", "left")
    v, b, r = F.col("value"), F.col("bound"), F.col("ref")
    base = F.when(F.col("relative_to").isNull(), b).otherwise(b * r)
    ok = (
        F.when(F.col("op") == "<=", v <= base).when(F.col("op") == ">=", v >= base).when(F.col("op") == "=", v == base)
        .when(F.col("op") == "within", F.abs(v - r) <= b * F.abs(r)).when(F.col("op") == "near", F.abs(v - r) <= b)
    )
    return x.select("gate", "metric", "value", F.coalesce(ok, F.lit(False)).alias("ok"))


def positive_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles whose cheapest possible arc does not cost more than 0."""
    cheapest = F.col("step") + F.least(F.lit(0), "crowded", "covered", "stairs") + F.least(F.lit(0), "left_turn", "right_turn", "u_turn") + F.least(F.lit(0), "turn")
    return profiles.where(cheapest <= 0)


def first_reason(rules: dict[str, Column]) -> Column:
    """The first failing rule's name, else null."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules.items()])
