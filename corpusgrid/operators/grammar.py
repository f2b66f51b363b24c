"""Mention grammar (L7-L9): who or what a text means, in which role, and with which qualifiers.

A clause is rewritten with placeholders and read again: its mentions become numbered tokens (@0, @1, ...), descriptions that
only a map can resolve become tokens of their own (#north_most, #anchor_near:0), and cues before and after a token then
decide its role. Everything up to the pick is a projection of the clause; the pick is one partial aggregate by text.
Names, cues and aliases are the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions.expr import computed, let, phrase_pattern, tokenize


@dataclass(frozen=True)
class Grammar:
    """Fixed phrases and patterns (regular expressions without groups that capture) of a language, in folded form.

    names: kind -> phrase -> type; kinds are place, person and item (an item is what is carried, never a target).
    heads, stops, keywords: a head noun, up to four words that are no stops, and a keyword (keyword -> type) are a place.
    generic, link, most: "a place next to @0 ... of all" is anchor_near. extremes: ref -> pattern after generic.
    directions: word -> ref, after an optional lead; nearer, farther: cues between a mention and its anchor.
    """

    names: dict[str, dict[str, str]]
    heads: list[str] = field(default_factory=list)
    stops: list[str] = field(default_factory=list)
    keywords: dict[str, str] = field(default_factory=dict)
    generic: str = r"(?!)"
    link: str = r"(?!)"
    most: str = r"(?!)"
    extremes: dict[str, str] = field(default_factory=dict)
    lead: str = ""
    directions: dict[str, str] = field(default_factory=dict)
    nearer: str = r"(?!)"
    farther: str = r"(?!)"
    negate_before: str = r"(?!)"
    negate_after: str = r"(?!)"
    via_before: str = r"(?!)"
    via_after: str = r"(?!)"

    def pattern(self) -> str:
        """Names, longest first, then described places."""
        every = [p for names in self.names.values() for p in names]
        found = phrase_pattern(every)
        if self.heads:
            stop = r"(?!(?:" + "|".join(self.stops) + r")\b)" if self.stops else ""
            found += r"|\b(?:" + "|".join(self.heads) + r") (?:" + stop + r"\w+ ){0,4}?(?:" + "|".join(sorted(self.keywords, key=len, reverse=True)) + r")\b"
        return found


def _lookup(of: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), key) if of else F.lit(None).cast("string")


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def mention_roles(clauses: DataFrame, g: Grammar, row: str, text: str = "text") -> DataFrame:
    """Row, clause, at, kind, type, ref, anchor, role of the mentions of each clause (row, clause, text).

    kind is place, person, or the ref of a description that names no type (then type is null). role: negated by a cue
    that ends just before or starts just after it; via by a cue before, or after up to the next comma; else goal.
    Anchors and items are no mentions of their own. Null and empty clauses have none.
    """
    kinds = {p: kind for kind, names in g.names.items() for p in names}
    types = {p: t for names in g.names.values() for p, t in names.items()}
    known = F.coalesce(F.col(text), F.lit(""))
    x = computed(clauses.select(row, "clause", known.alias("_text")), _s=F.array_join(tokenize(F.col("_text")), " ")).drop("_text")
    x = computed(x, _found=F.regexp_extract_all("_s", F.lit(g.pattern()), F.lit(0)), _parts=F.split("_s", g.pattern())).drop("_s")

    # 1. placeholders
    mark = lambda i: F.when(i < F.size("_found"), F.when(_lookup(kinds, F.get("_found", i)) == "item", F.lit("item")).otherwise(F.concat(F.lit("@"), i.cast("string")))).otherwise("")
    marked = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_found")), lambda i: F.concat(F.get("_parts", i), mark(i))), "")
    # 2. descriptions that need the map
    marked = F.regexp_replace(marked, rf"\b(?:{g.generic}) (?:{g.link}) @(\d+)(?: \w+){{0,2}} (?:{g.most})\b", "#anchor_near:$1")
    for ref, words in g.extremes.items():
        marked = F.regexp_replace(marked, rf"\b(?:{g.generic}) (?:{words})\b", "#" + ref)
    x = computed(x, _m=marked).drop("_parts")

    # 3. qualifiers of named mentions: a direction, or nearer to or farther from an anchor
    lead, ways = rf"(?: (?:{g.lead}))?" if g.lead else "", "|".join(g.directions) or r"(?!)"
    qualifier = rf"@\d+(?:{lead} (?:{ways})\b| ?,?(?: (?:{g.nearer}|{g.farther})) @\d+\b(?!(?: \w+)? (?:{g.most})\b))"

    def qualified(q: Column) -> Column:
        anchor = _number(q, r" @(\d+)$")
        ref = F.when(anchor.isNull(), _lookup(g.directions, F.regexp_extract(q, r"(\w+)$", 1))).when(q.rlike(rf" (?:{g.farther}) @\d+$"), "far").otherwise("near")
        return F.struct(_number(q, r"^@(\d+)").alias("k"), ref.alias("ref"), anchor.alias("anchor"))

    near = F.transform(F.regexp_extract_all("_m", F.lit(r"#anchor_near:(\d+)"), F.lit(1)), lambda k: k.cast("int"))
    x = computed(x, _q=F.transform(F.regexp_extract_all("_m", F.lit(qualifier), F.lit(0)), qualified), _near=near, _t=F.split("_m", " "))
    anchors = F.concat(F.filter(F.transform("_q", lambda q: q["anchor"]), lambda k: k.isNotNull()), F.col("_near"))
    tokens = F.filter(F.transform("_t", lambda w, i: F.struct(i.alias("at"), w.alias("_w"))), lambda t: t["_w"].rlike(r"^(?:@\d|#\w)"))

    # 4. a role for each token
    keyword = r"(" + "|".join(sorted(g.keywords, key=len, reverse=True)) + r")$" if g.keywords else r"((?!))"
    name_type = lambda k: let(F.get("_found", k), lambda p: F.coalesce(_lookup(types, p), _lookup(g.keywords, F.regexp_extract(p, keyword, 1))))
    x = computed(x, _anchors=anchors, _tokens=tokens).drop("_m", "_near")
    x = x.select("*", F.inline("_tokens")).drop("_tokens")
    k = _number(F.col("_w"), r"^@(\d+)")
    x = computed(x, **{"_k": k, "_ref": F.nullif(F.regexp_extract("_w", r"^#([a-z_]+)", 1), F.lit("")), "_a": _number(F.col("_w"), r"^#anchor_near:(\d+)")})
    x = x.where(F.col("_k").isNull() | ~F.array_contains("_anchors", F.col("_k")))
    x = computed(x, _own=F.try_element_at(F.filter("_q", lambda q: q["k"] == F.col("_k")), F.lit(1)), kind=F.when(F.col("_k").isNull(), F.col("_ref")).otherwise(F.coalesce(_lookup(kinds, F.get("_found", F.col("_k"))), F.lit("place"))))
    before = F.concat(F.lit(" "), F.array_join(F.slice("_t", 1, F.col("at")), " "))
    after = F.array_join(F.slice("_t", F.col("at") + 2, F.size("_t")), " ")
    x = computed(x, _b=before, _f=after)
    negated = F.col("_b").rlike(rf"\b(?:{g.negate_before})$") | F.col("_f").rlike(rf"^(?:{g.negate_after})\b")
    via = F.col("_b").rlike(rf"\b(?:{g.via_before})$") | F.trim(F.substring_index("_f", ",", 1)).rlike(rf"^(?:{g.via_after})\b")
    role = F.when(negated, "negated").when(F.col("kind").isin("place", "person") & via, "via").otherwise("goal")
    anchor = F.coalesce("_a", F.col("_own.anchor"))
    return x.select(
        row, "clause", "at", "kind", name_type(F.col("_k")).alias("type"), F.coalesce("_ref", F.col("_own.ref")).alias("ref"), name_type(anchor).alias("anchor"), role.alias("role")
    )


def final_pick(mentions: DataFrame, row: str) -> DataFrame:
    """Row, goal, via (structs of kind, type, ref, anchor): the last mention of each role, persons only if there is
    nothing else. A via that means the same place as the goal is none."""
    what = F.struct("kind", "type", "ref", "anchor")
    order = F.struct((F.col("kind") != "person").cast("int"), "clause", "at")
    last = lambda role: F.max_by(F.when(F.col("role") == role, what), F.when(F.col("role") == role, order))
    x = mentions.groupBy(row).agg(last("goal").alias("goal"), last("via").alias("via"))
    same = (F.col("goal.kind") == "place") & F.col("via.type").eqNullSafe(F.col("goal.type")) & F.col("via.ref").eqNullSafe(F.col("goal.ref"))
    return x.withColumn("via", F.when(~F.coalesce(same, F.lit(False)), F.col("via")))


def parse_job(clauses: DataFrame, flags: DataFrame, g: Grammar, row: str) -> DataFrame:
    """One row per row of flags (row and further columns): type, ref and anchor of its goal and via, and its flags."""
    picked = final_pick(mention_roles(clauses, g, row), row)
    parts = [F.col(f"{part}.{c}").alias(part if c == "type" else f"{part}_{c}") for part in ("goal", "via") for c in ("type", "ref", "anchor")]
    return flags.join(picked.select(row, *parts), row, "left")


def target_specs(parsed: DataFrame, row: str) -> DataFrame:
    """Rows of J1's specs from parsed texts: row as g, type, ref, anchor of each text that names a goal."""
    return parsed.where(F.col("goal").isNotNull() | F.col("goal_ref").isNotNull()).select(F.col(row).alias("g"), F.col("goal").alias("type"), F.col("goal_ref").alias("ref"), F.col("goal_anchor").alias("anchor"))
