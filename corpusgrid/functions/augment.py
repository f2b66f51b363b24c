"""Augmentation (T12-T20). Every random choice is a coin hashed from the row's id, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions.expr import fold, let
from corpusgrid.session import broadcast_if_small


def coin(*keys) -> Column:
    """Number in [0, 1) from the keys, by a digest that SQL engines share."""
    text = F.concat_ws(":", *[F.lit(k) if isinstance(k, (str, int)) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def typo(word: Column, rate: float, *keys) -> Column:
    """A word of four or more letters loses or swaps an inner letter, with probability rate."""
    at = (F.floor(coin(*keys, "at") * (F.length(word) - 2)) + 2).cast("int")
    lost = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))
    swap = F.concat(F.substring(word, F.lit(1), at - 2), F.substring(word, at, F.lit(1)), F.substring(word, at - 1, F.lit(1)), F.substring(word, at + 1, F.length(word)))
    changed = F.when((coin(*keys, "kind") < 0.5) | (at <= 2), lost).otherwise(swap)
    return F.when((F.length(word) >= 4) & (coin(*keys, "hit") < rate), changed).otherwise(word)


def typos(text: Column, rate: float, key: Column, seed: str) -> Column:
    return let(F.split(text, " "), lambda ws: F.array_join(F.transform(ws, lambda w, i: typo(w, rate, seed, key, i)), " "))


def stress_variants(df: DataFrame, key: str, text: str) -> DataFrame:
    """Variant, text: no_accents, no_punctuation, plain (lower, no punctuation), typos at 5 and 15 percent."""
    t, bare = F.col(text), F.regexp_replace(F.col(text), r"[.,!?;:()\[\]]", "")
    made = {"no_accents": fold(t), "no_punctuation": bare, "plain": F.lower(bare), "typos_5": typos(t, 0.05, F.col(key), "t5"), "typos_15": typos(t, 0.15, F.col(key), "t15")}
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias(text)) for n, c in made.items()])).alias("x")).select(key, "x.*")


def noise(text: Column, key: Column) -> Column:
    """3 in 10 rows lose punctuation, a typo rate out of five, then one of three casings."""
    bare = F.when(coin("bare", key) < 0.3, F.regexp_replace(text, r"[.,!?;:]", "")).otherwise(text)
    pick = F.floor(coin("rate", key) * 5)
    typed = F.when(pick == 2, typos(bare, 0.03, key, "n")).when(pick == 3, typos(bare, 0.06, key, "n")).when(pick == 4, typos(bare, 0.1, key, "n")).otherwise(bare)
    case = coin("case", key)
    return F.when(case < 0.2, F.lower(typed)).when(case < 0.3, F.upper(typed)).otherwise(typed)


def alias_swap(text: Column, aliases: dict[str, list[str]], key: Column, rate: float = 1.0, blocked: list[str] = ()) -> Column:
    """An alias found becomes another alias of its key, outside blocked phrases; at most one swap a key."""
    for i, phrase in enumerate(blocked):
        text = F.replace(text, F.lit(phrase), F.lit(f"\x02{i}\x03"))
    for name, names in aliases.items():
        ordered = sorted(names, key=len, reverse=True)
        pattern = r"\b(?:" + "|".join(ordered) + r")\b"
        pick = F.element_at(F.array(*map(F.lit, names)), (F.floor(coin("alias", name, key) * len(names)) + 1).cast("int"))
        text = F.when((coin("swap", name, key) < rate) & text.rlike(pattern), F.concat(F.regexp_extract(text, rf"(?s)^(.*?){pattern}", 1), pick, F.regexp_extract(text, rf"(?s)^.*?{pattern}(.*)$", 1))).otherwise(text)
    for i, phrase in enumerate(blocked):
        text = F.replace(text, F.lit(f"\x02{i}\x03"), F.lit(phrase))
    return text


def phrase_patches(df: DataFrame, patches: DataFrame, text: str) -> DataFrame:
    """Patches (ord, old, new): a row with one matching patch (as it is, or folded) is changed; several give an error row.

    Adds patched, hits and patch. patches is a small table: it is joined by containment.
    """
    id_ = df.columns[0]
    texts = df.select(id_, text, fold(F.col(text)).alias("_folded"))  # folded once, not once for each patch
    small = broadcast_if_small(patches.select("ord", "old", "new", fold(F.col("old")).alias("_plain")), 10_000)
    hits = texts.join(small, F.contains(F.col(text), F.col("old")) | F.contains("_folded", "_plain"))
    per = hits.groupBy(id_).agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("ord", "old", "new")).alias("p"))
    x = df.join(per, id_, "left")
    done = F.when(F.contains(F.col(text), F.col("p.old")), F.replace(F.col(text), F.col("p.old"), F.col("p.new"))).otherwise(F.replace(fold(F.col(text)), fold(F.col("p.old")), fold(F.col("p.new"))))
    return x.select(*df.columns, F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("p.ord")).alias("patch"), F.when(F.col("hits") == 1, done).otherwise(F.col(text)).alias("patched"))


def ablate(text: Column, swaps: dict[str, str]) -> Column:
    """Struct of the text with evidence phrases swapped, and whether any was found."""
    out, found = text, F.lit(False)
    for old, new in swaps.items():
        found = found | F.contains(text, F.lit(old))
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.struct(out.alias("text"), found.alias("matched"))


def drop_and_reorder(clauses: Column, optional: str, rate: float, key: Column) -> Column:
    """Optional clauses (by pattern) go with probability rate, the others turn by a hashed offset."""
    kept = F.filter(clauses, lambda c, i: ~(c.rlike(optional) & (coin("drop", key, i) < rate)))

    def turn(k: Column) -> Column:
        n = F.size(k)
        at = F.floor(coin("turn", key) * n).cast("int")
        return F.concat(F.slice(k, at + 1, n - at), F.slice(k, 1, at))

    return F.when(F.size(kept) > 0, let(kept, turn)).otherwise(clauses)


def render(frames: DataFrame, slots: dict[str, DataFrame], key: str, frame: str = "frame") -> DataFrame:
    """Frames with {name} placeholders filled by a hashed pick from each slot table (pos from 0, value)."""
    out = frames.withColumn("text", F.col(frame))
    for name, table in slots.items():
        picked = out.withColumn("_pos", F.floor(coin("slot", name, F.col(key)) * table.count()).cast("long"))
        vals = table.select(F.col("pos").alias("_pos"), F.col("value").alias("_v"))
        out = picked.join(broadcast_if_small(vals), "_pos", "left").withColumn("text", F.replace("text", F.lit("{" + name + "}"), F.coalesce("_v", F.lit("")))).drop("_pos", "_v")
    return out


def toggles(df: DataFrame, key: str, flags: dict[str, tuple[str, str]], text: str = "text") -> DataFrame:
    """Every combination of the flags (2 or 8 rows a shell), each with its clause for true or false appended."""
    out = df.select(key, text)
    for name, (yes, no) in flags.items():
        out = out.withColumn(name, F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(text, F.concat_ws(" ", text, F.when(F.col(name), yes).otherwise(no)))
    return out.withColumn("group_id", F.col(key))


def holdout_bank(bank: DataFrame, pos: str, held: bool) -> DataFrame:
    """Every fifth phrase is held out; an empty side falls back to the whole bank."""
    part = bank.where((F.pmod(F.col(pos), F.lit(5)) == 4) == F.lit(held))
    return bank if part.isEmpty() else part
