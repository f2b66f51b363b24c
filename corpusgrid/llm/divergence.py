"""Source divergence audit by in-mapper stripes.

Every partition folds its whole documents into stripes: term -> (document frequency, counts by source), per language.
When the stripes of a task reach STRIPE_BYTES they are passed on (spilled to the shuffle) and begun anew. One exchange by
language and term merges them: counts add up by source, and terms with enough documents stay. Merged stripes then give
the divergences directly:

term: each cell of a stripe gives its group's excess over the language; the 50 highest of a group are picked in each
    task before they meet.
pair: the L1 distance of two sources is a sum over stripes. Stripes go to units of about UNIT_TERMS terms and two blocks
    of BLOCK sources, where the dense cells are compared in numpy; sums of units add up. Terms that no source of a unit
    has add the difference of the two floors, so they are never written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.llm.text import list_array, slices, word_counts, word_table
from corpusgrid.session import broadcast_if_small, stage

#: Documents that a term needs in its language; ranks of part term.
LEAST_DOCS, TOP = 30, 50
#: Estimated bytes of a task's stripes before they are passed on; terms and sources of a unit of pairs, about.
STRIPE_BYTES, UNIT_TERMS, BLOCK = 96 << 20, 2000, 256
SCALE, PRIOR = 1_000_000_000, 5


def _rows(stripes: dict):
    """Arrow batches of the stripes of a task, 50,000 at a time."""
    flat = ((lang, term, s) for lang, terms in stripes.items() for term, s in terms.items())
    names = ["lang", "term", "df", "sources", "counts"]
    while part := [x for _, x in zip(range(50_000), flat)]:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in part], pa.string()),
                pa.array([x[1] for x in part], pa.string()),
                pa.array([x[2][0] for x in part], pa.int64()),
                list_array([x[2][1].keys() for x in part], pa.string()),
                list_array([x[2][1].values() for x in part], pa.int64()),
            ],
            names,
        )


def stripes(docs: DataFrame, limit: int = STRIPE_BYTES) -> DataFrame:
    """lang, term, df, sources, counts: partial stripes of each task. The null term counts the documents of a source.

    Null text, lang and source count as ''; rows that repeat a doc_id are documents of their own.
    """
    table = word_table("")

    def fold(batches):
        found, used = {}, 0
        for whole in batches:
            for b in slices(whole, "text"):
                for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    terms = found.setdefault(lang, {})
                    for term, n in [(None, 1), *word_counts(text, table).items()]:
                        s = terms.get(term)
                        if s is None:
                            terms[term] = [1, {source: n}]
                            used += 450 + len(term or b"")
                        else:
                            s[0] += 1
                            if source in s[1]:
                                s[1][source] += n
                            else:
                                s[1][source] = n
                                used += 60
                    if used > limit:
                        yield from _rows(found)
                        found, used = {}, 0
        yield from _rows(found)

    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    df = docs.select(some("lang").alias("lang"), some("source").alias("source"), some("text").cast("binary").alias("text"))
    return df.mapInArrow(fold, "lang string, term string, df long, sources array<string>, counts array<long>")


def merge(partial: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, cells (source, n), total: stripes merged by key, those of terms with enough documents and the null term.

    One exchange by language and term; the sums by source inside need no other.
    """
    cell = F.inline(F.concat(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n")), F.array(F.struct(F.lit(None).cast("string").alias("source"), F.col("df").alias("n")))))
    cells = partial.repartition("lang", "term").select("lang", "term", cell).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    of_source = F.when(F.col("source").isNotNull(), F.struct("source", "n"))
    merged = cells.groupBy("lang", "term").agg(
        F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("df"), F.collect_list(of_source).alias("cells"), F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).alias("total")
    )
    return merged.where((F.col("df") >= least_docs) | F.col("term").isNull()).drop("df")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    over, under = F.lit(SCALE).cast("decimal(11,0)") * wide(count + PRIOR), wide(total + PRIOR * kept)
    return F.call_function("div", over, under).cast("long") + 1


def groups_of(merged: DataFrame) -> DataFrame:
    """lang, source, at (place in the language), n, n_lang, kept, floor (the share of a term that the group lacks)."""
    cells = merged.where("term is not null").select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = merged.where("term is not null").groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count(F.lit(1)).alias("kept"))
    every = merged.where("term is null").select("lang", F.inline("cells")).select("lang", "source")
    found = every.join(cells, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "n_lang", "kept"])
    at = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at")
    return found.select("lang", "source", at, "n", "n_lang", "kept", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("kept"))).otherwise(0).alias("floor"))


def _sums(unit: pa.Table, block: int) -> pa.Table:
    """lang, a, b (places, a < b), value, terms: distances of a unit's pairs over the terms that its sources have."""
    lang, left, right = (unit.column(c)[0].as_py() for c in ("lang", "left", "right"))
    is_floor = unit.column("term").is_null().to_numpy(zero_copy_only=False)
    at, p = unit.column("at").to_numpy(), unit.column("p").to_numpy()
    order = np.argsort(at[is_floor])
    places = at[is_floor][order]
    codes = unit.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[~is_floor].astype(int)
    dense = np.repeat(p[is_floor][order][None], codes.max() + 1 if len(codes) else 0, axis=0)
    dense[codes, np.searchsorted(places, at[~is_floor])] = p[~is_floor]
    i, j = np.flatnonzero(places // block == left), np.flatnonzero(places // block == right)
    value = np.array([np.abs(dense[:, j] - dense[:, [x]]).sum(0) for x in i], "int64").reshape(len(i), len(j))
    a, b = np.repeat(places[i], len(j)), np.tile(places[j], len(i))
    once = a < b
    n = int(once.sum())
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": a[once], "b": b[once], "value": value.ravel()[once], "terms": np.full(n, len(dense), "int64")})


def pairs(merged: DataFrame, groups: DataFrame, unit_terms: int = UNIT_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value: L1 distance of each group from each other source of its language."""
    small = broadcast_if_small(groups)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("kept") / unit_terms)).cast("int")
    cells = merged.where("term is not null").select("lang", "term", F.inline("cells")).join(small.drop("n_lang").withColumnRenamed("n", "total"), ["lang", "source"])
    cells = cells.select("lang", "term", "at", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"))
    floors = groups.select("lang", F.lit(None).cast("string").alias("term"), "at", F.col("floor").alias("p"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    blocks = groups.groupBy("lang").agg(F.floor(F.max("at") / block).cast("int").alias("last"))
    own, other = F.floor(F.col("at") / block).cast("int"), F.explode(F.sequence(F.lit(0), F.col("last")))
    units = cells.unionByName(floors).join(broadcast_if_small(stage(blocks, "blocks")), "lang").withColumn("_o", other)
    units = units.select("lang", "chunk", F.least(own, "_o").alias("left"), F.greatest(own, "_o").alias("right"), "term", "at", "p")
    sums = units.groupBy("lang", "chunk", "left", "right").applyInArrow(lambda unit: _sums(unit, block), "lang string, a int, b int, value long, terms long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    end = lambda c, name: broadcast_if_small(groups.select("lang", F.col("at").alias(c), F.col("source").alias(name), F.col("floor").alias(f"_{c}"), *(["kept"] if c == "a" else [])))
    sums = sums.join(end("a", "x"), ["lang", "a"]).join(end("b", "y"), ["lang", "b"])
    value = F.col("value") + (F.col("kept") - F.col("terms")) * F.abs(F.col("_a") - F.col("_b"))
    ways = F.inline(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return sums.withColumn("value", value).select("lang", "value", ways)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, limit: int = STRIPE_BYTES, unit_terms: int = UNIT_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language departs from the others and from the language.

    part pair: the distance from each other source (0 if the language keeps no term); part term: the terms that the
    source has above the language's share, up to rank top. Null text, lang and source count as ''; repeated rows each
    count; ties rank by the item's UTF-8 bytes; no rows in, no rows out; other columns are not read.
    """
    merged = stage(merge(stripes(docs, limit), least_docs), "stripes")
    groups = stage(groups_of(merged), "groups")
    cells = merged.where("term is not null").select("lang", "term", "total", F.inline("cells")).join(broadcast_if_small(groups.select("lang", "source", F.col("n").alias("_n"), "n_lang", "kept")), ["lang", "source"])
    excess = share(F.col("n"), F.col("_n"), F.col("kept")) - share(F.col("total"), F.col("n_lang"), F.col("kept"))
    terms = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    both = pairs(merged, groups, unit_terms, block).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return ranked(both).unionByName(ranked(terms).where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through audit; nulls, ties, repeats and empty tables as told there."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang, source) + {PRIOR} * v) p FROM e JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang) + {PRIOR} * v) q FROM l JOIN v USING (lang)),
pr AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0) value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
