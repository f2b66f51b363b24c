"""Ranked lexical search by NRA: impact-sorted lists, read in sequence, without random access.

Index: every document is folded to its words once; the postings of words that some item asks for are staged with a header
row for each document, from which the statistics of all documents come. Documents are dealt by hash to shards of about
SHARD postings, as many as the data need; Spark sorts each shard's postings by term and falling impact.

Search: a task reads its shards one after the other. For each item all lists are read in step, to growing depths. What was
read of a document adds up to its lower bound; what the unread lists can still give at most, to its upper bound. The
reading ends when every document whose upper bound reaches the k-th best score (ties count, unread documents too) is
resolved. The k-th best score of the task's earlier shards counts from the start, so most later shards end early. Each
task passes on k rows an item; these meet by item.

Items are searched in blocks of at most BLOCK_TERMS pairs of item and term (an item alone may have more), which go to the
tasks as arrays; the index is built once for all blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusgrid.llm.text import lowered, map_texts, word_counts, word_table
from corpusgrid.operators.sample import positions, running_sum
from corpusgrid.session import broadcast_if_small, stage

#: Everything but letters, digits and what is not ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Results an item, postings of a shard, pairs of item and term of a block, entries of each list that are read first.
TOP, SHARD, BLOCK_TERMS, FIRST = 10, 300_000, 500_000, 32


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item; rows that share an item_id (null too) are one item."""
    words = F.array_remove(F.split(lowered(F.col("text")), SEPARATORS), "")
    return items.select("item_id", F.explode(words).alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, doc_id, n, t, tf: a row for each document and term of the vocabulary (term, t), and one with null t for each
    document. Rows that repeat a doc_id are documents of their own."""
    table = word_table("0123456789")

    def make():
        def fold(text):
            found = word_counts(text, table) if text else {}
            return sum(found.values()), list(found.keys()), list(found.values())

        return fold

    df = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    df = map_texts(df, ["row", "doc_id"], "text", make, [("n", "long"), ("terms", "array<string>"), ("tfs", "array<long>")])
    every = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))), F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))
    df = df.select("row", "doc_id", "n", F.inline(every)).join(broadcast_if_small(vocabulary), "term", "left")
    return df.where("term is null or t is not null").select("row", "doc_id", "n", "t", "tf")


def weights(df: DataFrame, docs: int) -> DataFrame:
    """Adds w = floor(1000 ln((2 docs + 2) / (2 df + 1))) to a table with df."""
    return df.withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1).cast("double"))))


def resolve(lists: list, size: int, place: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first k of `size` documents by score, ties by place, and their scores, by sequential reads.

    lists: (documents, scores), each sorted by falling score. best: scores that other documents have already.
    """
    lower, depth, step = np.zeros(size, np.int64), 0, FIRST
    while True:
        depth, before, step = depth + step, depth, step * 2
        for d, s in lists:
            lower[d[before:depth]] += s[before:depth]
        bounds = [int(s[depth - 1]) if depth < len(s) else 0 for _, s in lists]
        more = np.full(size, sum(bounds), np.int64)  # what a document can still get
        for (d, _), b in zip(lists, bounds):
            if b:
                more[d[:depth]] -= b
        seen = np.concatenate([lower if size <= k else np.partition(lower, size - k)[size - k :], best])
        least = max(1, int(np.partition(seen, len(seen) - k)[len(seen) - k])) if len(seen) >= k else 1
        live = np.flatnonzero(lower + more >= least)
        if not more[live].any():
            first = live[np.lexsort((place[live], -lower[live]))][:k]
            return first, lower[first]


def _shards(batches):
    """Tables of one shard each, from batches that are sorted by shard."""
    held = []
    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                if held and held[0].column("shard")[0].as_py() != shard[low]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _order(x: tuple) -> tuple:
    """Falling score, then doc_id with null last, then row."""
    return x[0], x[1] is None, 0 if x[1] is None else x[1], x[2]


def _searcher(shared, k: int):
    """Function of the sorted postings of a task: its k best documents for each item of the block."""

    def run(batches):
        item, t, w = shared.value
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, int)
        best: dict = {}
        kind = None
        for shard in _shards(batches):
            kind = shard.schema.field("doc_id").type
            rows, first, code = np.unique(shard.column("row").to_numpy(), return_index=True, return_inverse=True)
            ids = shard.column("doc_id").take(pa.array(first))
            place = np.empty(len(rows), np.int64)
            place[pc.sort_indices(pa.table({"d": ids, "r": rows}), sort_keys=[("d", "ascending"), ("r", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(rows))
            terms, low = np.unique(shard.column("t").to_numpy(), return_index=True)
            high, impact = np.r_[low[1:], len(code)], shard.column("impact").to_numpy()
            at = np.searchsorted(terms, t)
            there = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == t) & (w > 0)
            for s, e in zip(starts, np.r_[starts[1:], len(item)]):
                lists = [(code[low[at[i]] : high[at[i]]], impact[low[at[i]] : high[at[i]]] * w[i]) for i in range(s, e) if there[i]]
                if lists:
                    held = best.get(item[s], [])
                    found, scores = resolve(lists, len(rows), place, k, np.array([-x[0] for x in held], np.int64))
                    new = [(-int(x), ids[int(d)].as_py(), int(rows[d])) for d, x in zip(found, scores)]
                    best[item[s]] = sorted(held + new, key=_order)[:k]
        if best:
            flat = [(i, *x) for i, found in best.items() for x in found]
            cols = [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[2] for x in flat], kind), pa.array([x[3] for x in flat], pa.int64()), pa.array([-x[1] for x in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["item", "doc_id", "row", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, shard: int = SHARD, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, scores above 0, ties by ascending doc_id.

    Null texts have no terms and count neither in N nor in L; a null doc_id comes last among equals; rows that repeat a
    doc_id are ranked each; items without terms, or whose terms stand in no document, give no rows, nor do empty tables;
    other columns are not read.
    """
    spark = docs.sparkSession
    asked = stage(item_terms(items), "asked")
    vocabulary = stage(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "vocabulary")
    found = stage(postings(docs, vocabulary), "postings")
    n, total = found.where("t is null and n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = stage(found.where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("df")), "df")
    size = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    names = stage(positions(asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("terms")), "item_id"), "items")
    blocks = running_sum(names, [], "terms", "pos").select("item_id", F.col("pos").alias("item"), F.floor((F.col("upto") - 1) / block_terms).alias("block"))
    pairs = asked.join(vocabulary, "term").join(weights(df, n), "t").join(blocks, asked["item_id"].eqNullSafe(blocks["item_id"]))
    pairs = stage(pairs.select("block", "item", "t", "w"), "pairs")
    m = f"(10 + ((90 * n * {n}L) div {total}L))"
    index = found.where("t is not null").select(
        F.pmod(F.xxhash64("row"), F.lit(1 + size // shard)).alias("shard"), "t", F.expr(f"(1000000000L * tf) div (1000 * tf + 8 * {m})").alias("impact"), "row", "doc_id"
    )
    kind = StructType([StructField("item", LongType()), docs.schema["doc_id"], StructField("row", LongType()), StructField("score", LongType())])
    parts = []
    blocks = sorted(b[0] for b in pairs.select("block").distinct().collect())  # one for each BLOCK_TERMS pairs
    for block in blocks:
        own = pairs.where(F.col("block") == block)
        table = own.orderBy("item", "t").select("item", "t", "w").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("item", "t", "w")))
        lists = index if len(blocks) == 1 else index.join(broadcast_if_small(own.select("t").distinct()), "t", "left_semi")
        lists = lists.repartition("shard").sortWithinPartitions("shard", "t", F.desc("impact"))
        parts.append(lists.select("shard", "t", "impact", "row", "doc_id").mapInArrow(_searcher(shared, k), kind))
    best = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(broadcast_if_small(names.select("item_id", F.col("pos").alias("item"))), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Every item of benchmark against every row of documents through search; edge cases as told there."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () id, doc_id, {_WORDS} w FROM documents),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) term FROM benchmark)),
s AS (SELECT count(*)::BIGINT docs, sum(len(w))::BIGINT total FROM d WHERE len(w) > 0),
f AS (SELECT id, doc_id, n, term, count(*) tf FROM (SELECT id, doc_id, len(w)::BIGINT n, unnest(w) term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT w FROM f, s GROUP BY term, docs),
p AS (SELECT id, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)) impact FROM f, s),
r AS (SELECT item_id, id, doc_id, sum(w * impact)::BIGINT score FROM i JOIN w USING (term) JOIN p USING (term) GROUP BY ALL HAVING sum(w * impact) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, id) rank FROM r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {TOP}"""
