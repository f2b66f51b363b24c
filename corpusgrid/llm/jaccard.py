"""N-gram Jaccard join by MinHash banding.

1. A document is the set of its word five-grams (64-bit hashes). Documents with equal sets are one class; the rest
   works on classes, numbered in the order of their smallest doc_id.
2. Signatures of bands * ROWS minima; band keys are shuffled. The number of bands follows from the similarity and the
   recall that is wanted.
3. All members of a bucket are compared by their signatures: each with the bucket's first class, and, block against
   block, whatever that has not tied together yet. A pair whose signatures agree in fewer places than the similarity
   can explain (SLACK deviations) is none; the others tie their ends. Ties are a forest, no bucket emits its pairs. The
   components of the ties are the candidate groups.
4. Within a group, every pair is verified on the full n-gram sets. Groups are cut into hashed blocks, and a task gets
   two blocks; it returns per class its links and a forest of verified pairs, whose components are the result's.

A pair that shares a bucket is thus always compared; there is no cap on candidates. Work grows with the square of a
bucket of unlike classes, and of a group of near copies, spread over the pairs of their blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.components import components
from corpusgrid.llm.text import Cache, map_texts, slices
from corpusgrid.operators.sample import positions
from corpusgrid.session import stage, unstage

N, SIMILARITY = 5, 0.8
#: Chance of a pair at the threshold to share no band; it takes (1 - 0.8 ** 6) ** 32.
MISS, ROWS, SEED = 6e-5, 6, 5
#: Deviations that the agreement of two signatures may fall short of the similarity: a chance of 1e-9.
SLACK = 6.0
#: Classes and n-grams in a block of a group, n-grams hashed at a time, bytes of word hashes that a task remembers.
BLOCK, BLOCK_GRAMS, CHUNK, CACHE = 512, 1 << 19, 1 << 15, 24 << 20
#: Signatures in a block of a bucket whose members are compared with each other.
SIGNED = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float, miss: float, rows: int = ROWS) -> int:
    """Bands of `rows` rows that miss a pair at `similarity` with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def least_agreement(similarity: float, size: int, slack: float = SLACK) -> float:
    """Share of `size` signature rows in which a pair at `similarity` agrees at least, but for `slack` deviations."""
    return similarity - slack * math.sqrt(similarity * (1 - similarity) / size)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sorted distinct n-gram hashes of a text; words are runs of other than space and \\x09-\\x0D."""

    def __init__(self, n: int = N):
        from xxhash import xxh64_intdigest

        self.n, self.digest, self.cache = n, xxh64_intdigest, Cache(CACHE)
        self.factors = _mix(np.arange(1, n + 1, dtype=np.uint64) * _MIX) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        """A text with fewer than n words has one n-gram, all its words; without words it has none."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        cache, digest, out = self.cache, self.digest, []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache.keep(w, digest(w), 70 + len(w))
            out.append(h)
        h = np.array(out, dtype=np.uint64)
        k = min(self.n, len(h))
        total = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            total += h[j : len(h) - k + 1 + j] * self.factors[j]
            total = _mix(total)
        return np.unique(total)


def class_of(grams: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set of n-grams."""
    return int(np.bitwise_xor.reduce(_mix(grams + _MIX)).astype(np.int64)), int(np.add.reduce(_mix(grams * _MIX + np.uint64(3))).astype(np.int64))


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, signatures of a byte a row) of non-empty sets."""
    rng = np.random.default_rng(SEED)
    size = bands * rows
    a = (rng.integers(0, 1 << 32, size, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    b = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    minima = np.empty((len(sets), size), dtype=np.uint32)
    low = 0
    while low < len(sets):
        high, total = low, 0
        while high < len(sets) and (total == 0 or total + len(sets[high]) <= CHUNK):
            total += len(sets[high])
            high += 1
        x = (np.concatenate(sets[low:high]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[low : high - 1])])
        for k in range(size):
            # multiply, add and fold: a permutation of 32-bit numbers for each k
            h = x * a[k] + b[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            minima[low:high, k] = np.minimum.reduceat(h, starts)
        low = high
    keys = np.zeros((len(sets), bands), dtype=np.uint64)
    wide = minima.astype(np.uint64).reshape(len(sets), bands, rows)
    for r in range(rows):
        keys = _mix(keys + wide[:, :, r] * _MIX + np.uint64(r + 1))
    return keys, (minima & 0xFF).astype(np.uint8)


def sketch(docs: DataFrame, bands: int, rows: int = ROWS, n: int = N) -> DataFrame:
    """doc_id, c1, c2 (class of the n-gram set), n_grams, bands (array<long>), sig (binary); null bands for no words."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, c1 long, c2 long, n_grams long, bands array<long>, sig binary"

    def run(batches):
        grams = Grams(n)
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [grams(t) for t in b.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, sig = _signatures([sets[i] for i in full], bands, rows) if full else ([], [])
                c1, c2, band, sigs = ([None] * len(sets) for _ in range(4))
                for at, i in enumerate(full):
                    c1[i], c2[i] = class_of(sets[i])
                    band[i], sigs[i] = keys[at].astype(np.int64), sig[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "c1", "c2", "n_grams", "bands", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _agreement(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Share of equal rows between byte signatures, corrected for bytes that are equal by chance."""
    return ((one == others).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _estimate(edges: DataFrame, least: float) -> DataFrame:
    """Edges (a, b, sa, sb) whose signatures agree in at least the share `least`."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                keep = np.nonzero(_agreement(x, y) >= least)[0]
                yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep)), b.column("b").take(pa.array(keep))], ["a", "b"])

    return edges.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _untied(each: DataFrame, buckets: DataFrame, tied: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Ties (a, b) between the groups that meet in a bucket, a forest for two blocks.

    Only pairs inside a bucket's largest group are left out, which are tied already.
    """
    at = ["band", "key"]
    marked = each.join(buckets.where("n > 2").select(*at), at).join(tied, "node", "left").withColumn("group", F.coalesce("group", "node"))
    parts = marked.groupBy(*at, "group").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy(*at).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "group")).alias("top")).where("parts > 1")
    mixed = mixed.select(*at, F.col("top.group").alias("most"), F.ceil(F.col("top.n") / SIGNED).alias("large"), F.ceil((F.col("all") - F.col("top.n")) / SIGNED).alias("small"))
    placed = marked.join(mixed, at).withColumn("inside", F.col("group") == F.col("most"))
    # blocks of the largest group are numbered -1, -2, ..., those of the others 0, 1, ...
    place = F.xxhash64("node", F.lit(SEED))
    placed = placed.withColumn("block", F.when(F.col("inside"), -1 - F.pmod(place, F.col("large"))).otherwise(F.pmod(place, F.col("small"))))
    others = F.sequence(F.when(F.col("inside"), F.lit(0)).otherwise(-F.col("large")).cast("long"), F.col("small") - 1)
    placed = placed.withColumn("other", F.explode(others)).select(*at, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "group", "block")
    keys = [*at, "x", "y"]
    placed = placed.join(reps.select("node", "sig"), "node").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held, key = [], None

        def close():
            held.sort(key=lambda h: h[2])
            ids, groups, blocks, sigs = zip(*held)
            first = blocks.count(blocks[0])
            sig = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(ids), -1)
            _, root = np.unique(np.array(groups), return_inverse=True)
            root = root.copy()
            a, b = [], []
            for i in range(first):
                for j in np.nonzero((_agreement(sig[i], sig[i + 1 :]) >= least) & (root[i + 1 :] != root[i]))[0] + i + 1:
                    if root[i] != root[j]:
                        a.append(ids[i])
                        b.append(ids[j])
                        root[root == root[j]] = root[i]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, "node", "group", "block", "sig"))):
                if row[:4] != key and held:
                    yield close()
                    held = []
                key = row[:4]
                held.append(row[4:])
        if held:
            yield close()

    return placed.mapInArrow(run, "a long, b long").distinct()


def _counts(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of the intersections of the first `rows` sets with all sets."""
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(sets)), lengths)[order]
    flat = flat[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    gram = np.cumsum(new) - 1
    often = np.bincount(gram) > 1  # n-grams of one set alone add nothing
    keep = often[gram]
    owner, gram = owner[keep], (np.cumsum(often) - 1)[gram[keep]]
    out = np.zeros((rows, len(sets)), dtype=np.float32)
    for low in range(0, int(often.sum()), 8192):
        a, b = np.searchsorted(gram, [low, low + 8192])
        m = np.zeros((len(sets), 8192), dtype=np.float32)
        m[owner[a:b], gram[a:b] - low] = 1
        out += m[:rows] @ m.T
    return out.astype(np.int64)


def _verify(members: DataFrame, similarity: float) -> DataFrame:
    """members (group, x, y, node, copies, block, grams), a task per (group, x, y) -> node, links, root.

    links counts the documents of other classes with Jaccard similarity of at least `similarity`; root is a member of
    the same component. Rows come sorted, and at most two blocks are held at a time.
    """

    def one(ids, copies, blocks, grams):
        order = np.argsort(blocks, kind="stable")
        ids, copies, blocks = ids[order], copies[order], blocks[order]
        sets = [np.frombuffer(grams[i], dtype=np.uint64) for i in order]
        first = int((blocks == blocks[0]).sum())
        same = first == len(ids)
        both = _counts(sets, first)
        size = np.array([len(s) for s in sets])
        union = size[:first, None] + size[None] - both
        near = both * 1_000_000 >= union * round(similarity * 1_000_000)
        if same:
            np.fill_diagonal(near, False)
        else:
            near[:, :first] = False
        links = np.zeros(len(ids), dtype=np.int64)
        links[:first] += near @ copies
        if not same:
            links[first:] += near[:, first:].T @ copies[:first]
        root = list(range(len(ids)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(near)):
            root[find(j)] = find(i)
        return ids, links, ids[[find(i) for i in range(len(ids))]]

    def run(batches):
        held, key = [], None

        def close():
            ids, copies, blocks, grams = zip(*held)
            columns = one(np.array(ids), np.array(copies, dtype=np.int64), np.array(blocks), grams)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "links", "root"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("group", "x", "y", "node", "copies", "block", "grams"))):
                if row[:3] != key and held:
                    yield close()
                    held = []
                key = row[:3]
                held.append(row[3:])
        if held:
            yield close()

    keys = ["group", "x", "y"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, links long, root long")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, miss: float = MISS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_grams, class_id, n_links, component_id, kept: one row per row.

    class_id is the smallest doc_id with the same n-gram set, n_links the number of other documents with a similarity
    of at least `similarity` (those of the class among them), component_id the smallest doc_id reachable over links,
    kept whether that is the document itself. A link is missed with probability `miss` at most. Null or blank text has
    no n-grams and links with nothing; so does a row with a null doc_id, which is kept. Rows that share a doc_id are
    documents of their own, each with the class of its own text; they are kept or not by the id they share. An empty
    table gives no rows.
    """
    bands = bands_for(similarity, miss, rows)
    least = least_agreement(similarity, bands * rows)
    made = stage(sketch(docs, bands, rows, n), "sketch")
    usable = made.where("doc_id is not null and c1 is not null")
    classes = usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("size"))
    classes = stage(positions(classes, "rep", "c1", "c2").withColumnRenamed("pos", "node"), "classes")
    reps = usable.withColumnRenamed("doc_id", "rep").join(classes.select("rep", "c1", "c2", "node"), ["rep", "c1", "c2"]).select("node", "bands", "sig").dropDuplicates(["node"])
    reps = stage(reps, "reps")
    each = reps.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = stage(each.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1"), "buckets")
    edges = each.join(buckets, ["band", "key"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    signed = edges.join(reps.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    named_groups = lambda edges: stage(components(edges).select("node", F.col("component").alias("group")), "groups")
    groups = named_groups(_estimate(signed, least))
    more = stage(_untied(each, buckets, groups, reps, least), "untied")
    if not more.isEmpty():
        groups = named_groups(groups.select(F.col("node").alias("a"), F.col("group").alias("b")).unionByName(more))
    unstage(reps, buckets, more)
    # blocks by hash: a member meets its own block and every other block of its group once
    placed = groups.join(classes, "node")
    sizes = placed.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_GRAMS)).alias("n"))
    placed = placed.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("n"))).drop("size")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(placed, "rep")

    def make():
        grams = Grams(n)

        def one(text):
            found = grams(text)
            return (*(class_of(found) if len(found) else (None, None)), found.tobytes())

        return one

    members = map_texts(texts, ["group", "node", "copies", "block", "n", "c1", "c2"], "text", make, [("own1", "long"), ("own2", "long"), ("grams", "binary")])
    members = members.where("c1 = own1 and c2 = own2").dropDuplicates(["node"])  # rows of the class, where several texts share its doc_id
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    members = members.withColumn("other", other).select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "copies", "block", "grams")
    verified = stage(_verify(members, similarity), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    whole = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = whole.join(classes.select(F.col("node").alias("component"), F.col("rep").alias("component_rep")), "component").select("node", "component_rep")
    result = stage(
        classes.join(links, "node", "left").join(whole, "node", "left").select(
            "c1", "c2", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_rep", "rep").alias("component")
        ),
        "result",
    )
    unstage(groups, verified, classes)
    named = made.select("doc_id", "n_grams", F.when(F.col("doc_id").isNotNull(), F.col("c1")).alias("c1"), "c2")
    out = named.join(result, ["c1", "c2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_grams", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through jaccard_join; nulls, repeated ids and empty tables as told there."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
