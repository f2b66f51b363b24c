"""Near duplicates of embeddings by sorted projection passes.

Equal vectors of a label are one class. In each pass the classes of a label stand in the order of a key of random
hyperplane signs, most significant first; classes are cut into blocks of this order, and each block is compared with
itself and the beginning of the next one, so that every neighbour window of WINDOW places is covered. What passes ship
is the vector in a byte a component, with the angle that this costs it: a pair is a candidate if its angle, less both
losses, can reach the cosine, so no pair is lost. Candidates are united over all passes; a task returns a forest of
them, not the pairs. How many leading signs part a label into pieces of a window's size is measured in every pass;
passes are added until a pair at the threshold is missed with the wanted probability at most, even in the densest
piece. A label for which all pairs are the smaller work is compared whole.

The links, and the components they make, are then found by the exact cosine on all pairs inside each group of
candidates, block against block: a tight group of any size keeps all its links.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.components import components
from corpusgrid.session import broadcast_if_small, stage, unstage

COSINE, WINDOW, BITS, MISS, SEED = 0.98, 512, 64, 0.002, 11
#: Vectors in a block of an order (in windows), of a label that is compared whole, and of a group of candidates.
WINDOWS, WHOLE, BLOCK = 4, 2048, 2048


def passes_for(largest: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes to begin with: those after which a pair at the threshold is missed with probability of about `miss` at
    most, if every bit halves the pieces. near_duplicates measures the pieces and adds passes.

    A pair shares a window if the leading bits that part the label into pieces of a window's size agree.
    """
    bits = max(0.0, math.log2(max(largest, 1) / window)) + 1
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if largest <= window else max(2, math.ceil(math.log(miss) / math.log(1 - agree)))


def _units(vectors) -> np.ndarray:
    x = np.stack([*vectors]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with a byte a component, and the angle between each and what its bytes say."""
    x = _units(vectors)
    q = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
    y = q.astype(np.float64)
    along = (x * y).sum(axis=1) / np.linalg.norm(y, axis=1)
    return q, np.arccos(np.clip(along, -1, 1)) + 1e-7


def _unpacked(q) -> np.ndarray:
    y = np.frombuffer(b"".join(q), dtype=np.int8).reshape(len(q), -1).astype(np.float32)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _candidates(f: pd.DataFrame, first: int, cosine: float) -> np.ndarray:
    """Which pairs of the first rows of f (q, lost) with all of them may have the cosine."""
    x, lost = _unpacked(f["q"].to_list()), f["lost"].to_numpy()
    least = np.cos(np.minimum(math.acos(cosine) + lost[:first] + lost.max(), math.pi)) - 1e-5
    return x[:first] @ x.T >= least[:, None]


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a matrix of near pairs that tie the same places together without a cycle."""
    root, out = list(range(near.shape[1])), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def _passes(vectors: DataFrame, kinds: dict[str, str], start: int, cosine: float, window: int) -> DataFrame:
    """vectors (label, dim, passes, rep, embedding) in passes start, start + 1, ... -> a, b: forests of near pairs; and
    label, dim, pass, bits: signs that part a block's pieces to a window's size, one more than window + 1 vectors share."""

    def keyed(frames):
        for f in frames:
            for dim, part in f.groupby("dim"):
                x = _unpacked(part["q"].to_list())
                for p in range(int(part["passes"].max())):
                    on = (part["passes"] > p).to_numpy()
                    some = part[on]
                    signs = np.packbits(x[on] @ np.random.default_rng([SEED, dim, start + p]).normal(size=(dim, BITS)) > 0, axis=1)
                    yield pd.DataFrame({"pass": start + p, "label": some["label"].to_numpy(), "dim": dim, "key": [r.tobytes() for r in signs], "rep": some["rep"].to_numpy(), "q": some["q"].to_list(), "lost": some["lost"].to_numpy()})

    label, rep = kinds["label"], kinds["rep"]
    projected = vectors.select("label", "dim", "passes", "rep", "q", "lost").mapInPandas(keyed, f"pass int, label {label}, dim int, key binary, rep {rep}, q binary, lost float")
    order = ["pass", "label", "dim", "key", "rep"]
    ordered = projected.repartitionByRange(*order).sortWithinPartitions(*order)
    # place in the whole order: partition and place in it, then the sizes of the partitions before
    at = F.monotonically_increasing_id()
    ordered = stage(ordered.withColumns({"part": F.shiftright(at, 33), "place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.join(broadcast_if_small(parts.select("part", before.alias("before"))), "part").withColumn("place", F.col("before") + F.col("place"))
    # a block is WINDOWS windows long and is met by the first window of the next one
    size = window * WINDOWS
    block = F.floor(F.col("place") / size)
    here = F.struct(block.alias("block"), F.lit(True).alias("own"))
    also = F.when((F.col("place") % size < window) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))
    placed = placed.select(*order, "place", "q", "lost", F.explode(F.array_compact(F.array(here, also))).alias("b"))
    placed = placed.select("pass", "label", "dim", "key", "rep", "place", "q", "lost", "b.block", "b.own")

    def verify(f: pd.DataFrame) -> pd.DataFrame:
        """Forest of the candidates between a block's vectors and those of the next one's beginning, and the bits."""
        found = []
        for (p, name, dim), g in f.groupby(["pass", "label", "dim"]):
            g = g.sort_values("place")
            n, ids, place = int(g["own"].sum()), g["rep"].to_numpy(), g["place"].to_numpy()
            for low in range(0, n, window):  # a window of rows at a time bounds the matrix
                part = g.iloc[low:]
                near = np.triu(_candidates(part, min(window, n - low), cosine), 1)
                found += [(ids[low + i], ids[low + j], None, None, None, None) for i, j in _forest(near)]
            _, i, j = np.intersect1d(place[:n] + window, place, return_indices=True)
            if len(i):
                a, b = (np.frombuffer(b"".join(g["key"].iloc[at]), dtype=">u8") for at in (i, j))
                found.append((None, None, name, dim, p, BITS - int((a ^ b).min()).bit_length() + 1))
        return pd.DataFrame(found, columns=["a", "b", "label", "dim", "pass", "bits"], dtype=object)

    out = stage(placed.groupBy("block").applyInPandas(verify, f"a {rep}, b {rep}, label {label}, dim int, pass int, bits int"), "passes")
    unstage(ordered)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row.

    Only vectors of the same label and length are compared; a null label, vector or component, a non-finite component
    or a zero vector links with nothing, and so does a row with a null vec_id (its component_id is null, kept true).
    Repeated rows are vectors of their own. An empty table gives no rows.
    """
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine
    rows = vectors.select("vec_id", "label", "embedding")
    keys = [F.xxhash64("label", "embedding"), F.xxhash64(F.lit(SEED), "embedding", "label")]
    rows = rows.withColumns({"k1": F.when(usable, keys[0]), "k2": keys[1]})
    classes = stage(
        rows.where(usable).groupBy("k1", "k2").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
        ),
        "classes",
    )
    kinds = dict(classes.dtypes)
    rep, target, same = kinds["rep"], math.log(miss), 1 - math.acos(cosine) / math.pi

    def pack(frames):
        for f in frames:
            for dim, part in f.groupby("dim"):
                q, lost = _packed(part["embedding"])
                yield pd.DataFrame({"label": part["label"].to_numpy(), "dim": dim, "rep": part["rep"].to_numpy(), "q": [r.tobytes() for r in q], "lost": lost})

    vectors_of = classes.select("label", F.size("embedding").alias("dim"), "rep", "embedding").mapInPandas(pack, f"label {kinds['label']}, dim int, rep {rep}, q binary, lost float")
    vectors_of = stage(vectors_of, "vectors")
    sizes = vectors_of.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))

    def planned(n: int, logmiss: float, agree: float | None) -> tuple[int, bool]:
        """(further passes, compare whole) of a label of n classes whose passes so far miss with exp(logmiss)."""
        if logmiss <= target:
            return 0, False
        if agree is None:
            more = passes_for(n, cosine, window, miss)
        else:
            more = math.ceil((target - logmiss) / math.log1p(-agree)) if agree > 0 else None
        # a pass compares a vector with some three windows, all pairs with half the label
        return (0, True) if more is None or n <= 3 * window * more else (more, False)

    def plan(frames):
        for f in frames:
            f["passes"], f["whole"] = zip(*(planned(n, m, None if math.isnan(g) else g) for n, m, g in zip(f["n"], f["logmiss"], f["agree"]))) if len(f) else ([], [])
            yield f[["label", "dim", "n", "logmiss", "passes", "whole"]]

    plan_of = f"label {kinds['label']}, dim int, n long, logmiss double, passes int, whole boolean"
    state = stage(sizes.withColumns({"logmiss": F.lit(0.0), "agree": F.lit(float("nan"))}).mapInPandas(plan, plan_of), "plan")
    found, whole_labels, done = [], [state.where("whole")], 0
    while n_passes := state.agg(F.max("passes")).first()[0] or 0:
        active = state.where("passes > 0")
        out = _passes(vectors_of.join(broadcast_if_small(active.select("label", "dim", "passes")), ["label", "dim"]), kinds, done, cosine, window)
        done += n_passes
        found.append(out.where("a is not null").select("a", "b"))
        # a pass in which more than a window share all bits finds nothing for certain
        hit = F.when(F.col("bits") <= BITS, F.pow(F.lit(same), F.col("bits"))).otherwise(0.0)
        seen = out.where("bits is not null").groupBy("label", "dim", "pass").agg(F.max("bits").alias("bits")).groupBy("label", "dim").agg(F.sum(F.log1p(-hit)).alias("gain"), F.avg(hit).alias("agree"))
        state = active.join(seen, ["label", "dim"]).select("label", "dim", "n", (F.col("logmiss") + F.col("gain")).alias("logmiss"), "agree")
        state = stage(state.mapInPandas(plan, plan_of), "plan")
        whole_labels.append(state.where("whole"))

    dense = reduce(DataFrame.unionByName, whole_labels).select("label", "dim", F.ceil(F.col("n") / WHOLE).alias("blocks"))
    dense = vectors_of.join(broadcast_if_small(dense), ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("blocks")))
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dense = dense.select("label", "dim", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", "block", "q", "lost")

    def pairs(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block", kind="stable")
        ids, n, found = f["rep"].to_numpy(), int((f["block"] == f["block"].iloc[0]).sum()), []
        for low in range(0, n, 512):
            near = np.triu(_candidates(f.iloc[low:], min(512, n - low), cosine), 1)
            found += [(ids[low + i], ids[low + j]) for i, j in _forest(near)]
        return pd.DataFrame(found, columns=["a", "b"])

    found.append(dense.groupBy("label", "dim", "x", "y").applyInPandas(pairs, f"a {rep}, b {rep}"))
    forest = reduce(DataFrame.unionByName, found).distinct()
    groups = stage(components(forest).select(F.col("node").alias("rep"), F.col("component").alias("group")), "groups")
    # inside a group all pairs are compared exactly, block against block
    sizes = groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    members = groups.join(sizes, "group").join(classes.select("rep", "copies", "embedding"), "rep")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", "copies", "block", "embedding")

    def exact(f: pd.DataFrame) -> pd.DataFrame:
        """Per vector of two blocks its links, and a vector of the same component."""
        f = f.sort_values("block", kind="stable")
        n, copies, ids = int((f["block"] == f["block"].iloc[0]).sum()), f["copies"].to_numpy(), f["rep"].to_numpy()
        x, links, tied = _units(f["embedding"]), np.zeros(len(f), dtype=np.int64), [(i, i) for i in range(len(f))]
        for low in range(0, n, 512):
            high = min(low + 512, n)
            near = x[low:high] @ x.T >= cosine
            near[np.arange(high - low), np.arange(low, high)] = False
            if n < len(f):
                near[:, :n] = False
            links[low:high] += near @ copies
            if n < len(f):
                links[n:] += near[:, n:].T @ copies[low:high]
            wide = np.zeros((high, len(f)), dtype=bool)
            wide[low:] = near
            tied += _forest(wide)
        a, b = np.array(tied).T
        return pd.DataFrame({"rep": ids[a], "root": ids[b], "links": np.where(a == b, links[a], 0)})

    verified = stage(members.groupBy("group", "x", "y").applyInPandas(exact, f"rep {rep}, root {rep}, links long"), "verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = stage(components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component"), "components")
    unstage(groups, vectors_of)
    result = classes.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(whole, "rep", "left")
    result = result.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.drop("label", "embedding").join(result, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of embeddings through near_duplicates; nulls, repeats and empty tables as told there."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
