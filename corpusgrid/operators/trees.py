"""Decision trees by key (E7, E8): a model for every key in one pass, grown from histograms.

Rows never meet by key: a level of all trees of all keys is one aggregate over (key, tree, node, feature, bin), a table whose
size the parameters bound. Rows are packed once into blocks of arrays by key; each task adds up its own blocks, so no row is
repeated by tree or feature, and Spark adds up the tasks' cells. Splits come back to the driver and go out with the next level; a row's node is found by walking the
trees so far, so the rows themselves are never rewritten. Sums of gradients make boosted trees (g = p - y, h = p (1 - p)) and
averaging ones (g = -y w, h = w) the same job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.session import stage, unstage

#: Keys times trees that are grown together, at most: what is broadcast and what comes back to the driver.
MOST_TREES = 20_000
#: Rows that a task packs or adds up at a time, and cells that it hands on at a time.
TASK_ROWS, TASK_CELLS = 500_000, 1_000_000
BLOCK = "_k int, n int, y binary, b binary, w binary"
CELL = "_k int, tree int, node int, f int, bin int, g double, h double, n long"
TREE = "struct<feats:array<int>,cuts:array<int>,leaf:array<double>>"


@dataclass(frozen=True)
class Family:
    """How trees are grown: boosted one after the other, or together on resampled rows (bootstrap). subset: percentage of
    features tried at a node; random_cut: one cut a feature, drawn by hash."""

    trees: int = 5
    depth: int = 3
    boosted: bool = True
    rate: float = 0.3
    penalty: float = 1.0
    least_rows: int = 5
    bootstrap: bool = False
    subset: int = 100
    random_cut: bool = False


#: The families that E8 chooses from.
FAMILIES = {
    "boosting": Family(),
    "extra_trees": Family(trees=12, depth=4, boosted=False, penalty=0.0, subset=70, random_cut=True),
    "forest": Family(trees=12, depth=4, boosted=False, penalty=0.0, subset=70, bootstrap=True),
}


def cut_points(df: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """Up to bins - 1 distinct cuts of each feature, at its quantiles over all rows."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 100_000).alias(f) for f in features]).first()
    return [sorted(set(row[f] or [])) for f in features]


def binned(df: DataFrame, features: list[str], cuts: list[list[float]], name: str = "_b") -> DataFrame:
    """Adds the bins of the features: how many cuts are below the value; 0 for null."""
    below = lambda f, c: F.size(F.filter(F.array(*map(F.lit, c)), lambda x: x < F.col(f))) if c else F.lit(0)
    return df.withColumn(name, F.array(*[F.coalesce(F.when(F.col(f).isNotNull(), below(f, c)), F.lit(0)) for f, c in zip(features, cuts)]))


def _matrix(lists) -> np.ndarray:
    """A row for each list of an Arrow column; all have the same length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // max(len(lists), 1))


def _walk(bins: np.ndarray, feats: np.ndarray, cuts: np.ndarray, steps: int) -> np.ndarray:
    """Node that each row of bins reaches in `steps` steps; nodes are numbered as in a heap, a node without feature keeps its rows."""
    node, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    for _ in range(steps if (feats >= 0).any() else 0):
        f = feats[node]
        node = np.where(f >= 0, 2 * node + 1 + (bins[row, f] > cuts[node]), node)
    return node


def _sum(bins: np.ndarray, trees: list[tuple], depth: int) -> np.ndarray:
    total = np.zeros(len(bins))
    for feats, cuts, leaf in trees:
        total += leaf[_walk(bins, feats, cuts, depth)]
    return total


def _arrays(tree: dict) -> tuple:
    return np.array(tree["feats"], dtype=np.int64), np.array(tree["cuts"], dtype=np.int64), np.array(tree["leaf"], dtype=np.float64)


def _by_key(k: np.ndarray):
    """(key, numbers of its rows) of each key."""
    order = np.argsort(k, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(k[order]))[0] + 1) if len(k) else []:
        yield int(k[rows[0]]), rows


def _draws(row: Column, tree: Column) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, by hash."""
    u = F.pmod(F.xxhash64(row, tree), F.lit(1_000_003)) / 1_000_003.0
    return sum(((u >= x).cast("int") for x in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634)), F.lit(0))


def _gathered(batches, rows_of: Callable):
    """Lists of batches of about TASK_ROWS rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += rows_of(b)
        if n >= TASK_ROWS:
            yield held
            held, n = [], 0
    if n:
        yield held


def _pack(batches):
    """Rows (_k, _y, _b, and _w: draws for each tree) to blocks of a key: labels (2: null), bins and draws, four bytes a bin."""
    import pyarrow as pa

    for held in _gathered(batches, lambda b: b.num_rows):
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda c, t=table: t[c].combine_chunks()
        y, bins, w = column("_y").cast("int8").fill_null(2).to_numpy(), _matrix(column("_b")).astype(np.int32), None
        if "_w" in table.column_names:
            w = _matrix(column("_w")).astype(np.int8)
        blocks = [(k, len(rows), y[rows].tobytes(), bins[rows].tobytes(), None if w is None else w[rows].tobytes()) for k, rows in _by_key(column("_k").to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*blocks), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], [c.split()[0] for c in BLOCK.split(", ")])


def _task_cells(family: Family, growing: list[list[tuple]], done: list[list[tuple]], level: int) -> Callable:
    """What a task makes of its blocks: sums by CELL, of the nodes of a level; at the trees' depth a cell for each node, without
    feature."""
    import pyarrow as pa

    leaves, low = level == family.depth, 2**level - 1
    # averaging trees are counted by class, which is a draw's number and the label: exact, in one count for all three sums
    classes = 2 if not family.bootstrap else 12
    w_of, y_of = (np.arange(classes) // 2 if family.bootstrap else np.ones(classes, dtype=np.int64)), np.arange(classes) % 2

    def cells(k: int, bins: np.ndarray, y: np.ndarray, known: np.ndarray, w: np.ndarray | None):
        """(tree, node, f, bin, g, h, n) of the rows of a key."""
        features, width = (1, 1) if leaves else (bins.shape[1], int(bins.max(initial=0)) + 1)
        nodes = 2 * low + 1 if leaves else 2**level
        own = np.zeros((len(bins), 1), dtype=np.int64) if leaves else np.arange(features) * width + bins
        if family.boosted:
            p = 1 / (1 + np.exp(-_sum(bins, done[k], family.depth)))
            gs, hs = np.where(known, p - y, 0.0), p * (1 - p)
        for t, (feats, cuts) in enumerate(growing[k]):
            at = _walk(bins, feats, cuts, level) - (0 if leaves else low)
            stay = slice(None) if leaves or (at >= 0).all() else at >= 0
            cell, at = own[stay], at[stay] * (features * width)
            if family.boosted:
                cell = (cell + at[:, None]).ravel()
                g, h = (np.bincount(cell, np.repeat(x[stay], features), nodes * features * width) for x in (gs, hs))
                n = np.bincount(cell, minlength=len(g))
            else:
                kind = y[stay] if w is None else y[stay] + 2 * w[stay, t]
                by = np.bincount((cell * classes + (at * classes + kind)[:, None]).ravel(), minlength=nodes * features * width * classes).reshape(-1, classes)
                g, h, n = by @ (-y_of * w_of), by @ w_of, by.sum(axis=1)
            some = np.nonzero(n)[0]
            node, rest = np.divmod(some, features * width)
            yield np.full(len(some), t), node + (0 if leaves else low), (rest // width if not leaves else rest - 1), rest % width, g[some], h[some], n[some]

    types = ["int32"] * 5 + ["float64"] * 2 + ["int64"]
    names = [c.split()[0] for c in CELL.split(", ")]
    batch = lambda found: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*found), types)], names)

    def task(batches):
        one = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
        for held in _gathered(one, lambda b: b["n"][0].as_py()):
            blocks: dict[int, list] = {}
            for b in held:
                blocks.setdefault(b["_k"][0].as_py(), []).append(b)
            found, n = [], 0
            for key, own in blocks.items():
                array = lambda c, t, own=own: np.concatenate([np.frombuffer(b[c][0].as_buffer(), dtype=t) for b in own])
                y = array("y", np.int8).astype(np.int64)
                bins, w = array("b", np.int32).reshape(len(y), -1), array("w", np.int8).astype(np.int64).reshape(len(y), -1) if family.bootstrap else None
                for cols in cells(key, bins, y % 2, y < 2, w):
                    found.append((np.full(len(cols[0]), key), *cols))
                    n += len(cols[0])
                    if n >= TASK_CELLS:
                        yield batch(found)
                        found, n = [], 0
            if found:
                yield batch(found)

    return task


def fit(df: DataFrame, key: str, label: str, family: Family = FAMILIES["boosting"], row: str | None = None, bins: str = "_b") -> DataFrame:
    """key, trees: a model of each key that tells rows whose label (boolean) is true. df has bins; row names its rows for
    the bootstrap. Every level reads the blocks that df is packed into once. More than MOST_TREES trees at once raise."""
    spark, kind, depth = df.sparkSession, dict(df.dtypes)[key], family.depth
    keys = [r[0] for r in df.select(key).distinct().limit(MOST_TREES + 1).collect()]
    together = 1 if family.boosted else family.trees
    if len(keys) * together > MOST_TREES:
        raise ValueError(f"over {MOST_TREES} trees at once")
    done = [[] for _ in keys]
    nodes = 2 ** (depth + 1) - 1
    numbers = spark.createDataFrame(list(zip(keys, range(len(keys)))), f"`{key}` {kind}, _k int")
    drawn = [F.array(*[_draws(F.col(row), F.lit(t)).cast("byte") for t in range(together)]).alias("_w")] if family.bootstrap else []
    rows = df.join(F.broadcast(numbers), key).select("_k", F.col(label).alias("_y"), F.col(bins).alias("_b"), *drawn)
    blocks = stage(rows.mapInArrow(_pack, BLOCK), "blocks")
    own = ["_k", "tree", "node"]
    for _ in range(0, family.trees, together):
        growing = [[{"feats": [-1] * nodes, "cuts": [0] * nodes, "leaf": [0.0] * nodes} for _ in range(together)] for _ in keys]

        def hist(level: int, by: list[str], growing=growing) -> DataFrame:
            shape = [[_arrays(t)[:2] for t in ts] for ts in growing]
            found = blocks.mapInArrow(_task_cells(family, shape, [[_arrays(t) for t in ts] for ts in done], level), CELL)
            # tasks have added up their rows: one shuffle, by what all further steps of a level go by
            return found.repartition(*own).groupBy(*by).agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))

        for level in range(depth):
            x = hist(level, [*own, "f", "bin"])
            if family.subset < 100:
                x = x.where(F.pmod(F.xxhash64("tree", "node", "f"), F.lit(100)) < family.subset)
            every = Window.partitionBy(*own, "f")
            upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            for c in ("g", "h", "n"):
                x = x.withColumns({f"{c}l": F.sum(c).over(upto), f"{c}r": F.sum(c).over(every)})
                x = x.withColumn(f"{c}r", F.col(f"{c}r") - F.col(f"{c}l"))
            part = lambda s: F.col(f"g{s}") * F.col(f"g{s}") / (F.col(f"h{s}") + family.penalty)
            whole = (F.col("gl") + F.col("gr")) * (F.col("gl") + F.col("gr")) / (F.col("hl") + F.col("hr") + family.penalty)
            able = x.where((F.col("nl") >= family.least_rows) & (F.col("nr") >= family.least_rows) & (F.col("hl") > 0) & (F.col("hr") > 0))
            able = able.withColumn("gain", F.round(part("l") + part("r") - whole, 9)).where("gain > 0")
            if family.random_cut:
                able = able.withColumn("_r", F.row_number().over(every.orderBy(F.xxhash64("tree", "node", "f", "bin")))).where("_r = 1")
            best = able.groupBy(*own).agg(F.max_by(F.struct("f", "bin"), F.struct("gain", -F.col("f"), -F.col("bin"))).alias("s"))
            for r in best.collect():  # at most a row for each node of a level of the trees that grow
                tree = growing[r["_k"]][r["tree"]]
                tree["feats"][r["node"]], tree["cuts"][r["node"]] = r["s"]["f"], r["s"]["bin"]
        step = -F.col("g") / (F.col("h") + family.penalty) * (family.rate if family.boosted else 1.0)
        for r in hist(depth, own).select(*own, F.when(F.col("h") > 0, step).otherwise(0.0).alias("leaf")).collect():
            growing[r["_k"]][r["tree"]]["leaf"][r["node"]] = r["leaf"]
        for ts, grown in zip(done, growing):
            ts += grown
    unstage(blocks)
    return spark.createDataFrame(list(zip(keys, done)), f"`{key}` {kind}, trees array<{TREE}>")


def score(df: DataFrame, model: DataFrame, key: str, family: Family = FAMILIES["boosting"], bins: str = "_b") -> DataFrame:
    """Adds p, by the model of the row's key; rows of a key without a model go."""
    spark, found = df.sparkSession, model.select(key, "trees").collect()  # fit() bounds the trees
    models = [[_arrays(t.asDict()) for t in r["trees"]] for r in found]
    numbers = spark.createDataFrame([(r[0], i) for i, r in enumerate(found)], f"`{key}` {dict(model.dtypes)[key]}, _k int")

    @F.arrow_udf("double")
    def p(k, b):
        import pyarrow as pa

        k, b, out = k.to_numpy(), _matrix(b), np.zeros(len(k))
        for i, rows in _by_key(k):
            total = _sum(b[rows], models[i], family.depth)
            out[rows] = 1 / (1 + np.exp(-total)) if family.boosted else total / len(models[i])
        return pa.array(out)

    return df.join(F.broadcast(numbers), key).withColumn("p", p(F.col("_k"), F.col(bins))).drop("_k")
