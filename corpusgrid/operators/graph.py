"""Analytics over many small graphs at once (G1-G13). Nodes are (r, c); keys start with the graph id `g`.

edges: g, ord, ar, ac, br, bc, status, stairs, oneway_r, oneway_c (null: both ways). Small graphs are dealt to buckets and
searched there, many at once; large ones in rounds that carry all graphs in one job, are written to the shared folder and
end with one small count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.session import Grown, broadcast_if_small, dealt, stage, unstage

#: Graphs of up to so many arcs are searched in one task each; profiles that a search may take.
GROUP_ARCS, MOST_PROFILES, FAR = 20_000, 10_000, 1 << 60
#: Graphs that are searched together in a bucket have about so many arcs.
BUCKET_ARCS = 100_000
#: Arcs of the graphs of a bucket in the search for routes, and profiles that they are relaxed for at once.
ROUTE_ARCS, TOGETHER_PROFILES = 20_000, 8
#: Actions: up 0, down 1, left 2, right 3, and the kind of turn from a heading to an action.
DELTAS = ((-1, 0), (1, 0), (0, -1), (0, 1))
CLOCKWISE = (0, 3, 1, 2)


def action_of(dr: Column, dc: Column) -> Column:
    return reduce(lambda w, a: w.when((dr == DELTAS[a][0]) & (dc == DELTAS[a][1]), a), range(1, 4), F.when((dr == DELTAS[0][0]) & (dc == DELTAS[0][1]), 0))


def turn_kind(heading: Column, action: Column) -> Column:
    """Straight, right_turn, u_turn or left_turn, by quarter turns clockwise."""
    at = lambda c: F.element_at(F.array(*[F.lit(CLOCKWISE.index(a)) for a in range(4)]), c.cast("int") + 1)
    return F.element_at(F.array(*map(F.lit, ("straight", "right_turn", "u_turn", "left_turn"))), F.pmod(at(action) - at(heading), F.lit(4)) + 1)


def arcs(edges: DataFrame, legged: Column | bool = False) -> DataFrame:
    """G1: directed legal arcs: not closed, stairs only if legged, one-way only toward its target.

    Arcs of all graphs are never a side to broadcast, though estimates of exploded rows may call them small."""
    legged = legged if isinstance(legged, Column) else F.lit(legged)
    keep = [c for c in edges.columns if c not in ("ar", "ac", "br", "bc", "oneway_r", "oneway_c")]
    way = lambda a, b: edges.where(F.col("oneway_r").isNull() | ((F.col("oneway_r") == F.col(f"{b}r")) & (F.col("oneway_c") == F.col(f"{b}c")))).select(
        *keep, F.col(f"{a}r").alias("r"), F.col(f"{a}c").alias("c"), F.col(f"{b}r").alias("r2"), F.col(f"{b}c").alias("c2")
    )
    both = way("a", "b").unionByName(way("b", "a")).hint("merge").where((F.col("status") != "closed") & (~F.col("stairs") | legged))
    return both.withColumn("action", action_of(F.col("r2") - F.col("r"), F.col("c2") - F.col("c"))).where("action is not null")


def arc_cost(status: Column, stairs: Column, turn: Column, profile: dict[str, Column]) -> Column:
    """Cost in hundredths; no turn at the first step of a search without heading."""
    by = lambda c, names: sum((F.when(c == n, profile[n]).otherwise(0) for n in names), F.lit(0))
    turned = F.when(turn != "straight", profile["turn"]).otherwise(0)
    return profile["step"] + by(status, ("crowded", "covered")) + F.when(stairs, profile["stairs"]).otherwise(0) + F.coalesce(turned, F.lit(0)) + F.coalesce(by(turn, ("left_turn", "right_turn", "u_turn")), F.lit(0))


def _parts(arc_rows: DataFrame, keys: list[str], group_arcs: int) -> tuple[DataFrame, int, DataFrame | None]:
    """Arcs staged, the number of buckets that their graphs are dealt to, and the keys of graphs of over group_arcs arcs."""
    a = stage(arc_rows.select(*keys, "r", "c", "r2", "c2").distinct(), "arcs")
    sizes = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    large = stage(sizes.where(F.col("n") > group_arcs).select(*keys), "large") if (found["most"] or 0) > group_arcs else None
    return a, (found["n"] or 0) // BUCKET_ARCS + 1, large


def _split(large: DataFrame | None, keys: list[str], tables: list[DataFrame], how: str) -> list[DataFrame]:
    return [df.join(large, keys, how) for df in tables]


def _by_buckets(a: DataFrame, nodes: list[DataFrame], keys: list[str], buckets: int, solve, more: str = "") -> DataFrame:
    """Rows (keys, r, c and `more`) that solve() gives for the graphs of each bucket, all at once.

    nodes: tables of (keys, r, c). solve gets the ends of the arcs as numbers of nodes, an array of such numbers for each
    table, the graph of each node, and coordinates; it returns node numbers and further columns.
    """
    kinds, at, tables = dict(a.dtypes), [*keys, "r", "c"], len(nodes)
    for c in ("r", "c"):  # the wider type of what is compared
        kinds[c] = "bigint" if "bigint" in [dict(x.dtypes)[n] for x, n in ((a, c), (a, f"{c}2"), *((x, c) for x in nodes))] else kinds[c]
    rows = [a.select(*keys, F.lit(0).alias("_part"), *[F.col(c).cast("long") for c in ("r", "c", "r2", "c2")]).dropna()]  # an arc has two ends
    none = F.lit(None).cast("long")
    rows += [df.select(*keys, F.lit(i + 1).alias("_part"), F.col("r").cast("long"), F.col("c").cast("long"), none.alias("r2"), none.alias("c2")) for i, df in enumerate(nodes)]
    every = reduce(DataFrame.unionByName, rows).dropna(subset=at).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        part = f["_part"].to_numpy()
        ends = f[part == 0]
        every = pd.concat([f[at], ends[[*keys, "r2", "c2"]].set_axis(at, axis=1).astype({"r": "int64", "c": "int64"})], ignore_index=True)
        number = every.groupby(at, sort=False).ngroup().to_numpy()
        named = every[~pd.Series(number).duplicated().to_numpy()].reset_index(drop=True)
        graph = named.groupby(keys, sort=False).ngroup().to_numpy()
        found, extra = solve(number[: len(f)][part == 0], number[len(f) :], [number[: len(f)][part == i + 1] for i in range(tables)], graph, named[["r", "c"]].to_numpy())
        return named.iloc[found].assign(**extra)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in at) + more
    return every.groupBy("_bucket").applyInPandas(one, schema)


def _spread(u: np.ndarray, v: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n nodes can be reached from the start nodes over arcs u to v."""
    seen = np.zeros(n, dtype=bool)
    seen[start] = True
    while len(u):
        new = v[seen[u] & ~seen[v]]
        if not len(new):
            break
        seen[new] = True
        left = ~seen[v]
        u, v = u[left], v[left]
    return seen


def reachable(arc_rows: DataFrame, starts: DataFrame, keys: list[str] = ["g"], back: bool = False, group_arcs: int = GROUP_ARCS) -> DataFrame:
    """Nodes that can be reached from the starts (included), per key.

    Graphs of up to group_arcs arcs are dealt to buckets of about BUCKET_ARCS arcs and searched there; larger ones by a
    frontier that grows in rounds of joins until it is empty."""
    a, buckets, large = _parts(arc_rows, keys, group_arcs)
    if back:
        a = a.select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    starts = starts.select(*keys, "r", "c")

    def solve(u, v, nodes, graph, _):
        return np.nonzero(_spread(u, v, nodes[0], len(graph)))[0], {}

    lost = starts.where(reduce(Column.__or__, [F.col(c).isNull() for c in [*keys, "r", "c"]])).distinct()  # they meet no arc
    small, rest = ([a, starts], []) if large is None else (_split(large, keys, [a, starts], how) for how in ("left_anti", "left_semi"))
    found = _by_buckets(small[0], [small[1]], keys, buckets, solve).unionByName(lost)
    return found.unionByName(_reachable_by_rounds(*rest, keys)) if rest else found


def _reachable_by_rounds(ways: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """reachable() for graphs of any size: a round writes its new nodes only, as a further part of the visited table."""
    ways, at, seen = stage(ways, "ways"), [*keys, "r", "c"], Grown(ways.sparkSession, "seen")
    frontier = seen.add(starts.distinct())
    while not frontier.isEmpty():
        step = frontier.hint("merge").join(ways, at).select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c")).distinct()
        frontier = seen.add(step.join(seen.table().hint("merge"), at, "left_anti"))
    unstage(ways)
    return seen.table()


def _both_ways(arc_rows: DataFrame, keys: list[str]) -> DataFrame:
    back = arc_rows.select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    return arc_rows.select(*keys, "r", "c", "r2", "c2").unionByName(back)


def weakly_reachable(arc_rows: DataFrame, starts: DataFrame, keys: list[str] = ["g"]) -> DataFrame:
    """The same with every arc passable both ways."""
    return reachable(_both_ways(arc_rows, keys), starts, keys)


def mission_reachable(arc_rows: DataFrame, starts: DataFrame, vias: DataFrame, goals: DataFrame, keys: list[str] = ["g"], group_arcs: int = GROUP_ARCS) -> DataFrame:
    """Keys whose goal can be reached, through a via node first where the key has any."""
    a, buckets, large = _parts(arc_rows, keys, group_arcs)
    tables = [a, *[x.select(*keys, "r", "c") for x in (starts, vias, goals)]]

    def solve(u, v, nodes, graph, _):
        start, via, goal = nodes
        n = len(graph)
        bound, is_via = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        bound[graph[via]] = is_via[via] = True
        first = _spread(u, v, start, n)
        second = _spread(u, v, np.concatenate([np.nonzero(first & is_via)[0], start[~bound[graph[start]]]]), n)
        goal = goal[second[goal]]
        return goal[np.unique(graph[goal], return_index=True)[1]], {}

    small, rest = (tables, []) if large is None else (_split(large, keys, tables, how) for how in ("left_anti", "left_semi"))
    found = _by_buckets(small[0], small[1:], keys, buckets, solve).select(*keys)
    return found.unionByName(_mission_by_rounds(*rest, keys)) if rest else found


def _mission_by_rounds(ways: DataFrame, starts: DataFrame, vias: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    first = _reachable_by_rounds(ways, starts, keys)
    with_via = vias.select(*keys).distinct()
    second = first.join(vias.distinct(), [*keys, "r", "c"]).unionByName(starts.join(with_via, keys, "left_anti"))
    return _reachable_by_rounds(ways, second, keys).join(goals.distinct(), [*keys, "r", "c"], "left_semi").select(*keys).distinct()


def route_costs(arc_rows: DataFrame, profiles: DataFrame, missions: DataFrame, vias: DataFrame, goals: DataFrame, group_arcs: int = GROUP_ARCS) -> DataFrame:
    """Cost of the best route per graph, profile and legal first action; unreachable actions have no row.

    missions: g, r, c, heading. At least one step is taken; via counts at the start or on any arrival. The states of a
    graph are (node, heading on arrival, via done). Graphs of up to group_arcs arcs are dealt to buckets, where all of them
    are relaxed at once for all profiles; larger ones are relaxed in rounds of joins.
    """
    return RouteSearch(arc_rows, missions, vias, goals, group_arcs).costs(profiles)


class RouteSearch:
    """route_costs() for several tables of profiles over the same graphs, which are counted once; staged, dealt out once."""

    def __init__(self, arc_rows: DataFrame, missions: DataFrame, vias: DataFrame, goals: DataFrame, group_arcs: int = GROUP_ARCS, staged: bool = False):
        sizes = arc_rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        found = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        small, self.large, self.arcs = [arc_rows, missions, vias, goals], None, found["n"] or 0
        if (found["most"] or 0) > group_arcs:
            large = stage(sizes.where(F.col("n") > group_arcs).select("g"), "large")
            small, self.large = ([x.join(large, "g", how) for x in small] for how in ("left_anti", "left_semi"))
        rows = _route_rows(*small, self.arcs // ROUTE_ARCS + 1)
        self.rows = stage(rows, "routes") if staged else rows

    def costs(self, profiles: DataFrame) -> DataFrame:
        # some buckets a task: by their bytes alone, far too many would be put into one
        found = _routes_by_buckets(dealt(self.rows, self.arcs, "_bucket", per_task=3 * ROUTE_ARCS), profiles)
        return found if self.large is None else found.unionByName(_routes_by_rounds(self.large[0], profiles, *self.large[1:]))


#: Statuses that have a price of their own, after all others.
PRICED = ("crowded", "covered")


def _route_rows(arc_rows: DataFrame, missions: DataFrame, vias: DataFrame, goals: DataFrame, buckets: int) -> DataFrame:
    """Arcs (part 0; x the action, y the kind), missions (1; x the heading), vias (2) and goals (3) in one table."""
    none = F.lit(None).cast("int")
    status = F.when(F.col("status") == PRICED[0], 1).when(F.col("status") == PRICED[1], 2).otherwise(0)
    kind = (status * 2 + F.coalesce(F.col("stairs"), F.lit(False)).cast("int")).cast("int")
    long = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]
    place = lambda df, part, x: df.select("g", F.lit(part).cast("byte").alias("part"), *long("r", "c"), none.cast("long").alias("r2"), none.cast("long").alias("c2"), x.cast("int").alias("x"), none.alias("y"))
    rows = [
        arc_rows.select("g", F.lit(0).cast("byte").alias("part"), *long("r", "c", "r2", "c2"), F.col("action").cast("int").alias("x"), kind.alias("y")).dropna(subset=["r", "c", "r2", "c2", "x"]),
        place(missions, 1, F.col("heading")).dropna(subset=["r", "c", "x"]), *[place(df, k, none).dropna(subset=["r", "c"]) for k, df in ((2, vias), (3, goals))],
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("_bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))


def _prices(profiles: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names of the profiles, and the price of a move by (status, stairs, heading, action, profile)."""
    weights, spark = [p for p in profiles.columns if p != "profile"], profiles.sparkSession
    statuses = ("normal", *PRICED)
    kinds = spark.createDataFrame([(i, st, sr, h, a) for i, st in enumerate(statuses) for sr in (False, True) for h in range(4) for a in range(4)], "status_id int, status string, stairs boolean, heading int, action int")
    named = profiles.select("profile", *[F.col(p).alias(f"w_{p}") for p in weights]).limit(MOST_PROFILES + 1)
    cost = arc_cost(F.col("status"), F.col("stairs"), turn_kind(F.col("heading"), F.col("action")), {p: F.col(f"w_{p}") for p in weights})
    priced = named.crossJoin(F.broadcast(kinds)).select("profile", "status_id", "stairs", "heading", "action", cost.cast("long").alias("cost")).collect()
    names = sorted({r["profile"] for r in priced})
    if len(names) > MOST_PROFILES:
        raise ValueError(f"over {MOST_PROFILES} profiles")
    price, at = np.zeros((len(statuses), 2, 4, 4, len(names)), dtype=np.int64), {p: i for i, p in enumerate(names)}
    for r in priced:
        price[r["status_id"], int(r["stairs"]), r["heading"], r["action"], at[r["profile"]]] = r["cost"]
    return names, price


def _relaxed(source: np.ndarray, target: np.ndarray, cost: np.ndarray, graph: np.ndarray, best: np.ndarray) -> None:
    """Lowers best, the cost that is left in each state (rows) for each profile (columns), until no move lowers it further.

    Moves are sorted by source; graph is that of each move. Graphs in which nothing changes any more leave the rounds."""
    while len(source):
        edge = np.nonzero(np.concatenate([[True], source[1:] != source[:-1]]))[0]
        at = source[edge]
        while True:
            old = best[at]
            found = np.minimum(np.minimum.reduceat(cost + best[target], edge, axis=0), old)
            moved = (found < old).any(axis=1) & (found < FAR // 2).any(axis=1)
            if not moved.any():
                return
            best[at] = np.where(found < FAR // 2, found, FAR)
            live = np.zeros(int(graph[-1]) + 1, dtype=bool)
            live[graph[edge[moved]]] = True
            stay = live[graph]
            if 4 * np.count_nonzero(stay) < 3 * len(stay):
                source, target, cost, graph = source[stay], target[stay], cost[stay], graph[stay]
                break


def _routes_by_buckets(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """route_costs() of whole graphs that are numbered by _bucket: moves of a bucket's graphs are arrays."""
    import pyarrow as pa

    names, price = _prices(profiles)
    kind = dict(rows.dtypes)["g"]

    def solve(g, part, r, c, r2, c2, x, y):
        """Arrays (graph, profile, action, cost) of a bucket; graphs are numbered by g."""
        own = part == 0
        ends = [np.concatenate([a, b[own]]) for a, b in ((g, g), (r, r2), (c, c2))]
        rows_, cols = (np.unique(v, return_inverse=True)[1] for v in ends[1:])
        _, number = np.unique((ends[0] * (int(rows_.max()) + 1) + rows_) * (int(cols.max()) + 1) + cols, return_inverse=True)
        n = int(number.max()) + 1
        of = np.empty(n, dtype=np.int64)  # nodes are numbered graph by graph
        of[number] = ends[0]
        at, v = number[: len(g)], number[len(g) :]
        u, act, sort = at[own], x[own], y[own]
        is_via, bound = np.zeros(n, dtype=np.int64), np.zeros(int(of[-1]) + 1, dtype=bool)
        is_via[at[part == 2]] = 1
        bound[of[at[part == 2]]] = True
        # a move for every arc, heading before it, and whether the via is done before it; state = (node * 4 + heading) * 2 + done.
        # A graph without a via has it done from the start.
        h, d = np.repeat(np.arange(4), 2), np.tile(np.arange(2), 4)
        source = (u[:, None] * 4 + h) * 2 + d
        target = (v[:, None] * 4 + act[:, None]) * 2 + np.maximum(d, is_via[v][:, None])
        priced = ((sort[:, None] * 4 + h) * 4 + act[:, None]) + 0 * d
        real = ((d > 0) | bound[of[u]][:, None]).ravel()
        source, target, priced, first = (m.ravel()[real] for m in (source, target, priced, np.broadcast_to(act[:, None], source.shape)))
        order = np.argsort(source, kind="stable")
        source, target, priced, first = source[order], target[order], priced[order], first[order]
        graph = of[source // 8]
        ends_at = ((at[part == 3][:, None] * 4 + np.arange(4)) * 2 + 1).ravel()
        begin = part == 1
        starts = np.zeros(n * 8, dtype=bool)
        starts[(at[begin] * 4 + x[begin]) * 2 + np.where(bound[of[at[begin]]], is_via[at[begin]], 1)] = True
        mine = np.nonzero(starts[source])[0]
        key = graph[mine] * 4 + first[mine]
        mine = mine[np.argsort(key, kind="stable")]
        key = np.sort(key)
        group = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        if not len(mine) or not len(ends_at) or not names:
            return
        flat = price.reshape(-1, len(names))
        for low in range(0, len(names), TOGETHER_PROFILES):
            cost = flat[priced, low : low + TOGETHER_PROFILES]
            best = np.full((n * 8, cost.shape[1]), FAR, dtype=np.int64)
            best[ends_at] = 0
            _relaxed(source, target, cost, graph, best)
            least = np.minimum.reduceat(cost[mine] + best[target[mine]], group, axis=0)
            k, p = np.nonzero(least < FAR // 2)
            yield key[group][k] // 4, low + p, key[group][k] % 4, least[k, p]

    def one(t: pa.Table):
        t = t.combine_chunks()
        coded = t["g"].combine_chunks().dictionary_encode(null_encoding="encode")
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        graph = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        column = lambda name: t[name].fill_null(0).to_numpy().astype(np.int64)
        label = pa.array(names, pa.string())
        for g, p, a, cost in solve(graph, *map(column, ("part", "r", "c", "r2", "c2", "x", "y"))):
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(g)), label.take(pa.array(p)), pa.array(a.astype(np.int32)), pa.array(cost)], ["g", "profile", "action", "cost"])

    def whole(t: pa.Table) -> pa.Table:
        made = list(one(t))
        empty = pa.Table.from_arrays([t["g"].slice(0, 0), pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int64())], names=["g", "profile", "action", "cost"])
        return pa.Table.from_batches(made) if made else empty

    return rows.groupBy("_bucket").applyInArrow(whole, f"g {kind}, profile string, action int, cost long")


def _routes_by_rounds(arc_rows: DataFrame, profiles: DataFrame, missions: DataFrame, vias: DataFrame, goals: DataFrame) -> DataFrame:
    """route_costs() by backward relaxation in rounds: only states that improved in a round are expanded in the next, for
    all graphs and profiles at once. A graph may be of any size."""
    weights = [p for p in profiles.columns if p != "profile"]
    profiles = profiles.select("profile", *[F.col(p).alias(f"w_{p}") for p in weights])
    cost = arc_cost(F.col("status"), F.col("stairs"), turn_kind(F.col("heading"), F.col("action")), {p: F.col(f"w_{p}") for p in weights})
    headings = F.explode(F.array(*map(F.lit, range(4))))
    priced = arc_rows.crossJoin(broadcast_if_small(profiles)).withColumn("heading", headings).select("g", "profile", "r", "c", "heading", "r2", "c2", "action", cost.alias("cost"))
    via = vias.select("g", F.col("r").alias("r2"), F.col("c").alias("c2"), F.lit(True).alias("_via")).distinct()
    need = vias.select("g").distinct().withColumn("_need", F.lit(True))
    phases = priced.join(via, ["g", "r2", "c2"], "left").withColumn("done", F.explode(F.array(F.lit(False), F.lit(True))))
    moves = stage(phases.withColumn("done2", F.col("done") | F.coalesce("_via", F.lit(False))).drop("_via"), "moves")
    state = ["g", "profile", "r", "c", "heading", "done"]
    ends = goals.select("g", "r", "c").distinct().crossJoin(broadcast_if_small(profiles.select("profile"))).withColumn("heading", headings)
    best = changed = stage(ends.select("g", "profile", "r", "c", "heading", F.lit(True).alias("done"), F.lit(0).cast("long").alias("left")), "left")
    while True:
        nxt = changed.select("g", "profile", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("heading").alias("action"), F.col("done").alias("done2"), "left")
        found = moves.join(nxt, ["g", "profile", "r2", "c2", "action", "done2"]).groupBy(*state).agg(F.min(F.col("cost") + F.col("left")).alias("new"))
        better = found.join(best, state, "left").where("left is null or new < left")
        changed = stage(better.select(*state, F.col("new").cast("long").alias("left")), "changed")
        if changed.isEmpty():
            break
        best = stage(best.join(changed.select(*state), state, "left_anti").unionByName(changed), "left")
    here = vias.select("g", "r", "c", F.lit(True).alias("_here")).distinct()
    start = missions.select("g", "r", "c", "heading").join(need, "g", "left").join(here, ["g", "r", "c"], "left")
    start = start.withColumn("done", F.col("_need").isNull() | F.coalesce("_here", F.lit(False))).drop("_need", "_here")
    first = moves.join(start, ["g", "r", "c", "heading", "done"])
    rest = best.select("g", "profile", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("heading").alias("action"), F.col("done").alias("done2"), "left")
    return first.join(rest, ["g", "profile", "r2", "c2", "action", "done2"]).groupBy("g", "profile", "action").agg(F.min(F.col("cost") + F.col("left")).alias("cost"))


def best_action(costs: DataFrame, keys: list[str], priority: list[int]) -> DataFrame:
    """Cheapest action, ties by the priority list."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("action").cast("int"))
    return costs.groupBy(*keys).agg(F.min_by(F.struct("action", "cost"), F.struct("cost", rank)).alias("b")).select(*keys, "b.action", "b.cost")


def lattice_edges(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes of a graph that stand side by side, right and down."""
    b = nodes.select("g", F.col("r").alias("br"), F.col("c").alias("bc"))
    a = nodes.select("g", F.col("r").alias("ar"), F.col("c").alias("ac"))
    step = lambda dr, dc: a.withColumns({"br": F.col("ar") + dr, "bc": F.col("ac") + dc}).join(b, ["g", "br", "bc"])
    return step(0, 1).unionByName(step(1, 0)).select("g", "ar", "ac", "br", "bc")


def relaxations(edges: DataFrame, nodes: DataFrame, grids: DataFrame, extra: DataFrame) -> DataFrame:
    """Edges of the cumulative repair steps: 1 drop one-way, 2 add lattice edges, 3 reopen closed, 4 add missing nodes.

    grids: g, grid_rows, grid_cols; step 4 fills each graph's own grid and adds the nodes of extra (g, r, c), which may
    stand outside of it.
    """
    plain = edges.select("g", "ar", "ac", "br", "bc", "status", "stairs").withColumns({"oneway_r": F.lit(None).cast("int"), "oneway_c": F.lit(None).cast("int")})
    both_ways = lambda df: df.select("g", "ar", "ac", "br", "bc").unionByName(df.select("g", F.col("br").alias("ar"), F.col("bc").alias("ac"), F.col("ar").alias("br"), F.col("ac").alias("bc"))).hint("merge")
    lacking = lambda found: lattice_edges(found).join(both_ways(edges), ["g", "ar", "ac", "br", "bc"], "left_anti")
    fresh = lambda df: df.select("g", "ar", "ac", "br", "bc", F.lit("normal").alias("status"), F.lit(False).alias("stairs"), F.lit(None).cast("int").alias("oneway_r"), F.lit(None).cast("int").alias("oneway_c"))
    reopened = plain.withColumn("status", F.when(F.col("status") == "closed", "normal").otherwise(F.col("status")))
    added = fresh(lacking(nodes.select("g", "r", "c").distinct()))
    every = grids.where("grid_rows > 0 and grid_cols > 0").select("g", "grid_cols", F.explode(F.sequence(F.lit(0), F.col("grid_rows") - 1)).alias("r")).select("g", "r", F.explode(F.sequence(F.lit(0), F.col("grid_cols") - 1)).alias("c"))
    full = every.unionByName(extra.select("g", "r", "c")).distinct().hint("merge")
    steps = (plain, plain.unionByName(added), reopened.unionByName(added), reopened.unionByName(fresh(lacking(full))))
    return reduce(DataFrame.unionByName, [x.withColumn("step", F.lit(i + 1)) for i, x in enumerate(steps)])


def repair(edges: DataFrame, nodes: DataFrame, starts: DataFrame, vias: DataFrame, goals: DataFrame, grids: DataFrame, landmarks: DataFrame) -> DataFrame:
    """First step of the ladder at which the mission is reachable (0: as it is, null: never).

    Each graph is filled up to its own grid, with the nodes of its robot and its landmarks.
    """
    as_is = edges.select("g", "ar", "ac", "br", "bc", "status", "stairs", "oneway_r", "oneway_c").withColumn("step", F.lit(0))
    a = arcs(as_is.unionByName(relaxations(edges, nodes, grids, starts.select("g", "r", "c").unionByName(landmarks.select("g", "r", "c")))))
    steps = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step")
    each = lambda df: df.select("g", "r", "c", steps)
    ok = mission_reachable(a, each(starts), each(vias), each(goals), ["g", "step"])
    return starts.select("g").distinct().join(ok.groupBy("g").agg(F.min("step").alias("step")), "g", "left")


def greedy_action(legal: DataFrame, targets: DataFrame) -> DataFrame:
    """Legal (g, r2, c2, action, heading): action to the node nearest (Manhattan) to a target; ties keep the heading, then the lowest."""
    d = legal.join(targets.select("g", F.col("r").alias("tr"), F.col("c").alias("tc")), "g").withColumn("d", F.abs(F.col("r2") - F.col("tr")) + F.abs(F.col("c2") - F.col("tc")))
    return d.groupBy("g").agg(F.min(F.struct("d", (F.col("action") != F.col("heading")).alias("turns"), "action")).alias("b")).select("g", "b.action", "b.d")


def fallback_category(starts: DataFrame, arc_rows: DataFrame, vias: DataFrame, goals: DataFrame) -> DataFrame:
    """Why a mission fails, with the number of reached nodes and whether the goal is reachable both ways."""
    got = stage(reachable(arc_rows, starts), "got").hint("merge")
    weak = weakly_reachable(arc_rows, starts)
    has = lambda df, nodes, name: df.join(nodes, ["g", "r", "c"], "left_semi").select("g").distinct().withColumn(name, F.lit(True))
    legal = starts.join(arc_rows, ["g", "r", "c"], "left_semi").select("g").distinct().withColumn("legal", F.lit(True))
    x = starts.select("g").distinct().join(legal, "g", "left").join(has(got, vias, "via"), "g", "left").join(has(got, goals, "goal"), "g", "left").join(has(weak, goals, "weak"), "g", "left")
    x = x.join(vias.select("g").distinct().withColumn("need", F.lit(True)), "g", "left").join(got.groupBy("g").agg(F.count(F.lit(1)).alias("reached")), "g", "left")
    category = F.when(F.col("legal").isNull(), "no_legal_action").when(F.col("need").isNotNull() & F.col("via").isNull(), "via_unreachable").when(F.col("goal").isNull(), "goal_unreachable").otherwise("other")
    return x.select("g", category.alias("category"), F.col("weak").isNotNull().alias("weak_route"), "reached")


def emergency_action(legal: Column, heading: Column) -> Column:
    """The heading if legal, else the lowest legal action, else the heading."""
    return F.when(F.array_contains(legal, heading), heading).otherwise(F.coalesce(F.array_min(legal), heading))


def shortest_path(arc_rows: DataFrame, starts: DataFrame, goals: DataFrame, group_arcs: int = GROUP_ARCS) -> DataFrame:
    """One shortest path per graph to its first goal reached, as (g, step, r, c); of several, goals and predecessors of
    least (r, c). Levels grow until no node is new, in buckets of small graphs and in rounds of joins for large ones."""
    a, buckets, large = _parts(arc_rows, ["g"], group_arcs)
    tables = [a, starts.select("g", "r", "c"), goals.select("g", "r", "c")]
    small, rest = (tables, []) if large is None else (_split(large, ["g"], tables, how) for how in ("left_anti", "left_semi"))
    found = _by_buckets(small[0], small[1:], ["g"], buckets, _walks, ", step int").select("g", "step", "r", "c")
    return found.unionByName(_path_by_rounds(*rest)) if rest else found


def _walks(u, v, nodes, graph, where):
    """Nodes of a shortest path of each graph and their steps, for _by_buckets()."""
    start, goal = nodes
    n, order = len(graph), np.argsort(np.lexsort((where[:, 1], where[:, 0])))
    at, before, k = np.full(n, -1), np.full(n, -1), 0
    at[start] = 0
    sort = np.argsort(order[u], kind="stable")[::-1]  # the least predecessor is set last
    u, v = u[sort], v[sort]
    while True:
        new = (at[u] == k) & (at[v] < 0)
        if not new.any():
            break
        k += 1
        before[v[new]] = u[new]
        at[v[new]] = k
    goal = goal[at[goal] >= 0]
    goal = goal[np.lexsort((order[goal], at[goal]))]
    here = goal[np.unique(graph[goal], return_index=True)[1]]
    path = [here]
    while len(here):
        here = before[here]
        here = here[here >= 0]
        path.append(here)
    path = np.concatenate(path)
    return path, {"step": at[path].astype("int32")}


def _path_by_rounds(arc_rows: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """shortest_path() for graphs of any size.

    A level is written once, as a part of the visited table, and is what the walk back reads for its step."""
    at, seen = ["g", "r", "c"], Grown(arc_rows.sparkSession, "levels")
    ways = stage(arc_rows.select(*at, "r2", "c2"), "arcs")
    level = seen.add(starts.select(*at, F.lit(0).alias("step"), F.lit(None).cast("int").alias("pr"), F.lit(None).cast("int").alias("pc")).dropDuplicates(at))
    while not level.isEmpty():
        step = level.select(*at).hint("merge").join(ways, at).groupBy("g", F.col("r2").alias("r"), F.col("c2").alias("c")).agg(F.min(F.struct("r", "c")).alias("p"))
        new = step.join(seen.table().hint("merge"), at, "left_anti")
        level = seen.add(new.select(*at, F.lit(seen.parts).alias("step"), F.col("p.r").alias("pr"), F.col("p.c").alias("pc")))
    first = Window.partitionBy("g").orderBy("step", "r", "c")
    ends = stage(seen.table().hint("merge").join(goals.select(*at).distinct(), at).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "ends")
    path = Grown(arc_rows.sparkSession, "walk")
    here = path.add(ends.where(F.col("step") == seen.parts - 1))
    for k in range(seen.parts - 2, -1, -1):  # walk back level by level
        before = here.select("g", F.col("pr").alias("r"), F.col("pc").alias("c"))
        here = path.add(seen.part(k).join(before.hint("merge"), at, "left_semi").unionByName(ends.where(F.col("step") == k)))
    unstage(ways, ends, seen.table())
    return path.table().select("g", "step", "r", "c")


def problems(scenes: DataFrame, nodes: DataFrame, edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """V2: (g, problem) for every structural rule that a graph breaks."""
    at = ["g", "r", "c"]
    ends_of = 2 * edges.count()
    deal = lambda df: dealt(df, ends_of, *at)
    on = lambda df: deal(df).join(deal(nodes.select(*at)), at, "left_anti")
    end = lambda side: edges.select("g", F.col(f"{side}r").alias("r"), F.col(f"{side}c").alias("c"))
    ends = [F.struct(F.col(f"{x}r").alias("r"), F.col(f"{x}c").alias("c")) for x in "ab"]
    undirected = edges.select("g", F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    target = F.struct("oneway_r", "oneway_c")
    rules = {
        "grid_size": scenes.where("grid_rows not between 5 and 9 or grid_cols not between 5 and 9"),
        "node_outside": nodes.select(*at).join(scenes.select("g", "grid_rows", "grid_cols"), "g").where("r < 0 or c < 0 or r >= grid_rows or c >= grid_cols"),
        "robot_off_node": on(scenes.select("g", F.col("robot_r").alias("r"), F.col("robot_c").alias("c"))),
        "duplicate_edge": undirected.groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "edge_end_missing": on(end("a").unionByName(end("b"))),
        "not_adjacent": edges.where("abs(ar - br) + abs(ac - bc) <> 1"),
        "oneway_target": edges.where(F.col("oneway_r").isNotNull() & (target != F.struct(F.col("ar").alias("oneway_r"), F.col("ac").alias("oneway_c"))) & (target != F.struct(F.col("br").alias("oneway_r"), F.col("bc").alias("oneway_c")))),
        "landmark_off_node": on(landmarks.select(*at)),
        "landmark_on_robot": landmarks.join(scenes.select("g", F.col("robot_r").alias("r"), F.col("robot_c").alias("c")), at),
    }
    return reduce(DataFrame.unionByName, [df.select("g", F.lit(n).alias("problem")) for n, df in rules.items()]).distinct()
