"""Tables of the library's own shapes, derived from the driver tables by integer arithmetic that SQL repeats exactly.

One lattice of N x N per supplier: g = s_suppkey. Every derived value is a short formula of g and a position.
"""

from __future__ import annotations

from pyspark.sql import functions as F

N = 5
#: Lattices of a task.
PER_TASK = 2_000
TYPES = ("gate", "library", "canteen", "store")
#: Cost profiles in hundredths: step, crowded, covered, stairs, turn, left_turn, right_turn, u_turn.
PROFILE_COLUMNS = ("step", "crowded", "covered", "stairs", "turn", "left_turn", "right_turn", "u_turn")


def _profile(i: int) -> tuple[int, ...]:
    """Weights of the i-th profile by arithmetic; every arc costs something under each of them."""
    return (100, 25 * (i % 4) ** 3, (i // 4 % 3 - 1) * 30, i * 7 % 5 * 20 - 20, i * 3 % 7 * 10, (i * 5 % 3 - 1) * 10, (i * 11 % 3 - 1) * 10, i % 6 * 25)


#: Unit costs, and 47 profiles by formula.
PROFILES = {"unit": (100, 0, 0, 0, 0, 0, 0, 0)} | {f"p{i:02d}": _profile(i) for i in range(1, 48)}


def graphs(t):
    """Tables of lattices hold many rows a supplier, which the optimizer's estimates leave out: the hint keeps them from being
    broadcast, and so from passing through the driver, as if they were small. Suppliers are dealt out before the rows are made,
    since a small file is one task, whatever it grows to; what is grouped by a lattice needs no further shuffle."""
    g = t.supplier.select(F.col("s_suppkey").alias("g"))
    return g.repartition(t.supplier.count() // PER_TASK + 1, "g").hint("merge")


def _is_node(r, c):
    return (F.col("g") * 11 + F.col(r) * 3 + F.col(c) * 5) % 23 != 0


def nodes(t):
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(N) for c in range(N)]))
    n = graphs(t).select("g", cells.alias("x")).select("g", "x.r", "x.c")
    return n.where(_is_node("r", "c"))


def edges(t):
    pairs = [(r, c, r + dr, c + dc, d) for r in range(N) for c in range(N) for d, (dr, dc) in enumerate(((0, 1), (1, 0))) if r + dr < N and c + dc < N]
    rows = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ar", "ac", "br", "bc", "d"), p)]) for p in pairs]))
    e = graphs(t).select("g", rows.alias("x")).select("g", "x.*").where(_is_node("ar", "ac") & _is_node("br", "bc"))
    k = F.col("g") * 31 + F.col("ar") * 7 + F.col("ac") * 13 + F.col("d") * 5
    status = F.when(k % 10 == 0, "closed").when(k % 10 <= 2, "crowded").when(k % 10 == 3, "covered").otherwise("normal")
    one = (F.col("g") * 13 + F.col("ar") * 5 + F.col("ac") * 3 + F.col("d") * 2) % 8
    to = lambda x: F.when(one == 0, F.col(f"b{x}")).when(one == 1, F.col(f"a{x}"))
    stairs = (F.col("g") * 17 + F.col("ar") * 3 + F.col("ac") * 11 + F.col("d")) % 7 == 0
    return e.select("g", (F.col("ar") * 20 + F.col("ac") * 2 + F.col("d")).alias("ord"), "ar", "ac", "br", "bc", status.alias("status"), stairs.alias("stairs"), to("r").alias("oneway_r"), to("c").alias("oneway_c"))


def scenes(t):
    g = F.col("g")
    return graphs(t).select("g", F.lit(N).alias("grid_rows"), (F.lit(N) - (g % 19 == 0).cast("int")).alias("grid_cols"), (g % N).cast("int").alias("robot_r"), (F.floor(g / N) % N).cast("int").alias("robot_c"), (g % 4).cast("int").alias("heading"))


def landmarks(t):
    ks = F.explode(F.array(*map(F.lit, range(6)))).alias("ord")
    k, g = F.col("ord"), F.col("g")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), ((g + k * k) % 4 + 1).cast("int"))
    return graphs(t).select("g", ks).select("g", "ord", kind.alias("type"), ((g * 3 + k * 2) % N).cast("int").alias("r"), ((g + k * 3 + 1) % N).cast("int").alias("c"))


def goals(t):
    return landmarks(t).where(F.col("type") == F.element_at(F.array(*map(F.lit, TYPES)), (F.col("g") % 4 + 1).cast("int"))).select("g", "r", "c")


def vias(t):
    return landmarks(t).where((F.col("g") % 3 == 0) & (F.col("ord") == 4)).select("g", "r", "c")


def starts(t):
    return scenes(t).select("g", F.col("robot_r").alias("r"), F.col("robot_c").alias("c"), "heading")


#: Profiles of the queries that only show what is done with costs.
FEW = {k: PROFILES[k] for k in ("unit", "p07", "p22")}


def profiles(t, of=None):
    return t.spark.createDataFrame([(k, *v) for k, v in (of or PROFILES).items()], "profile string, " + ", ".join(f"{c} long" for c in PROFILE_COLUMNS))


_T = "['gate', 'library', 'canteen', 'store']"
SQL = f"""WITH RECURSIVE graphs AS (SELECT s_suppkey g FROM supplier), cells AS (SELECT * FROM (SELECT unnest(range({N}))::INT r), (SELECT unnest(range({N}))::INT c)),
nodes AS (SELECT g, r, c FROM graphs, cells WHERE (g * 11 + r * 3 + c * 5) % 23 <> 0),
raw AS (SELECT a.g, a.r ar, a.c ac, b.r br, b.c bc, CASE WHEN a.r = b.r THEN 0 ELSE 1 END d FROM nodes a JOIN nodes b ON a.g = b.g AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1))),
edges AS (SELECT g, ar, ac, br, bc, CASE WHEN k = 0 THEN 'closed' WHEN k <= 2 THEN 'crowded' WHEN k = 3 THEN 'covered' ELSE 'normal' END status, (g * 17 + ar * 3 + ac * 11 + d) % 7 = 0 stairs,
  CASE o WHEN 0 THEN br WHEN 1 THEN ar END oneway_r, CASE o WHEN 0 THEN bc WHEN 1 THEN ac END oneway_c
  FROM (SELECT *, (g * 31 + ar * 7 + ac * 13 + d * 5) % 10 k, (g * 13 + ar * 5 + ac * 3 + d * 2) % 8 o FROM raw)),
scenes AS (SELECT g, {N} grid_rows, {N} - (g % 19 = 0)::INT grid_cols, g % {N} robot_r, (g // {N}) % {N} robot_c, g % 4 heading FROM graphs),
landmarks AS (SELECT g, k ord, {_T}[(g + k * k) % 4 + 1] AS type, (g * 3 + k * 2) % {N} r, (g + k * 3 + 1) % {N} c FROM graphs, (SELECT unnest(range(6)) k)),
goals AS (SELECT DISTINCT g, r, c FROM landmarks WHERE type = {_T}[g % 4 + 1]), vias AS (SELECT g, r, c FROM landmarks WHERE g % 3 = 0 AND ord = 4),
ways AS (SELECT g, ar r, ac c, br r2, bc c2, status, stairs, oneway_r o1, oneway_c o2 FROM edges UNION ALL SELECT g, br, bc, ar, ac, status, stairs, oneway_r, oneway_c FROM edges),
legs AS (SELECT g, r, c, r2, c2, status, stairs, CASE WHEN r2 < r THEN 0 WHEN r2 > r THEN 1 WHEN c2 < c THEN 2 ELSE 3 END action FROM ways WHERE status <> 'closed' AND (o1 IS NULL OR (o1 = r2 AND o2 = c2))),
arcs AS (SELECT * FROM legs WHERE NOT stairs)"""
