"""Queries on tables larger than those of the other tests: what is bounded, dealt out and read in whole."""

import oracle
from pyspark.sql import functions as F

from corpusgrid.plans import registry


def same_as_sql(spark, name, folder="/root/testdata/sf0.1"):
    return oracle.compare(spark, folder, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_scene_list_is_read(spark):
    """Eleven lists, more than there are shuffle partitions."""
    assert same_as_sql(spark, "s2_annotations") == ""


def lattice(spark):
    from corpusgrid.plans import fixtures as X

    t = registry.Tables(spark, "/root/testdata/sf0.01")
    from corpusgrid.operators import graph as G

    return G, G.arcs(X.edges(t)), X.starts(t), X.vias(t), X.goals(t)


def test_searches_by_buckets_and_by_rounds_agree(spark, monkeypatch):
    G, arcs, starts, vias, goals = lattice(spark)
    monkeypatch.setattr(G, "BUCKET_ARCS", 700)  # several buckets, and graphs on both sides of 60 arcs
    rows = lambda df: sorted(map(tuple, df.collect()))
    for of in (lambda n: G.reachable(arcs, starts, group_arcs=n), lambda n: G.mission_reachable(arcs, starts, vias, goals, group_arcs=n), lambda n: G.shortest_path(arcs, starts, goals, group_arcs=n)):
        small = rows(of(20_000))
        assert len(small) > 50 and small == rows(of(60)) and len(set(small)) == len(small)


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    """A round is a job of all graphs that passes through the driver; small graphs are searched without any."""
    G, arcs, starts, vias, goals = lattice(spark)

    def refuse(*a):
        raise AssertionError("a round")

    monkeypatch.setattr(G, "Grown", refuse)
    assert G.reachable(arcs, starts).count() and G.mission_reachable(arcs, starts, vias, goals).count() and G.shortest_path(arcs, starts, goals).count()


def test_lattices_are_not_broadcast(spark):
    from corpusgrid.operators import graph as G
    from corpusgrid.plans import fixtures as X

    t = registry.Tables(spark, "/root/testdata/sf0.001")
    arcs = G.arcs(X.edges(t))
    for df in (X.edges(t), X.starts(t).join(arcs.select("g", "r", "c").distinct(), ["g", "r", "c"]), G.relaxations(X.edges(t), X.nodes(t), X.scenes(t), X.starts(t)), arcs.join(X.starts(t), ["g", "r", "c"]), X.nodes(t).join(X.landmarks(t), ["g", "r", "c"])):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_by_group_and_by_cells_agree(spark, monkeypatch):
    from corpusgrid.operators import features as P
    from corpusgrid.plans.scenes import points

    p = points(registry.Tables(spark, "/root/testdata/sf0.01"))
    p = p.where("g % 10 < 3 and (g % 2 = 0 or k % 3 > 0)")  # groups of different sizes
    rows = lambda df: sorted(map(tuple, df.collect()))
    inside = P.neighbours(p, ["g"], "k", 2)
    assert "SortMergeJoin" not in (plan := inside._jdf.queryExecution().executedPlan().toString()) and "Window" not in plan  # no pair is a row
    want = rows(inside)
    monkeypatch.setattr(P, "GROUP_POINTS", 20)  # some groups larger
    assert len(want) > 500 and want == rows(P.neighbours(p, ["g"], "k", 2))


def test_rows_of_models_are_shuffled_once(spark):
    """Lines are dealt out before they become twelve rows, and no later step deals those rows again."""
    for name in ("e1_soft_vote", "e12_soft_labels", "e9_assignment"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan, name
        assert same_as_sql(spark, name, "/root/testdata/sf0.01") == ""


def test_pairs_of_a_text_are_made_in_its_row(spark):
    from corpusgrid.operators import lexicon as L

    d = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, []), (4, None), (5, ["b", "a", "c"])], "row int, ws array<string>")
    words, kept = d.selectExpr("row", "posexplode(ws) as (pos, w)"), spark.createDataFrame([("a",), ("b",)], "w string")
    found = L.text_bigrams(d, kept, "ws", 1)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, L.bigrams(words, kept, "row", 1).collect())) == [("a", "b", 2), ("b", "a", 2)]


def test_sets_are_matched_in_one_shuffle(spark):
    from corpusgrid.operators import metrics as A

    s = "g int, k int"
    m = A.set_match(spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 5), (3, None)], s), spark.createDataFrame([(1, 1), (1, 2), (2, 6), (3, None), (4, 1)], s), ["k"], "g")
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(tuple, m.collect())) == [(1, True, 2, 2, 2), (2, False, 0, 1, 1), (3, False, 0, 1, 1), (4, False, 0, 0, 1)]


def test_routes_of_many_graphs_are_searched_in_one_call(spark, monkeypatch):
    """Graphs are no groups of their own; buckets and blocks of profiles give what rounds of joins give."""
    G, arcs, starts, vias, goals = lattice(spark)
    from corpusgrid.plans import fixtures as X

    monkeypatch.setattr(G, "ROUTE_ARCS", 700)
    monkeypatch.setattr(G, "TOGETHER_PROFILES", 2)
    few = X.profiles(registry.Tables(spark, "/root/testdata/sf0.01"), X.FEW)
    named = lambda df: df.withColumn("g", F.when(F.col("g") != 7, F.concat(F.lit("g"), "g")))
    args = [x.where("g < 12") for x in (arcs, starts, vias, goals)]
    rows = lambda costs: sorted(map(tuple, costs.select("g", "profile", "action", "cost").collect()), key=str)
    costs = G.route_costs(args[0], few, *args[1:])
    grouped = [x for x in costs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FlatMapGroups" in x]
    assert len(grouped) == 1 and "_bucket" in grouped[0]
    want = rows(G.route_costs(args[0], few, *args[1:], group_arcs=0))
    assert len(want) > 50 and rows(costs) == want
    search = G.RouteSearch(*map(named, args), staged=True)  # ids of another type, one of them null
    assert rows(search.costs(few)) == sorted(((None if g == 7 else f"g{g}", *x) for g, *x in want), key=str)
    assert rows(search.costs(few.where("profile = 'unit'"))) == [x for x in rows(search.costs(few)) if x[1] == "unit"]
    assert search.costs(few.limit(0)).count() == 0 and G.route_costs(args[0], few, args[1].limit(0), *args[2:]).count() == 0


def test_grammar_reads_a_clause_once(spark):
    """No step of the grammar is written out again by the steps that use it; results are those of SQL."""
    mentions = registry.QUERIES["l7_roles"](spark, "/root/testdata/sf0.01")
    plan = mentions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("dr lee|") <= 3 and plan.count(r"\p{Mn}") == 1
    assert all(same_as_sql(spark, name, "/root/testdata/sf0.01") == "" for name in ("l7_roles", "l8_final_pick", "l9_parse_job"))


def test_early_epochs_are_kept_by_chunks():
    """State is asked once for all epochs of a chunk that arrive together, not once an epoch."""
    from corpusgrid.streaming import logs as R

    class State(dict):
        calls = 0

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    class Progress:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    import pandas as pd

    of = lambda seqs: iter([pd.DataFrame({"seq": seqs, "score": [0.5] * len(seqs), "loss": [1.0] * len(seqs)})])
    p = R.PlateauProcessor(None, gain=0.005, drop=0.02, least=8, patience=3)
    p.early, p.progress, found = State(), Progress(), []
    for seqs in (list(range(2, 1000, 2)), [1], list(range(3, 1000, 2)), [5, 6], [1001]):
        found += [int(x["stop_epoch"].iloc[0]) for x in p.handleInputRows((1,), of(seqs), None)]
    assert found == [8] and p.progress.held[0] == 1000 and list(p.early) == [(1001 // 256,)] and p.early.calls < 60


def test_lattices_are_dealt_out_before_their_rows_are_made(spark, monkeypatch):
    """a small file of suppliers is one task, in which all edges of all lattices would be grouped."""
    from corpusgrid.plans import fixtures as X
    from corpusgrid.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(X, "PER_TASK", 10)
    n = t.supplier.count()
    for make in (X.nodes, X.edges, X.scenes, X.landmarks):
        sizes = [r["n"] for r in make(t).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("g").alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) <= 30
