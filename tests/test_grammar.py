"""Mention grammar on hand-made texts, down to the place on a map."""

import pytest
from pyspark.sql import functions as F

from corpusgrid.functions import expr as T
from corpusgrid.operators import grammar as N
from corpusgrid.operators.resolve import resolve_targets
from corpusgrid.plans.lexicons import GRAMMAR


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row int, text string")
    clauses = df.select("row", F.posexplode(T.clauses(F.col("text"), ["then"])).alias("clause", "text"))
    out = {}
    for r in N.mention_roles(clauses, GRAMMAR, "row").orderBy("row", "clause", "at").collect():
        out.setdefault(r["row"], []).append((r["type"] or r["kind"], r["role"], r["ref"], r["anchor"]))
    return [out.get(i, []) for i in range(len(texts))]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Go via the gate, bring it to the library", [("gate", "goal", None, None), ("library", "goal", None, None)]),  # an article stands between
        ("go via gate and to library", [("gate", "via", None, None), ("library", "goal", None, None)]),
        ("store first, to library", [("store", "via", None, None), ("library", "goal", None, None)]),
        ("store, first to library", [("store", "goal", None, None), ("library", "goal", None, None)]),  # the cue must stand before the comma
        ("store is closed, gate is done first", [("store", "negated", None, None), ("gate", "negated", None, None)]),
        ("never to gate but library", [("gate", "negated", None, None), ("library", "goal", None, None)]),
        ("to library in the north", [("library", "goal", "north", None)]),
        ("to library near gate", [("library", "goal", "near", "gate")]),
        ("to library, far from main gate", [("library", "goal", "far", "gate")]),
        ("to library near gate of all", [("library", "goal", None, None), ("gate", "goal", None, None)]),  # a superlative follows
        ("to the place furthest north", [("north_most", "goal", "north_most", None)]),
        ("skip building next to gate most days of all", [("anchor_near", "negated", "anchor_near", "gate")]),
        ("to building next to gate", [("gate", "goal", None, None)]),
        ("via dr lee then the spot where we eat", [("office", "via", None, None), ("canteen", "goal", None, None)]),
        ("the spot where we do not eat", []),
        ("parcel", []),
        ("via parcel gate", [("gate", "goal", None, None)]),
        ("@0 #north_most gate", [("gate", "goal", None, None)]),
        ("GATE; Gâte", [("gate", "goal", None, None), ("gate", "goal", None, None)]),
        ("", []),
    ],
)
def test_roles(spark, text, want):
    assert parsed(spark, text) == [want]


def test_pick_prefers_places_and_the_last(spark):
    texts = ["gate then dr lee", "dr lee", "gate then store then via gate", "via gate then gate", "via gate then gate in the north", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row int, text string")
    clauses = df.select("row", F.posexplode(T.clauses(F.col("text"), ["then"])).alias("clause", "text"))
    got = {r["row"]: (r["goal"], r["goal_ref"], r["via"]) for r in N.parse_job(clauses, df.select("row"), GRAMMAR, "row").collect()}
    assert got == {0: ("gate", None, None), 1: ("office", None, None), 2: ("store", None, "gate"), 3: ("gate", None, None), 4: ("gate", "north", "gate"), 5: (None, None, None)}


def test_refs_find_their_place_on_the_map(spark):
    marks = [("gate", 0, 5, 5), ("store", 1, 4, 5), ("store", 2, 0, 9), ("library", 3, 9, 0)]
    texts = ["to store near gate", "to store far from gate", "to place furthest north", "to building next to library of all", "to store", "to store in the north", "to canteen"]
    lm = spark.createDataFrame([(g, *m) for g in range(len(texts)) for m in marks], "g int, type string, ord int, r int, c int")
    df = spark.createDataFrame(list(enumerate(texts)), "row int, text string")
    job = N.parse_job(df.withColumn("clause", F.lit(0)), df.select("row"), GRAMMAR, "row")
    got = {r["g"]: (r["r"], r["c"]) for r in resolve_targets(N.target_specs(job, "row"), lm).collect()}
    assert got == {0: (4, 5), 1: (0, 9), 2: (0, 9), 3: (5, 5), 4: (4, 5), 5: (0, 9)}
