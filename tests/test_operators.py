"""Operators whose results have no SQL twin, and cases with known answers."""

import json
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusgrid.components import components
from corpusgrid.functions import augment as U
from corpusgrid.functions import expr as T
from corpusgrid.operators import dedup as D
from corpusgrid.operators import ensemble as E
from corpusgrid.operators import features as P
from corpusgrid.operators import lexicon as L
from corpusgrid.operators import metrics as A
from corpusgrid.operators import sample as M
from corpusgrid.sources import files as S
from corpusgrid.streaming import logs as R


def test_labelled_duplicates(spark):
    df = spark.createDataFrame([(1, "A b", 1), (2, "a  B", 1), (3, "a b", 0), (4, "x", None), (5, "X", None)], "id int, text string, l int")
    got = {(r["id"], r["rule"]) for r in D.labelled_duplicates(df, T.squash(F.col("text")), F.struct("l"), "id").collect()}
    assert got == {(2, "duplicate_text"), (3, "duplicate_text_conflicting_labels"), (5, "duplicate_text")}


def test_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, pos int")
    assert {(r["pos"], r["problem"]) for r in D.id_problems(df, "k", "pos").collect()} == {(2, "duplicate_id"), (3, "missing_id")}


def test_mcnemar(spark):
    df = spark.createDataFrame([(0, 0), (10, 0), (5, 5)], "b int, c int")
    got = [r["p"] for r in df.select(A.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got == pytest.approx([1.0, 2 * 2**-10, 1.0])


def test_score_bound(spark):
    df = spark.range(100).withColumn("c", F.col("id") < 10)
    bound = lambda d, k: [r["bound"] for r in A.score_bound(d, F.floor(F.col("id") / 10), F.col("c"), k, 60.0).collect()]
    assert bound(df, 10) == [10.0] and bound(df, 1) == [100.0] and bound(df, 0) == [] and bound(df, 11) == []
    two = spark.range(30).withColumn("c", (F.col("id") < 8) | F.col("id").isin(10, 11))
    assert bound(two, 2) == [50.0]


def test_fair_schedule():
    w = {"a": 42, "b": 18, "c": 15, "d": 12, "e": 9, "f": 4}
    plan = M.fair_schedule(w)
    assert {r: sum(x[1] == r for x in plan) for r in w} == w
    for k in range(1, 101):  # never far from the fair share
        for r in w:
            assert abs(sum(x[1] == r for x in plan[:k]) - k * w[r] / 100) < 2


def test_quotas_with_ties(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "stratum string, w double")
    assert {r["stratum"]: r["quota"] for r in M.largest_remainder(w, "w", 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_components(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 3), (None, 1)], "a int, b int")
    assert {tuple(r) for r in components(df).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)}
    assert components(df.limit(0)).count() == 0
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(chain).collect()} == {0}


def test_quantile_flavours(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 10)], "g int, v double")
    got = A.quantiles(df, "g", "v").first()
    assert (got["median"], got["lower_index"], got["upper_index"]) == (2.5, 3.0, 10.0) and got["linear"] == pytest.approx(7.9)


def test_one_edit(spark):
    pairs = [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "abcd"), ("abc", "axc"), ("abc", "cba"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(T.within_one_edit(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, True, False, False]


def test_alias_swap_keeps_blocked_phrases(spark):
    df = spark.range(40).withColumn("x", F.lit("a big red box, red door"))
    al = {"colour": ["red", "blue"], "size": ["big", "large"]}
    got = [r[0] for r in df.select(U.alias_swap(F.col("x"), al, F.col("id"), 1.0, ["red box"])).collect()]
    assert all("red box" in x for x in got) and {x.split()[-2] for x in got} == {"red", "blue"} and {x.split()[1] for x in got} == {"big", "large"}


def test_dropout_only_takes_optional_clauses(spark):
    df = spark.range(50).withColumn("s", F.array(F.lit("go"), F.lit("not here"), F.lit("take it")))
    got = [r[0] for r in df.select(U.drop_and_reorder(F.col("s"), "not", 0.5, F.col("id"))).collect()]
    assert all({"go", "take it"} <= set(x) for x in got) and {len(x) for x in got} == {2, 3}


def corrected(spark, counts, bigrams, *rows):
    v = spark.createDataFrame(list(counts.items()), "w string, n long")
    p = spark.createDataFrame([(*k.split(), n) for k, n in bigrams.items()], "a string, b string, n long")
    said = spark.createDataFrame([(i, j, w) for i, text in enumerate(rows) for j, w in enumerate(text.split())], "row int, pos int, w string")
    got = {(r["row"], r["pos"]): r["fixed"] for r in L.correct(said, v, p, "row").collect()}
    return [" ".join(got[i, j] for j in range(len(text.split()))) for i, text in enumerate(rows)]


def test_correction_uses_neighbours(spark):
    counts, bigrams = {"red": 50, "read": 80, "box": 60, "bring": 40}, {"red box": 30, "bring red": 9}
    assert corrected(spark, counts, bigrams, "brnig rd bxo", "rd", "") == ["bring red box", "red", ""]


def test_correction_of_known_words(spark):
    counts = {"the": 90, "form": 70, "from": 60, "run": 50, "is": 9, "si": 9}
    bigrams = {"the from": 50, "from run": 3, "is si": 50}
    # one side with ten is enough, if no side has more than a tenth for the present word; what is no word is no side
    assert corrected(spark, counts, bigrams, "the form run", "the form 7", "form", "the form is", "is is") == ["the from run", "the from 7", "form", "the from is", "is is"]
    assert corrected(spark, counts, bigrams | {"form run": 1}, "the form run", "7 form run") == ["the form run", "7 form run"]


def test_correction_candidates_are_lost_letters_and_swaps(spark):
    counts = {"cat": 90, "cast": 5, "act": 5}
    assert corrected(spark, counts, {}, "cst", "zat", "catt", "ct", "c", "c7t") == ["cast", "zat", "catt", "cat", "c", "c7t"]
    assert corrected(spark, {"abc": 5, "abd": 5, "dab": 5}, {}, "ab")[0] == "dab"  # the greater word of equals


def test_correction_goes_from_left_to_right(spark):
    # the first word decides the second by its corrected form; the right neighbour counts as it is written
    counts, bigrams = {"big": 9, "bag": 9, "cut": 9, "cat": 9}, {"big cat": 40, "bag cut": 50, "bag ct": 7}
    assert corrected(spark, counts, bigrams, "bg ct", "big ct", "bag ct") == ["bag cut", "big cat", "bag cut"]


def test_correction_by_hand(spark):
    rng = random.Random(3)
    counts = {w: rng.randrange(8, 40) for w in {"".join(rng.choices("abc", k=rng.randrange(2, 5))) for _ in range(60)}}
    bigrams = {f"{a} {b}": rng.choice([1, 3, 12, 40, 150]) for a in counts for b in counts if rng.random() < 0.2}
    texts = [" ".join("".join(rng.choices("abc7", [9, 9, 9, 1], k=rng.randrange(1, 5))) for _ in range(30)) for _ in range(40)]
    support, want = lambda a, b: bigrams.get(f"{a} {b}", 0), []
    for text in texts:
        words, done = text.split(), []
        for i, w in enumerate(words):
            left, right = done[-1] if done else "", words[i + 1] if i + 1 < len(words) else ""
            near = {c for c in counts if c != w and (w in {c[:j] + c[j + 1 :] for j in range(len(c))} or c in {w[:j] + w[j + 1] + w[j] + w[j + 2 :] for j in range(len(w) - 1)})}
            new = w
            if near and len(w) > 1 and w.isalpha():
                best = max(near, key=lambda c: (support(left, c) + support(c, right), counts[c], c))
                good = [(support(left, best), support(left, w))] * left.isalpha() + [(support(best, right), support(w, right))] * right.isalpha()
                if w not in counts or len(w) > 2 and any(x >= 10 for x, _ in good) and all(x >= 10 * y for x, y in good):
                    new = best
            done.append(new)
        want.append(" ".join(done))
    assert corrected(spark, counts, bigrams, *texts) == want and want != texts


def test_draws_of_large_and_text_ids(spark):
    big = spark.range(5_000_000_000, 5_000_000_400).withColumnRenamed("id", "k")
    got = [r["k"] for r in M.exact_sample(big, "k", 40).collect()]
    assert len(set(got)) == 40 and got != [r["k"] for r in M.exact_sample(big, "k", 40, seed=1).collect()]
    text = big.select(F.concat(F.lit("id"), "k").alias("k"), (F.col("k") % 3).alias("s"))
    assert M.exact_sample(text, "k", 7).count() == 7 and {r["fold"] for r in M.folds(text, "k", "s").collect()} == set(range(5))


def test_numbers_and_sums_within_keys(spark):
    df = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 2 else f"k{i % 3}", i) for i in range(200)], "k string, v int").repartition(5)
    want, got = {}, {(r["k"], r["v"]): r["n"] for r in M.numbered(df, ["k"], "v").collect()}
    sums, upto = {}, {(r["k"], r["v"]): r["upto"] for r in M.running_sum(df, ["k"], "v", "v").collect()}
    for i in range(200):
        k = None if i % 7 == 0 else "hot" if i % 2 else f"k{i % 3}"
        want[k], sums[k] = want.get(k, 0) + 1, sums.get(k, 0) + i
        assert (got[k, i], upto[k, i]) == (want[k], sums[k])


def test_stress_is_reproducible(spark):
    df = spark.createDataFrame([(1, "Lấy gói hàng, nhanh!")], "id int, text string")
    a, b = (sorted(map(tuple, U.stress_variants(df, "id", "text").collect())) for _ in range(2))
    assert a == b and dict((x[1], x[2]) for x in a)["plain"] == "lấy gói hàng nhanh" and dict((x[1], x[2]) for x in a)["no_accents"] == "lay goi hang, nhanh!"


def test_log_lines(spark, tmp_path):
    lines = ['{"event": "epoch", "run": 1, "seq": 2, "loss": 0.5}', '{"event": "warning", "run": 1, "seq": 3}', '{"event": "epo', "[1]", "7", "", "  ", '{"run": 1}', '{"event": "epoch", "run": 1, "seq": "x"}', '{"event": "epoch", "run": 2, "seq": 1, "more": {"a": 1}}']
    (tmp_path / "a.log").write_text("\n".join(lines))
    text = spark.read.text(str(tmp_path / "a.log"))
    bad = {r["value"] for r in R.parsed(text).where("bad").collect()}
    assert {'{"event": "epo', "[1]", "7", '{"run": 1}'} <= bad and len(bad) == 5
    got = {r["run"]: (r["last_event"], r["last_epoch"], r["warnings"], r["events"], r["bad"]) for r in R.tail_lines(text).collect()}
    assert got == {1: ("warning", 2, 1, 2, 0), 2: ("epoch", 1, 0, 1, 0), None: (None, None, 0, 0, 5)}


def test_plateau_in_any_order(spark, tmp_path):
    """Whatever the order, and with repeats, the stream stops where the batch does; a lost epoch holds its run up."""
    rng = random.Random(4)
    rows = [("epoch", run, i, float(rng.randrange(5)) / 10, float(rng.randrange(5))) for run in range(6) for i in range(1, 30) if (run, i) != (5, 3)]
    want = {r["run"]: r["stop_epoch"] for r in R.plateau(spark.createDataFrame(rows, R.LOG)).where("stop_epoch is not null").collect()}
    dealt = rows + rng.sample(rows, 20)
    rng.shuffle(dealt)
    for i in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("event", "run", "seq", "score", "loss"), r))) for r in dealt[i::5]))
    def stops(wait, seconds, **trigger):
        found, place = [], f"{tmp_path}/out-{wait}"
        out = R.plateau_any_order(spark.readStream.schema(R.LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), wait)
        with R.rocks(spark):
            q = out.writeStream.foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", f"{place}-checkpoint").trigger(**trigger).start()
        for _ in range(seconds):
            if q.awaitTermination(1) or 5 in {r["run"] for r in found}:
                break
        q.stop()
        got = [(r["run"], r["stop_epoch"]) for r in found]
        assert len(got) == len(dict(got))
        return dict(got)

    assert 5 in want and stops(None, 90, availableNow=True) == {r: e for r, e in want.items() if r != 5}
    assert stops(20_000, 90, processingTime="1 second") == want  # by then all files are read, and only the lost epoch is missing


def test_plateau_batch_equals_stream_and_loop(spark, tmp_path):
    rows = [("epoch", run, seq, 0.5 + min(seq, 3 + run) * 0.01, 1.0 - min(seq, 3 + run) * 0.03) for run in range(4) for seq in range(1, 15)]
    df = spark.createDataFrame(rows, R.LOG)
    batch = {r["run"]: r["stop_epoch"] for r in R.plateau(df).collect()}
    state, want = {}, {}
    for _, run, seq, score, loss in rows:
        state[run], stop = R._advance(state.get(run, (None, None, 0, 0)), score, loss, 0.005, 0.02, 8, 3)
        if stop:
            want.setdefault(run, seq)
    assert batch == want
    for k in range(3):
        df.where((F.col("seq") > 5 * k) & (F.col("seq") <= 5 * k + 5)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = R.plateau_stream(spark.readStream.schema(R.LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("stops").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["run"]: r["stop_epoch"] for r in spark.table("stops").collect()} == want


def test_json_sources(spark, tmp_path):
    obs = [{"id": f"test-1-R{i}", "robot_id": i, "image": "a.png", "mission": "go"} for i in range(10)]
    (tmp_path / "obs.json").write_text(json.dumps(obs))
    (tmp_path / "labels.json").write_text("[0, 1, 2, 3, 0, 1, 2, 3, 0, 7]")
    o, l = S.observations(spark, str(tmp_path / "obs.json")), S.labels(spark, str(tmp_path / "labels.json"))
    assert o.count() == 10 and S.scene_index(o).first()["image"] == "a.png" and o.first()["scene_id"] == "test-1"
    assert [tuple(r) for r in S.alignment_problems(o, l).collect()] == [("9", "no_label")]
    (tmp_path / "c.jsonl").write_text('{"id": "a", "text": "x"}\nnot json\n')
    assert [(r["_corrupt_record"], r["line"]) for r in S.jsonl(spark, str(tmp_path / "c.jsonl")).orderBy("id").collect()] == [("not json", 2), (None, 1)]
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError):
        S.jsonl(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "s.json").write_text(json.dumps([{"scene_id": "s", "road_look": {"normal": "closed"}}]))
    assert S.annotations(spark, str(tmp_path / "s.json")).first()["legend_swapped"]
    S.write_positional(l.where("label is not null"), "pos", "label", str(tmp_path / "out"), 9)
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == [0, 1, 2, 3, 0, 1, 2, 3, 0]
    with pytest.raises(ValueError):
        S.write_positional(l, "pos", "label", str(tmp_path / "out2"), 11)


def test_coordinate_search(spark):
    score = lambda p: p.select("profile", (-F.abs(F.col("a") - 3) - F.abs(F.col("b") - 1)).cast("double").alias("score"))
    best, value = E.coordinate_search(spark, {"a": 0, "b": 0}, {"a": [1, 3, 5], "b": [1, 2]}, score)
    assert best == {"a": 3, "b": 1} and value == 0


def test_fold_of_every_script(spark):
    texts = ["Ärger Đã ĐẾN", "한국어 각 힣 가", "がぎぐ パピプ ガ", "ΆΈ ё й", "ক\u09cb ொ", "\uf900 ½ ﬁ", "ASCII only", "", None, "ñ" * 1000 + "글"]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r[0] for r in df.orderBy("i").select(T.fold(F.col("text"))).collect()] == want


def test_neighbours_by_hand(spark):
    """Spread, clustered, equal and lone points; ties go to the lower key."""
    rng = random.Random(7)
    groups = {
        "even": [(i % 6 * 10.0, i // 6 * 10.0) for i in range(36)], "far": [(rng.random(), rng.random()) for _ in range(30)] + [(1000.0, 1000.0), (1000.5, 1000.0), (-500.0, 3.0)],
        "equal": [(1.0, 1.0)] * 5, "lone": [(3.0, 4.0)], "pair": [(0.0, 0.0), (5.0, 0.0)], "line": [(float(2**i), 0.0) for i in range(12)],
    }
    rows = [(g, k, *p) for g, ps in groups.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double").repartition(3)
    for n in (1, 2, 4):
        want = set()
        for g, ps in groups.items():
            for k, (x, y) in enumerate(ps):
                near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, (a, b) in enumerate(ps) if j != k)[:n]
                want |= {(g, k, j, r) for r, (_, j) in enumerate(near, 1)}
        got = [(r["g"], r["k"], r["k2"], r["rank"]) for r in P.neighbours(df, ["g"], "k", n).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_staging_leaves_nothing_behind(spark):
    from urllib.parse import urlparse

    from corpusgrid.operators import graph as G
    from corpusgrid.session import shared_dir, staging

    arcs = spark.createDataFrame([(g, i, 0, i + 1, 0) for g in range(3) for i in range(5)], "g int, r int, c int, r2 int, c2 int")
    start, goal = spark.createDataFrame([(g, 0, 0) for g in range(3)], "g int, r int, c int"), spark.createDataFrame([(g, 4, 0) for g in range(3)], "g int, r int, c int")
    place = os.path.join(urlparse(shared_dir(spark)).path, "corpusgrid")
    folders = lambda: set(os.listdir(place)) if os.path.isdir(place) else set()
    before = folders()
    with staging(spark):
        assert G.reachable(arcs, start).count() == 18 and G.shortest_path(arcs, start, goal).count() == 15
        assert len(folders() - before) == 2  # what the two lazy results read
    assert folders() == before


def test_stored_buckets(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "none"), (7, "v7")], "k long, v string")
    stored, written = S.sync(df, "k", str(tmp_path), "a", 16)
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(stored) == rows(df) and written.count() == 16
    assert S.sync(df.repartition(4, "v"), "k", str(tmp_path), "a", 16)[1].count() == 0
    less = df.where("k <> 7 and k is not null")
    stored, written = S.sync(less, "k", str(tmp_path), "a", 16)
    assert rows(stored) == rows(less) and written.count() == 2
    changed = S.changed_buckets(S.bucket_digests(df, "k", 16), S.bucket_digests(less, "k", 16))
    assert {r["bucket"] for r in changed.where("change = 'altered'").collect()} == {r["bucket"] for r in written.collect()}
    assert {r["change"] for r in S.changed_buckets(S.bucket_digests(df, "k", 16), S.bucket_digests(df.limit(0), "k", 16)).collect()} == {"removed"}
    assert rows(S.sync(df, "k", str(tmp_path), "a", 16)[0]) == rows(df)
    roots = [S.root_digest(S.bucket_digests(x, "k", 16)).first()["root"] for x in (df, df.repartition(3), less, df.limit(0))]
    assert roots[0] == roots[1] and len(set(roots)) == 3
    assert S.sync(df.limit(0), "k", str(tmp_path), "empty")[0].count() == 0
