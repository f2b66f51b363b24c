"""Queries of logs and files: events stand for metric logs (user_id is the run, event_id the order, value the loss)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusgrid.plans.registry import query
from corpusgrid.session import shared_dir
from corpusgrid.sources import files as S
from corpusgrid.streaming import logs as R

LOG_SQL = "WITH l AS (SELECT CASE event_id % 9 WHEN 0 THEN 'warning' WHEN 1 THEN 'progress' ELSE 'epoch' END AS event, user_id AS run, event_id AS seq, round(value % 10, 3) / 10 AS score, round(value % 7, 3) AS loss FROM events) "


def log(t, events=None):
    k = F.col("event_id") % 9
    e = events if events is not None else t.events
    return e.select(F.when(k == 0, "warning").when(k == 1, "progress").otherwise("epoch").alias("event"), F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.round(F.col("value") % 10, 3) / 10).alias("score"), F.round(F.col("value") % 7, 3).alias("loss"))


def streamed(t, made, mode: str):
    """Run `made` over the events as a stream of the files that are there, into a table of the shared folder."""
    spark, place = t.spark, f"{shared_dir(t.spark)}/corpusgrid/stream-{uuid.uuid4().hex}"
    t.events.repartition(4).write.parquet(f"{place}/in")
    source = spark.readStream.schema(t.events.schema).parquet(f"{place}/in")
    out = made(log(t, source))
    schema = out.schema

    def write(df, n):
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/out")

    q = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/out")


TAIL_SQL = LOG_SQL + "SELECT run, arg_max(event, seq) AS last_event, max(seq) FILTER (event = 'epoch') AS last_epoch, count(*) FILTER (event = 'warning') AS warnings, count(*) AS events FROM l GROUP BY run"


@query(TAIL_SQL)
def r1_tail(t):
    return R.tail(log(t))


@query(TAIL_SQL)
def r1_tail_stream(t):
    return streamed(t, R.tail, "complete")


def log_lines(t) -> str:
    """The log as text files of JSON lines, some of them broken or blank: the folder."""
    place = f"{shared_dir(t.spark)}/corpusgrid/lines-{uuid.uuid4().hex}"
    k = F.col("seq") % 50
    line = F.when(k == 7, F.concat(F.lit('{"event": "epoch", "run": '), "seq")).when(k == 8, "").when(k == 9, F.concat(F.lit('{"run": '), "seq", F.lit("}"))).otherwise(F.to_json(F.struct("event", "run", "seq", "score", "loss")))
    log(t).repartition(4).select(line.alias("value")).write.text(place)
    return place


_GOOD, _BAD = "seq % 50 NOT IN (7, 8, 9)", "seq % 50 IN (7, 9)"
LINES_SQL = TAIL_SQL.replace("FROM l GROUP BY run", f"FROM l WHERE {_GOOD} GROUP BY run").replace("AS events FROM", "AS events, 0 AS bad FROM") + f" UNION ALL SELECT NULL, NULL, NULL, 0, 0, count(*) FROM l WHERE {_BAD} HAVING count(*) > 0"


@query(LINES_SQL)
def r1_tail_lines(t):
    return R.tail_lines(t.spark.read.text(log_lines(t)))


@query(LOG_SQL + f"SELECT CASE WHEN {_GOOD} THEN 'events' ELSE 'dead' END AS part, count(*) AS n, sum(seq) AS seqs FROM l WHERE seq % 50 <> 8 GROUP BY 1")
def r1_dead_letters(t):
    """A stream of lines, file by file, into a table of events and one of the lines that could not be read."""
    place = log_lines(t)
    R.route_lines(t.spark.readStream.option("maxFilesPerTrigger", 1).text(place), f"{place}-out", f"{place}-checkpoint")
    seqs = lambda c: F.sum(c.cast("long")).alias("seqs")
    events = t.spark.read.parquet(f"{place}-out/events").agg(F.lit("events").alias("part"), F.count(F.lit(1)).alias("n"), seqs(F.col("seq")))
    dead = t.spark.read.parquet(f"{place}-out/dead").agg(F.lit("dead").alias("part"), F.count(F.lit(1)).alias("n"), seqs(F.regexp_extract("value", r"(\d+)\D*$", 1)))
    return events.unionByName(dead).where("n > 0")


_BETTER = "(e.score >= best + 0.005 OR e.loss <= low - 0.02)"
R2 = LOG_SQL.replace("WITH l AS", "WITH RECURSIVE l AS") + f""", e AS MATERIALIZED (SELECT run, seq, score, loss, row_number() OVER (PARTITION BY run ORDER BY seq) k FROM l WHERE event = 'epoch'),
r AS (SELECT run, k, score best, loss low, 0 stale, 1 n, NULL::BIGINT stop FROM e WHERE k = 1 UNION ALL
SELECT e.run, e.k, greatest(best, e.score), least(low, e.loss), CASE WHEN {_BETTER} THEN 0 ELSE stale + 1 END, n + 1, coalesce(stop, CASE WHEN n + 1 >= 8 AND CASE WHEN {_BETTER} THEN 0 ELSE stale + 1 END >= 3 THEN e.seq END) FROM r JOIN e ON e.run = r.run AND e.k = r.k + 1),
s AS (SELECT run, max(stop) AS stop_epoch FROM r GROUP BY run) SELECT run, stop_epoch FROM s"""


@query(R2)
def r2_plateau(t):
    """Batch form; tests compare it with the stream form and a plain loop."""
    return R.plateau(log(t))


@query(R2 + " WHERE stop_epoch IS NOT NULL")
def r2_plateau_stream(t):
    return streamed(t, R.plateau_stream, "append")


@query(R2.replace("e.seq END) FROM r", "e.k END) FROM r") + " WHERE stop_epoch IS NOT NULL")
def r2_plateau_any_order(t):
    """Epochs of a run are numbered from 1 and dealt over four files, which the stream reads one at a time."""
    from pyspark.sql import Window

    spark, place = t.spark, f"{shared_dir(t.spark)}/corpusgrid/stream-{uuid.uuid4().hex}"
    x = log(t).where("event = 'epoch'").withColumn("seq", F.row_number().over(Window.partitionBy("run").orderBy("seq")).cast("long"))
    x.repartition(4, F.hash("seq")).write.parquet(f"{place}/in")
    out = R.plateau_any_order(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"))
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{place}/out/micro={n}")
    with R.rocks(spark):
        out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{place}/out")


@query(LOG_SQL + """, e AS (SELECT *, coalesce(loss > lag(loss) OVER (PARTITION BY run ORDER BY seq) + 0.025, false) up FROM l WHERE event = 'epoch'), i AS (SELECT *, sum((NOT up)::INT) OVER (PARTITION BY run ORDER BY seq) g FROM e)
SELECT run, seq FROM (SELECT *, sum(up::INT) OVER (PARTITION BY run, g ORDER BY seq) s FROM i) WHERE up AND s = 2""")
def r3_worsening(t):
    return R.worsening(log(t))


@query("SELECT event_id % 40 AS batch_id, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY 1")
def r4_audit_batches(t):
    """Every batch id arrives in two files, so in two micro-batches; the second pass replays all of them and must add nothing."""
    place = f"{shared_dir(t.spark)}/corpusgrid/audit-{uuid.uuid4().hex}"
    t.events.select((F.col("event_id") % 40).alias("batch_id"), "event_id", "value").repartition(4, F.col("event_id") % 40 + F.col("event_id") % 2).write.parquet(f"{place}/in")
    stream = t.spark.readStream.schema("batch_id long, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    audit = lambda df: df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"))
    for attempt in range(2):
        R.audit_batches(stream, f"{place}/out", f"{place}/checkpoint-{attempt}", audit)
    return t.spark.read.parquet(f"{place}/out").groupBy("batch_id").agg(F.sum("n").alias("n"), F.sum("high").alias("high"))


ROBOTS = "o AS (SELECT s_suppkey s, i robot, row_number() OVER (ORDER BY s_suppkey, i) - 1 pos FROM supplier, (SELECT unnest(range(10)) i) WHERE NOT (s_suppkey % 7 = 0 AND i = 9)), l AS (SELECT pos, CASE WHEN pos % 13 > 0 THEN pos % 4 END AS label FROM (SELECT unnest(range((SELECT count(*) + 2 FROM o))) pos))"


def split(t):
    """A split in its source format, a list of observations and a list of labels, written from supplier: the folder.

    Every seventh scene lacks its last robot, every fifth has two missions, every thirteenth label is not valid, and there
    are two labels too many. Both lists are one JSON value by their format, so the table behind them is a small one.
    """
    place, s, i = f"{shared_dir(t.spark)}/corpusgrid/split-{uuid.uuid4().hex}", F.col("s_suppkey"), F.col("i")
    rows = t.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).where(~((s % 7 == 0) & (i == 9)))
    o = rows.select(
        "s_suppkey", "i", F.concat(F.lit("train-"), s, F.lit("-R"), i).alias("id"), i.alias("robot_id"), F.concat(F.lit("img"), (s * 3 + i) % 5, F.lit(".png")).alias("image"),
        F.concat(F.lit("go "), F.when((s % 5 == 0) & (i == 3), "back").otherwise("on")).alias("mission"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "i", "id", "robot_id", "image", "mission"))), lambda x: F.struct(x["id"].alias("id"), x["robot_id"].alias("robot_id"), x["image"].alias("image"), x["mission"].alias("mission")))
    o.agg(F.to_json(listed).alias("value")).write.text(f"{place}/observations")
    n = F.count(F.lit(1)) + 1
    o.agg(F.to_json(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda p: F.when(p % 13 == 0, 7).otherwise(p % 4))).alias("value")).write.text(f"{place}/labels")
    return place


@query("WITH " + ROBOTS + """ SELECT 'train-' || s AS key, 'scene_shape' AS problem FROM (SELECT DISTINCT s FROM o) WHERE s % 7 = 0 OR s % 5 = 0
UNION ALL SELECT l.pos::VARCHAR, CASE WHEN o.pos IS NULL THEN 'no_observation' ELSE 'no_label' END FROM l LEFT JOIN o ON o.pos = l.pos WHERE o.pos IS NULL OR label IS NULL UNION ALL SELECT count(*)::VARCHAR, 'list_length' FROM l HAVING count(*) % 10 <> 0""")
def s1_split_loader(t):
    place = split(t)
    return S.alignment_problems(S.observations(t.spark, f"{place}/observations"), S.labels(t.spark, f"{place}/labels"))


@query("SELECT 'scene-' || s_suppkey AS scene_id, s_suppkey % 4 + 5 AS grid_rows, CASE s_suppkey % 3 WHEN 0 THEN 'rain' ELSE 'dry' END AS weather, s_suppkey % 3 = 0 AS legend_swapped FROM supplier")
def s2_annotations(t):
    place, s = f"{shared_dir(t.spark)}/corpusgrid/scenes-{uuid.uuid4().hex}", F.col("s_suppkey")
    look = F.struct(F.lit("normal").alias("normal"), F.when(s % 3 == 0, "crowded").otherwise("closed").alias("closed"))
    scene = F.struct(F.concat(F.lit("scene-"), s).alias("scene_id"), F.struct((s % 4 + 5).alias("rows"), F.lit(5).alias("cols")).alias("grid"), F.when(s % 3 == 0, "rain").otherwise("dry").alias("weather"), look.alias("road_look"))
    # one file for each scene list of a hundred scenes: a file is one JSON value, what follows it is not read
    t.supplier.groupBy(F.floor(s / 100).alias("part")).agg(F.to_json(F.array_sort(F.collect_list(scene))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(place)
    return S.annotations(t.spark, place).select("scene_id", F.col("grid.rows").cast("long").alias("grid_rows"), "weather", "legend_swapped")


@query("SELECT 'train-' || s_suppkey AS scene_id, 'img' || (s_suppkey * 3) % 5 || '.png' AS image FROM supplier")
def s3_scene_index(t):
    return S.scene_index(S.observations(t.spark, f"{split(t)}/observations"))


@query("WITH " + ROBOTS + " SELECT pos, label FROM l")
def s5_positional_list(t):
    return S.labels(t.spark, f"{split(t)}/labels").select(F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("label"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey * 7 % 4 AS label FROM supplier")
def s11_prediction_sink(t):
    """Predictions written as one list by position, and read again."""
    from corpusgrid.operators.sample import positions

    place = f"{shared_dir(t.spark)}/corpusgrid/predictions-{uuid.uuid4().hex}"
    p = positions(t.supplier.select("s_suppkey"), "s_suppkey").select((F.col("pos") - 1).alias("pos"), (F.col("s_suppkey") * 7 % 4).alias("action"))
    S.write_positional(p.repartition(3), "pos", "action", place, p.count())
    return S.labels(t.spark, place).select(F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("label"))


@query("SELECT 'document' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'P' WHEN doc_id % 3 = 1 THEN 'F' ELSE 'U' END AS status, replace(replace(replace(text, chr(9), ' '), chr(10), ' '), chr(13), ' ') AS reason FROM documents WHERE doc_id // 50 % 2 = 0")
def s6_verdicts(t):
    """Packed lines are read back; every second batch lacks a line and so does not count."""
    d = t.documents.select(F.floor(F.col("doc_id") / 50).alias("batch_id"), F.concat(F.lit("document"), "doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "P").when(F.col("doc_id") % 3 == 1, "F").otherwise("U").alias("status"), "text", "doc_id")
    lines = d.where("batch_id % 2 = 0 or doc_id % 50 <> 7").select("batch_id", F.concat_ws("\t", "id", "status", F.regexp_replace("text", r"[\t\r\n]", " ")).alias("line"))
    return S.verdicts(lines, d.select("batch_id", "id")).select("id", "status", "reason")


@query("SELECT max(t) AS rows, string_agg(lang || '=' || n, ',' ORDER BY lang) AS langs, true AS same_in_any_order, true AS differs_in_a_value FROM (SELECT lang, count(*) n, sum(count(*)) OVER ()::BIGINT t FROM documents GROUP BY lang)")
def s9_manifest(t):
    """The digest is that of the rows in any layout, and another one if one value changes."""
    m = S.manifest(t.documents, "lang")
    text = F.array_join(F.transform(F.map_entries("lang"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    d = t.documents
    again = S.manifest(d.repartition(5, "text")).select(F.col("digest").alias("again"))
    other = S.manifest(d.withColumn("lang", F.when(F.col("doc_id") == d.agg(F.min("doc_id")).first()[0], "xx").otherwise(F.col("lang")))).select(F.col("digest").alias("other"))
    x = m.crossJoin(F.broadcast(again)).crossJoin(F.broadcast(other))  # a row each
    return x.select("rows", text.alias("langs"), (F.col("digest") == F.col("again")).alias("same_in_any_order"), (F.col("digest") != F.col("other")).alias("differs_in_a_value"))


@query("SELECT doc_id, lang, CASE WHEN length(text) < 60 THEN 'review' ELSE 'retained' END AS status, true AS refused FROM documents UNION ALL SELECT NULL, NULL, 'rejected', true")
def s4_s7_s8_round_trip(t):
    """JSONL out and in with a bad line, routed by status, create-only: every row comes back once, and a second write is refused."""
    place = f"{shared_dir(t.spark)}/corpusgrid/jsonl-{uuid.uuid4().hex}"
    t.documents.select("doc_id", "text", "lang").write.json(f"{place}/in")
    t.spark.createDataFrame([("not a line of JSON",)], "value string").write.mode("append").text(f"{place}/in")
    back = S.jsonl(t.spark, f"{place}/in", "doc_id long, text string, lang string")
    routed = back.withColumn("status", F.when(F.col("_corrupt_record").isNotNull(), "rejected").when(F.length("text") < 60, "review").otherwise("retained"))
    S.write_routed(routed, "status", f"{place}/out")
    try:
        S.write_routed(routed.limit(1), "status", f"{place}/out")
        refused = False
    except Exception as error:
        refused = "ALREADY_EXISTS" in str(error)
    return t.spark.read.parquet(f"{place}/out").select("doc_id", "lang", "status", F.lit(refused).alias("refused"))


@query("SELECT doc_id, n_chars, true AS kept_as_it_was FROM documents")
def s10_cached(t):
    """The second call finds the first one's files and writes nothing."""
    place = f"{shared_dir(t.spark)}/corpusgrid/cache-{uuid.uuid4().hex}"
    d = t.documents.select("doc_id", "n_chars")
    first = sorted(S.cached(d, place, "v1").inputFiles())
    second = S.cached(d.repartition(7), place, "v1")
    other = S.cached(d.withColumn("n_chars", F.col("n_chars") + 1), place, "v1")
    same = first == sorted(second.inputFiles()) and not set(first) & set(other.inputFiles())
    return second.withColumn("kept_as_it_was", F.lit(same))


_BUCKET = "(('0x' || md5('0:' || doc_id)[1:15])::BIGINT % 64)::INT"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS rows FROM documents GROUP BY 1 HAVING bool_or(doc_id % 97 = 3)")
def s10_changed_buckets(t):
    """A table stored by buckets and stored again with a few changed rows: the buckets of these, and no others, are written.
    The digests name the same buckets, and what is read back is the changed table."""
    place = f"{shared_dir(t.spark)}/corpusgrid/buckets-{uuid.uuid4().hex}"
    d = t.documents.select("doc_id", "n_chars")
    changed = d.withColumn("n_chars", F.when(F.col("doc_id") % 97 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    S.sync(d, "doc_id", place, "v1", 64)
    stored, written = S.sync(changed.repartition(5), "doc_id", place, "v1", 64)
    named = S.changed_buckets(S.bucket_digests(d, "doc_id", 64), S.bucket_digests(changed, "doc_id", 64))
    same = S.root_digest(S.bucket_digests(stored, "doc_id", 64)).join(F.broadcast(S.root_digest(S.bucket_digests(changed, "doc_id", 64))), ["rows", "root"])  # a row each
    return written.join(named.where("change = 'altered'").select("bucket"), "bucket").join(F.broadcast(same.select(F.lit(True).alias("_same")))).drop("_same")
