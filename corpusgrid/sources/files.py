"""Sources and sinks (S1-S11). Order is always a column: files have no order once they are distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusgrid.operators.contracts import group_shape
from corpusgrid.operators.sample import coin, numbered
from corpusgrid.session import broadcast_if_small, stage

OBSERVATION = "id string, robot_id int, image string, mission string"
SCENE = (
    "scene_id string, grid struct<rows:int,cols:int>, nodes array<struct<rc:array<int>,xy:array<double>>>, "
    "edges array<struct<a:array<int>,b:array<int>,status:string,stairs:boolean,oneway_to:array<int>>>, landmarks array<struct<type:string,rc:array<int>>>, "
    "robot struct<rc:array<int>,heading:string>, weather string, road_look map<string,string>"
)
CORPUS = "id string, text string, goal struct<type:string,ref:string,anchor:string>, via struct<type:string,ref:string,anchor:string>, urgent boolean, fragile boolean"


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON list with their position from 0 and their scene."""
    whole = spark.read.text(path, wholetext=True)
    x = whole.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(':'.join(c.split(' ')) for c in OBSERVATION.split(', '))}>>")).alias("pos", "o"))
    return x.select("pos", "o.*", F.regexp_extract("o.id", r"(.*)-R\d+$", 1).alias("scene_id"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(pos, label) of a JSON list of integers 0..3; other values come as a null label."""
    whole = spark.read.text(path, wholetext=True)
    x = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "v"))
    return x.select("pos", F.when(F.col("v").rlike("^[0-3]$"), F.col("v").cast("int")).alias("label"))


def alignment_problems(obs: DataFrame, label_rows: DataFrame, robots: int = 10) -> DataFrame:
    """Scenes that are not robots 0..9 with one mission, positions without a valid label or observation, and the
    length of the list of labels if it is no multiple of the robots."""
    shape = group_shape(obs, "scene_id", "robot_id", robots, "mission").select(F.col("scene_id").alias("key"), F.lit("scene_shape").alias("problem"))
    lone = obs.select("pos", F.lit(1).alias("_o")).join(label_rows, "pos", "full").where("_o is null or label is null")
    length = label_rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % robots != 0).select(F.col("n").cast("string").alias("key"), F.lit("list_length").alias("problem"))
    return shape.unionByName(lone.select(F.col("pos").cast("string").alias("key"), F.when(F.col("_o").isNull(), "no_observation").otherwise("no_label").alias("problem"))).unionByName(length)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Scenes with legend_swapped: any look that is not drawn as its status."""
    s = spark.read.schema(SCENE).json(path, multiLine=True)
    return s.withColumn("legend_swapped", F.coalesce(F.exists(F.map_entries("road_look"), lambda e: e["key"] != e["value"]), F.lit(False)))


def scene_index(obs: DataFrame) -> DataFrame:
    """S3: image of every scene, from its first row."""
    return obs.groupBy("scene_id").agg(F.min_by("image", "pos").alias("image"))


def jsonl(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """Rows of a JSONL corpus with file and line (from 1 in each file); blank lines go.

    A line that does not parse stays, with the line in _corrupt_record. No line at all is an error. Lines are numbered by
    the block of the file that they are in and their place in it, so a large file is in many tasks.
    """
    lines = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    if lines.isEmpty():
        raise ValueError(f"{path} holds no line")
    x = numbered(lines, ["file"], "_block", "_at").withColumnRenamed("n", "line").where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return x.select("file", "line", parsed.alias("r")).select("file", "line", "r.*")


def pack(df: DataFrame, *columns: str) -> DataFrame:
    """One tab-separated line a row; tabs and line ends inside become blanks."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " "), F.lit("")) for c in columns]).alias("line"))


def verdicts(lines: DataFrame, batch: DataFrame) -> DataFrame:
    """Lines (batch_id, line) id, P/F/U and reason; a batch counts only if every id of it has exactly one valid line."""
    parts = F.split("line", "\t", 3)
    x = lines.select("batch_id", parts[0].alias("id"), parts[1].alias("status"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("reason")).where("status in ('P', 'F', 'U')")
    known = x.join(batch.select("batch_id", "id"), ["batch_id", "id"], "left_semi")
    have = known.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
    want = batch.groupBy("batch_id").agg(F.count_distinct("id").alias("want"))
    whole = want.join(have, "batch_id").where("n = want and ids = want").select("batch_id")
    return known.join(whole, "batch_id", "left_semi")


def write_routed(df: DataFrame, status: str, path: str) -> None:
    """Every row goes unchanged to the folder of its status; an existing path is an error."""
    df.write.mode("errorifexists").partitionBy(status).parquet(path)


def manifest(df: DataFrame, *counted: str) -> DataFrame:
    """One row: rows, counts of values of some columns, and a digest of the content that no order or layout changes.

    A manifest lists the values of a column; a column of over 10,000 values is an error, not a list.
    """
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("_s"), F.bit_xor(row).alias("_x"))
    for c in counted:
        per = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        found = per.limit(10_001).collect()
        if len(found) > 10_000:
            raise ValueError(f"{c} has over 10,000 values")
        pairs = [x for r in sorted(found, key=lambda r: r["v"]) for x in (F.lit(r["v"]), F.lit(r["n"]).cast("long"))]
        out = out.withColumn(c, F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>"))
    return out.withColumn("digest", F.sha2(F.concat_ws(":", "rows", "_s", "_x"), 256)).drop("_s", "_x")


def cached(df: DataFrame, root: str, schema_id: str) -> DataFrame:
    """The table stored under its content's digest and schema id; written only if it is not there yet."""
    fp = manifest(df).first()["digest"][:16]
    path = f"{root.rstrip('/')}/{schema_id}/fp={fp}"
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_digests(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Bucket, rows, digest: the rows dealt by a digest of their key, and a digest of each bucket's content that no
    order or layout changes. Buckets without rows are not listed."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    x = df.select(F.pmod(coin(F.col(key)), F.lit(buckets)).cast("int").alias("bucket"), row.alias("_r"))
    x = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("_r").cast("decimal(38,0)")).alias("_s"), F.bit_xor("_r").alias("_x"))
    return x.select("bucket", "rows", F.sha2(F.concat_ws(":", "rows", "_s", "_x"), 256).alias("digest"))


def root_digest(digests: DataFrame) -> DataFrame:
    """One row: rows, and the digest over the sorted digests of the buckets. A table of buckets is of bounded size."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat_ws("=", x["bucket"].cast("string"), x["digest"])), ",")
    return digests.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(listed, 256).alias("root"))


def changed_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bucket and change (added, removed, altered) of two tables of bucket digests."""
    x = old.select("bucket", F.col("digest").alias("_o")).join(new.select("bucket", F.col("digest").alias("_n")), "bucket", "full").where(~F.col("_o").eqNullSafe(F.col("_n")))
    return x.select("bucket", F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("altered").alias("change"))


def sync(df: DataFrame, key: str, root: str, schema_id: str, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """S10 by buckets: (the table as stored, the buckets that had to be written). Buckets are stored under their digest, and
    only those whose digest is not there yet are written; older ones stay for readers of older versions."""
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{schema_id}"
    digests = stage(bucket_digests(df, key, buckets).withColumn("fp", F.substring("digest", 1, 16)).select("bucket", "fp", "rows"), "digests")
    hadoop, schema = spark._jvm.org.apache.hadoop.fs.Path(path), StructType([*df.schema, StructField("bucket", IntegerType()), StructField("fp", StringType())])
    if hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        stored = spark.read.schema(schema).parquet(path).select("bucket", "fp").distinct()
    else:
        stored = spark.createDataFrame([], "bucket int, fp string")
    new = stage(digests.join(stored, ["bucket", "fp"], "left_anti"), "new_buckets")
    if not new.isEmpty():
        dealt = df.withColumn("bucket", F.pmod(coin(F.col(key)), F.lit(buckets)).cast("int"))
        dealt.join(broadcast_if_small(new.select("bucket", "fp")), "bucket").select(*df.columns, "bucket", "fp").repartition("bucket").write.mode("append").partitionBy("bucket", "fp").parquet(path)
    elif stored.isEmpty():
        return df, new.select("bucket", "rows")  # an empty table that was never stored
    now = spark.read.schema(schema).parquet(path)
    return now.join(broadcast_if_small(digests.select("bucket", "fp")), ["bucket", "fp"], "left_semi").select(*df.columns), new.select("bucket", "rows")


def write_positional(df: DataFrame, pos: str, value: str, path: str, expected: int) -> None:
    """The values in the order of pos as one JSON list; positions must be 0..expected-1 without gaps.

    A submission is one small file by its format, so this sink is for results of a bounded size only.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("a"), F.max(pos).alias("b"), F.count_distinct(pos).alias("d")).first()
    if (n["n"], n["d"], n["a"], n["b"]) != (expected, expected, 0, expected - 1):
        raise ValueError(f"expected positions 0..{expected - 1}, found {n}")
    line = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value]))
    df.agg(line.alias("value")).write.mode("errorifexists").text(path)
