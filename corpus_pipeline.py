"""The pipeline over documents: every stage calls one operator and works on all that the stage before kept.

language: documents without a recognised language go; lang becomes the prediction.
near_duplicates: of documents linked by five-gram Jaccard similarity of 0.8 or more, the smallest doc_id stays.
personal_data: spans of personal data are replaced by their kind.
mixing: each document appears as often as the mix takes it, in the order of the shards' shuffles.
tokens: ids of every document.

Null texts have no language and go in the first stage; a null doc_id is passed on as it is; rows that repeat a doc_id
share its decision. Empty tables pass through. Columns other than those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.llm import bpe, jaccard, langid, mixing, pii
from corpusgrid.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Predictions less certain than this count as no language.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, which becomes their lang; the model learns from docs themselves."""
    found = langid.predict(docs, langid.train(docs), keep=("doc_id", "text", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Docs whose doc_id is the smallest of its group of linked documents, or that have no n-grams or no doc_id."""
    dropped = jaccard.jaccard_join(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Docs with personal data and secrets replaced in text, and n_chars counted anew."""
    clean = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, ordered by shard and place."""
    _, copies = mixing.mix(docs)
    copies = copies.dropDuplicates(["doc_id", "copy"]).withColumnRenamed("doc_id", "_id")
    drawn = docs.select(*COLUMNS).join(copies, F.col("doc_id").eqNullSafe(F.col("_id")))
    return drawn.repartitionByRange("shard", "place", "doc_id").sortWithinPartitions("shard", "place", "doc_id").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests and ids of every document."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing_stage),
    ("tokens", tokens),
]
#: Models and MinHash have no SQL form; tests compare run() with its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
