"""The pipeline against its stages' rules."""

from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusgrid.llm import bpe, pii


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "tokens"]
    kept = []
    for name, step in P.STAGES:
        out = P.stage(step(spark, docs, SF), name)
        if name != "tokens":
            assert tuple(out.columns) == P.COLUMNS
        kept.append(out)
        docs = out
    language, unique, clean, mixed, tokens = kept
    first = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in language.collect()} == {i for i, r in first.items() if any(c.isalpha() for c in r["text"] or "")}
    # exact copies: one of each text is left
    texts = [r["text"] for r in unique.collect()]
    assert len(texts) == len(set(texts)) and set(texts) <= {r["text"] for r in language.collect()}
    assert clean.count() == unique.count()
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and not [s for s in pii.base_spans(r["text"]) if s[1] in (0, 1, 3)]
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(copies) <= {r["doc_id"] for r in clean.collect()} and max(copies.values()) <= 2
    own = bpe.Bpe(bpe.vocabulary_path())
    by = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in tokens.limit(20).collect():
        assert r["ids"] == own.encode(by[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_hard_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (4, "some words of a text, mail a@b.org", "en", None, 34), (5, "some words of a text, mail a@b.org", "en", "b", 34), (None, "other words with no id at all", None, "b", 29)]
    rows += [(i, f"more words of a text with number {i}, some {i} times as long", "en", "c", 40) for i in range(10, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copy", F.lit(1)).withColumn("place", F.lit(2))
    for _, step in P.STAGES:
        docs = P.stage(step(spark, docs, ""), "hard")
    got = {r["doc_id"] for r in docs.collect()}
    assert got <= {4, None, *range(10, 22)} and got
