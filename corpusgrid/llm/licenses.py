"""License scans by diagonal voting.

All rolling word pairs of a text meet the templates' pairs in a broadcast join (the templates are this module's or the
caller's, so the side is bounded and checked). A hit votes for its diagonal: start = position in the text - position in
the template. The votes of a diagonal are the set of template positions, so repeated rows and repeated words cannot vote
twice. A base phrase stands where a diagonal has all its votes. For the other templates each diagonal merges with those
that follow within DRIFT (words inserted or lost; the bound holds for a span as a whole), and the merged span is verified:
its hits are read in the template's order, and only those count that move on in the text as well. Their share of the
template's pairs is the cover. A template that ends in a version needs the pairs of its version as well.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.session import broadcast_if_small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own labels, by well-known wordings of public licences, of any length.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "gpl-2.0": ["licensed under the gnu general public license version 2"],
    "gpl-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": ["gnu lesser general public license"],
    "agpl": ["gnu affero general public license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "creative commons attribution 4 0 international"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0"],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "public-domain": ["released into the public domain"],
}
#: Words that a span may gain or lose in all, for templates of fewer than LONG pairs and for longer ones; the least cover.
DRIFT, LONG_DRIFT, LONG, COVER = 3, 12, 40, 0.8


def _rows(templates=None) -> list[tuple[list[str], str, bool]]:
    """(words, label, base) of every template; templates of a single word have no pair and are refused."""
    cut = lambda t: [w for w in re.split(SEPARATORS, t.translate({c: c + 32 for c in range(65, 91)})) if w]
    rows = [(cut(p), label, True) for p, label in BASE.items()] + [(cut(t), label, False) for label, ts in (templates or TEMPLATES).items() for t in ts]
    if any(len(w) < 2 for w, _, _ in rows):
        raise ValueError("a template needs two words")
    return rows


def _version(w: list[str]) -> int:
    return next((i for i, x in enumerate(reversed(w)) if not x.isdigit()), len(w) - 1)


def template_pairs(spark, templates=None) -> DataFrame:
    """A row for each word pair of each template: template, label, base, at, pairs, version (numbers at its end), gram."""
    pairs = [(k, label, base, i, a, b, len(w) - 1, _version(w)) for k, (w, label, base) in enumerate(_rows(templates)) for i, (a, b) in enumerate(zip(w, w[1:]))]
    df = spark.createDataFrame(pairs, "template int, label string, base boolean, at int, a string, b string, pairs int, version int")
    return df.select("template", "label", "base", "at", "pairs", "version", F.xxhash64("a", "b").alias("gram"))


def scan(docs: DataFrame, templates=None, cover: float = COVER) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Null text counts as empty; repeated rows each give a row; an empty table gives none. spans has the verified places
    of the method (label, first word, last word, cover). score is the best cover of any template, 1 for a base phrase,
    0 where no word pair of a template stands.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.array_remove(F.split(text, SEPARATORS), "").alias("_w"))
    df = df.withColumn("n_words", F.size("_w"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_words") - 2), lambda i: F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1)))
    # a null gram at the end stands for the document itself, so that one pass yields counts and hits
    grams = F.concat(F.when(F.col("n_words") >= 2, pairs).otherwise(F.array().cast("array<bigint>")), F.array(F.lit(None).cast("bigint")))
    rows = df.select("doc_id", "text_id", "n_words", F.posexplode(grams).alias("pos", "gram"))
    hits = rows.join(broadcast_if_small(template_pairs(spark, templates)), "gram", "left").where("gram is null or template is not null")
    named = ["doc_id", "text_id", "n_words", "template", "label", "base", "pairs", "version"]
    votes = hits.groupBy(*named, (F.col("pos") - F.col("at")).alias("start")).agg(F.collect_set("at").alias("ats"), F.count(F.lit(1)).alias("n"))
    votes = votes.where("template is null or not base or size(ats) = pairs")
    per_template = Window.partitionBy("doc_id", "text_id", "template").orderBy("start")
    near = lambda drift: F.collect_list(F.struct("start", "ats")).over(per_template.rangeBetween(0, drift))
    spans = votes.withColumn("_near", F.when(F.col("base"), F.array(F.struct("start", "ats"))).when(F.col("pairs") < LONG, near(DRIFT)).otherwise(near(LONG_DRIFT)))
    places = F.flatten(F.transform("_near", lambda d: F.transform(d["ats"], lambda at: F.struct(at.alias("at"), (d["start"] + at).alias("pos")))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("ends"), F.lit(-1).alias("at"), F.lit(-1).alias("pos"), F.lit(-1).alias("from"))
    ends = lambda at: (at >= F.col("pairs") - F.col("version")).cast("int")
    forward = lambda a, h: (h["at"] > a["at"]) & (h["pos"] > a["pos"])
    moved = lambda a, h: F.struct((a["n"] + 1).alias("n"), (a["ends"] + ends(h["at"])).alias("ends"), h["at"].alias("at"), h["pos"].alias("pos"), F.when(a["n"] == 0, h["pos"]).otherwise(a["from"]).alias("from"))
    spans = spans.withColumn("_v", F.aggregate(F.array_sort(places), none, lambda a, h: F.when(forward(a, h), moved(a, h)).otherwise(a)))
    spans = spans.select(*named, F.col("start").alias("first"), F.col("_v.from").alias("from"), (F.col("_v.pos") + 1).alias("last"), "n", (F.col("_v.n") / F.col("pairs")).alias("covered"), (F.col("_v.ends") == F.col("version")).alias("ends"))
    covered, ends = F.col("covered"), F.col("ends")
    is_base, own = F.coalesce("base", F.lit(False)), F.coalesce(~F.col("base"), F.lit(False)) & (covered >= cover) & ends
    spans = spans.withColumn("_own", own)
    # of the spans that overlap, the first with the best cover is told
    rival = lambda a, b: F.coalesce(F.max(F.when(F.col("_own"), covered)).over(Window.partitionBy("doc_id", "text_id", "template").orderBy("first").rangeBetween(a, b)), F.lit(0.0))
    spans = spans.withColumn("_told", F.col("_own") & (covered > rival(-LONG_DRIFT, -1)) & (covered >= rival(1, LONG_DRIFT)))
    own = F.col("_own")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("doc_id", "text_id", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("_rows"),
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        listed(F.when(is_base, F.col("label"))).alias("base_labels"),
        listed(F.when(is_base | own, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), covered)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("_told"), F.struct("label", F.col("from").alias("first"), "last", covered.alias("cover"))))).alias("spans"),
    )
    return found.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through scan with this module's templates; nulls, repeats and empty tables as told there."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _oracle() -> str:
    values = ", ".join(f"({k}, '{' '.join(w)}', '{label}', {str(base).lower()}, {_version(w)})" for k, (w, label, base) in enumerate(_rows()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
g AS (SELECT doc_id, i - 1 pos, w[i] a, w[i + 1] b FROM (SELECT doc_id, w, unnest(range(1, len(w))) i FROM d)),
tpl AS (SELECT template, label, base, version, len(string_split(x, ' ')) - 1 pairs, string_split(x, ' ') w FROM (VALUES {values}) v(template, x, label, base, version)),
tp AS (SELECT template, label, base, version, pairs, i - 1 at_, w[i] a, w[i + 1] b FROM (SELECT *, unnest(range(1, len(w))) i FROM tpl)),
v AS (SELECT doc_id, template, label, base, version, pairs, pos - at_ start, list(DISTINCT at_) ats FROM g JOIN tp USING (a, b) GROUP BY ALL),
k AS (SELECT * FROM v WHERE NOT base OR len(ats) = pairs),
n AS (SELECT *, CASE WHEN base THEN [{{'s': start, 'a': ats}}] WHEN pairs < {LONG} THEN list({{'s': start, 'a': ats}}) OVER (PARTITION BY doc_id, template ORDER BY start RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING)
  ELSE list({{'s': start, 'a': ats}}) OVER (PARTITION BY doc_id, template ORDER BY start RANGE BETWEEN CURRENT ROW AND {LONG_DRIFT} FOLLOWING) END near FROM k),
h AS (SELECT *, list_sort(flatten([[{{'at': x, 'pos': y.s + x}} FOR x IN y.a] FOR y IN near])) hits FROM n),
m AS (SELECT *, list_reduce([{{'n': 0, 'e': 0, 'at': z.at, 'pos': z.pos}} FOR z IN hits], lambda a, b: CASE WHEN b.at > a.at AND b.pos > a.pos THEN {{'n': a.n + 1, 'e': a.e + (b.at >= pairs - version)::INT, 'at': b.at, 'pos': b.pos}} ELSE a END,
  {{'n': 0, 'e': 0, 'at': -1::BIGINT, 'pos': -1::BIGINT}}) v FROM h),
c AS (SELECT doc_id, label, base, start first, v.n / pairs cover, NOT base AND v.n / pairs >= {COVER} AND v.e = version own FROM m),
x AS (SELECT doc_id, count(*) FILTER (base) n_base, min(first) FILTER (base) first_word, max(first) FILTER (base) last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR own) labels, max(cover) score FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN x USING (doc_id)"""


ORACLE_SQL = _oracle()
