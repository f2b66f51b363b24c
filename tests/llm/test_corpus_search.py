"""Divergence audit, ranked search and decontamination against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrid.llm import decontaminate, divergence, ranked

DOCS = "doc_id long, text string, lang string, source string, term string, row long, n int"
ITEMS = "item_id long, text string, t int, block string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "clash", 7, 1) for r in rows], DOCS).repartition(3)


def made_up(seed, n, words=40, longest=60):
    rng = random.Random(seed)
    vocabulary = ["é" * (i % 3) + "w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(words)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(words)], k=rng.randrange(longest))).title(), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None, ""])) for i in range(n)]
    return [*rows, (n, None, "en", "a"), (n + 1, "", "fr", "only"), (n + 2, "12 .,", None, None), (3, "Wa WA wa!wa", "en", "a"), (3, "Wa WA wa!wa", "en", "a"), (None, rows[1][1], "de", "b"), (n + 3, "wa " * 5000 + "x" * 3000, "en", "b")]


# op11


def audit_by_hand(rows, least, top):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)
        total = sum((count[lang, s] for s in sources), Counter())

        def share(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}

        p, q = {s: share(count[lang, s]) for s in sources}, share(total)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("own", [{}, {"block": 2, "unit_terms": 3, "limit": 5000}])
def test_divergence_by_hand(spark, own):
    """The same with one unit a language as with many blocks, units and spills."""
    rows = made_up(1, 120)
    got = divergence.audit(docs_of(spark, rows), least_docs=5, top=4, **own).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == audit_by_hand(rows, 5, 4)


def test_divergence_spills_small_stripes(spark):
    df = docs_of(spark, made_up(2, 60)).coalesce(1)
    assert divergence.stripes(df, 2000).count() > divergence.stripes(df).count()


def test_divergence_without_terms_or_rows(spark):
    assert divergence.audit(docs_of(spark, [])).collect() == []
    got = divergence.audit(docs_of(spark, [(1, None, "en", "a"), (2, "x", "en", "b"), (3, "x", "de", "c")])).collect()
    assert {tuple(r) for r in got} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_divergence_shares_are_exact_for_huge_counts(spark):
    n, total, kept = 3 * 10**15 + 1, 10**16 + 7, 12345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


# op12


def rank_by_hand(rows, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    docs = [(i, Counter(cut(text))) for i, text, *_ in rows]
    size, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(cut(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * size // (total or 1)
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("shard, block", [(10**6, 10**6), (25, 12)])
def test_ranked_by_hand(spark, shard, block):
    """The same with one shard and block as with many."""
    rows = made_up(3, 150)
    rows += [(1000 + i, "wb wc wd we", "en", "a") for i in range(30)]  # ties beyond the last rank
    items = [(1, "wa WB wc"), (2, "wb wc wd we unknown"), (2, "wee wee"), (None, "éwb"), (4, None), (5, "..."), (6, "nowhere"), (7, " ".join(r[1] or "" for r in rows[:3]))]
    df = spark.createDataFrame([(*i, 1, "clash") for i in items], ITEMS)
    got = ranked.search(docs_of(spark, rows), df, shard=shard, block_terms=block).collect()
    assert Counter(tuple(r) for r in got) == rank_by_hand(rows, items, 10)


def test_ranked_empty_tables(spark):
    items, none = spark.createDataFrame([(1, "wa", 1, "")], ITEMS), spark.createDataFrame([], ITEMS)
    assert ranked.search(docs_of(spark, []), items).collect() == []
    assert ranked.search(docs_of(spark, made_up(4, 5)), none).collect() == []
    assert ranked.search(docs_of(spark, [(1, None, "", ""), (2, "?", "", "")]), items).collect() == []


def test_reading_ends_before_the_lists_do():
    """A clear winner ends the search although the lists go on; its score is whole."""
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop or 0)
            return super().__getitem__(key)

    n = 100_000
    docs, scores = np.arange(n), np.r_[10**6, np.full(n - 1, 5)]
    lists = [(docs.view(Watched), scores), (docs.copy(), scores)]
    found, best = ranked.resolve(lists, n, docs, 1, np.array([], np.int64))
    assert list(found) == [0] and list(best) == [2 * 10**6]
    assert max(read) < 1000


# op13


def hits_by_hand(rows, items, size):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[s : s + size])].add("" if item is None else str(item))
    out = []
    for i, text, *_ in rows:
        w, hit, ids = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontaminate_by_hand(spark):
    rows = made_up(5, 100)
    texts = [r[1] for r in rows[:100] if r[1]]
    items = [(i, " ".join(texts[i].split()[3:25])) for i in range(10)] + [(11, "wa"), (12, "WB wc"), (13, "wa wa wa"), (14, "x" * 3000), (15, None), (None, texts[20]), (16, texts[20]), (16, texts[20]), (17, "not here at all")]
    rows += [(500 + i, f"so {items[i % 10][1]} and, {items[0][1]}!", "en", "a") for i in range(40)]
    df = spark.createDataFrame([(*i, 1, "clash") for i in items], ITEMS)
    got = decontaminate.decontaminate(docs_of(spark, rows), df).collect()
    assert Counter(tuple(r)[:-1] for r in got) == hits_by_hand(rows, items, 10)
    assert all(r.n_near >= r.n_items for r in got)


def test_decontaminate_near_misses(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [item, item.replace("five", "x five"), item.replace("five six", "six five"), item.replace("five", "x y z five"), item.replace("five", "x"), " ".join(reversed(item.split()))]
    items = spark.createDataFrame([(1, item, 0, "")], ITEMS)
    got = decontaminate.decontaminate(docs_of(spark, [(i, t, "", "") for i, t in enumerate(texts)]), items).collect()
    assert {r.doc_id: (r.n_items, r.n_near) for r in got} == {0: (1, 1), 1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_decontaminate_empty_tables(spark):
    items, none = spark.createDataFrame([(1, "wa", 1, "")], ITEMS), spark.createDataFrame([], ITEMS)
    assert decontaminate.decontaminate(docs_of(spark, []), items).collect() == []
    got = decontaminate.decontaminate(docs_of(spark, [(1, "wa", "", ""), (None, None, "", "")]), none).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got} == {(1, 1, 0, False), (None, 0, 0, False)}


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity_by_hand(spark, slop):
    """Words may stand up to slop places from where the rarest one puts them."""
    rng = random.Random(slop)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    phrases = [["a", "b", "c"], ["h", "a"], ["d"], ["a", "a", "e", "b"], ["z", "a"]]
    postings = spark.createDataFrame([(r, p, ord(w)) for r, d in enumerate(docs) for p, w in enumerate(d)], "row long, pos int, t long")
    table = spark.createDataFrame([(k, [ord(w) for w in p]) for k, p in enumerate(phrases)], "phrase long, terms array<long>")
    n, want = Counter(w for d in docs for w in d), set()
    for r, d in enumerate(docs):
        for k, p in enumerate(phrases):
            anchor = min(range(len(p)), key=lambda o: (n[p[o]], o))
            for at in (x for x, w in enumerate(d) if w == p[anchor]):
                start = at - anchor
                if start >= -slop and all(p[o] in [d[x] for x in range(start + o - slop, start + o + slop + 1) if 0 <= x < len(d)] for o in range(len(p)) if o != anchor):
                    want.add((r, k, start, len(p)))
    assert {tuple(x) for x in decontaminate.search(postings, table, slop).collect()} == want
