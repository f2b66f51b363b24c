"""Embeddings and pages."""

import collections
import html as entities
import random
import re
import time

import numpy as np
import pytest
from conftest import SF

from corpusgrid.llm import embeddings, html

# embeddings


def brute(rows, cosine=0.98):
    fine = lambda e: e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)
    ok = [(i, l, np.array(e, dtype=np.float32).astype(float)) for i, e, l in rows if l is not None and fine(e)]
    links = collections.defaultdict(list)
    for i, l, e in ok:
        for j, m, f in ok:
            if i != j and l == m and len(e) == len(f) and e @ f / np.linalg.norm(e) / np.linalg.norm(f) >= cosine:
                links[i].append(j)
    comp = {}
    for i in sorted(r[0] for r in rows):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += links[k]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i, *_ in rows}


def near(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "2 as pass", "3 as key", "4 as n")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, **kw).collect()}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for _ in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            v = centre + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.08, 0.3])
            rows.append((i, [float(x) for x in v], int(rng.integers(0, 2))))
            i += 1
    got, want = near(spark, rows, window=16, miss=1e-4), brute(rows)
    assert got == want


def test_embeddings_tight_group_larger_than_a_window(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(size=16) * 0.06], 0) for i in range(60)]
    assert near(spark, rows, window=8, miss=1e-4) == brute(rows)


def test_embeddings_of_a_concentrated_label(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=64))
    x = unit(centre + unit(rng.normal(size=(1200, 64))) * 0.25)  # cosines of about 0.94
    side = rng.normal(size=(100, 64))
    side = unit(side - (side * x[:100]).sum(axis=1, keepdims=True) * x[:100])
    x = np.concatenate([x, x[:100] * 0.9805 + side * np.sqrt(1 - 0.9805**2), unit(rng.normal(size=(1200, 64)))])
    rows = [(i, [float(c) for c in v], int(i >= 1300)) for i, v in enumerate(x)]
    got, want = near(spark, rows, window=16), brute(rows)
    linked = [i for i, v in want.items() if v[0]]
    assert len(linked) >= 200 and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i][0] <= want[i][0] for i in want)


def test_embeddings_recall_on_a_large_clustered_label(spark):
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    n, planted, dim = 12_000, 1_000, 32
    x = unit(unit(rng.normal(size=dim)) * 2.3 + unit(rng.normal(size=(n, dim))))  # median cosine 0.84
    side = rng.normal(size=(planted, dim))
    side = unit(side - (side * x[:planted]).sum(axis=1, keepdims=True) * x[:planted])
    x = np.concatenate([x, x[:planted] * 0.981 + side * np.sqrt(1 - 0.981**2)]).astype(np.float32)
    want = np.zeros(len(x), dtype=int)
    y = unit(x.astype(np.float64))
    for low in range(0, len(y), 1000):
        want[low : low + 1000] = (y[low : low + 1000] @ y.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 7) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    linked = [i for i in range(len(x)) if want[i]]
    found = sum(got[i] == want[i] for i in linked) / len(linked)
    assert len(linked) >= 2 * planted and found >= 0.99 and all(got[i] <= want[i] for i in range(len(x)))


def test_embeddings_packing_loses_no_candidate():
    import pandas as pd

    rng = np.random.default_rng(8)
    for dim in (2, 8, 64, 300):
        x = rng.normal(size=(400, dim)) * 10.0 ** rng.integers(-3, 4, size=(400, 1))
        x[200:] = x[:200] * 3 + rng.normal(size=(200, dim)) * np.linalg.norm(x[:200], axis=1, keepdims=True) * 3 * 0.2 / np.sqrt(dim)
        q, lost = embeddings._packed(x)
        f = pd.DataFrame({"q": [r.tobytes() for r in q], "lost": lost})
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert embeddings._candidates(f, 400, 0.98)[y @ y.T >= 0.98].all() and lost.max() < 0.05


def test_embeddings_hard_cases(spark):
    inf, nan = float("inf"), float("nan")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [inf, 1.0, 1.0], 1), (8, [nan, 1.0, 1.0], 1), (9, [None, 1.0, 1.0], 1), (10, v, 2), (11, [1.0, 2.0], 1), (12, [], 1)]
    got = near(spark, rows)
    assert got == brute(rows) and got[3] == (2, 1, False)
    none = near(spark, [*rows, (None, v, 1)])
    assert none[None] == (0, None, True)
    assert near(spark, rows[:0] or [(1, None, None)]) == {1: (0, 1, True)}


def test_embeddings_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).count() == 0


def test_embeddings_passes_grow_with_the_label():
    assert embeddings.passes_for(100) == 1 and embeddings.passes_for(5_000) < embeddings.passes_for(10_000_000)


# main text


def nested_siblings(rng, n):
    """Random containers that nest: siblings[i] is the block before i in its container, or -1."""
    stack, out, made = [(0, [])], [], 1
    for i in range(n):
        while rng.random() < 0.4 and len(stack) > 1:
            stack.pop()
        while rng.random() < 0.4:
            stack.append((made, []))
            made += 1
        out.append(stack[-1][1][-1] if stack[-1][1] else -1)
        stack[-1][1].append(i)
    return out


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randint(1, 9)
        a, b = ([float(rng.randint(0, 9)) for _ in range(n)] for _ in range(2))
        siblings, near, far = nested_siblings(rng, n), rng.randint(0, 5), rng.randint(0, 5)
        edges = [(i - 1, i, near) for i in range(1, n)] + [(j, i, far) for i, j in enumerate(siblings) if j >= 0]
        cost = lambda side: sum(b[i] if s else a[i] for i, s in enumerate(side)) + sum(c for i, j, c in edges if side[i] != side[j])
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert cost(html.cut(a, b, siblings, near, far)) == best
    assert html.cut([], [], []) == []


def test_cut_of_many_blocks_takes_linear_time():
    rng = random.Random(4)
    n = 100_000
    start = time.time()
    html.cut([rng.random() for _ in range(n)], [rng.random() for _ in range(n)], nested_siblings(rng, n))
    assert time.time() - start < 20


ARTICLE = "<article><h1>A title</h1><p>Some words of a story, and more.</p></article>"
TEXT = "A title\nSome words of a story, and more."


@pytest.mark.parametrize("page", [
    f'<div class="layout has-sidebar">{ARTICLE}</div>', f'<form id="aspnetForm">{ARTICLE}</form>', f'<div class="sidebar">{ARTICLE}</div>', f'<svg class="icon" />{ARTICLE}', f"<svg><svg></svg><path/></svg>{ARTICLE}",
    f'{ARTICLE}<section id="comments"><article class="x"><p>Nice words, thanks a lot for them.</p></article></section>', f"<noscript>{ARTICLE}", f'<aside><article><p>Read this too, it is nice.</p></article></aside><main>{ARTICLE}</main>',
    f'{ARTICLE[:-10]}<div class="related"><a href="/x">More of this</a></div><aside>Some words, beside the story.</aside></article>', f"<header>Site</header><nav><a>x</a></nav>{ARTICLE}<footer>All rights, and more words.</footer>",
    f'<div class="social-post">{ARTICLE[9:-10]}</div>', f'<div class="entry comment-open">{ARTICLE[9:-10]}</div>', f'<form id="aspnetForm"><div class="content">{ARTICLE[9:-10]}</div><label>Name</label></form>'.replace("<label>Name</label>", ""),
])
def test_page_keeps_its_article_and_nothing_else(page):
    assert html.main_text(page, html.PRIOR) == TEXT


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.op7_html_extraction(spark, SF).collect():
        m = re.search(r"<article>(.*?)(?:</article>|$)", source[r["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1)>", m.group(1) if m else "")
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>?", "", p.replace("<br>", " "))).split()) for p in parts]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name</h1></header>
<div id="menu"><ul><li><a href="/">Home</a></li><li><a href=/b>News</a></li></ul></div>
<div class="content"><h2>A  title</h2><p>First words of the story, and then some more of them &amp; so on.
<p>A second paragraph with a <a href='x'>link</a> in it, long enough to be read as text.</p><div class="ad-box">Buy now</div>
<script>if (a < b) { document.write("<p>no</p>") }</script><p>The third one ends the story, 1 &lt; 2, after the advert.</p></div>
<div class="cookie-notice">We use cookies, as all do. Accept.</div><aside>More to read</aside>
<section id="comments"><p>Nice article, thanks a lot for writing it.</p></section><form><label>Name</label></form><footer>&copy; all</footer></body></html>"""


def test_page_without_article():
    got = html.main_text(PAGE, html.PRIOR).split("\n")
    assert got == [
        "A title", "First words of the story, and then some more of them & so on.", "A second paragraph with a link in it, long enough to be read as text.",
        "The third one ends the story, 1 < 2, after the advert.",
    ]


def test_pages_hard_cases(spark):
    deep = "<div>" * 5000 + "deep words stand here" + "</div>" * 5000
    long_ = "<article>" + "<p>some words of a long page, again and again.</p>" * 5000 + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<"), (None, "u", "<p"), (5, "u", "<article><p>cut in the mid<a href='"), (6, "u", deep), (7, "u", long_), (7, "u", long_), (8, "u", "<!-- never ends <p>x"), (9, "u", "1 < 2 and <b>3</b>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html.extract(df, html.train(df)).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[8] == "" and by[5] == "cut in the mid" and by[7].count("\n") == 4999
    assert html.extract(df.limit(0), html.train(df.limit(0))).count() == 0


ONE = "The main article of this page has a long first sentence, with commas, and it ends here."
TWO = "A second paragraph follows the first one, with more words, and it ends here too."
OWN = f"<p>{ONE}</p><p>{TWO}</p>"


@pytest.mark.parametrize("page", [
    f'<article class="share">{OWN}</article>',
    f'<nav><a href="/">Home</a> <a href="/a">About us</a></nav><article class="post widget">{OWN}</article><footer>All rights reserved</footer>',
    f'<main class="main menu">{OWN}</main>',
    f'<div class="page has-sidebar no-comments">{OWN}</div>',
    f'<div class="sidebar-layout">{OWN}</div>',
    f'<article><div class="body with-sidebar">{OWN}</div></article>',
    *[f'<article>{OWN}<div class="{c}"><p>I liked this a lot, thanks for writing it, greetings to all.</p></div></article>' for c in (
        "user-comments", "comment-thread", "reader-comments", "site-footer", "sidebar-main", "adsbygoogle", "ad-box-large", "related-articles", "newsletter-form-wide", "cookie-banner-text")],
    f'<article>{OWN}</article><article class="comment"><p>I liked this a lot, thanks for writing it.</p></article>',
    f'<main>{OWN}<article class="comment"><p>I liked this a lot, thanks for writing it.</p></article></main>',
])
def test_words_on_elements_are_evidence(page):
    assert html.main_text(page, html.PRIOR) == f"{ONE}\n{TWO}"


def test_text_of_math_noscript_and_object_stays():
    page = f"<article><p>{ONE}</p><p>The value is <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> in all cases, as was shown.</p><noscript><p>{TWO}</p></noscript><object data='a'><p>{TWO}</p></object></article>"
    assert html.main_text(page, html.PRIOR).split("\n") == [ONE, "The value is x=2 in all cases, as was shown.", TWO, TWO]


@pytest.mark.parametrize("raw", ["<svg><p>word</p>", "<template><p>word</p>", "<select><p>word</p>", "<div><b><i>", "<b>x</div>", "<div></section>", "<p><b>x", "<style>a</style><svg>", "<textarea>a</textarea>"])
def test_open_elements_take_linear_time(raw):
    start = time.process_time()
    html.blocks("<article>" + raw * 8000)
    assert time.process_time() - start < 2


@pytest.mark.parametrize("junk", ["<p" * 3000, "<a href=\"" * 3000, "<" * 20000, "&" * 20000, "<!" * 20000])
def test_broken_markup_takes_linear_time(junk):
    html.main_text(junk, html.PRIOR)
