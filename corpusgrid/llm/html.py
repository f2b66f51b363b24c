"""Main text of web pages by minimum cut.

A page becomes a list of text blocks. A logistic classifier on the text of a block (length, links, punctuation, words of
class and id) and the role of the nearest element around it give each block its cost of being content or boilerplate
(terminal capacities); neighbouring blocks, and blocks that follow each other in one container, are tied by smoothness
edges. The minimum cut labels all blocks of a page together.

Roles: article and main hold content; menus, footers, asides and the like bar it, as do elements whose class, id or role
is a boilerplate word as a whole. A compound with such a word in any place (user-comments, site-footer) is suspect, unless
it says that its element has or lacks the thing (has-sidebar). An article or main cancels what wrappers above it say;
inside comments, related links or a barred element, or with a boilerplate word of its own, it does so only where the page
has no other one. A form or a suspect element that holds most of the page is a wrapper. The classifier learns from pages
with an article or main element: inside or outside is the label, and no feature.

Scripts, styles, frames, templates, drawings and form controls have no text; noscript, object and math keep theirs.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.text import map_texts

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title template svg select annotation annotation-xml".split())
#: Of these, the ones that nest and whose missing end tag costs nothing; others run to the end of the page, as in HTML.
NESTED = frozenset("template svg select annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math object q rp rt ruby s samp select small span strike strong sub sup svg td textarea th time tt u var wbr"
    " annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
SPACED = frozenset("br td th".split())
BARRED = frozenset("nav footer aside header head button dialog menu".split())
MAIN = frozenset("article main".split())
#: Words of class, id and role that name boilerplate, those of them that hold other articles, and words that name the main part.
BAD_WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
HOLDERS = frozenset("comment comments disqus modal popup promo promoted promotion related replies respond sidebar sponsor sponsored widget".split())
#: What a compound may hold beside boilerplate words and still name boilerplate, as ad-box and cookie-notice do.
SHAPES = frozenset("area bar block bottom box container inner item left list outer right section slot top unit wrap wrapper".split())
#: Boilerplate words that say less in a compound, and words before one that make it a property of the page.
VAGUE = frozenset("banner header login notice notices respond social toolbar".split())
PROPERTY = frozenset("has hide hides is no with without".split())
GOOD_WORDS = frozenset("article body content entry main page post story text".split())
WORD = re.compile(r"[a-z]+")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NONE, IN_MAIN, IN_BARRED, IN_BAD, IN_FORM, HELD_MAIN, SUSPECT = range(7)
#: Evidence of the roles, in the logistic scale, and the most that the text of a block can add or take.
STRUCTURE, TEXT = (0.0, 5.0, -7.0, -6.0, -3.0, -6.0, -4.0), 2.5
FEATURES = ("bias", "bad_part", "good_word", "log_words", "link_share", "heading", "sentence_marks")
#: What the classifier believes before it sees a page, and how strongly.
PRIOR = np.array([-0.5, -1.0, 1.5, 0.4, -3.0, 0.3, 0.8])
PRIOR_STRENGTH, TRAIN_PAGES, TRAIN_BLOCKS = 5.0, 400, 20_000
NEIGHBOUR, SIBLING = 0.4, 0.6


def blocks(page: str | None) -> list[tuple[str, tuple, int, int]]:
    """(text, features, role, container) of every non-empty block in page order; the last, unfinished tag of a cut page is dropped."""
    page = page or ""
    out, chunks = [], []
    # element: (name, id, container, role, under main, held, bad part, good, link, heading, place of the block that it is or is in)
    stack = [("", 0, 0, NONE, False, False, False, False, False, False, 0)]
    made, links, letters = 1, 0, 0
    open_names, ends = Counter(), {}

    def flush():
        nonlocal links, letters
        text = " ".join("".join(chunks).split()) if chunks else ""
        if text:
            _, _, container, role, _, _, part, good, _, heading, _ = owner
            n = text.count(" ") + 1
            f = (1.0, part, good, math.log(n), links / max(letters, 1), heading, min(text.count(".") + text.count(","), 4) / 4)
            out.append((text, tuple(map(float, f)), role, container))
        chunks.clear()
        links = letters = 0

    def block():
        return stack[stack[-1][10]]

    def shut(k):
        open_names.subtract(e[0] for e in stack[k:])
        del stack[k:]

    owner = stack[0]
    pos, end = 0, len(page)
    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            at = end
        if at > pos:
            chunk = entities.unescape(page[pos:at])
            if not chunks:
                owner = block()
            chunks.append(chunk)
            size = len(chunk.strip())
            letters += size
            links += size if stack[-1][8] else 0
        if at >= end:
            break
        nxt = page[at + 1 : at + 2]
        if nxt == "!" or nxt == "?":
            close = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            pos = end if close < 0 else close + (3 if page.startswith("<!--", at) else 1)
            continue
        if not (nxt.isalpha() or (nxt == "/" and page[at + 2 : at + 3].isalpha())):
            if not chunks:
                owner = block()
            chunks.append("<")  # a bare sign, not a tag
            pos = at + 1
            continue
        m = TAG.match(page, at)
        close = m.end() if m else page.find(">", at) + 1
        if close <= 0:
            break  # markup cut off
        closing, name = page[at + 1] == "/", re.split(r"[\s/>]", page[at + 1 + (nxt == "/") : close], maxsplit=1)[0].lower()
        pos = close
        if name in RAW and not closing:
            if not (name == "svg" and page[close - 2] == "/"):  # foreign elements may end at once
                if name not in ends:
                    ends[name] = _ends(page, name)
                pos = ends[name](close)
            if name not in INLINE:
                flush()
            continue
        if name in SPACED:
            chunks.append(" ") if chunks else None
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
        if closing:
            low = stack[-1][10] if name in INLINE else 0  # an inline end tag does not close a block
            k = next((k for k in range(len(stack) - 1, low, -1) if stack[k][0] == name), 0) if open_names[name] else 0
            if k:
                shut(k)
        else:
            if name in ("p", "li", "dt", "dd", "option", "tr"):
                # an open element of the same name ends here, with the inline elements in it
                k = stack[-1][10]
                if stack[k][0] == name:
                    shut(k)
            _, above, container, role, under, held, part, good, link, heading, home = stack[-1]
            tokens = [] if not m or name in ("html", "body") else [t for a in ATTR.finditer(m[3]) for t in (a[2] or a[3] or a[4] or "").lower().split()]
            parts = {w for t in tokens for w in WORD.findall(t)}
            whole = {w for t in tokens for w in (WORD.findall(t),) if w and w[0] in BAD_WORDS and BAD_WORDS | SHAPES >= set(w) for w in w}
            if name in MAIN and not (whole and under):
                if not under:  # an article inside another one changes nothing
                    role = HELD_MAIN if held or whole else IN_MAIN
                    part, under = False, True
            elif name in BARRED or whole:
                role = IN_BARRED if name in BARRED else IN_BAD
                held = held or name in BARRED or bool(whole & HOLDERS)
            elif role not in (IN_BARRED, IN_BAD) and any(_suspect(WORD.findall(t)) for t in tokens):
                role = SUSPECT
            elif name == "form" and role not in (IN_BARRED, IN_BAD):
                role = IN_FORM
            stack.append((
                name, made, above if name not in INLINE else container, role, under, held, part or bool(parts & BAD_WORDS), good or bool(parts & GOOD_WORDS), link or name == "a",
                name in ("h1", "h2", "h3", "h4", "h5", "h6"), home if name in INLINE else len(stack),
            ))
            open_names[name] += 1
            made += 1
    flush()
    return _resolved(out)


def _suspect(words: list[str]) -> bool:
    """Whether a compound holds a telling boilerplate word that is not said to be a property."""
    return len(words) > 1 and any(w in BAD_WORDS and w not in VAGUE and not PROPERTY & set(words[:i]) for i, w in enumerate(words))


def _ends(page: str, name: str):
    """Function of the place after a raw element's start tag: where the text goes on. The page is read once for all."""
    tags = [(m.start(), m.end(), bool(m[1]), m[0].endswith("/>")) for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page)]
    if name not in NESTED:
        closed = [t for t in tags if t[2]]
        starts = [t[0] for t in closed]
        return lambda pos: closed[k][1] if (k := bisect_left(starts, pos)) < len(closed) else len(page)
    after, open_ = {}, []
    for _, end, closing, at_once in tags:
        if closing and open_:
            after[open_.pop()] = end
        elif not closing and not at_once:
            open_.append(end)
    return lambda pos: after.get(pos, pos)


def _resolved(found: list) -> list:
    """Blocks with the roles that only the whole page decides: held articles, and wrappers of the page."""
    words = Counter()
    for text, _, role, _ in found:
        words[role] += text.count(" ") + 1
    change = {HELD_MAIN: IN_BAD if words[IN_MAIN] else IN_MAIN}
    if not words[IN_MAIN] and not words[HELD_MAIN]:
        change |= {role: NONE for role in (IN_FORM, SUSPECT) if 2 * words[role] > words.total()}
    return [(t, f, change.get(role, role), at) for t, f, role, at in found]


def cut(content: list[float], other: list[float], siblings: list[int], neighbour: float = NEIGHBOUR, sibling: float = SIBLING) -> list[bool]:
    """Which blocks lie on the content side of the minimum cut (ties go to the other side), in linear time.

    content and other are the costs of cutting a block off from each side; edges tie each block to the next one and to
    siblings[i], an earlier block or -1. These edges nest (containers do), so the cut is found exactly by taking out a
    block whose edges all lead to two others: the least cost for each of their four labellings is an edge between them.
    """
    n, none = len(content), (0.0, neighbour, neighbour, 0.0)
    own = list(zip(content, other))  # label 0, boilerplate, cuts a block off from content
    open_, edge, gone = [], [], []  # blocks in play, the edge from each to the one before, and those taken out
    for i in range(n):
        e = none
        if siblings[i] >= 0:
            while open_[-1] != siblings[i]:
                t, f = open_.pop(), edge.pop()
                u = own[t]
                pick, cost = [], []
                for a in (0, 1):
                    for b in (0, 1):
                        x0, x1 = f[2 * a] + u[0] + e[b], f[2 * a + 1] + u[1] + e[2 + b]
                        pick.append(x1 < x0)
                        cost.append(x1 if x1 < x0 else x0)
                gone.append((t, open_[-1], i, pick))
                e = tuple(cost)
            e = (e[0], e[1] + sibling, e[2] + sibling, e[3])
        open_.append(i)
        edge.append(e)
    label, back = [False] * n, []
    best = own[open_[0]] if n else (0.0, 0.0)
    for t, e in zip(open_[1:], edge[1:]):
        pick = (best[1] + e[2] < best[0] + e[0], best[1] + e[3] < best[0] + e[1])
        back.append(pick)
        best = tuple(best[pick[x]] + e[2 * pick[x] + x] + own[t][x] for x in (0, 1))
    if n:
        label[open_[-1]] = best[1] < best[0]
    for k in range(len(open_) - 1, 0, -1):
        label[open_[k - 1]] = back[k - 1][label[open_[k]]]
    for t, a, b, pick in reversed(gone):
        label[t] = pick[2 * label[a] + label[b]]
    return label


def fit(rows: list[tuple[list[float], float]], strength: float = PRIOR_STRENGTH) -> np.ndarray:
    """Weights of the logistic classifier by Newton's steps, with a Gaussian prior around PRIOR; PRIOR without rows."""
    if not rows:
        return PRIOR
    x, y, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), PRIOR.copy()
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - PRIOR)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
    return w


def main_text(page: str | None, weights: np.ndarray) -> str:
    """Text of the blocks on the content side of the page's minimum cut; empty for a null or empty page."""
    found = blocks(page)
    if not found:
        return ""
    role = np.array([r for _, _, r, _ in found])
    score = np.clip(np.array([f for _, f, _, _ in found]) @ weights, -TEXT, TEXT) + np.array(STRUCTURE)[role]
    siblings, last = [], {}
    for i, (_, _, _, container) in enumerate(found):
        siblings.append(last.get(container, -1))
        last[container] = i
    side = cut(np.log1p(np.exp(score)).tolist(), np.log1p(np.exp(-score)).tolist(), siblings)
    return "\n".join(b[0] for b, s in zip(found, side) if s)


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_blocks: int = TRAIN_BLOCKS) -> np.ndarray:
    """Classifier from at most train_blocks blocks, drawn by hash, of about train_pages pages, drawn by hash too.

    A block of a page that has an article or main element is content if it lies in it, else boilerplate; other pages
    teach nothing. The driver gets the numbers of the drawn blocks only.
    """
    n = pages.select("page_id").count()
    share = min(1_000_000, math.ceil(1_000_000 * train_pages / max(n, 1)))
    picked = pages.where(F.pmod(F.xxhash64("page_id", F.lit(37)), F.lit(1_000_000)) < share)

    def make():
        def one(page):
            found = blocks(page)
            if not any(role == IN_MAIN for _, _, role, _ in found):
                return ([],)
            return ([[*f, float(role == IN_MAIN)] for _, f, role, _ in found],)

        return one

    rows = map_texts(picked.select("html"), [], "html", make, [("found", "array<array<double>>")]).select(F.explode("found").alias("b"))
    rows = rows.orderBy(F.xxhash64("b"), "b").limit(train_blocks).collect()
    return fit([(r["b"][:-1], r["b"][-1]) for r in rows])


def extract(pages: DataFrame, weights: np.ndarray, keep=("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars (code points); a row per row, null html counts as empty, whole pages are read."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value

        def one(page):
            text = main_text(page, w)
            return text, len(text)

        return one

    return map_texts(pages, list(keep), "html", make, [("text", "string"), ("n_chars", "long")])


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every row of pages through extract, with a classifier of these pages; nulls and empty tables as told there."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
