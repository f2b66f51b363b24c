"""Personal data: fixed patterns, plus a character-level bidirectional LSTM with CRF transitions trained in numpy.

The tagger is trained on contexts drawn from the documents into which spans of many written forms are set, among them
forms that the patterns do not know (name at host dot org, defanged addresses, numbers in words or without a country
code, keys and passwords, also without a digit), numbers that are no personal data, and plain text. At scanning, the
whole text is covered by overlapping windows. Each window is decoded by Viterbi, and each character takes its tag from
the window in whose middle it lies best. Spans of the tagger that touch no pattern span and whose characters have a mean
posterior of SURE are added.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.text import map_texts

#: Kinds of the patterns, and then those that only the tagger has.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
#: The patterns of the base kinds, in forms that take linear time on any text.
TRIGGER = re.compile(r"[0-9@]").search
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = "zero one two three four five six seven eight nine".split()
#: What a context of training must not hold: a digit, an @, a spelled-out at ... dot, digits in words.
NEAR = re.compile(rf"[0-9@]|(?i:\bat\b(?=[^\w\n][^\n]{{1,40}}[^\w\n]dot\b)|[\[(]at[\])]|\b(?:{'|'.join(DIGITS)})\b(?=(?:[ ,-]+(?:{'|'.join(DIGITS)})\b){{6}}))")
#: Bounds of training: documents drawn, windows made of them (and as many plain ones); then the characters of a document
#: that are drawn, and those of a window of training.
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS, MORE_EPOCHS, BATCH = 400, 1_500, 14, 4, 50
DRAWN, PIECE = 720, 72
#: Windows at scanning, and the shape of the model. What two windows share is more than twice what is within REACH.
WIDTH, STRIDE, REACH, HIDDEN, SURE = 360, 300, 28, 16, 0.8
#: Windows that are decoded together, and texts that are in Python at a time.
TOGETHER = 2048
CLASSES = {c: i + 6 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz@.-+()[]_% \n,:;/=\"'&<>")}
TAGS = 1 + 2 * len(KINDS)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the patterns, per kind leftmost and not overlapping, sorted."""
    found = []
    if not TRIGGER(text):
        return found
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            found.append((s, 0, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that cover the whole text; the last one ends with it."""
    last = max(0, len(text) - WIDTH)
    return [*range(0, last, STRIDE), last] if text else []


def _class(c: str) -> int:
    return CLASSES.get(c) or (2 if c in "0123456789" else 4 if c in "ABCDEF" else 3 if c.isupper() else 5 if c.isalpha() else 1)


ASCII = np.array([_class(chr(c)) for c in range(128)], dtype=np.uint8)


def classes(text: str) -> np.ndarray:
    """Character classes: padding 0, other 1, digit 2, capital 3, A to F 4, further letters 5, then single marks."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = ASCII[np.minimum(points, 127)]
    wide = np.nonzero(points > 127)[0]
    if len(wide):
        found, which = np.unique(points[wide], return_inverse=True)
        out[wide] = np.array([_class(chr(p)) for p in found], dtype=np.uint8)[which]
    return out


def encode(chunk: str, width: int = PIECE) -> np.ndarray:
    """Character classes of a window, padded to width."""
    own = classes(chunk[:width])
    return np.concatenate([own, np.zeros(width - len(own), dtype=np.uint8)]).astype(np.int64)


def tags_of(spans, start: int) -> np.ndarray:
    out = np.zeros(PIECE, dtype=np.int64)
    for s, k, e in spans:
        for p in range(max(s, start), min(e, start + PIECE)):
            out[p - start] = 2 * k + (1 if p == s else 2)
    return out


def _lstm(x, wx, wh, b, steps):
    """Hidden states of one direction; steps is the order of positions. Returns what the backward pass needs."""
    n, h = x.shape[0], wh.shape[0]
    hidden, cell = np.zeros((n, h), dtype=wx.dtype), np.zeros((n, h), dtype=wx.dtype)
    kept, out, given = {}, np.zeros((n, x.shape[1], h), dtype=wx.dtype), (wx + b)[x]
    for t in steps:
        g = given[:, t] + hidden @ wh
        gates = 1 / (1 + np.exp(-np.maximum(g[:, : 3 * h], -30)))
        i, f, o, u = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(g[:, 3 * h :])
        before, prev = cell, hidden
        cell = f * cell + i * u
        th = np.tanh(cell)
        hidden = o * th
        out[:, t] = hidden
        kept[t] = (gates, u, before, prev, th)
    return out, kept


def _lstm_back(x, wx, wh, kept, steps, dout):
    h = wh.shape[0]
    grads, prevs = [], []
    dh, dc = np.zeros((x.shape[0], h), dtype=wx.dtype), np.zeros((x.shape[0], h), dtype=wx.dtype)
    for t in reversed(steps):
        gates, u, before, prev, th = kept[t]
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - th * th)
        g = np.concatenate([dc * u, dc * before, dh * th, dc * i * (1 - u * u)], axis=1)
        g[:, : 3 * h] *= gates * (1 - gates)
        grads.append(g)
        prevs.append(prev)
        dh, dc = g @ wh.T, dc * f
    g = np.concatenate(grads)
    on = np.zeros((len(g), len(wx)), dtype=wx.dtype)
    on[np.arange(len(g)), np.concatenate([x[:, t] for t in reversed(steps)])] = 1
    return on.T @ g, np.concatenate(prevs).T @ g, g.sum(0)


def emissions(model, x):
    steps = list(range(x.shape[1]))
    fwd, kf = _lstm(x, *(model[k] for k in ("fx", "fh", "fb")), steps)
    bwd, kb = _lstm(x, *(model[k] for k in ("bx", "bh", "bb")), steps[::-1])
    both = np.concatenate([fwd, bwd], axis=2)
    return both @ model["out"] + model["bias"], both, kf, kb


def marginals(e, trans):
    """Posterior of each tag at each position, and the expected number of each transition (scaled forward-backward)."""
    n, t, k = e.shape
    em, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(trans)
    a, b, c = np.empty((t, n, k)), np.ones((t, n, k)), np.empty((t, n, 1))
    for j in range(t):
        a[j] = em[:, j] if j == 0 else (a[j - 1] @ move) * em[:, j]
        c[j] = a[j].sum(1, keepdims=True)
        a[j] /= c[j]
    on = np.empty((t, n, k))  # what a step to j brings
    for j in range(t - 1, 0, -1):
        on[j] = em[:, j] * b[j] / c[j]
        b[j - 1] = on[j] @ move.T
    pair = move * (a[:-1].reshape(-1, k).T @ on[1:].reshape(-1, k)) if t > 1 else np.zeros((k, k))
    return (a * b).transpose(1, 0, 2), pair


def train(chunks: list[str], tags: list[np.ndarray], epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 7, known: dict | None = None, fast: float = 0.03) -> dict | None:
    """Fit by Adam on the CRF likelihood, from a model that is known or from scratch; None without windows."""
    if not chunks:
        return None
    rng = np.random.default_rng(seed)
    x, y = np.stack([encode(c) for c in chunks]), np.stack(tags)
    c = 6 + len(CLASSES)
    m = {}
    for d in "fb":
        m[d + "x"], m[d + "h"], m[d + "b"] = rng.normal(0, 0.3, (c, 4 * hidden)), rng.normal(0, 0.2, (hidden, 4 * hidden)), np.zeros(4 * hidden)
        m[d + "b"][hidden : 2 * hidden] = 1.0
    m |= {"out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    m = known or {k: v.astype(np.float32) for k, v in m.items()}
    mom, var, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        rate = fast * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(x))
        for low in range(0, len(x), BATCH):
            rows = order[low : low + BATCH]
            xb, yb, n = x[rows], y[rows], len(rows)
            e, both, kf, kb = emissions(m, xb)
            post, pair = marginals(e, m["trans"])
            de = post.astype(np.float32)
            de[np.arange(n)[:, None], np.arange(PIECE)[None], yb] -= 1
            np.add.at(pair, (yb[:, :-1].ravel(), yb[:, 1:].ravel()), -1)
            g = {"trans": pair, "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS), "bias": de.sum((0, 1))}
            dboth = de @ m["out"].T
            steps = list(range(PIECE))
            g["fx"], g["fh"], g["fb"] = _lstm_back(xb, m["fx"], m["fh"], kf, steps, dboth[:, :, :hidden])
            g["bx"], g["bh"], g["bb"] = _lstm_back(xb, m["bx"], m["bh"], kb, steps[::-1], dboth[:, :, hidden:])
            step += 1
            for k, v in g.items():
                v = np.clip(v / n, -5, 5)
                mom[k] = 0.9 * mom[k] + 0.1 * v
                var[k] = 0.99 * var[k] + 0.01 * v * v
                m[k] = (m[k] - rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def viterbi(e, trans):
    n, t, k = e.shape
    score, back = e[:, 0], np.zeros((n, t, k), dtype=np.int64)
    for j in range(1, t):
        all_ = score[:, :, None] + trans[None]
        back[:, j] = all_.argmax(1)
        score = all_.max(1) + e[:, j]
    out = np.zeros((n, t), dtype=np.int64)
    out[:, -1] = score.argmax(1)
    for j in range(t - 1, 0, -1):
        out[:, j - 1] = back[np.arange(n), j, out[:, j]]
    return out


def _prepared(model: dict) -> dict:
    """The model as scanning takes it: a table for each gate; sigmoids are halves of 1 + tanh, so hidden states are doubled."""
    h, kinds = model["fh"].shape[0], len(KINDS)
    half = np.array([0.5, 0.5, 0.5, 1.0], dtype=np.float32)[:, None, None]
    gates = lambda w: np.ascontiguousarray(w.reshape(len(w), 4, h).transpose(1, 0, 2)) * half
    out = {"trans": model["trans"], "bias": model["bias"][:, None], "out": [np.ascontiguousarray(x.T) / 2 for x in (model["out"][:h], model["out"][h:])]}
    for d in "fb":
        out[d + "x"], out[d + "h"] = gates(model[d + "x"] + model[d + "b"]), gates(model[d + "h"]) / 2
    move = model["trans"] - model["trans"][0, 0]
    kind = (np.arange(TAGS) - 1) // 2
    other = np.where((kind[:, None] == kind[None]) | (kind[:, None] < 0), -np.inf, move).max(axis=0)
    own = np.stack([[move[1 + 2 * k + a, 1 + 2 * k + b] for k in range(kinds)] for b in (0, 1) for a in (0, 1)]).reshape(2, 2, kinds, 1)
    out["move"] = {"out": move[1:, :1], "in": move[0, 1:, None], "other": other[1:, None], "own": own}
    return out


def _scanned(ready: dict, x: np.ndarray) -> np.ndarray:
    """emissions() of windows x (n, width) without what training needs: (width, tags, n)."""
    n, width = x.shape
    h, at = ready["fh"].shape[2], np.ascontiguousarray(x.T).astype(np.intp)
    total = np.empty((width, len(ready["bias"]), n), dtype=np.float32)
    g, given = np.empty((4, n, h), dtype=np.float32), np.empty((4, n, h), dtype=np.float32)
    i, f, o, u = g
    for d, steps in (("f", range(width)), ("b", range(width - 1, -1, -1))):
        wx, wh, out = ready[d + "x"], ready[d + "h"], ready["out"][d == "b"]
        hidden, cell = np.zeros((n, h), dtype=np.float32), np.zeros((n, h), dtype=np.float32)
        for t in steps:
            np.matmul(hidden, wh, out=g)
            wx.take(at[t], axis=1, out=given, mode="clip")
            np.add(g, given, out=g)
            np.tanh(g, out=g)
            g[:3] += 1
            cell *= f
            u *= i
            cell += u
            cell *= 0.5
            np.tanh(cell, out=hidden)
            hidden *= o
            if d == "f":
                np.matmul(out, hidden.T, out=total[t])
            else:
                total[t] += out @ hidden.T
    total += ready["bias"]
    return total


def _maybe(ready: dict, e: np.ndarray) -> np.ndarray:
    """Windows (width, tags, n) in which a way with a tag may be best.

    Viterbi's scores over that of no tag at all; changes from kind to kind are priced as the cheapest into a tag, so that no
    score is below its true one."""
    move = ready["move"]
    score, after = e[0, 1:] - e[0, 0], np.full(e.shape[2], -np.inf, dtype=np.float32)  # after: no tag any more
    for t in range(1, len(e)):
        new = np.maximum(score.max(axis=0) + move["other"], np.maximum(after, 0) + move["in"])
        for b in (0, 1):
            for a in (0, 1):
                np.maximum(new[b::2], score[a::2] + move["own"][b, a], out=new[b::2])
        after = np.maximum((score + move["out"]).max(axis=0), after)
        new -= e[t, 0]
        score = np.add(new, e[t, 1:], out=new)
    return np.nonzero(np.maximum(score.max(axis=0), after) > -1e-3)[0]


def _decoded(model: dict, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tags of windows of training by Viterbi, and their posteriors."""
    x = np.stack([encode(c) for c in chunks])
    best, post = np.zeros(x.shape, dtype=np.int64), np.ones(x.shape)
    for i, tags, sure in _tagged(_prepared(model), x):
        best[i], post[i] = tags, sure
    return best, post


def _tagged(ready: dict, x: np.ndarray):
    """(number, tags by Viterbi, their posteriors) of the windows that have a tag."""
    e = _scanned(ready, x)
    some = _maybe(ready, e)
    if len(some):
        e = np.ascontiguousarray(e[:, :, some].transpose(2, 0, 1))
        best = viterbi(e, ready["trans"])
        hit = np.nonzero(best.any(axis=1))[0]
        if len(hit):
            every, _ = marginals(e[hit], ready["trans"])
            post = np.take_along_axis(every, best[hit][:, :, None], 2)[:, :, 0]
            yield from zip(some[hit], best[hit], post)


def _joined(starts: list[int], found: dict, length: int, sure: float) -> list[tuple[int, int, int]]:
    """Spans of a text of `length` characters from its windows: each character as in the window that holds it deepest.

    found: tags and posteriors of the windows that have any, by their number."""
    if not found:
        return []
    hit = np.array(sorted(found))
    # neighbours of a window with a tag have a say as well; those at two strides reach no character deeper
    near = np.unique(np.clip(np.concatenate([hit - 1, hit, hit + 1]), 0, len(starts) - 1))
    width = len(found[hit[0]][0])
    none = (np.zeros(width, dtype=np.int64), np.ones(width))
    tags, post = (np.stack([found.get(i, none)[k] for i in near.tolist()]) for k in (0, 1))
    at = np.array(starts)[near][:, None] + np.arange(width)[None]
    low, high = np.array(starts)[near], np.minimum(np.array(starts)[near] + width, length)
    # distance to the nearest inner edge; the text's own ends are no edges
    depth = np.minimum(np.where(low[:, None] > 0, at - low[:, None], width), np.where(high[:, None] < length, high[:, None] - 1 - at, width))
    inside = at < length
    place, depth, tag, p = at[inside], depth[inside], tags[inside], post[inside]
    order = np.lexsort((-depth, place))
    place, tag, p = place[order], tag[order], p[order]
    first = np.concatenate([[True], place[1:] != place[:-1]])
    place, tag, p = place[first], tag[first], p[first]
    keep = tag > 0
    place, tag, p = place[keep], tag[keep], p[keep]
    if not len(place):
        return []
    kind = (tag - 1) // 2
    new = np.nonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)]))[0]
    ends = np.append(new[1:], len(place))
    sums = np.add.reduceat(p, new)
    return [(int(place[a]), int(kind[a]), int(place[b - 1]) + 1) for a, b, q in zip(new, ends, sums) if q >= sure * (b - a)]


def spans_of(model: dict | None, texts: list[str], sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """Spans of the tagger over whole texts; windows of several texts are decoded together."""
    starts = [windows(t) if model else [] for t in texts]
    ready, found = _prepared(model) if model else None, [{} for _ in texts]
    waiting: dict[int, list] = {}  # by width: a short text is padded by its length alone, whatever its neighbours are

    def decode(width: int) -> None:
        todo = waiting.pop(width)
        x = np.zeros((len(todo), width), dtype=np.uint8)
        for row, (_, _, own) in zip(x, todo):
            row[: len(own)] = own
        for k, tags, post in _tagged(ready, x):
            i, at, _ = todo[k]
            found[i][at] = (tags, post)

    for i, text in enumerate(texts):
        own = classes(text) if starts[i] else None
        for at, s in enumerate(starts[i]):
            width = min(WIDTH, -(-len(text) // PIECE) * PIECE)
            waiting.setdefault(width, []).append((i, at, own[s : s + width]))
            if len(waiting[width]) == TOGETHER:
                decode(width)
    for width in list(waiting):
        decode(width)
    return [_joined(s, f, len(t), sure) for t, s, f in zip(texts, starts, found)]


def all_spans(model: dict | None, texts: list[str | None]) -> list[tuple[list, list]]:
    """Per text (base spans, base spans and what the tagger adds); empty for null."""
    texts = [t or "" for t in texts]
    out = []
    for t, own in zip(texts, spans_of(model, texts)):
        base = base_spans(t)
        out.append((base, sorted(base + [x for x in own if all(x[2] <= s or x[0] >= e for s, _, e in base)]) if own else base))
    return out


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def written(rng: np.random.Generator) -> list[tuple[str, int | None]]:
    """A made-up piece of text in parts (characters, kind): personal data in one of many forms, or a number that is none."""
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    of = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    word = lambda: of("abcdefghijklmnoprstuvwz", rng.integers(2, 9))
    kind = int(rng.integers(0, len(KINDS) + 2))
    if kind == 0:
        user = word() + pick("", ".", "_", "-") + pick(word(), digits(2), "")
        host, end = word() + pick("", digits(1), "." + word()), pick("com", "org", "net", "de", "fr", "es", "example.com", word()[:3])
        at, dot = pick(("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), (" AT ", " DOT "), ("[at]", "[dot]"))
        return [(user.rstrip("._-") + at + host.replace(".", dot) + dot + end.replace(".", dot), 0)]
    if kind == 1:
        parts, dot = [str(x) for x in rng.integers(0, 256, 4)], pick(".", ".", "[.]", " . ", "(.)")
        return [(dot.join(parts), 1)]
    if kind == 2:
        d, gap = pick("4", "5", "3", "6") + digits(15), pick("", "", " ", "-", ".", "/")
        return [(gap.join(d[i : i + 4] for i in range(0, 16, 4)), 2)]
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        if rng.random() < 0.15:
            return [(pick(" ", ", ", "-").join(DIGITS[int(x)] for x in digits(int(rng.integers(7, 11)))), 3)]
        return [(pick(f"+{pick('1', '44', '49', '33')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"00{digits(2)} {a} {b}{c}", f"0{digits(2)} {c} {digits(4)}", f"0{a}/{b}{c}"), 3)]
    if kind == 4 and rng.random() < 0.3:  # words for a password, after its name alone
        return [(pick("password", "passwd", "secret", "pwd") + pick("=", ' = "', '="'), None), (of("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[: pick(26, 52)], int(rng.integers(8, 25))), 4)]
    if kind == 4:
        hexes, mixed, capitals = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
        name = pick("password", "passwd", "token", "secret", "api_key", "apikey", "pwd")
        return pick(
            [(pick("AKIA", "ASIA") + of(capitals, 9) + digits(1) + of(capitals, 6), 4)], [(name + pick("=", ": ", ' = "', '="'), None), (of(hexes, int(rng.integers(8, 20))) + digits(1) + of(hexes, int(rng.integers(7, 20))), 4)],
            [(pick("sk_live_", "ghp_", "xoxb-", "key-") + of(mixed, int(rng.integers(10, 20))) + digits(1) + of(mixed, int(rng.integers(8, 16))), 4)], [(name + pick("=", ' = "'), None), (of(mixed, int(rng.integers(6, 16))) + digits(1) + of(mixed, int(rng.integers(5, 16))), 4)],
        )
    return [(pick(
        digits(1), digits(2), str(rng.integers(1700, 2100)), f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}", f"CC BY {digits(1)}.0", f"License, Version {digits(1)}.0.",
        f"{digits(2)},{digits(3)}", f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{digits(2)}:{digits(2)}", f"p. {digits(3)}", f"({digits(1)})", f"{digits(1)}. ", f"{digits(2)} %", f"no {digits(5)}",
        f"{digits(1)}) ", f"at {word()}, dot {word()}", "@", f"{digits(3)} {word()} {digits(4)}", f"{word()}{digits(2)}", f"{digits(6)}", "",
    ), None)]


def examples(contexts: list[str], n: int, seed: int = 5) -> tuple[list[str], list[np.ndarray]]:
    """n windows with their tags: written() pieces set into the contexts."""
    rng, chunks, tags = np.random.default_rng(seed), [], []
    for i in range(n):
        text, spans = "", []
        context = contexts[i % len(contexts)]
        for cut in np.sort(rng.integers(0, len(context) + 1, int(rng.integers(1, 3)))):
            text += context[len(text) and int(cut) // 2 : int(cut)][: PIECE // 2] + (" " if rng.random() < 0.9 else "")
            for part, kind in written(rng):
                if kind is not None:
                    spans.append((len(text), kind, len(text) + len(part)))
                text += part
            text += pick_end(rng)
        text += context[-int(rng.integers(1, PIECE)) :]
        low = int(rng.integers(0, max(1, len(text) - PIECE // 2)))
        chunks.append(text[low : low + PIECE])
        tags.append(tags_of(spans, low))
    return chunks, tags


def plain(contexts: list[str], n: int, seed: int = 6) -> tuple[list[str], list[np.ndarray]]:
    """n windows without personal data: pieces of the contexts; one in five repeats a word of them, as worthless text does."""
    rng, chunks = np.random.default_rng(seed), []
    order = rng.permutation(len(contexts))
    for i in range(n):
        context = contexts[order[i % len(order)]]
        words = context.split()
        if i % 5 == 4 and words:
            context = " ".join([words[rng.integers(len(words))]] * PIECE)
            context = context[: int(rng.integers(PIECE // 3, PIECE + 1))] + pick_end(rng) + contexts[rng.integers(len(contexts))]
        chunks.append(context[:PIECE])
    return chunks, [np.zeros(PIECE, dtype=np.int64)] * n


def pick_end(rng: np.random.Generator) -> str:
    return (" ", " ", " ", ". ", ", ", "\n", '" ')[rng.integers(7)]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> dict | None:
    """Tagger trained on train_windows windows with written() pieces and as many plain ones, made of contexts from train_docs
    documents, drawn by hash; None without texts.

    A context is PIECE characters without a trigger, from the DRAWN ones of a document at a place that the hash draws as well.
    """
    n = docs.where(F.length("text") > 0).select("doc_id").count()
    o = F.xxhash64("doc_id", F.lit(31))
    # some four times as many as are wanted, so that tasks send little to the driver whatever their number
    rows = docs.where(F.length("text") > 0).where(F.shiftrightunsigned(o, 11) < F.lit(int(min(1.0, 4 * train_docs / max(n, 1)) * (1 << 53))))
    piece = F.expr(f"substring(text, cast(pmod(o, greatest(length(text) - {DRAWN}, 1)) as int) + 1, {DRAWN})")
    rows = rows.withColumn("o", o).select(piece.alias("piece"), "o", F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("h"))
    drawn = sorted(r["piece"] for r in rows.orderBy("o", "id", "h").limit(train_docs).collect())
    contexts = [c for d in drawn for c in (d[at : at + PIECE] for at in range(0, len(d), PIECE)) if not NEAR.search(c)] or ([" "] if drawn else [])
    if not contexts:
        return None
    return learned(contexts, train_windows)


def learned(contexts: list[str], train_windows: int) -> dict | None:
    """Tagger of the contexts. Plain windows in which the first fit sees personal data are shown again, in a second one."""
    chunks, tags = (a + b for a, b in zip(examples(contexts, train_windows), plain(contexts, train_windows)))
    model = train(chunks, tags)
    new, none = plain(contexts, 4 * train_windows, seed=8)
    wrong = np.nonzero(_decoded(model, new)[0].any(axis=1))[0].tolist() if new else []
    wrong = wrong[: train_windows // 5]
    return train(chunks + [new[i] for i in wrong], tags + none[: len(wrong)], MORE_EPOCHS, known=model, fast=0.01)


def find(docs: DataFrame, model: dict | None, keep=("doc_id",)) -> DataFrame:
    """keep columns, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans; a row per row.

    Counts and digest are of the base patterns; spans lists all spans as kind:start:end in code points, comma-joined, and
    n_spans counts them. Null text counts as empty: no spans. Without a model the patterns stand alone. Empty tables,
    repeated rows and extra columns are fine.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def many(texts):
            for base, every in all_spans(m, texts):
                yield (*(sum(k == j for _, k, _ in base) for j in range(BASE)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every))

        return many

    names = [*((f"n_{k}", "long") for k in KINDS[:BASE]), ("base_sha256", "string"), ("spans", "string"), ("n_spans", "long")]
    return map_texts(docs, list(keep), "text", make, names, together=True, rows=TOGETHER)


def redact(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; null text stays null, columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def many(texts):
            for text, (_, spans) in zip(texts, all_spans(m, texts)):
                out, at = [], 0
                for s, k, e in spans:
                    if e > at:
                        out += [text[at : max(s, at)], f"<{KINDS[k].upper()}>"]
                        at = e
                yield (None if text is None else "".join([*out, text[at:]]) if out else text,)

        return many

    rows = map_texts(docs, list(docs.columns), "text", make, [("_redacted", "string")], together=True, rows=TOGETHER)
    return rows.withColumn("text", F.col("_redacted")).select(*docs.columns)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through find, with a tagger fitted on contexts of these documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, fit(docs))
