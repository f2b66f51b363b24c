"""Removal of long byte strings that an earlier document holds, by distributed prefix doubling.

Positions are ranked by the bytes that follow: the rank of length 16 is named by the pair of the 8 bytes here and 8 on,
that of 32 by the pair of ranks 16 apart, that of 50 by the pair of ranks of 32 at 18 apart. Spark deals and sorts the
names; positions whose string no other document holds leave after each round.

Ranking all positions in each round would move many times the input, so the first rounds rank a sample that loses
nothing: every window of 50 bytes has an anchor, the smallest 16-byte name inside it, chosen from the window's bytes
alone; equal windows have equal anchors at equal offsets. A run is a maximal row of windows with one anchor.

1. Offset 16: the runs, packed, are dealt and sorted by the name of their anchor. Anchors of one document leave (unique
   at 16). Runs equal in all their bytes are settled: all but the smallest document's are covered.
2. Offset 32: of what is left, a half of a run leaves if its 32 bytes left or right of the anchor's edge are unique.
3. Threshold: all windows of the rest are rows of the pair (rank of 32 here, rank of 32 at 18 on), which Spark groups;
   a window is covered if a smaller document holds its pair.

Ranks have 64 bits. A removal rests on at least 96 bits in step 1 (the anchor's name and the run's) and in step 3 (the
pair, its second rank cut to 32 bits), so that at 100 TB (6e12 runs) a false match has a chance below 1e-3.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.session import broadcast_if_small, stage, unstage

LENGTH, K = 50, 16
SPAN = LENGTH - K + 1  # 16-byte names in a window
#: Bytes named at a time; records of runs that a task holds before it deals them out; records aimed at in a bucket.
SEGMENT, HOLD, BUCKET = 1 << 20, 1 << 19, 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FIELDS = (("name", np.uint32), ("run", np.uint64), ("left", np.uint16), ("right", np.uint16), ("doc", np.int64), ("lo", np.int64), ("at", np.uint8), ("more", np.uint8))
#: Further places of a shipped run in its own document: record, bytes from the place before, how often in a row.
PLACES = (("owner", np.int32), ("step", np.int64), ("times", np.int32))
#: A span of windows in one number: first window, windows after it (under 64), whether it is asked for or covered.
WIDE = 64


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64-bit name of a pair of names."""
    h = (x ^ (x >> np.uint64(32))) * _A + y * _B
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def names(data: np.ndarray) -> dict[int, np.ndarray]:
    """Names of 16, 32 and 50 bytes at every position of data (uint8, at least 50 long) that has so many bytes."""
    n8 = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    n16 = _pair(n8[:-8], n8[8:])
    n32 = _pair(n16[:-16], n16[16:])
    return {16: n16, 32: n32, 50: _pair(n32[:-18], n32[18:])}


def runs(data: np.ndarray, valid: np.ndarray) -> tuple:
    """Runs of the valid windows of data: (first window, last window, anchor, names)."""
    n = names(data)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    packed = (n[16] >> bits << bits) | np.arange(len(n[16]), dtype=np.uint64)
    m, width = packed, 1
    while width * 2 <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (SPAN - width)], m[SPAN - width :])
    anchor = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] & ~valid[:-1])
    first = np.nonzero(new & valid)[0]
    # a run ends where the next one starts or validity ends
    stop = np.ones(len(anchor), dtype=bool)
    stop[:-1] = new[1:] | (valid[:-1] & ~valid[1:])
    last = np.nonzero(stop & valid)[0]
    return first, last, anchor[first], n


def records(texts: list[tuple[int, int, bytes]]) -> list[dict[str, np.ndarray]]:
    """Records of the runs of documents (doc_id, base, bytes), in segments of at most about SEGMENT bytes."""
    out, part, size = [], [], 0

    def close():
        nonlocal part, size
        if part:
            data = np.frombuffer(b"".join(b for _, _, b in part), dtype=np.uint8)
            if len(data) >= LENGTH:
                starts = np.cumsum([0, *(len(b) for _, _, b in part)])
                valid = np.zeros(len(data) - LENGTH + 1, dtype=bool)
                for s, e in zip(starts, starts[1:]):
                    valid[s : max(s, e - LENGTH + 1)] = True
                lo, hi, at, n = runs(data, valid)
                which = np.searchsorted(starts, lo, side="right") - 1
                cut = at - (SPAN // 2)  # windows up to here hold the 32 bytes that end with the anchor's name
                left = np.where(lo <= cut, n[32][np.maximum(at - 16, 0)] | np.uint64(1), np.uint64(0)).astype(np.uint16)
                right = np.where(hi >= cut, n[32][np.minimum(at, len(n[32]) - 1)] | np.uint64(1), np.uint64(0)).astype(np.uint16)
                out.append({
                    "key": n[16][at], "run": _pair(_pair(n[50][lo], n[50][hi]), ((hi - lo) * 64 + (at - lo)).astype(np.uint64)), "left": left, "right": right,
                    "doc": np.array([d for d, _, _ in part])[which], "lo": lo - starts[which] + np.array([o for _, o, _ in part])[which],
                    "at": (at - lo).astype(np.uint8), "more": (hi - lo).astype(np.uint8),
                })
        part, size = [], 0

    for doc, base, data in texts:
        for low in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
            piece = data[low : low + SEGMENT + LENGTH - 1]
            if len(piece) >= LENGTH:
                if size + len(piece) > SEGMENT:
                    close()
                part.append((doc, base + low, piece))
                size += len(piece)
    close()
    return out


def _spans(doc: np.ndarray, lo: np.ndarray, more: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    """Rows (doc_id, span) of spans of windows, by document."""
    span = (lo.astype(np.int64) * WIDE + more) * 2 + asked
    order = np.lexsort((span, doc))
    return pa.RecordBatch.from_arrays([pa.array(doc[order]), pa.array(span[order])], ["doc_id", "span"])


def _marked(span: np.ndarray, asked: int, base: int, n: int) -> np.ndarray:
    """Which of a text's n windows its covered (0) or asked (1) spans hold."""
    mark = np.zeros(n + 1, dtype=np.int32)
    span = span[(span & 1) == asked] >> 1
    lo, more = span // WIDE - base, span % WIDE
    own = (lo >= 0) & (lo < n)
    np.add.at(mark, lo[own], 1)
    np.add.at(mark, (lo + more)[own] + 1, -1)
    return np.cumsum(mark)[:n] > 0


def _pack_places(owner: np.ndarray, lo: np.ndarray, base: np.ndarray) -> dict[str, np.ndarray]:
    """PLACES of further places lo, sorted by owner and place; base has the first place of every owner."""
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    step = lo - np.where(same, np.concatenate([[0], lo[:-1]]), base[owner])
    new = np.nonzero(~same | np.concatenate([[True], step[1:] != step[:-1]]))[0] if len(owner) else np.zeros(0, dtype=int)
    return {k: v.astype(t) for (k, t), v in zip(PLACES, (owner[new], step[new], np.diff([*new, len(owner)])))}


def _unpack_places(p: dict[str, np.ndarray], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, lo) of packed places, by owner."""
    owner, total = np.repeat(p["owner"], p["times"]), np.cumsum(np.repeat(p["step"], p["times"]), dtype=np.int64)
    if not len(owner):
        return owner.astype(np.int64), total
    first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    before = np.concatenate([[0], total])[first]
    return owner.astype(np.int64), total - np.repeat(before, np.diff([*first, len(owner)])) + base[owner]


def _deal(buckets: int):
    """Mapper: documents -> rows (bucket, packed fields). Of equal runs that a task holds, only the smallest document's
    goes on, with all its places in that document; the others are known to be covered and travel in bucket -1."""

    def flush(held):
        if not held:
            return
        r = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order = np.lexsort((r["lo"], r["doc"], r["run"]))
        run, doc = r["run"][order], r["doc"][order]
        first = np.concatenate([[True], run[1:] != run[:-1]])
        least = doc[first][np.cumsum(first) - 1]
        repeat = doc != least
        # of several equal runs in the smallest document, one is shipped with the places of the others
        ship = order[first]
        more = order[repeat]
        again = ~first & ~repeat
        again = again & (r["lo"][order] != np.concatenate([[-1], r["lo"][order][:-1]]))  # rows that repeat a doc_id repeat its places
        bucket = (r["key"][ship] % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((ship, bucket))
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        ship, bucket = ship[by], bucket[by]
        owner, lo = rank[(np.cumsum(first) - 1)[again]], r["lo"][order[again]].astype(np.int64)
        at = np.lexsort((lo, owner))
        places = _pack_places(owner[at], lo[at], r["lo"][ship].astype(np.int64))
        edge = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
        fields = {k: r[k][ship].astype(t) if k != "name" else (r["key"][ship] >> np.uint64(32)).astype(t) for k, t in FIELDS}
        if len(more):
            yield -1, more, r, None
        for a, b in zip(edge, [*edge[1:], len(ship)]):
            x, y = np.searchsorted(places["owner"], [a, b])
            yield int(bucket[a]), slice(a, b), fields, {k: v[x:y] - (a if k == "owner" else 0) for k, v in places.items()}

    def run(batches):
        held, size = [], 0

        def emit():
            rows = []
            for bucket, at, f, places in flush(held):
                empty = {k: b"" for k, _ in FIELDS + PLACES}
                if bucket < 0:
                    empty |= {"doc": f["doc"][at].astype(np.int64).tobytes(), "lo": f["lo"][at].tobytes(), "more": f["more"][at].astype(np.uint8).tobytes()}
                    # spread what passes through over all buckets
                    rows.append((-1 - int(f["run"][at[0]] % np.uint64(buckets)), empty))
                else:
                    rows.append((bucket, {k: f[k][at].tobytes() for k, _ in FIELDS} | {k: places[k].astype(t).tobytes() for k, t in PLACES}))
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int64()), *(pa.array([x[k] for _, x in rows], pa.binary()) for k, _ in FIELDS + PLACES)], ["bucket", *(k for k, _ in FIELDS + PLACES)]
            )

        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                for r in records([x for x in zip(*(part.column(c).to_pylist() for c in ("doc_id", "base", "text"))) if len(x[2]) >= LENGTH]):
                    held.append(r)
                    size += len(r["doc"])
                if size >= HOLD:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return run


def _settle(batches):
    """Reducer of sorted buckets: -> (doc_id, span), a row for each span that is covered or asked for."""
    held, now = [], None

    def close():
        r = {k: np.concatenate([np.frombuffer(h[k], dtype=t) for h in held]) for k, t in FIELDS}
        if now < 0:  # known to be covered
            return _spans(r["doc"], r["lo"], r["more"], 0)
        p = {k: np.concatenate([np.frombuffer(h[k], dtype=t) for h in held]) for k, t in PLACES}
        sizes = [len(h["at"]) // np.dtype(dict(FIELDS)["at"]).itemsize for h in held]
        p["owner"] = p["owner"] + np.repeat(np.cumsum([0, *sizes[:-1]]), [len(h["owner"]) // 4 for h in held])
        order = np.lexsort((r["doc"], r["run"], r["name"]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        r = {k: v[order] for k, v in r.items()}
        name, run, doc = r["name"], r["run"], r["doc"]
        # anchors of one document drop out
        new = np.concatenate([[True], name[1:] != name[:-1]])
        start = np.nonzero(new)[0]
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        keep = several[np.cumsum(new) - 1]
        r = {k: v[keep] for k, v in r.items()}
        name, run, doc = r["name"], r["run"], r["doc"]
        if not len(doc):
            return None
        held_on = keep[rank[p["owner"]]]
        p = {k: v[held_on] for k, v in p.items()}
        p["owner"] = (np.cumsum(keep) - 1)[rank[p["owner"]]]
        owner, place = _unpack_places(p, r["lo"])
        by = np.argsort(owner, kind="stable")
        owner, place = owner[by], place[by]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (name[1:] != name[:-1])])
        least = doc[new][np.cumsum(new) - 1]
        done = np.nonzero(doc != least)[0]
        # one run of each content remains; its halves are asked for if their 32 bytes occur in another run
        rest = np.nonzero(new)[0]
        lo, hi, cut = r["lo"], r["lo"] + r["more"], r["lo"] + r["at"] - SPAN // 2
        asked = []
        for side, a, b in (("left", lo, np.minimum(hi, cut)), ("right", np.maximum(lo, cut), hi)):
            key = name[rest].astype(np.uint64) << np.uint64(16) | r[side][rest]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            some = rest[(r[side][rest] > 0) & (count[inverse] > 1)]
            there = np.isin(owner, some)  # what is asked of a run is asked at all its places
            shift = place[there] - lo[owner[there]]
            some = np.concatenate([some, owner[there]])
            shift = np.concatenate([np.zeros(len(some) - len(shift), dtype=np.int64), shift])
            asked.append((doc[some], a[some] + shift, b[some] + shift))
        there = np.isin(owner, done)
        also = owner[there]
        sure = (np.concatenate([doc[done], doc[also]]), np.concatenate([lo[done], place[there]]), np.concatenate([hi[done], place[there] + r["more"][also]]))
        docs, los, his = (np.concatenate(x) for x in zip(sure, *asked))
        return _spans(docs, los, his - los, np.repeat([0, 1], [len(sure[0]), len(docs) - len(sure[0])]))

    for b in batches:
        for row in b.to_pylist():
            if row["bucket"] != now and held:
                out = close()
                if out is not None and out.num_rows:
                    yield out
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        out = close()
        if out is not None and out.num_rows:
            yield out


def _ask(batches):
    """Documents with asked spans -> rows (here, on, doc_id, at) of the windows that are not covered already."""
    for b in batches:
        for low in range(0, b.num_rows, 200):
            part = b.slice(low, 200)
            ids, ats, here, on = [], [], [], []
            for i, (doc, base, text) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "base", "text")))):
                n, span = len(text) - LENGTH + 1, part.column("spans")[i].values.to_numpy(zero_copy_only=False)
                at = np.nonzero(_marked(span, 1, base, n) & ~_marked(span, 0, base, n))[0]
                if len(at):
                    pair = np.empty((2, len(at)), dtype=np.uint64)
                    for s in range(0, n, SEGMENT):
                        x, y = np.searchsorted(at, [s, s + SEGMENT])
                        if y > x:
                            rank = names(np.frombuffer(text, dtype=np.uint8, count=min(SEGMENT + LENGTH - 1, len(text) - s), offset=s))[32]
                            pair[:, x:y] = rank[at[x:y] - s], rank[at[x:y] - s + LENGTH - 32]
                    ids.append(np.full(len(at), doc, dtype=np.int64))
                    ats.append(at + base)
                    here.append(pair[0])
                    on.append(pair[1])
            if ids:
                columns = [np.concatenate(here).view(np.int64), (np.concatenate(on) >> np.uint64(32)).astype(np.uint32).view(np.int32), np.concatenate(ids), np.concatenate(ats)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["here", "on", "doc_id", "at"])


def _cut(batches):
    """Documents with covered windows -> what is left of them."""
    for b in batches:
        for low in range(0, b.num_rows, 200):
            part = b.slice(low, 200)
            rows = []
            for i, (base, text) in enumerate(zip(part.column("base").to_pylist(), part.column("text").to_pylist())):
                span, found = (np.zeros(0, dtype=np.int64) if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in (part.column("spans")[i], part.column("found")[i]))
                data, n = np.frombuffer(text, dtype=np.uint8), len(text) - LENGTH + 1
                window = _marked(span, 0, base, n)
                found = found - base
                window[found[(found >= 0) & (found < n)]] = True
                mark = np.zeros(len(data) + 1, dtype=np.int32)
                mark[:n] += window
                mark[LENGTH:] -= window
                gone = np.cumsum(mark)[:-1] > 0
                left = data[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("base"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                ["doc_id", "base", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def _with_base(whole: DataFrame) -> DataFrame:
    """Adds base: where a row's text begins among the different texts of its doc_id, laid end to end; 0 for most rows."""
    each = whole.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("_t"), (F.octet_length("text") + 1).cast("long").alias("_n"))
    repeated = each.groupBy("doc_id").agg(F.min("_t").alias("a"), F.max("_t").alias("b")).where("a <> b").select("doc_id")
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    bases = each.join(broadcast_if_small(stage(repeated, "repeated")), "doc_id", "left_semi").distinct().select("doc_id", "_t", F.coalesce(before, F.lit(0)).alias("base"))
    bases = broadcast_if_small(stage(bases, "bases"))
    return whole.withColumn("_t", F.xxhash64("text")).join(bases, ["doc_id", "_t"], "left").drop("_t").withColumn("base", F.coalesce("base", F.lit(0)))


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_kept, kept (binary): one row per row.

    A byte goes if it lies in a string of 50 bytes of its text that also starts in a document with a smaller doc_id;
    strings are judged on the input. doc_id is an integer. Rows that share one, with equal or different texts, never
    cover each other, and each covers larger ids. Null text counts as empty. A row with a null doc_id keeps all its
    bytes and covers nothing. Texts under 50 bytes, and empty tables, pass through.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id orders the documents and must be an integer, not {kind}")
    whole = _with_base(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")))
    long_ones = whole.where(f"doc_id is not null and octet_length(text) >= {LENGTH}")
    total = long_ones.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total // 18 // BUCKET)
    kinds = ", ".join(f"{k} binary" for k, _ in FIELDS + PLACES)
    dealt = long_ones.mapInArrow(_deal(buckets), f"bucket long, {kinds}").repartition("bucket").sortWithinPartitions("bucket")
    settled = stage(dealt.mapInArrow(_settle, "doc_id long, span long"), "settled")  # each step is staged, so that its shuffles are gone before the next one's
    pieces = stage(settled.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), "pieces")
    unstage(settled)
    texts = long_ones.dropDuplicates(["doc_id", "base"])
    asked = pieces.where(F.exists("spans", lambda s: s.bitwiseAND(F.lit(1)) == 1))
    windows = stage(texts.join(asked, "doc_id").select("doc_id", "base", "text", "spans").mapInArrow(_ask, "here long, on int, doc_id long, at long"), "windows")
    least = windows.groupBy("here", "on").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").drop("most")
    least = stage(least, "least")
    found = stage(windows.join(least, ["here", "on"]).where("doc_id <> least").groupBy("doc_id").agg(F.collect_list("at").alias("found")), "found")
    unstage(windows, least)
    sure = pieces.where(F.exists("spans", lambda s: s.bitwiseAND(F.lit(1)) == 0))
    ready = texts.join(sure.join(found, "doc_id", "full"), "doc_id")
    cut = ready.select("doc_id", "base", "text", "spans", "found").mapInArrow(_cut, "doc_id long, base long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = cut if with_kept else cut.drop("kept")
    base = whole.select("doc_id", "base", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"), *(["text"] if with_kept else []))
    out = base.join(cut, ["doc_id", "base"], "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"), *([F.coalesce("kept", "text").alias("kept")] if with_kept else []),
    )


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through remove_repeats; nulls, repeated ids and empty tables as told there."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
