"""Queries of augmentation and lexicon jobs over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgrid.functions import augment as A
from corpusgrid.functions import expr as T
from corpusgrid.operators import grammar as N
from corpusgrid.operators import lexicon as L
from corpusgrid.operators import resolve as J
from corpusgrid.operators.grammar import Grammar
from corpusgrid.plans import fixtures as X
from corpusgrid.plans.registry import query
from corpusgrid.plans.scenes import J1_SQL
from corpusgrid.plans.text import WORDS
from corpusgrid.session import stage


def sql_coin(*parts: str) -> str:
    return f"(('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:8])::BIGINT / 4294967296.0)"


def _typo_sql(w: str, rate: float, seed: str, key: str, i: str) -> str:
    c = lambda k: sql_coin(f"'{seed}'", key, i, f"'{k}'")
    at = f"(floor({c('at')} * (length({w}) - 2)) + 2)::BIGINT"
    return f"""CASE WHEN length({w}) >= 4 AND {c('hit')} < {rate} THEN CASE WHEN {c('kind')} < 0.5 OR {at} <= 2 THEN {w}[1:{at} - 1] || {w}[{at} + 1:] ELSE {w}[1:{at} - 2] || {w}[{at}] || {w}[{at} - 1] || {w}[{at} + 1:] END ELSE {w} END"""


def typos_sql(text: str, rate: float, seed: str, key: str) -> str:
    return f"array_to_string([{_typo_sql('w[i]', rate, seed, key, '(i - 1)')} for i in range(1, len(w) + 1)], ' ')"


_BARE = r"regexp_replace(text, '[.,!?;:()\[\]]', '', 'g')"


@query(rf"""WITH c AS (SELECT conv_id * 1000 + turn AS id, text, string_split(text, ' ') w FROM conversations)
SELECT id, 'no_accents' AS variant, strip_accents(replace(lower(text), 'đ', 'd')) AS text FROM c UNION ALL SELECT id, 'no_punctuation', {_BARE} FROM c UNION ALL SELECT id, 'plain', lower({_BARE}) FROM c
UNION ALL SELECT id, 'typos_5', {typos_sql('text', 0.05, 't5', 'id')} FROM c UNION ALL SELECT id, 'typos_15', {typos_sql('text', 0.15, 't15', 'id')} FROM c""")
def t12_stress_variants(t):
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return A.stress_variants(c, "id", "text")


@query(rf"""WITH a AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), b AS (SELECT id, string_split(CASE WHEN {sql_coin("'bare'", 'id')} < 0.3 THEN regexp_replace(text, '[.,!?;:]', '', 'g') ELSE text END, ' ') w, floor({sql_coin("'rate'", 'id')} * 5) p FROM a),
c AS (SELECT id, CASE p WHEN 2 THEN {typos_sql('', 0.03, 'n', 'id')} WHEN 3 THEN {typos_sql('', 0.06, 'n', 'id')} WHEN 4 THEN {typos_sql('', 0.1, 'n', 'id')} ELSE array_to_string(w, ' ') END x FROM b)
SELECT id, md5(CASE WHEN {sql_coin("'case'", 'id')} < 0.2 THEN lower(x) WHEN {sql_coin("'case'", 'id')} < 0.3 THEN upper(replace(x, 'ß', 'SS')) ELSE x END) AS noisy FROM c""")
def t13_noise(t):
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return c.select("id", F.md5(A.noise(F.col("text"), F.col("id"))).alias("noisy"))


ALIASES = {"size": ["large", "big", "huge"], "colour": ["red", "blue", "green"]}


def _swap_sql(text: str, name: str, key: str, rate: float) -> str:
    pattern = r"\b(?:" + "|".join(sorted(ALIASES[name], key=len, reverse=True)) + r")\b"
    pick = f"{ALIASES[name]}[floor({sql_coin(repr('alias'), repr(name), key)} * {len(ALIASES[name])})::BIGINT + 1]"
    return f"CASE WHEN {sql_coin(repr('swap'), repr(name), key)} < {rate} AND regexp_matches({text}, '{pattern}') THEN regexp_extract({text}, '(?s)^(.*?){pattern}', 1) || {pick} || regexp_extract({text}, '(?s)^.*?{pattern}(.*)$', 1) ELSE {text} END"


@query(f"""WITH p AS (SELECT p_partkey, lower(p_name) || ' large red box' x FROM part), a AS (SELECT p_partkey, x, replace(x, 'red box', chr(2) || '0' || chr(3)) y FROM p), b AS (SELECT p_partkey, x, {_swap_sql('y', 'size', 'p_partkey', 0.7)} y FROM a)
SELECT p_partkey, x, replace({_swap_sql('y', 'colour', 'p_partkey', 0.7)}, chr(2) || '0' || chr(3), 'red box') AS swapped FROM b""")
def t14_alias_swap(t):
    """Hashed choice among aliases; tests check keys, blocked phrases and reruns."""
    p = t.part.select("p_partkey", F.concat(F.lower("p_name"), F.lit(" large red box")).alias("x"))
    return p.select("p_partkey", "x", A.alias_swap(F.col("x"), ALIASES, F.col("p_partkey"), 0.7, ["red box"]).alias("swapped"))


@query("""WITH p(o, old, new) AS (VALUES (1, 'all rights reserved', 'some rights reserved'), (2, 'licensed under', 'released under'), (3, 'version 2.0', 'version 3.0')), d AS (SELECT doc_id, lower(text) x FROM documents),
h AS (SELECT doc_id, count(*) n, min(o) o, arg_min(old, o) old, arg_min(new, o) new FROM d JOIN p ON contains(x, old) OR contains(strip_accents(replace(x, 'đ', 'd')), old) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS hits, CASE WHEN n = 1 THEN o END AS patch, md5(CASE WHEN n = 1 THEN CASE WHEN contains(x, old) THEN replace(x, old, new) ELSE replace(strip_accents(replace(x, 'đ', 'd')), old, new) END ELSE x END) AS patched FROM d LEFT JOIN h USING (doc_id)""")
def t15_phrase_patches(t):
    p = t.spark.createDataFrame([(1, "all rights reserved", "some rights reserved"), (2, "licensed under", "released under"), (3, "version 2.0", "version 3.0")], "ord int, old string, new string")
    d = t.documents.select("doc_id", F.lower("text").alias("x"))
    return A.phrase_patches(d, p, "x").select("doc_id", "hits", "patch", F.md5("patched").alias("patched"))


@query("SELECT doc_id, contains(lower(text), 'trash') OR contains(lower(text), 'scum') AS matched, md5(replace(replace(lower(text), 'trash', 'waste'), 'scum', 'foam')) AS text FROM documents")
def t16_ablation(t):
    x = t.documents.select("doc_id", A.ablate(F.lower("text"), {"trash": "waste", "scum": "foam"}).alias("a"))
    return x.select("doc_id", "a.matched", F.md5("a.text").alias("text"))


@query(rf"""WITH s AS (SELECT conv_id, turn, conv_id * 1000 + turn k, [y for y in [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split_regex(text, '[.!?;()\[\]]')] if y <> ''] s FROM conversations),
f AS (SELECT conv_id, turn, k, s, [s[i] for i in range(1, len(s) + 1) if NOT (regexp_matches(s[i], '\bnot\b') AND {sql_coin("'drop'", 'k', '(i - 1)')} < 0.5)] l FROM s), a AS (SELECT *, floor({sql_coin("'turn'", 'k')} * len(l))::BIGINT at_ FROM f)
SELECT conv_id, turn, array_to_string(CASE WHEN len(l) > 0 THEN l[at_ + 1:] || l[1:at_] ELSE s END, '. ') AS text FROM a""")
def t17_drop_and_reorder(t):
    """Hashed dropout of clauses; tests check that only optional clauses go."""
    x = t.conversations.select("conv_id", "turn", T.sentences(F.col("text")).alias("s"))
    return x.select("conv_id", "turn", F.array_join(A.drop_and_reorder(F.col("s"), r"\bnot\b", 0.5, F.col("conv_id") * 1000 + F.col("turn")), ". ").alias("text"))


@query(f"""WITH s AS (SELECT s_suppkey pos0, row_number() OVER (ORDER BY s_suppkey) - 1 pos, s_name v FROM supplier), p AS (SELECT p_partkey k, 'send ' || p_name || ' by {{who}}' f, floor({sql_coin("'slot'", "'who'", 'p_partkey')} * (SELECT count(*) FROM supplier))::BIGINT pos FROM part)
SELECT k, replace(f, '{{who}}', v) AS text FROM p JOIN s USING (pos)""")
def t18_render(t):
    from corpusgrid.operators.sample import positions

    frames = t.part.select(F.col("p_partkey").alias("k"), F.concat(F.lit("send "), "p_name", F.lit(" by {who}")).alias("frame"))
    slots = positions(t.supplier.select("s_suppkey", F.col("s_name").alias("value")), "s_suppkey").select((F.col("pos") - 1).alias("pos"), "value")
    return A.render(frames, {"who": slots}, "k").select("k", "text")


@query("SELECT p_partkey, u AS urgent, f AS fragile, concat_ws(' ', p_name, CASE WHEN u THEN 'at once' ELSE 'any time' END, CASE WHEN f THEN 'with care' ELSE 'as it is' END) AS text FROM part, (VALUES (true), (false)) a(u), (VALUES (true), (false)) b(f)")
def t19_toggles(t):
    p = t.part.select("p_partkey", F.col("p_name").alias("text"))
    return A.toggles(p, "p_partkey", {"urgent": ("at once", "any time"), "fragile": ("with care", "as it is")}).drop("group_id")


@query("SELECT item_id FROM benchmark WHERE item_id % 5 = 4")
def t20_holdout_bank(t):
    return A.holdout_bank(t.benchmark, "item_id", True).select("item_id")


def texts(t):
    return t.documents.select("doc_id", F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)).alias("ws"))


def tokens(t):
    return texts(t).select(F.explode("ws").alias("w"))


VOCAB = f"""WITH v AS MATERIALIZED (SELECT w, count(*) n FROM (SELECT unnest({WORDS}) w FROM documents) WHERE regexp_matches(w, '^[a-z]+$') GROUP BY w HAVING count(*) >= 8),
k AS MATERIALIZED (SELECT DISTINCT w, n, unnest(list_append([w[1:i - 1] || w[i + 1:] for i in range(1, length(w) + 1)], w)) k FROM v),
c AS MATERIALIZED (SELECT DISTINCT a.w, b.w big FROM k a JOIN k b ON a.k = b.k WHERE b.n >= 10 * a.n AND a.w <> b.w),
p AS MATERIALIZED (SELECT w, big FROM c WHERE damerau_levenshtein(w, big) <= 1),
o0 AS MATERIALIZED (SELECT NULL::VARCHAR w WHERE false)"""
for _i in range(1, 7):  # words that are out after each round
    VOCAB += f", o{_i} AS MATERIALIZED (SELECT DISTINCT w FROM p ANTI JOIN o{_i - 1} x ON p.big = x.w)"
VOCAB += ", kept AS (SELECT v.w, v.n FROM v ANTI JOIN o6 ON v.w = o6.w)"


@query(VOCAB + " SELECT w, n FROM v WHERE w NOT IN (SELECT w FROM o6)")
def l1_vocabulary(t):
    return L.vocabulary(tokens(t))


@query(VOCAB + f", d AS (SELECT {WORDS} w FROM documents), b AS (SELECT w[i] a, w[i + 1] b FROM (SELECT w, unnest(range(1, len(w))) i FROM d)) SELECT a, b, count(*) AS n FROM b WHERE a IN (SELECT w FROM kept) AND b IN (SELECT w FROM kept) GROUP BY ALL HAVING count(*) >= 3")
def l2_bigrams(t):
    return L.text_bigrams(texts(t), L.vocabulary(tokens(t)), "ws")


TOKENS = r"regexp_extract_all(strip_accents(replace(lower(text), 'đ', 'd')), '[a-z0-9]+|[.,!?;:()\[\]]')"
_SAID = f"SELECT conv_id * 1000 + turn AS row, i - 1 AS pos, w[i] AS w, w[i + 1] AS nxt FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) i FROM (SELECT conv_id, turn, {TOKENS} w FROM conversations))"
_LESS, _SWAP = "unnest([{w}[1:i - 1] || {w}[i + 1:] for i in range(1, length({w}) + 1)])", "unnest([{w}[1:i - 1] || {w}[i + 1] || {w}[i] || {w}[i + 2:] for i in range(1, length({w}))])"
CORRUPTIONS = f"""cd AS MATERIALIZED (SELECT DISTINCT w, cand, n FROM (SELECT s.w, k.cand, k.n FROM sw s JOIN (SELECT w cand, n, {_LESS.format(w='w')} k FROM kept) k ON k.k = s.w
  UNION ALL SELECT s.w, k.w, k.n FROM (SELECT w, {_SWAP.format(w='w')} c FROM sw) s JOIN kept k ON k.w = s.c) WHERE w <> cand)"""
_WORD = "regexp_matches({}, '^[a-z]+$')"
L3 = VOCAB.replace("WITH v", "WITH RECURSIVE v", 1) + f""", d AS (SELECT {WORDS} w FROM documents), b AS MATERIALIZED (SELECT a, b, count(*) n FROM (SELECT w[i] a, w[i + 1] b FROM (SELECT w, unnest(range(1, len(w))) i FROM d)) WHERE a IN (SELECT w FROM kept) AND b IN (SELECT w FROM kept) GROUP BY ALL HAVING count(*) >= 3),
said AS MATERIALIZED (SELECT s.*, k.w IS NOT NULL known FROM ({_SAID}) s LEFT JOIN kept k ON s.w = k.w), sw AS MATERIALIZED (SELECT DISTINCT w FROM said WHERE length(w) >= 2 AND {_WORD.format('w')}), {CORRUPTIONS},
f(row, pos, w, fixed) AS (SELECT DISTINCT row, -1::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM said
  UNION ALL
  SELECT row, pos, w, CASE WHEN best IS NULL THEN w WHEN NOT known THEN best.cand WHEN length(w) >= 3 AND greatest(CASE WHEN lw THEN best.l ELSE 0 END, CASE WHEN rw THEN best.r ELSE 0 END) >= 10
      AND (NOT lw OR best.l >= 10 * l0) AND (NOT rw OR best.r >= 10 * r0) THEN best.cand ELSE w END
  FROM (SELECT s.row, s.pos, s.w, s.known, coalesce({_WORD.format('p.fixed')}, false) lw, coalesce({_WORD.format('s.nxt')}, false) rw, coalesce(max(lo.n), 0) l0, coalesce(max(ro.n), 0) r0,
      max(CASE WHEN c.cand IS NOT NULL THEN struct_pack(t := coalesce(ln.n, 0) + coalesce(rn.n, 0), n := c.n, cand := c.cand, l := coalesce(ln.n, 0), r := coalesce(rn.n, 0)) END) best
    FROM f p JOIN said s ON s.row = p.row AND s.pos = p.pos + 1 LEFT JOIN cd c ON c.w = s.w LEFT JOIN b ln ON ln.a = p.fixed AND ln.b = c.cand LEFT JOIN b rn ON rn.a = c.cand AND rn.b = s.nxt
    LEFT JOIN b lo ON lo.a = p.fixed AND lo.b = s.w LEFT JOIN b ro ON ro.a = s.w AND ro.b = s.nxt GROUP BY s.row, s.pos, s.w, s.known, p.fixed, s.nxt))"""


@query(L3 + " SELECT row, pos, w, fixed FROM f WHERE pos >= 0 AND w <> fixed")
def l3_correct(t):
    """Conversations corrected against the vocabulary of the documents; the twin walks the positions by recursion."""
    v = stage(L.vocabulary(tokens(t)), "vocabulary")
    said = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), F.posexplode(T.tokenize(F.col("text"))).alias("pos", "w"))
    return L.correct(said, v, stage(L.text_bigrams(texts(t), v, "ws"), "bigrams"), "row").where("w <> fixed")


@query(VOCAB + f", sw AS (SELECT DISTINCT w FROM (SELECT unnest({WORDS}) w FROM conversations) WHERE length(w) >= 2), {CORRUPTIONS} SELECT w, cand, n FROM cd")
def t9_corruptions(t):
    """Words of the conversations with the vocabulary words of the documents that a lost letter or a swap turned into them."""
    said = t.conversations.select(F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).where(F.length("w") >= 2)
    return L.corruptions(said.distinct(), stage(L.vocabulary(tokens(t)), "vocabulary"))


KINDS = {"licence": ["general public license", "apache license", "cc by", "license"], "rights": ["all rights reserved"]}


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(lower(text), '\b(?:general public license|all rights reserved|apache license|license|cc by)\b') l FROM documents)
SELECT doc_id, i - 1 AS pos, CASE l[i] WHEN 'all rights reserved' THEN 'rights' ELSE 'licence' END AS kind, l[i] AS phrase FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM m)""")
def l4_mentions(t):
    return t.documents.select("doc_id", F.posexplode(L.mentions(F.lower("text"), KINDS)).alias("pos", "m")).select("doc_id", "pos", "m.kind", "m.phrase")


@query(r"SELECT doc_id, CASE regexp_extract(lower(text), '\b(?:the|a)\s+(?:\w+\s+){0,4}(license|rights)\b', 1) WHEN 'license' THEN 'permission' WHEN 'rights' THEN 'ownership' END AS meaning FROM documents WHERE regexp_matches(lower(text), '\b(?:the|a)\s+(?:\w+\s+){0,4}(license|rights)\b')")
def l5_described(t):
    m = L.described(F.lower("text"), ["the", "a"], {"license": "permission", "rights": "ownership"}, [])
    return t.documents.select("doc_id", m.alias("meaning")).where("meaning is not null")


@query(r"""WITH s AS (SELECT doc_id, i, lower(l[i]) x FROM (SELECT doc_id, string_split_regex(text, '[.!?;()\[\]]') l, unnest(range(1, len(string_split_regex(text, '[.!?;()\[\]]')) + 1)) i FROM documents)),
f AS (SELECT doc_id, i, CASE WHEN regexp_matches(x, 'all rights') THEN true WHEN regexp_matches(x, 'licensed') THEN false WHEN regexp_matches(x, '\b(?:no|not)\s+(?:\w+\s+){0,2}(?:trash|scum)\b') THEN false WHEN regexp_matches(x, '\b(?:trash|scum)\b') THEN true END v FROM s)
SELECT doc_id, coalesce(arg_max(v, i) FILTER (v IS NOT NULL), false) AS flag FROM f GROUP BY doc_id""")
def l6_flags(t):
    s = F.transform(F.split("text", T.ENDS), F.lower)
    return t.documents.select("doc_id", L.read_flag(s, "all rights", "licensed", "trash|scum", "no|not").alias("flag"))


GRAMMAR = Grammar(
    names={"place": {"gate": "gate", "main gate": "gate", "library": "library", "canteen": "canteen", "store": "store"}, "person": {"dr lee": "office"}, "item": {"parcel": "parcel"}},
    heads=["the spot"], stops=["not"], keywords={"eat": "canteen"}, generic="place|building", link="next to|close to", most="of all", extremes={"north_most": "furthest north", "east_most": "furthest east"},
    lead="in the|to the", directions={"north": "north", "west": "west"}, nearer="near|by", farther="far from",
    negate_before="not to|never to|skip", negate_after="is closed|is done", via_before="via|by way of", via_after=r"(?:\w+ )?first",
)
NAMES = ("gate", "library", "canteen", "store")


def mission_texts(t):
    """A mission in words for each order: where to pass or not to pass, then where to bring it, then flags."""
    o = F.col("o_orderkey")
    at = lambda i: F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(o * 7 + i * 5, F.lit(4)) + 1).cast("int"))
    pick = lambda n, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(o, F.lit(n)) + 1).cast("int"))
    c = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    first = pick(4, c("Go via ", at(0)), c("Take ", at(0), " first,"), c("Skip ", at(0)), c(at(0), " is closed"))
    goal = pick(
        8, c("bring the parcel to ", at(2), " near ", at(3)), c("bring it to ", at(2), " in the north"), c("bring it to ", at(2)), "bring it to the place furthest north",
        c("bring it to the place close to ", at(3), " of all"), "hand it to Dr Lee", "bring it to the spot where people eat", c("bring it to ", at(2), ", far from ", at(3)),
    )
    text = c(first, " and not to ", at(1), pick(2, ". Then ", " then "), goal, F.when(o % 5 == 0, ". it is urgent").otherwise(""), F.when(o % 11 == 0, ". not fragile").when(o % 11 == 1, ". fragile").otherwise(""))
    return t.orders.select("o_orderkey", text.alias("text"))


def mission_clauses(t):
    return mission_texts(t).select("o_orderkey", F.posexplode(T.clauses(F.lower("text"), ["then"])).alias("clause", "text"))


def missions(t):
    """One row per mission: goal and via with their qualifiers, and both flags of the whole text."""
    s = F.split(F.lower("text"), T.ENDS)
    flags = mission_texts(t).select("o_orderkey", L.read_flag(s, "at once", "no hurry", "urgent", "not|no").alias("urgent"), L.read_flag(s, "with care", "sturdy", "fragile", "not|no").alias("fragile"))
    return N.parse_job(mission_clauses(t), flags, GRAMMAR, "o_orderkey")


ROLES = f"""o AS (SELECT o_orderkey k, [{list(NAMES)}[(o_orderkey * 7 + i * 5) % 4 + 1] for i in range(0, 4)] n FROM orders),
m AS (SELECT k, 0 clause, 'place' kind, n[1] AS type, NULL::VARCHAR ref, NULL::VARCHAR anchor, CASE WHEN k % 4 < 2 THEN 'via' ELSE 'negated' END role FROM o UNION ALL SELECT k, 0, 'place', n[2], NULL, NULL, 'negated' FROM o
UNION ALL SELECT k, 1, CASE k % 8 WHEN 3 THEN 'north_most' WHEN 4 THEN 'anchor_near' WHEN 5 THEN 'person' ELSE 'place' END, CASE k % 8 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'office' WHEN 6 THEN 'canteen' ELSE n[3] END,
  CASE k % 8 WHEN 0 THEN 'near' WHEN 1 THEN 'north' WHEN 3 THEN 'north_most' WHEN 4 THEN 'anchor_near' WHEN 7 THEN 'far' END, CASE WHEN k % 8 IN (0, 4, 7) THEN n[4] END, 'goal' FROM o),
p AS (SELECT a.k, a.type goal, a.ref goal_ref, a.anchor goal_anchor, CASE WHEN NOT (a.kind = 'place' AND b.type = a.type AND a.ref IS NULL) THEN b.type END via FROM (SELECT * FROM m WHERE role = 'goal') a LEFT JOIN (SELECT * FROM m WHERE role = 'via') b USING (k))"""


@query(f"WITH {ROLES} SELECT k AS o_orderkey, clause, kind, type, ref, anchor, role FROM m")
def l7_roles(t):
    return N.mention_roles(mission_clauses(t), GRAMMAR, "o_orderkey").drop("at")


@query(f"WITH {ROLES} SELECT k AS o_orderkey, goal, via FROM p")
def l8_final_pick(t):
    x = N.final_pick(N.mention_roles(mission_clauses(t), GRAMMAR, "o_orderkey"), "o_orderkey")
    return x.select("o_orderkey", F.col("goal.type").alias("goal"), F.col("via.type").alias("via"))


@query(f"WITH {ROLES} SELECT k AS o_orderkey, goal, goal_ref, goal_anchor, via, NULL::VARCHAR AS via_ref, NULL::VARCHAR AS via_anchor, k % 5 = 0 AS urgent, k % 11 = 1 AS fragile FROM p")
def l9_parse_job(t):
    return missions(t)


@query(X.SQL + f", {ROLES}, specs AS (SELECT k g, goal AS type, goal_ref AS ref, goal_anchor AS anchor FROM p SEMI JOIN graphs ON graphs.g = p.k), {J1_SQL}")
def l9_resolved_targets(t):
    """Goals of the parsed missions, resolved on the lattice that has the mission's number."""
    specs = N.target_specs(missions(t), "o_orderkey").join(X.graphs(t), "g", "left_semi")
    return J.resolve_targets(specs, X.landmarks(t))
