"""BPE encoding by per-prefix dynamic programming, and decoding.

For a piece of the pre-tokenizer, the tokens that are suffixes of each prefix come from an automaton over the vocabulary
with suffix links (Aho-Corasick: a suffix automaton of the text would report more strings than tokens). The exact encoding of a prefix ends in exactly one token: the one whose
predecessor, the last token of the shorter prefix, stays compatible with it, that is, whose pair would not have been
merged otherwise. One last token is stored per prefix; following the back-pointers from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame

from corpusgrid.llm.text import Cache, map_texts

VOCABULARY = "byte_bpe_50k.json"
#: The public pre-tokenization pattern of byte-level BPE, with Unicode's white space spelled out.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Bytes that a worker remembers of pieces and of pairs of tokens, also from task to task.
CACHE, PAIRS = 64 << 20, 40 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary with its automaton, and caches of bounded size."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        data = json.load(open(path, encoding="utf-8"))
        model, before = data["model"], data.get("pre_tokenizer") or {}
        plain = not data.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        rare = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if not plain or any(model.get(x) for x in rare) or any(t.get(x) for t in data.get("added_tokens", []) for x in flags):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        letter = byte_letters()
        back = {c: b for b, c in letter.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.split = regex.compile(PATTERN).findall
        self.on_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        # bytes are handled as latin-1 strings, a character a byte
        text_of = {i: bytes(back[c] for c in t).decode("latin-1") for t, i in model["vocab"].items() if t not in self.special}
        self.text, self.length = text_of, {i: len(t) for i, t in text_of.items()}
        self.bytes_of = {str(i): t.encode("latin-1") for i, t in text_of.items()} | {str(i): t.encode() for t, i in self.special.items()}
        ids = {t: i for i, t in text_of.items()}
        plain = {t: "".join(chr(back[c]) for c in t) for t in model["vocab"] if t not in self.special}
        self.merge, self.parts = {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = ids[plain[a]], ids[plain[b]], ids[plain[a] + plain[b]]
            self.merge[left, right] = rank
            if whole not in self.parts:
                self.parts[whole] = (rank, left, right)
        # rank of the merge that makes a token; single bytes come before every merge
        self.rank = {i: self.parts[i][0] if i in self.parts else -1 for i in text_of}
        if len({t for t in text_of.values() if len(t) == 1}) < 256:
            raise ValueError(f"{path} does not have a token for every byte")
        self.auto = ahocorasick.Automaton()
        for i, t in text_of.items():
            if len(t) == 1 or i in self.parts:
                self.auto.add_word(t, i)
        self.auto.make_automaton()
        self.fits, self.pieces = Cache(PAIRS), Cache(CACHE)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b is how their joined bytes are encoded: no earlier merge reaches over the border."""
        key = a << 24 | b
        found = self.fits.get(key)
        if found is None:
            found = self.fits.keep(key, self._compatible(a, b), 36)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        # Take the two tokens apart in falling order of merge rank; at each state, the border pair must not merge
        # before the merge that was just undone.
        limit, merge, rank, parts = float("inf"), self.merge, self.rank, self.parts
        while True:
            met = merge.get((a, b))
            if met is not None and met < limit:
                return False
            if rank[a] > rank[b]:
                limit, _, a = parts[a]
            elif rank[b] >= 0:
                # of equal ranks the left merge comes first, so a border merge of this very rank also precedes
                limit, b, _ = parts[b]
                limit += 1
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        """ids of one piece, given as a latin-1 view of its bytes."""
        n = len(piece)
        last = [-1] * (n + 1)
        length, known, found = self.length, self.fits.get, -1
        for end, token in self.auto.iter(piece):  # the tokens that end at a place come longest first
            if end == found:
                continue
            start = end + 1 - length[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known(before << 24 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[end + 1], found = token, end
        out, i = [], n
        while i > 0:
            out.append(last[i])
            i -= length[last[i]]
        return out[::-1]

    def piece(self, piece: str) -> str:
        """ids of a piece, joined by commas."""
        ids = self.encode_piece(piece.encode("utf-8").decode("latin-1"))
        return self.pieces.keep(piece, ",".join(map(str, ids)), 50 + 2 * len(piece) + 4 * len(ids))

    def encode_text(self, text: str) -> str:
        """ids of a text joined by commas; strings of special tokens count as these tokens."""
        out, get, piece = [], self.pieces.get, self.piece
        for part in self.on_special(text) if self.on_special else [text]:
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                out += [get(p) or piece(p) for p in self.split(part)]
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split(",") if i]

    def decode_text(self, ids: str) -> str:
        """Text of ids that are joined by commas, special tokens by their strings."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids) -> str:
        return self.decode_text(",".join(map(str, ids)))


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at path, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, with_decoded: bool = False, keep=("doc_id",)) -> DataFrame:
    """The keep columns, n_tokens, ids_sha256, decoded_sha256, ids (array<int>, with_ids) and decoded text (with_decoded), a row per row.

    Null text counts as empty; an empty text has no ids. Whole texts are encoded, in batches of the reader, and the ids
    of every text are decoded again. path must
    be readable on every worker, as the tokenizer files installed with the cluster's Python are.
    """
    path = path or vocabulary_path()

    def make():
        bpe = load(path)

        def one(text):
            text = text or ""
            ids = bpe.encode_text(text)
            decoded = bpe.decode_text(ids)
            row = (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            return (*row, *([np.array(ids.split(",") if ids else [], dtype=np.int32)] if with_ids else []), *([decoded] if with_decoded else []))

        return one

    names = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    more = [*([("ids", "array<int>")] if with_ids else []), *([("decoded", "string")] if with_decoded else [])]
    return map_texts(docs, list(keep), "text", make, [*names, *more])


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Every row of documents through encode, digests only; nulls and empty tables as told there."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
