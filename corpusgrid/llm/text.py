"""Column expressions shared by the text operators. Null text counts as empty everywhere."""

from __future__ import annotations

from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Separator of words: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows, and bytes of text, of a batch that are in Python at a time (a longer text comes alone).
SLICE, SLICE_BYTES = 256, 1 << 21


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09-\\x0D; empty array for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lowered(text: Column) -> Column:
    """Text with only A-Z in lower case; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(*keys: Column) -> Column:
    """Deterministic number in [0, 1) from the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


class Cache(dict):
    """Remembers values while their sizes add up to `limit` bytes; then the older half goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.used = limit, 0

    def keep(self, key, value, size: int):
        """value, remembered if it is small; size is about what key and value take, without the entry itself."""
        size += 150
        if size <= self.limit >> 4:
            if self.used + size > self.limit:
                for k in list(islice(self, (len(self) + 1) // 2)):
                    del self[k]
                self.used >>= 1
            self.used += size
            self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.used = 0


def slices(batch: pa.RecordBatch, column: str, rows: int = SLICE):
    """Parts of a batch of at most `rows` rows and, unless a row is longer by itself, SLICE_BYTES of the column."""
    upto = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
    low = 0
    while low < batch.num_rows:
        before = upto[low - 1] if low else 0
        high = min(low + rows, max(low + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right"))))
        yield batch.slice(low, high - low)
        low = high


def map_texts(df: DataFrame, pass_on: list[str], column: str, make, names: list[tuple[str, str]], together: bool = False, rows: int = SLICE) -> DataFrame:
    """Arrow batches of df through Python: pass_on columns unchanged, then the values that make()(text) returns.

    make is called once a task and returns the function of a text, whose close(), if it has one, is called at the
    task's end; names are the new columns with their SQL types. With together, the function takes a list of up to `rows` texts.
    """
    ddl = [f"`{n}` {t}" for n, t in names]
    schema = StructType([*(df.schema[c] for c in pass_on), *StructType.fromDDL(", ".join(ddl))])
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    types = [arrow[t] for _, t in names]

    most = rows

    def run(batches):
        f = make()
        try:
            for whole in batches:
                for b in slices(whole, column, most):  # bounds what is held in Python objects
                    texts = b.column(column).to_pylist()
                    rows = list(f(texts)) if together else [f(t) for t in texts]
                    own = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in pass_on), *own], [*pass_on, *(n for n, _ in names)])
        finally:
            getattr(f, "close", lambda: None)()

    return df.select(*dict.fromkeys([*pass_on, column])).mapInArrow(run, schema)


def word_table(kept: str) -> bytes:
    """Table for bytes.translate: A-Z to lower case, ASCII characters other than kept and all letters to spaces."""
    return bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or chr(c) in kept else 32 for c in range(256))


def word_counts(text: bytes, table: bytes, size: int = 1 << 20) -> Counter:
    """How often each word of a text (UTF-8) occurs; long texts are cut at spaces, so that only `size` bytes are in pieces."""
    text, found, at = text.translate(table), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def list_array(lists: list, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists from sequences of values, without a Python list of them all."""
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(chain.from_iterable(lists), kind))
