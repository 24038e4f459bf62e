"""Words, lines and row keys shared by the operators.

A word is a run of characters other than space and U+0009 to U+000D; letters
are folded for A to Z only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    parts = F.split(F.coalesce(col, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def row_key(*cols: Column) -> list[Column]:
    """96 bits that name a row by its content: equal rows share them, others don't in practice."""
    return [F.xxhash64(*cols).alias("__lf_k1"), F.hash(*cols).alias("__lf_k2")]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also where a lambda uses it."""
    return F.transform(F.array(value), body)[0]


def rebased(texts: pa.Array) -> pa.Array:
    """The same strings without nulls (null is empty), in buffers that start at their first byte.

    Some Arrow string kernels read a slice from the start of its parent's buffer.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if not texts.offset and not at[0]:
        return texts
    data = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0]))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), data)


def arrow_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of whole texts, in order, and the number of words of each text."""
    texts = rebased(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        ends = np.cumsum(counts)
        counts = before[ends] - before[ends - counts]
        flat = flat.filter(pa.array(full))
    return flat, counts


def split_batch(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Cut a batch into pieces whose texts have about ``most_bytes`` together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
