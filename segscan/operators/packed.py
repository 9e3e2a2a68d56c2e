"""Several values packed in one field: one row per value, position kept.

The work happens on the Arrow buffers of a whole batch at once: quote parity by a
running count per row, one delimiter mask over all bytes, child offsets from the
edges of the mask, then list arrays that are flattened with their parents' ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Bytes and byte sequences that part two values outside quote marks.
DELIMITERS = b",;|/\\&+ \t\n\r\x0b\x0c"
WIDE_DELIMITERS = tuple(s.encode() for s in ("，", "；", "、", "｜", "／", "·", "\u3000", "\u00a0", "\u2009"))
BRACKETS = {ord("["): ord("]"), ord("("): ord(")"), ord("{"): ord("}")}
# Words for "nothing", in lower case.
NOTHING = ("", "na", "n/a", "n.a.", "#n/a", "nan", "none", "null", "nil", "nothing", "empty", "missing", "-", "--", "–", "—", ".", "..", "?")

_IS_DELIMITER = np.zeros(256, bool)
_IS_DELIMITER[list(DELIMITERS)] = True
_DOUBLE, _SINGLE = ord('"'), ord("'")


def _odd_before(marks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether an odd number of marks stands in its row up to it; for each row their number."""
    upto = np.concatenate(([0], np.cumsum(marks)))
    before_row = upto[starts]
    return (upto[1:] - np.repeat(before_row, lengths)) & 1 == 1, upto[starts + lengths] - before_row


def _word(data: np.ndarray, free: np.ndarray, edge: np.ndarray, word: bytes) -> np.ndarray:
    """Where ``word`` stands outside quotes in any case between two edges; edge[i]: something ends before byte i."""
    n, k = len(data), len(word)
    at = np.zeros(n, bool)
    if n >= k:
        lower = data | 0x20 * ((data >= 65) & (data <= 90))
        hit = edge[: n - k + 1] & edge[k:]
        for i, b in enumerate(word):
            hit &= (lower[i : n - k + 1 + i] == b) & free[i : n - k + 1 + i]
        at[: n - k + 1] = hit
    return at


def split_values(column: pa.Array) -> pa.ListArray:
    """The values of each field as a list array (empty for null and for words for nothing).

    Commas, semicolons (also wide ones), bars, slashes, ampersands, plus signs, white space and the word
    "and" part values. What stands in double or single quote marks is one value; a doubled mark in it means
    one. A double mark that is never closed quotes up to the end of the field; an odd single mark is an apostrophe.
    Brackets around the whole list, also ``c(...)``, are dropped. A value loses outer white space, its
    quote marks and a leading chr.
    """
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1] if rows else np.zeros(1, np.int64)
    if rows == 0 or offsets[-1] == offsets[0]:
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.string()))
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    row_of = np.repeat(np.arange(rows), lengths)
    n = len(data)

    in_double, _ = _odd_before(data == _DOUBLE, starts, lengths)
    single = (data == _SINGLE) & ~in_double
    in_single, singles = _odd_before(single, starts, lengths)
    free = ~in_double & ~(in_single & (singles % 2 == 0)[row_of])

    gap = _IS_DELIMITER[data] & free
    for seq in WIDE_DELIMITERS:
        k = len(seq)
        if n >= k:
            hit = np.flatnonzero(np.logical_and.reduce([data[i : n - k + 1 + i] == b for i, b in enumerate(seq)]) & free[: n - k + 1])
            for i in range(k):
                gap[hit + i] = True
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    for word in (b"n/a", b"and"):
        edge = first.copy()
        edge[1:] |= gap
        edge[:-1] |= gap
        hit = np.flatnonzero(_word(data, free, edge, word))
        for i in range(len(word)):
            gap[hit + i] = True

    for _ in range(2):  # brackets around the list, at most two layers
        solid = np.flatnonzero(~gap)
        if not len(solid):
            break
        lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, starts + lengths)
        full = np.flatnonzero(hi - lo >= 2)
        if not len(full):
            break
        a, b = solid[lo[full]], solid[hi[full] - 1]
        c_call = ((data[a] | 0x20) == ord("c")) & (a + 1 < b) & (data[np.minimum(a + 1, n - 1)] == ord("("))
        opening = np.where(c_call, np.minimum(a + 1, n - 1), a)
        closed = np.zeros(len(full), bool)
        for left, right in BRACKETS.items():
            closed |= (data[opening] == left) & (data[b] == right)
        gap[opening[closed]] = True
        gap[b[closed]] = True
        gap[a[closed & c_call]] = True

    solid = ~gap
    begins = np.flatnonzero(solid & np.concatenate(([True], gap[:-1])) | (solid & first[:-1]))
    after = np.concatenate((gap[1:], [True])) | first[1:]
    ends = np.flatnonzero(solid & after) + 1
    parent = row_of[begins]
    for mark in (_DOUBLE, _SINGLE):
        whole = (data[begins] == mark) & (data[np.maximum(ends - 1, 0)] == mark) & (ends - begins >= 2)
        begins, ends = begins + whole, ends - whole
        if mark == _DOUBLE:
            doubled = whole
    sizes = ends - begins
    taken = np.zeros(n + 1, np.int64)
    np.add.at(taken, begins, 1)
    np.add.at(taken, ends, -1)
    bytes_ = data[np.cumsum(taken[:-1]) > 0]
    values = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(bytes_))).cast(pa.string())
    values = pc.if_else(pa.array(doubled), pc.replace_substring(values, '""', '"'), values)
    values = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_trim_whitespace(values), "^(?i:chr)", ""))
    real = ~pc.is_in(pc.utf8_lower(values), pa.array(NOTHING)).to_numpy(zero_copy_only=False)
    per_row = np.bincount(parent[real], minlength=rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)), values.filter(pa.array(real)))


def unpack(df: DataFrame, field: str, value: str = "value", position: str = "pos") -> DataFrame:
    """One row per value of ``field``: the other columns of ``df``, the position from 1, and the value.

    Fields that are null, empty or say nothing give no row; repeated values count again. A column of ``df``
    named like one of the two new ones raises ValueError.
    """
    others = [c for c in df.columns if c != field]
    if clash := {value, position} & set(others):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(position, T.IntegerType()), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_values(batch.column(batch.schema.get_field_index(field)))
            parents = pc.list_parent_indices(lists).to_numpy()
            ordinal = np.arange(len(parents)) - lists.offsets.to_numpy()[parents] + 1
            rest = batch.select(others).take(pa.array(parents))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(ordinal.astype(np.int32)), pc.list_flatten(lists)], names=[*others, position, value])

    return df.mapInArrow(run, schema)
