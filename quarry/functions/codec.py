"""Gaps, running sums and variable-byte codes of integer arrays, over whole Arrow batches.

Each takes time in proportion to its arrays. Lambda functions that look back into an array, or a fold that appends to one,
take the square of its length, and the arrays here are as long as a term has documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the lambda functions in ``body`` read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch without nulls, and the row of each."""
    values, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    if values.null_count:
        known = values.is_valid()
        values, rows = values.filter(known), rows.filter(known)
    return values.to_numpy(zero_copy_only=False).astype(np.int64), rows.to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def gaps(ids: Column) -> Column:
    """First value, then differences, of the sorted array without nulls."""

    @F.arrow_udf("array<bigint>")
    def differences(lists: pa.Array) -> pa.Array:
        values, rows = _flat(lists)
        values = values[np.lexsort((values, rows))]
        out, offsets = np.diff(values, prepend=0), _offsets(rows, len(lists))
        starts = offsets[:-1][np.diff(offsets) > 0]
        out[starts] = values[starts]
        return pc.if_else(lists.is_valid(), _lists(out, offsets), None)

    return differences(ids.cast("array<bigint>"))


def from_gaps(deltas: Column) -> Column:
    """Running sums: the inverse of ``gaps``."""

    @F.arrow_udf("array<bigint>")
    def sums(lists: pa.Array) -> pa.Array:
        values, rows = _flat(lists)
        offsets, done = _offsets(rows, len(lists)), np.concatenate([[0], np.cumsum(values)])
        return _lists(done[1:] - done[offsets[rows]], offsets)

    return sums(deltas.cast("array<bigint>"))


def _groups(x: Column) -> Column:
    """How many 7-bit groups a non-negative integer takes."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("int")


def vbyte_size(values: Column) -> Column:
    """Bytes of the variable-byte code of an array."""
    return F.aggregate(values, F.lit(0), lambda n, x: n + _groups(x))


def vbyte_encode(values: Column) -> Column:
    """Variable-byte code in hexadecimal: 7 bits a byte, low groups first, the top bit set on the last byte of a value."""

    @F.arrow_udf("string")
    def code(lists: pa.Array) -> pa.Array:
        flat, rows = _flat(lists)
        flat, n = flat.view(np.uint64), np.ones(len(flat), np.int64)
        for k in range(1, 10):
            n += (flat >> np.uint64(7 * k)) > 0
        until = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(until[-1], np.uint8)
        for k in range(n.max(initial=0)):
            m = n > k
            out[until[:-1][m] + k] = ((flat[m] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(n[m] == k + 1, 128, 0).astype(np.uint8)
        ends = (2 * until[_offsets(rows, len(lists))]).astype(np.int32)
        text = pa.StringArray.from_buffers(len(lists), pa.py_buffer(ends), pa.py_buffer(out.tobytes().hex().upper().encode()))
        return pc.if_else(lists.is_valid(), text, None)

    return code(values.cast("array<bigint>"))


def vbyte_decode(code: Column) -> Column:
    """The array that ``vbyte_encode`` made."""

    @F.arrow_udf("array<bigint>")
    def values(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        bytes_ = np.frombuffer(bytes.fromhex("".join(texts.to_pylist())), np.uint8)
        last = np.flatnonzero(bytes_ >= 128)
        starts = np.concatenate([[0], last + 1]).astype(np.int64)[: len(last)]
        bytes_ = bytes_[: last[-1] + 1] if len(last) else bytes_[:0]
        at = np.arange(len(bytes_)) - np.repeat(starts, last + 1 - starts)
        parts = (bytes_ & 127).astype(np.uint64) << (7 * at).astype(np.uint64)
        flat = np.add.reduceat(parts, starts).view(np.int64) if len(starts) else np.empty(0, np.int64)
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        return _lists(flat, np.searchsorted(last, np.concatenate([[0], np.cumsum(lengths)])))

    return values(code)
