"""OP-C1 to C4: variable-byte code and posting lists as bytes, for export; Parquet does this job inside the engine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTINGS = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tf", T.IntegerType())]))


def encode_numbers(values) -> bytes:
    """Seven bits to a byte, least first; the high bit says that more follow."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    size = 1 + sum((v >= np.uint64(1 << 7 * k)).astype(int) for k in range(1, 5))
    row = np.repeat(v, size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    more = (place < np.repeat(size, size) - 1).astype(np.uint64) << np.uint64(7)
    return ((row >> (np.uint64(7) * place.astype(np.uint64))) & np.uint64(127) | more).astype(np.uint8).tobytes()


def decode_numbers(raw: bytes, count: int | None = None) -> tuple[list[int], int]:
    """Numbers and the bytes they took; at most ``count``. A number cut short at the end raises ValueError."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 128)[:count]
    if count is not None and len(ends) < count or count is None and len(b) and b[-1] >= 128:
        raise ValueError("truncated number")
    out, start = [], 0
    for e in ends.tolist():
        out.append(sum((int(x) & 127) << 7 * k for k, x in enumerate(b[start : e + 1])))
        start = e + 1
    return out, start


def encode_list(doc_ids, tfs) -> bytes:
    """Count, then gap and one byte of frequency for each posting; ids must rise."""
    ids = [int(x) for x in doc_ids]
    if len(ids) != len(tfs) or any(y <= x for x, y in zip(ids, ids[1:])):
        raise ValueError("ids must rise and have one frequency each")
    gaps = [y - x for x, y in zip([0, *ids], ids)]
    return encode_numbers([len(ids)]) + b"".join(encode_numbers([g]) + bytes([min(int(t), 255)]) for g, t in zip(gaps, tfs))


def decode_list(raw: bytes) -> list[tuple[int, int]]:
    (n,), at = decode_numbers(raw, 1)
    out, last = [], 0
    for _ in range(n):
        (gap,), used = decode_numbers(raw[at : at + 5], 1)
        last += gap
        out.append((last, raw[at + used]))
        at += used + 1
    return out


def encode_lists(doc_ids: pa.Array, tfs: pa.Array) -> pa.Array:
    """``encode_list`` of all lists of a batch at once; null stays null."""
    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(null, 0, doc_ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    if not np.array_equal(sizes, np.where(null, 0, tfs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))):
        raise ValueError("ids must rise and have one frequency each")
    ids, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (doc_ids, tfs))
    ends = np.cumsum(sizes)
    first = (ends - sizes)[sizes > 0]
    gaps = np.diff(ids, prepend=0)
    gaps[first] = ids[first]
    bad = gaps <= 0
    bad[first] = ids[first] < 0
    if bad.any():
        raise ValueError("ids must rise and have one frequency each")
    # The numbers of all lists in order, each list's count before its gaps; gaps are followed by one byte of frequency.
    values = np.insert(gaps, ends - sizes, sizes)
    width, k = np.ones(len(values), np.int64), 1
    while k < 9 and (more := values >= 1 << 7 * k).any():
        width += more
        k += 1
    head = ends - sizes + np.arange(len(sizes))
    frequency = np.ones(len(values), np.int64)
    frequency[head] = 0
    at = np.cumsum(width + frequency) - width - frequency
    raw = np.zeros(int((width + frequency).sum()), np.uint8)
    for j in range(k):
        on = np.flatnonzero(width > j)
        raw[at[on] + j] = (values[on] >> 7 * j & 127) | np.where(width[on] > j + 1, 128, 0)
    raw[(at + width)[frequency == 1]] = np.minimum(tf, 255)
    starts = np.append(at[head], len(raw))
    out = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)])
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), out).cast(pa.binary())


def decode_lists(raw: pa.Array) -> pa.Array:
    """``decode_list`` of all lists of a batch at once; null stays null."""
    null = raw.is_null().to_numpy(zero_copy_only=False)
    raw = raw.cast(pa.large_binary()).fill_null(b"\0")
    starts = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    b = np.frombuffer(raw.buffers()[2], np.uint8)[starts[0] : starts[-1]] if len(raw) else np.zeros(0, np.uint8)
    starts, ends = starts[:-1] - starts[0], starts[1:] - starts[0]
    low = np.append(np.flatnonzero(b < 128), len(b))
    stop = low[np.searchsorted(low, starts)]
    if (stop >= ends).any():
        raise ValueError("truncated number")
    count, body = _numbers(b, starts, stop), stop + 1
    # A byte of 128 or more is either inside a gap or a frequency, and a gap can begin or go on after both; so from there, or from the list's
    # begin, bytes below 128 end a gap and hold a frequency by turns.
    turn = np.zeros(len(b) + 1, np.int64)
    turn[1:][b >= 128] = np.flatnonzero(b >= 128) + 1
    turn[body] = np.maximum(turn[body], body)
    place = np.arange(len(b))
    tf = (place - np.maximum.accumulate(turn)[:-1]) % 2 == 1
    of = np.repeat(np.arange(len(starts)), ends - starts)
    tf &= place >= body[of]
    tf_at = np.flatnonzero(tf)
    of = of[tf_at]
    have = np.bincount(of, minlength=len(starts))
    if (have < count).any():
        raise ValueError("truncated list")
    offset = np.cumsum(have) - have
    rank = np.arange(len(tf_at)) - offset[of]
    gap_at = np.where(rank > 0, np.append(0, tf_at)[:-1] + 1, body[of])
    keep = rank < count[of]
    tf_at, gap_at, of = tf_at[keep], gap_at[keep], of[keep]
    total = np.cumsum(_numbers(b, gap_at, tf_at - 1))
    offsets = np.append(0, np.cumsum(count))
    before = np.append(0, total)[offsets[:-1]]
    fields = [pa.array(total - before[of]), pa.array(b[tf_at].astype(np.int32))]
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(fields, ["doc_id", "tf"]))
    return pa.compute.if_else(pa.array(null), pa.scalar(None, lists.type), lists) if null.any() else lists


def _numbers(b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Numbers from the bytes first to last."""
    size = last - first + 1
    if len(size) and size.max() > 9:
        raise ValueError("number of more than nine bytes")
    out = np.zeros(len(first), np.int64)
    for j in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > j)
        out[on] |= (b[first[on] + j].astype(np.int64) & 127) << 7 * j
    return out


@F.arrow_udf(T.BinaryType())
def encode_postings(doc_ids: pa.Array, tfs: pa.Array) -> pa.Array:
    return encode_lists(doc_ids, tfs)


@F.arrow_udf(POSTINGS)
def decode_postings(raw: pa.Array) -> pa.Array:
    return decode_lists(raw)
