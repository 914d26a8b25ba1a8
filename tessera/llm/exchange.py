"""Packed exchanges: many small keyed entries travel as a few binary rows.

A task packs the entries of a batch into one row for each destination; destinations are
ints chosen so that Spark's hash partitioning spreads them evenly. Receivers see whole
arrays, work on them with NumPy, and pack their answers the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

GROUP_BYTES = 16 << 20  #: text behind one destination: what one task holds in memory follows from it


def _murmur(k):
    """Spark's hash() of an int or an array of ints."""
    k = np.asarray(k)
    rot = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    h = np.uint32(42) ^ rot(np.atleast_1d(k).astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = rot(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    h = (h ^ h >> np.uint32(16)).view(np.int32)
    return h if k.ndim else int(h[0])


def labels(n: int) -> np.ndarray:
    """n ints, the k-th of which Spark's hash partitioning sends to partition k of n: the least such, found in stretches of 2 n."""
    out, start, step = np.full(n, -1, np.int32), 0, max(1024, 2 * n)
    while (out < 0).any():
        tried = np.arange(start, start + step)
        at, first = np.unique(_murmur(tried).astype(np.int64) % n, return_index=True)
        new = out[at] < 0
        out[at[new]] = tried[first[new]]
        start += step
    return out


def groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """How many destinations keep each at about ``group_bytes`` of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // group_bytes))


def bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Destination 0..n-1 by the leading bits of the key: each is one range of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def slices(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    if not len(sorted_values):
        return []
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(sorted_values)]
    return list(zip(sorted_values[starts].tolist(), starts.tolist(), ends.tolist()))


def rows_of(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], list(types))


def small(values: np.ndarray) -> bytes:
    """Non-negative ints as one byte each; 255 and more as a 255 and, at the end, four bytes."""
    big = values >= 255
    return np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype("<u4").tobytes()


def unsmall(raw: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(raw, "<u4", offset=n)
    return values
