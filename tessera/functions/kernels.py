"""Array kernels for what has no relational form within one storage tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


PIECE, PIECE_BYTES = 512, 16 << 20


def pieces(batches, rows: int = PIECE, size: int = PIECE_BYTES):
    """Slices of batches, by rows and roughly by bytes: Python objects are made of one slice at a time, not of all rows of a batch."""
    for b in batches:
        n = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)


def label_tile(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels of a mask's 8-connected (or 4-connected) regions: each is named by its smallest place; -1 is background.

    Runs of each row are joined with those they touch in the row above, so work follows the number of runs.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    parent = list(range(len(row)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    rows, starts, ends = row.tolist(), start.tolist(), end.tolist()
    reach, above = int(diagonal), 0
    for k, (y, s, e) in enumerate(zip(rows, starts, ends)):
        while rows[above] < y - 1 or (rows[above] == y - 1 and ends[above] + reach <= s):
            above += 1
        j = above
        while rows[j] == y - 1 and starts[j] < e + reach:
            a, b = root(j), root(k)
            if a != b:
                parent[max(a, b)] = min(a, b)
            j += 1
    names = np.array([root(k) for k in range(len(rows))], np.int64)
    out = np.full(h * w, -1, np.int64)
    if len(names):
        first = row * w + start
        size = end - start
        out[np.repeat(first, size) + np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)] = np.repeat(first[names], size)
    return out.reshape(h, w)


def label_rows(side: int):
    """mapInArrow: (key, mask array) to (key, place, label) of the foreground places; ``side`` is the width of a tile."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(bool), lists.offsets.to_numpy()
            for key, lo, hi in zip(b.column(0).to_pylist(), ends[:-1], ends[1:]):
                lab = label_tile(flat[lo:hi].reshape(-1, side)).reshape(-1)
                at = np.flatnonzero(lab >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(lab[at], pa.int32())], ["key", "place", "label"])

    return run
