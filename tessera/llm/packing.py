"""Best-fit packing: bounded-space online best-fit over token pieces.

A fixed number of open bins; the free spaces in use are bits of one integer, so the
tightest bin for a piece is the lowest set bit at or above its length. When all bins
are open the fullest closes first. Each task packs its own partition: no shuffle, no
group in one task, and a lost task packs the same rows again. The bins left open at the end of
neighbouring tasks are then emptied and their pieces, the longest first, packed by best fit; no text moves.

Defined cases: null or empty text is the end id alone; a document longer than a
sequence is cut into full sequences and its first piece takes the rest; repeated
rows are packed as often as they come; empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SEQUENCE = 1024
OPEN_BINS = 512
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"


class Bins:
    """Open bins keyed by free space: a bitset of the spaces in use and a stack of bins for each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.n, self.made = capacity, most, 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.at[free]
        bin_id = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.n -= 1
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes the piece, and the place in it."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            if self.n >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if rest <= fullest:
                    return bin_id, self.capacity - free  # this one is the fullest: it closes
                self._take(fullest)
            self.at[rest].append(bin_id)
            self.bits |= 1 << rest
            self.n += 1
        return bin_id, self.capacity - free


_encoders: dict[str, object] = {}


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, all others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str):
    """The ids of a text by the tokenizer file, by the faster of two engines that read its vocabulary.

    The file is a byte-level BPE whose ids follow its merge order, so ids serve as ranks; special tokens are matched
    in texts as the file asks for. Texts that the faster engine refuses (very long runs of one kind of character) go
    to the engine that the file is written for.
    """
    if path not in _encoders:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = _letters()
        ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        whole = Tokenizer.from_file(path)

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:
                return whole.encode(text, add_special_tokens=False).ids

        _encoders[path] = encode
    return _encoders[path]


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens."""
    first = n % capacity or capacity
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


OPEN = -1  #: ``piece`` of the rows that tell of a task's open bins


def _pack(path: str, capacity: int, most: int, end_id: int):
    """Pieces of the task's documents, then a row (piece OPEN) for each bin left open."""

    def run(rows):
        encode, bins = encoder(path), Bins(capacity, most)
        base = TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], COLUMNS)
        for b in C.cut(rows, 1000, 8 << 20):
            out: list[list] = [[] for _ in COLUMNS]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = encode(text) if text else []
                got.append(end_id)
                raw = np.array(got, "<u4")
                for k, (start, length) in enumerate(pieces(len(got), capacity)):
                    bin_id, offset = bins.put(length)
                    row = (doc_id, k, start, length, zlib.crc32(raw[start : start + length]), base + bin_id, offset)
                    for column, value in zip(out, row):
                        column.append(value)
            yield made(out)
        left = [base + bin_id for stack in bins.at for bin_id in stack]
        if left:
            n = [0] * len(left)
            yield made([[None] * len(left), [OPEN] * len(left), n, n, n, left, n])

    return run


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
TASKS = 32  #: tasks whose open bins are emptied and packed together
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def repacked(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and place of each piece by best fit, the longest first."""
    bins, out = Bins(capacity, len(lengths)), [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        out[k] = bins.put(lengths[k])
    return out


def _repack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        to = repacked(table.column("length").to_pylist(), capacity)
        base = (table.column("near")[0].as_py() * TASKS << 40) + (1 << 39)  # beyond the bins that a task makes
        new = {"sequence_id": pa.array([base + k for k, _ in to], pa.int64()), "offset": pa.array([at for _, at in to], pa.int64())}
        return pa.table({c: new.get(c, table.column(c)) for c in COLUMNS})

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tasks pack their own documents; the pieces in the bins that TASKS neighbouring tasks leave open are then packed once more.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    d = C.id_text(docs, id_col, text_col)
    made = C.stored(d.coalesce(C.files(d)).mapInArrow(_pack(tokenizer_path, capacity, open_bins, end_id), SCHEMA), "packing-pieces")
    left = made.filter(F.col("piece") == OPEN).select("sequence_id", (F.shiftright("sequence_id", 40) / TASKS).cast("long").alias("near"))
    placed = C.looked_up(made.filter(F.col("piece") != OPEN), left, "sequence_id", F.xxhash64("doc_id", "piece"), "left")
    again = placed.filter("near IS NOT NULL").groupBy("near").applyInArrow(_repack(capacity), SCHEMA)
    return placed.filter("near IS NULL").select(*COLUMNS).unionByName(again)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """One row per piece of every row of ``documents``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is the end id alone; null ids stay null; rows repeat as they came; an empty table gives no rows.
    """
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
