"""Shared helpers: the cluster's shared folder, Arrow mapping, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words
WS = r"[\x20\x09-\x0D]+"
NO_ID = -(1 << 63)  #: stands for a null id while rows are ordered

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _fallback.get(app) or _fallback.setdefault(app, tempfile.mkdtemp(prefix="tessera-"))
    return base.rstrip("/")


FILE_BYTES, LEAST_FILES = 8 << 20, 12


def files(docs: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """How many files an intermediate table of these documents takes at most: in proportion to their stored bytes."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 30, max(LEAST_FILES, -(-size // file_bytes)))


def stored(df: DataFrame, name: str, at: str | None = None, most: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    ``most`` bounds the number of files: many partitions of few rows become few files.
    """
    spark = df.sparkSession
    df = df.coalesce(most) if most else df
    path = at or f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.mode("append" if at else "error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns):
    """A key of the whole row, null or not: rows that share an id keep their own texts."""
    return F.xxhash64(*columns)


BROADCAST_ROWS, SALTS = 200_000, 16


def looked_up(left: DataFrame, table: DataFrame, key: str, salt, how: str = "inner") -> DataFrame:
    """``left`` joined with a table of one row per ``key`` which may be hot in ``left``.

    A table of at most BROADCAST_ROWS rows (counted) is broadcast; beyond that its rows are repeated for
    SALTS salts and a hot key's rows are dealt by ``salt``, a hash of the row.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(table), key, how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [key, "salt"], how).drop("salt")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows: texts are long, and a batch is held whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 2000:
        spark.conf.set(key, "2000")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two needed columns, under fixed names: extra or clashing columns of the input do no harm."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_column, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % mod


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ids(column: pa.Array) -> np.ndarray:
    """int64 ids; null becomes NO_ID."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


class WordHash(dict):
    """64-bit hash of a word, kept for words seen lately."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: bytes, lower: bool) -> list[bytes]:
    """Words between ASCII white space; ``lower`` folds A-Z only."""
    return (text.lower() if lower else text).split()


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, n: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of each run of ``n`` consecutive word hashes (polynomial in ``base``, modulo 2^64, then mixed)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        if n <= 6:
            for k in range(n):
                out = out * base + h[k : len(h) - n + 1 + k]
        else:  # by doubling: hashes of runs of 1, 2, 4 ... words, then the rest of n
            at, step, run, power = 0, 1, h, base
            while True:
                if n >> (step.bit_length() - 1) & 1:
                    out = out * power + run[at : at + len(out)]
                    at += step
                if at >= n:
                    break
                run, power, step = run[: len(run) - step] * power + run[step:], power * power, step * 2
        return mix(out)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)


def cut(rows: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches, by rows and roughly by bytes, so that memory does not follow text lengths."""
    for b in batches(rows):
        n = max(1, min(most_rows, int(most_bytes * b.num_rows / max(1, b.nbytes))))
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)
