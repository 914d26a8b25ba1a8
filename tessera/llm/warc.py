"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member holding one WARC record; members fill
archives of about ARCHIVE_BYTES, rows of a Parquet table in the shared folder, so a lost
task leaves no half-written file. A payload of at least LEAST bytes that was captured
under a smaller page id is written as a revisit: its record keeps the HTTP header
(with the payload's length), the payload digest and the id of the record it refers to.

Index: entries sorted by reversed-host key are cut into compressed blocks (level one),
numbered in key order; a sparse directory (level two) holds the first and last key, cut to KEY
characters, of each stretch of neighbouring blocks. Stretches are as long as it takes for the
directory to have at most DIRECTORY_ROWS entries, so it can be sent to every task. A lookup searches
the directory by bisection, opens the blocks of the stretches found, searches these by their first keys,
and reads byte ranges of archives. ``captures`` does so for a table of keys, ``records_of`` and ``lookup`` for one url.

Defined cases: null html is an empty payload; a null or odd url keeps a key of its own
text; null page ids are responses; repeated rows (same id, same payload) are all
responses; empty tables give empty archives and no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C

LEAST = 100
ARCHIVE_BYTES = 2 << 20
BLOCK = 256  #: entries of an index block
DATE = "2020-01-01T00:00:00Z"
DIRECTORY_ROWS, KEY = 100_000, 64
FILE_BYTES = 4 << 20  #: stored pages behind a task that writes archives

ARCHIVES = "archive string, content binary, entries array<struct<key:string,page_id:long,offset:long,length:long>>"
BLOCKS = "part int, seq int, first string, last string, n int, block binary"

_url = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)")


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://a.b.org/x?y is ``org,b,a)/x?y``."""
    url = (url or "").replace("\n", "%0A")
    m = _url.match(url)
    if not m:
        return url
    host = m[1].rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (m[2] or "/")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and payload (None for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: None if (v := fields[name][len("<urn:page:") : -1]) == "None" else int(v)
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "revisit":
        return {"page_id": number("WARC-Record-ID"), "record_type": "revisit", "refers_to": number("WARC-Refers-To"), "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None}
    digest = hashlib.sha256(payload).hexdigest()
    if len(payload) != size or f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"record of page {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number("WARC-Record-ID"), "record_type": "response", "refers_to": None, "payload_bytes": size, "payload_digest": digest, "payload": payload}


def _write(limit: int):
    def run(rows):
        task, made, content, size, entries = TaskContext.get().partitionId(), 0, [], 0, []

        def full():
            return pa.RecordBatch.from_arrays([pa.array([f"warc-{task:06d}-{made:06d}.warc.gz"]), pa.array([b"".join(content)], pa.binary()), pa.array([entries], _entries)], ["archive", "content", "entries"])

        for b in C.batches(rows):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                member = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers_to), 4, mtime=0)
                content.append(member)
                entries.append({"key": url_key(url), "page_id": page_id, "offset": size, "length": len(member)})
                size += len(member)
                if size >= limit:
                    yield full()
                    made, content, size, entries = made + 1, [], 0, []
        if content:
            yield full()

    return run


_entries = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))


def write_archives(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``root/archives`` from (page_id, url, html) and returns that table."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = p.withColumn("digest", F.sha2(payload, 256))
    named = p.filter(F.octet_length(payload) >= LEAST).select("page_id", "digest")
    first = named.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    revisits = named.join(first, "digest").filter(F.col("page_id") != F.col("refers_to")).distinct()
    rows = p.join(revisits.hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return C.stored(rows.coalesce(C.files(pages, FILE_BYTES)).mapInArrow(_write(archive_bytes), ARCHIVES), "warc", f"{root}/archives")


def _block(rows):
    part, seq, keys, lines = TaskContext.get().partitionId(), 0, [], []

    def full():
        block = zlib.compress("\n".join(lines).encode(), 6)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([len(keys)], pa.int32()), pa.array([block], pa.binary())], ["part", "seq", "first", "last", "n", "block"])

    for b in C.batches(rows):
        for key, page_id, archive, offset, length in zip(*(c.to_pylist() for c in b.columns)):
            keys.append(key)
            lines.append(f"{archive}\t{offset}\t{length}\t{'' if page_id is None else page_id}\t{key}")
            if len(keys) == BLOCK:
                yield full()
                seq, keys, lines = seq + 1, [], []
    if keys:
        yield full()


def entries_of(block: bytes) -> list[tuple[str, int, int, int | None, str]]:
    """(archive, offset, length, page_id, key) of an index block."""
    out = []
    for line in zlib.decompress(block).decode().split("\n"):
        archive, offset, length, page_id, key = line.split("\t", 4)
        out.append((archive, int(offset), int(length), int(page_id) if page_id else None, key))
    return out


def build_index(archives: DataFrame, root: str) -> DataFrame:
    """Writes ``root/index``: sorted entries in compressed blocks, each row with its place in key order and its first and last key."""
    spark = archives.sparkSession
    e = archives.select("archive", F.explode("entries").alias("e")).select("e.key", "e.page_id", "archive", "e.offset", "e.length")
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), C.files(archives))
    ordered = e.repartitionByRange(n, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")
    return C.stored(ordered.mapInArrow(_block, BLOCKS), "warc-index", f"{root}/index")


class Directory:
    """First and last keys of the stretches of blocks, in key order; a stretch is (part, seq // blocks)."""

    def __init__(self, index: DataFrame, most: int = DIRECTORY_ROWS):
        self.blocks = max(1, -(-index.count() // most))
        stretch = (F.col("seq") / self.blocks).cast("int").alias("stretch")
        rows = index.groupBy("part", stretch).agg(F.substring(F.min("first"), 1, KEY).alias("first"), F.substring(F.max("last"), 1, KEY).alias("last")).collect()
        rows.sort(key=lambda r: (r["first"], r["last"], r["part"], r["stretch"]))
        self.firsts, self.lasts = [r["first"] for r in rows], [r["last"] for r in rows]
        self.places = [(r["part"], r["stretch"]) for r in rows]

    def find(self, key: str) -> list[tuple[int, int]]:
        """The stretches that can hold a key."""
        key = key[:KEY]
        return self.places[bisect.bisect_left(self.lasts, key) : bisect.bisect_right(self.firsts, key)]


def _keys(rows):
    for b in C.batches(rows):
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], ["key"])


def keys_of(urls: DataFrame) -> DataFrame:
    """The distinct index keys of a table's one column of urls."""
    return urls.distinct().mapInArrow(_keys, "key string").distinct()


_ASK = "part int, stretch int, kind int, at string, last string, block binary"


def _seek(shared):
    """The directory's answer for each key."""

    def run(rows):
        for b in C.batches(rows):
            out = [(*place, key) for key in b.column(0).to_pylist() for place in shared.value.find(key)]
            n = len(out)
            part, stretch, key = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(stretch, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(key, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], ["part", "stretch", "kind", "at", "last", "block"])

    return run


def _open(rows):
    """Rows by stretch, its blocks first, then the keys asked for, both in key order: the places of the captures found."""
    now, blocks, opened, entries = None, [], -1, []
    for b in C.batches(rows):
        found = []
        for part, stretch, kind, at, last, block in zip(*(c.to_pylist() for c in b.columns)):
            if (part, stretch) != now:
                now, blocks, opened = (part, stretch), [], -1
            if kind == 0:
                blocks.append((at, last, block))
                continue
            k = bisect.bisect_left(blocks, at, key=lambda x: x[1])
            while k < len(blocks) and blocks[k][0] <= at:
                if opened != k:
                    opened, entries = k, entries_of(blocks[k][2])
                lo, hi = bisect.bisect_left(entries, at, key=lambda e: e[4]), bisect.bisect_right(entries, at, key=lambda e: e[4])
                found += [e[:3] for e in entries[lo:hi]]
                k += 1
        archive, offset, length = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(archive, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["archive", "offset", "length"])


_fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _ranges(fields):
    def run(rows):
        for b in C.batches(rows):
            for content, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = [parse(gzip.decompress(content[p["offset"] : p["offset"] + p["length"]])) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in fields], [k for k, _ in fields])

    return run


def captures(spark: SparkSession, root: str, keys: DataFrame, directory_rows: int = DIRECTORY_ROWS, payload: bool = False) -> DataFrame:
    """All captures of the distinct ``keys`` (one column): page_id, payload_bytes, payload_digest, record_type, refers_to; ``payload`` (null for a revisit) if asked for."""
    index = spark.read.schema(BLOCKS).parquet(f"{root}/index")
    directory = Directory(index, directory_rows)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.mapInArrow(_seek(spark.sparkContext.broadcast(directory)), _ASK)
    held = index.select("part", (F.col("seq") / directory.blocks).cast("int").alias("stretch"), F.lit(0).alias("kind"), F.col("first").alias("at"), "last", "block")
    # a stretch has a bounded number of blocks, and no more keys that it holds than these have entries
    laid = held.unionByName(asked).repartition(n, "part", "stretch").sortWithinPartitions("part", "stretch", "kind", "at", "last")
    places = laid.mapInArrow(_open, "archive string, offset long, length long")
    # an archive holds a bounded number of records, so its list of ranges is bounded too
    places = places.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    archives = spark.read.schema(ARCHIVES).parquet(f"{root}/archives").select("archive", "content")
    joined = archives.join(places.hint("shuffle_hash"), "archive").select("content", "places")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return joined.mapInArrow(_ranges([*_fields, ("payload", pa.binary())] if payload else _fields), schema + ", payload binary" if payload else schema)


def records_of(spark: SparkSession, root: str, url: str | None) -> Iterator[dict]:
    """Records captured for a url, one partition's at a time: a key may have any number of captures."""
    key = spark.createDataFrame([(url,)], "url string")
    return (r.asDict() for r in captures(spark, root, keys_of(key), payload=True).toLocalIterator())


def lookup(spark: SparkSession, root: str, url: str | None) -> list[dict]:
    """``records_of`` as a list, for urls of few captures."""
    return list(records_of(spark, root, url))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of ``pages``, read back by the keys of its urls.

    Null html is an empty payload; null urls share a key; null page ids are responses; an empty table gives no rows.
    """
    import uuid

    root, pages = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/pages.parquet")
    build_index(write_archives(pages, root), root)
    return captures(spark, root, keys_of(pages.select(F.col("url").cast("string"))))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""
