"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256). The ledger, a Parquet table
partitioned by rule version in the shared folder, holds one row for each blob already
scanned under that rule version, with its findings. A scan takes the distinct blobs of
the batch, drops those in the ledger, scans the rest, appends them, and joins findings
back to all paths of the batch.

Of the ledger a delivery of at most BROADCAST_ROWS distinct blobs (counted) reads the addresses
alone and shuffles only those it shares; a larger one meets the ledger by address in a shuffle.

Hot blobs: distinct blobs come from a pre-aggregated ``min`` per address; texts are
then fetched by row key, which is unique, so no task gathers the copies of a blob. The
join back to paths is an equi-join whose hot keys adaptive execution splits.

Defined cases: null text is empty; equal texts have equal findings and are scanned
once; a null path is kept; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

# The three base rules. Letters of the first match in either (ASCII) case.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
RULE_VERSION = "base-1"

_compiled = {
    "assign": re.compile(RULES["assign"][0], re.ASCII | re.IGNORECASE),
    "access": re.compile(RULES["access"][0]),
    # any match of 16 or more is a maximal run, so shorter runs need not be found
    "hex": re.compile(r"[0-9a-f]{16,}"),
}
FINDING = "array<struct<kind:int,start:int,end:int>>"
KINDS = list(RULES)


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    found = []
    for kind, name in enumerate(KINDS):
        _, group, least = RULES[name]
        for m in _compiled[name].finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end()))
    found.sort()
    return [(k, s, e) for s, k, e in found]


_found_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(rows):
    for b in C.cut(rows, 4000, 32 << 20):
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t or "")] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _found_type)], ["blob", "found"])


FOUND = f"blob binary, found {FINDING}"


def _blobs(versions: DataFrame) -> DataFrame:
    rows = versions.select("path", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _held(ledger_rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """The ledger's rows of the distinct ``blobs``. Few of these (counted) are sent to where the ledger lies, which is not shuffled then."""
    few = blobs.limit(C.BROADCAST_ROWS + 1).count() <= C.BROADCAST_ROWS
    return ledger_rows.join(F.broadcast(blobs) if few else blobs.hint("merge"), "blob", "left_semi")


def scan(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> None:
    """Scans the blobs of ``versions`` (path, text) whose pair with the rule version is not in the ledger, and adds them to it.

    ``ledger`` is the table's folder; it is made by the first scan. A scan that fails part-way leaves the ledger as it was.
    """
    spark, at = versions.sparkSession, f"{ledger}/rule_version={rule_version}"
    # a row of each unseen blob: the smallest hash of (path, blob) names it, copies of a row are dropped below
    keyed = _blobs(versions).withColumn("row", F.xxhash64("path", "blob"))
    first = keyed.groupBy("blob").agg(F.min("row").alias("row"))
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        first = C.stored(first, "delivery", most=C.files(versions))
        first = first.join(_held(spark.read.schema(FOUND).parquet(at).select("blob"), first.select("blob")), "blob", "left_anti")
    unseen = keyed.join(first.select("row", F.col("blob").alias("first_blob")).hint("shuffle_hash"), "row", "left_semi").select("blob", "text")
    fresh = unseen.mapInArrow(_scan, FOUND)
    # repeated rows of one path may have scanned a blob twice: findings are equal, one is kept
    C.stored(fresh.groupBy("blob").agg(F.first("found").alias("found")), "ledger", at, C.files(versions))


def findings(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, found) for each row of ``versions`` whose blob the ledger holds under the rule version."""
    known = versions.sparkSession.read.schema(FOUND).parquet(f"{ledger}/rule_version={rule_version}")
    rows = C.stored(_blobs(versions).select("path", "blob"), "addresses", most=C.files(versions))
    # scans at the same time may both have added a blob: one is kept
    known = _held(known, rows.select("blob").distinct()).groupBy("blob").agg(F.first("found").alias("found"))
    return rows.join(known.hint("merge"), "blob")


def scan_incremental(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans what is unseen, then gives the findings of all rows."""
    scan(versions, ledger, rule_version)
    return findings(versions, ledger, rule_version)


def digest(found, kinds: list[str]):
    """``kind:start:end`` of each finding, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and blob of every row of ``documents``, by a ledger filled in two deliveries.

    The deliveries are the rows whose id has a negative hash and all others, as if one came after the other: of the second, only
    blobs not yet in the ledger are scanned. All findings are the ledger's. Null text is empty; null ids stay null; rows repeat as
    they came; an empty table gives no rows.
    """
    ledger = f"{C.shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    docs = C.id_text(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("doc_id", "path")
    negative = F.xxhash64("path") < 0
    scan(docs.filter(negative), ledger)
    scan(docs.filter(~negative), ledger)
    got = findings(docs, ledger).withColumnRenamed("path", "doc_id")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    got = got.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], digest(F.col("found"), KINDS).alias("spans"), F.hex("blob").alias("blob"))
    return got.withColumn("base_sha256", F.sha2(F.col("spans").cast("binary"), 256))


# DuckDB: gaps and matches alternate, so starts are running sums of their lengths
OP4_SQL = r"""
WITH rules(kind, k, gap_re, grp, least) AS (VALUES
  ('assign', 0, '(?s)(.*?)((?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 3, 12),
  ('access', 1, '(?s)(.*?)((AKIA[A-Z0-9]+))', 3, 18),
  ('hex', 2, '(?s)(.*?)(([0-9a-f]+))', 3, 16)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m0 AS (
  SELECT doc_id, 'assign' AS kind, 0 AS k, 12 AS least,
    regexp_extract_all(text, '(?s)(.*?)((?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 1) AS gaps,
    regexp_extract_all(text, '(?s)(.*?)((?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2) AS ms,
    regexp_extract_all(text, '(?s)(.*?)((?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 3) AS gs FROM d
  UNION ALL
  SELECT doc_id, 'access', 1, 18, regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 1), regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2), regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2) FROM d
  UNION ALL
  SELECT doc_id, 'hex', 2, 16, regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 1), regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 2), regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 2) FROM d),
m AS (SELECT doc_id, kind, k, least, unnest(gaps) AS g, unnest(ms) AS m, unnest(gs) AS v, unnest(range(len(ms))) AS i FROM m0),
s AS (SELECT doc_id, kind, k, least, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(m) AS s0, length(m) AS n FROM m),
f AS (SELECT doc_id, kind, k, CAST(s0 AS BIGINT) AS s0, CAST(s0 + n AS BIGINT) AS s1 FROM s WHERE length(v) >= least),
a AS (SELECT d.doc_id, count(*) FILTER (f.k = 0) AS n_assign, count(*) FILTER (f.k = 1) AS n_access, count(*) FILTER (f.k = 2) AS n_hex,
  coalesce(string_agg(f.kind || ':' || f.s0 || ':' || f.s1, ',' ORDER BY f.s0, f.k), '') AS spans
  FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT a.doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans, upper(sha256(d.text)) AS blob FROM a JOIN d ON d.doc_id = a.doc_id
"""
OP4_SQL = "WITH " + OP4_SQL[OP4_SQL.index("d AS (SELECT"):]
