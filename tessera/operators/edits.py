"""Mask editing as a log of events: strokes, undo and redo, folded per patch into masks.

A stroke is a line of a round brush (a point, if its ends are one) that paints or erases. It drops what was undone
and not redone, and is added; undo takes back the last stroke that counts, redo brings back the one taken back last. So a patch's
state is a list of strokes and how many of them count; no masks are kept. Events are sorted by patch and number within
partitions and streamed through: a task holds one patch's strokes and mask.

Defined cases: undo without a stroke and redo without an undo do nothing; a point outside the patch paints nothing but is a stroke;
a null mask is empty; patches without events keep their mask; events of unknown patches are passed over; equal
numbers of a patch are ordered by kind and place; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.fixtures import duck, table

EVENT = "patch_id string, seq bigint, kind string, x0 int, y0 int, x1 int, y1 int, radius int, erase boolean"
_STROKE = ("x0", "y0", "x1", "y1", "radius", "erase")


def painted(mask: np.ndarray, stroke: tuple) -> None:
    """Paints or erases, in place, the pixels within the radius of the stroke's line; in whole numbers throughout."""
    x0, y0, x1, y1, r, erase = stroke
    h, w = mask.shape
    if (x0, y0) == (x1, y1) and not (0 <= x0 < w and 0 <= y0 < h):
        return
    top, left = max(0, min(y0, y1) - r), max(0, min(x0, x1) - r)
    box = mask[top : max(0, max(y0, y1) + r + 1), left : max(0, max(x0, x1) + r + 1)]
    if not box.size:
        return
    y, x = np.mgrid[top : top + box.shape[0], left : left + box.shape[1]].astype(np.int64)
    dy, dx = y1 - y0, x1 - x0
    length, along, aside = dy * dy + dx * dx, (y - y0) * dy + (x - x0) * dx, (y - y0) * dx - (x - x0) * dy
    near = lambda cy, cx: (y - cy) ** 2 + (x - cx) ** 2 <= r * r
    inside = np.where(along <= 0, near(y0, x0), np.where(along >= length, near(y1, x1), aside**2 <= r * r * length))
    box[inside] = 0 if erase else 255


class Log:
    """Strokes of a patch and how many of them count."""

    def __init__(self):
        self.strokes: list[tuple] = []
        self.count = self.events = 0

    def take(self, kind: str, stroke: tuple) -> None:
        self.events += 1
        if kind == "stroke":
            del self.strokes[self.count :]
            self.strokes.append(stroke)
            self.count += 1
        elif kind == "undo":
            self.count = max(0, self.count - 1)
        elif kind == "redo":
            self.count = min(len(self.strokes), self.count + 1)


OUT = "patch_id string, h int, w int, mask binary, strokes int, modified boolean"


def _replayed(batches):
    schema = pa.schema([("patch_id", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("mask", pa.binary()), ("strokes", pa.int32()), ("modified", pa.bool_())])
    patch, log = None, Log()

    def finished():
        before = np.frombuffer(patch["mask"], np.uint8) if patch["mask"] else np.zeros(patch["h"] * patch["w"], np.uint8)
        mask = before.copy().reshape(patch["h"], patch["w"])
        for s in log.strokes[: log.count]:
            painted(mask, s)
        row = {**{k: patch[k] for k in ("patch_id", "h", "w")}, "mask": mask.tobytes(), "strokes": log.count, "modified": bool((mask.reshape(-1) != before).any())}
        return pa.RecordBatch.from_pylist([row], schema)

    for b in batches:
        for r in b.to_pylist():
            if r["kind"] is None:
                if patch:
                    yield finished()
                patch, log = r, Log()
            elif patch and patch["patch_id"] == r["patch_id"]:
                log.take(r["kind"], tuple(r[k] for k in _STROKE))
    if patch:
        yield finished()


def replay(patches: DataFrame, events: DataFrame) -> DataFrame:
    """(patch_id, h, w, mask, strokes, modified): each patch's mask after its events, and how many strokes count."""
    none = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in EVENT.split(", ")[1:]}
    bases = patches.select("patch_id", "h", "w", "mask", *[c.alias(k) for k, c in none.items()])
    log = events.filter("kind IS NOT NULL AND patch_id IS NOT NULL").select("patch_id", F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("binary").alias("mask"), *none)
    n = int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = bases.unionByName(log).withColumn("__event", F.col("kind").isNotNull())
    return both.repartition(n, "patch_id").sortWithinPartitions("patch_id", "__event", "seq", "kind", *_STROKE).drop("__event").mapInArrow(_replayed, OUT)


# ---- on the fixtures: each user edits a patch of 48 x 48, purchases undo and refunds redo

_KINDS = "CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'refund' THEN 'redo' WHEN 'error' THEN 'redo' ELSE 'stroke' END"
_PLACES = "event_id % 48 AS x0, event_id * 7 % 48 AS y0, CASE WHEN event_id % 3 = 0 THEN event_id % 48 ELSE event_id * 5 % 48 END AS x1, CASE WHEN event_id % 3 = 0 THEN event_id * 7 % 48 ELSE event_id * 11 % 48 END AS y1, 1 + event_id % 4 AS radius, event_id % 5 = 0 AS erase"
_STEP = "CASE kind WHEN 'stroke' THEN list_append(r.s[1 : r.n], e.event_id) ELSE r.s END, CASE kind WHEN 'stroke' THEN r.n + 1 WHEN 'undo' THEN greatest(0, r.n - 1) ELSE least(len(r.s), r.n + 1) END"
_IN = "CASE WHEN l = 0 OR u <= 0 THEN (y - y0) * (y - y0) + (x - x0) * (x - x0) <= radius * radius WHEN u >= l THEN (y - y1) * (y - y1) + (x - x1) * (x - x1) <= radius * radius ELSE v * v <= radius * radius * l END"
_REPLAY = (
    f"WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, {_KINDS} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), "
    f"r(user_id, k, s, n) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], 0::BIGINT FROM e UNION ALL SELECT r.user_id, e.k, {_STEP} FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1), "
    "f AS MATERIALIZED (SELECT user_id, s[1 : n] AS s, n FROM r QUALIFY k = max(k) OVER (PARTITION BY user_id)), "
    f"t AS MATERIALIZED (SELECT g.user_id, g.k, {_PLACES} FROM (SELECT user_id, unnest(s) AS event_id, unnest(range(n)) AS k FROM f) g), "
    "p AS (SELECT *, (y1 - y0) * (y1 - y0) + (x1 - x0) * (x1 - x0) AS l, (y - y0) * (y1 - y0) + (x - x0) * (x1 - x0) AS u, (y - y0) * (x1 - x0) - (x - x0) * (y1 - y0) AS v FROM (SELECT *, unnest(range(greatest(0, least(x0, x1) - radius), least(48, greatest(x0, x1) + radius + 1))) AS x FROM (SELECT *, unnest(range(greatest(0, least(y0, y1) - radius), least(48, greatest(y0, y1) + radius + 1))) AS y FROM t) a) b), "
    f"q AS (SELECT user_id, y, x, arg_max(erase, k) AS gone FROM p WHERE {_IN} GROUP BY ALL), "
    "a AS (SELECT user_id, count(*) AS area, CAST(sum(y * 48 + x) AS BIGINT) AS placed FROM q WHERE NOT gone GROUP BY user_id) "
    "SELECT f.user_id, f.n AS strokes, coalesce(area, 0) AS area, coalesce(placed, 0) AS placed FROM f LEFT JOIN a ON a.user_id = f.user_id"
)


@query("c08_edit_log", _REPLAY)
def c08(spark, sf):
    """What is left of each user's strokes after undo and redo, and the pixels painted: their number and the sum of their places."""
    e = table(spark, sf, "events")
    log = e.selectExpr("CAST(user_id AS STRING) AS patch_id", "event_id AS seq", f"{_KINDS} AS kind", *_split(_PLACES))
    log = log.select("patch_id", "seq", "kind", *[F.col(c).cast("int").alias(c) for c in _STROKE[:5]], "erase")
    bases = e.select(F.col("user_id").cast("string").alias("patch_id")).distinct().select("patch_id", F.lit(48).alias("h"), F.lit(48).alias("w"), F.lit(None).cast("binary").alias("mask"))

    def sums(batches):
        for b in batches:
            on = [np.flatnonzero(np.frombuffer(m, np.uint8)) for m in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(4).cast(pa.int64()), pa.array([len(x) for x in on], pa.int64()), pa.array([int(x.sum()) for x in on], pa.int64())], ["user_id", "strokes", "area", "placed"])

    return replay(bases, log).mapInArrow(sums, "user_id bigint, strokes bigint, area bigint, placed bigint")


def _split(columns: str) -> list[str]:
    """The column expressions of a list without commas inside."""
    return columns.split(", ")
