"""Edit logs against step-by-step painting with stacks of masks."""

import random

import numpy as np

from tessera.operators import edits


def slow(mask, events):
    """The mask is copied onto a stack before each stroke; undo and redo move copies between two stacks."""
    undo, redo = [], []
    for kind, x0, y0, x1, y1, r, erase in events:
        if kind == "stroke":
            undo.append([row[:] for row in mask])
            redo.clear()
            h, w = len(mask), len(mask[0])
            if (x0, y0) == (x1, y1) and not (0 <= x0 < w and 0 <= y0 < h):
                continue
            dx, dy = x1 - x0, y1 - y0
            for y in range(h):
                for x in range(w):
                    n = dx * dx + dy * dy
                    t = 0 if not n else min(1.0, max(0.0, ((x - x0) * dx + (y - y0) * dy) / n))
                    if (x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2 <= r * r + 1e-9:
                        mask[y][x] = 0 if erase else 255
        elif kind == "undo" and undo:
            redo.append([row[:] for row in mask])
            mask = undo.pop()
        elif kind == "redo" and redo:
            undo.append([row[:] for row in mask])
            mask = redo.pop()
    return mask


def test_replay_equals_painting_step_by_step(spark):
    rng = random.Random(1)
    patches, log, want = [], [], {}
    for k in range(12):
        h, w = rng.randint(5, 30), rng.randint(5, 30)
        base = None if k == 3 else bytearray(rng.choice([0, 255]) for _ in range(h * w))
        patches.append((f"p{k}", h, w, base, "x"))
        events = []
        for _ in range(0 if k == 4 else rng.randint(1, 40)):
            kind = rng.choice(["stroke", "stroke", "undo", "redo"])
            a = (rng.randint(-4, w + 4), rng.randint(-4, h + 4))
            b = a if rng.random() < 0.4 else (rng.randint(-4, w + 4), rng.randint(-4, h + 4))
            events.append((kind, *a, *b, rng.randint(0, 5), rng.random() < 0.3))
        log += [(f"p{k}", n, *e) for n, e in enumerate(events)]
        start = [list((base or bytes(h * w))[y * w : (y + 1) * w]) for y in range(h)]
        want[f"p{k}"] = bytes(v for row in slow(start, events) for v in row)
    log += [("nobody", 0, "stroke", 1, 1, 1, 1, 2, False), (None, 0, "stroke", 1, 1, 1, 1, 2, False), ("p1", 999, None, 1, 1, 1, 1, 2, False)]
    rng.shuffle(log)
    p = spark.createDataFrame(patches, "patch_id string, h int, w int, mask binary, kind string")
    e = spark.createDataFrame(log, edits.EVENT)
    got = edits.replay(p, e).collect()
    assert {r.patch_id: bytes(r.mask) for r in got} == want and len(got) == 12
    for r in got:
        base = next(x[3] for x in patches if x[0] == r.patch_id) or bytes(r.h * r.w)
        assert r.modified == (bytes(base) != bytes(r.mask))
    assert edits.replay(p.filter("false"), e).count() == 0 and edits.replay(p, e.filter("false")).filter("modified").count() == 0


def test_undo_and_redo_at_the_ends():
    log = edits.Log()
    for kind in ("undo", "redo", "stroke", "stroke", "undo", "undo", "undo", "redo", "stroke", "redo"):
        log.take(kind, (log.events,))
    # the second stroke was undone and dropped by the third
    assert log.strokes == [(2,), (8,)] and log.count == 2


def test_a_long_log_keeps_no_masks(spark):
    n = 20_000
    e = spark.range(n).selectExpr("'p' AS patch_id", "id AS seq", "CASE WHEN id % 4 = 3 THEN 'undo' ELSE 'stroke' END AS kind", "CAST(id % 64 AS INT) AS x0", "CAST(id * 7 % 64 AS INT) AS y0", "CAST(id % 64 AS INT) AS x1", "CAST(id * 7 % 64 AS INT) AS y1", "1 AS radius", "id % 2 = 0 AS erase")
    p = spark.createDataFrame([("p", 64, 64, None)], "patch_id string, h int, w int, mask binary")
    assert edits.replay(p, e).first().strokes == n // 2
    assert np.frombuffer(edits.replay(p, e).first().mask, "u1").any()
