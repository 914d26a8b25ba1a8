"""Windows of raster files of any layout against whole-file decoding, and mosaics written as tiled files and read back."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import engine as E
from tessera.sources import rasters as R
from tessera.sources import windows as V

rng = np.random.default_rng(11)


def picture(h, w, c, bits=8):
    return rng.integers(0, 256 if bits == 8 else 4000, (h, w, c)).astype(f"u{bits // 8}")


def tiff(px, tile=None, strip=7, deflate=False, predictor=1, planar=1, order="<", big=False):
    """A TIFF or BigTIFF of strips or tiles."""
    h, w, c = px.shape
    bits = 8 * px.dtype.itemsize
    bh, bw = (tile, tile) if tile else (strip, w)
    blocks = []
    for plane in [slice(k, k + 1) for k in range(c)] if planar == 2 else [slice(0, c)]:
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                part = px[y : y + bh, x : x + bw, plane]
                if tile:
                    part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(f"{order}u{bits // 8}").tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    wide = 16 if big else 8
    starts = [wide + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    tags = {256: [w], 257: [h], 258: [bits] * c, 259: [8 if deflate else 1], 277: [c], 284: [planar], 317: [predictor]}
    tags |= {322: [tile], 323: [tile], 324: starts, 325: [len(b) for b in blocks]} if tile else {273: starts, 278: [strip], 279: [len(b) for b in blocks]}
    body = b"".join(blocks)
    at = wide + len(body)
    kind, code, entry, inline = (16, "Q", "HHQ", 8) if big else (4, "I", "HHI", 4)
    base = at + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
    out, later = b"", b""
    for tag, values in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(raw) > inline:
            later += raw
            raw = struct.pack(order + code, base + len(later) - len(raw))
        out += struct.pack(order + entry, tag, kind, len(values)) + raw
    head = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return head + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + out + b"\0" * inline + later


LAYOUTS = {
    "strips": dict(), "big-strips": dict(big=True), "motorola": dict(order=">", big=True), "deflate": dict(deflate=True), "predicted": dict(deflate=True, predictor=2),
    "tiles": dict(tile=16), "big-tiles": dict(tile=16, big=True, deflate=True, predictor=2), "planes": dict(planar=2, tile=16), "plane-strips": dict(planar=2, strip=9),
    "one-strip": dict(strip=83), "one-packed-strip": dict(strip=83, deflate=True), "one-predicted-strip": dict(strip=83, predictor=2), "halves": dict(strip=50),
}


def whole(rows):
    out = {}
    for r in rows:
        assert r.error is None, r.error
        a = out.setdefault(r.path.rsplit("/", 1)[-1], np.full((r.image_h, r.image_w, r.bands), -1))
        assert (a[r.y : r.y + r.h, r.x : r.x + r.w] == -1).all()
        a[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.px, f"u{r.bits // 8}").reshape(r.h, r.w, r.bands)
    return out


@pytest.mark.parametrize("window", [700, 5000, 1 << 20])
def test_all_layouts_by_windows(spark, tmp_path, window):
    want = {}
    for k, (name, how) in enumerate(LAYOUTS.items()):
        px = picture(83, 45, 3 if k % 3 else 1, 16 if k % 4 == 1 else 8)
        (tmp_path / f"{name}.tif").write_bytes(tiff(px, **how))
        want[f"{name}.tif"] = px
    for name, c, bits in (("gray", 1, 8), ("colour", 3, 16), ("alpha", 4, 8)):
        px = picture(60, 31, c, bits)
        (tmp_path / f"{name}.png").write_bytes(R.encode_png(px))
        want[f"{name}.png"] = px[..., :3]
    rows = V.read_windows(spark, str(tmp_path), windowBytes=window, partitionBytes=4 * window).collect()
    got = whole(rows)
    assert set(got) == set(want)
    for name, px in want.items():
        assert (got[name] == px).all(), name
    # windows are small whatever the file's blocks are, a row of pixels or one block at least
    assert max(len(r.px) for r in rows) <= max(window, 16 * 16 * 6, 50 * 45 * 3 if window < 7000 else 0, 9 * 45 * 6)
    # blocks are what decoding whole files gives
    blocks = {}
    for r in V.read_blocks(spark, str(tmp_path), windowBytes=window).collect():
        a = blocks.setdefault(r.image_id.rsplit("/", 1)[-1], np.zeros((r.image_h, r.image_w, 3), int))
        a[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.px, "u1").reshape(r.h, r.w, 3)
    for name, px in want.items():
        assert (blocks[name] == R.normalised(px)[..., ::-1]).all(), name


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    # 96 MB in one plain strip, read in windows of 1 MB by partitions of 8 MB
    h, w = 6000, 16000
    row = (np.arange(w) % 251).astype(np.uint8)
    with open(tmp_path / "large.tif", "wb") as f:
        head = tiff(np.zeros((1, 1, 1), np.uint8), strip=1, big=True)
        f.write(head[:16])
        for y in range(h):
            f.write(np.roll(row, y).tobytes())
        at = f.tell()
        tags = {256: w, 257: h, 258: 8, 259: 1, 273: 16, 277: 1, 278: h, 279: h * w}
        f.write(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 16, 1, v) for t, v in sorted(tags.items())) + b"\0" * 8)
        f.seek(8)
        f.write(struct.pack("<Q", at))
    df = V.read_windows(spark, str(tmp_path), windowBytes=1 << 20, partitionBytes=8 << 20)
    assert df.rdd.getNumPartitions() >= 11
    got = df.select("y", "h", F.length("px").alias("n"), F.crc32("px").alias("crc")).collect()
    assert sum(r.h for r in got) == h and max(r.n for r in got) <= 1 << 20
    for r in got[::7]:
        assert r.crc == zlib.crc32(b"".join(np.roll(row, y).tobytes() for y in range(r.y, r.y + r.h)))


def test_what_cannot_be_read(spark, tmp_path):
    good = tiff(picture(20, 20, 3), deflate=True)
    (tmp_path / "none.tif").write_bytes(b"nothing of the kind")
    (tmp_path / "short.tif").write_bytes(tiff(picture(20, 20, 3))[:600])
    (tmp_path / "broken.tif").write_bytes(good[:40] + b"\0" * 30 + good[70:])
    (tmp_path / "half.png").write_bytes(R.encode_png(picture(40, 40, 3))[:900])
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "text.txt").write_text("no raster")
    rows = V.read_windows(spark, str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[-1] for r in rows if r.error} == {"none.tif", "short.tif", "broken.tif", "half.png"}
    # of a file that ends early there is what could be read
    assert [r.image_id.rsplit("/", 1)[-1] for r in V.read_blocks(spark, str(tmp_path)).collect() if r.h < r.image_h] in ([], ["half.png"])
    assert V.read_windows(spark, str(tmp_path / "nowhere")).count() == 0
    assert V.read_windows(spark, str(tmp_path / "none.tif")).count() == 1


def test_directories_without_pixels(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(picture(20, 30, 1), big=True))
    (tmp_path / "b.png").write_bytes(R.encode_png(picture(4, 4, 1)))
    got = {(r.path.rsplit("/", 1)[-1], r.tag): r.values for r in V.read_directories(V.list_rasters(spark, str(tmp_path))).collect()}
    assert got["a.tif", 256] == [30.0] and got["a.tif", 257] == [20.0] and {k for k, _ in got} == {"a.tif"}


@pytest.mark.parametrize("aligned", [True, False])
def test_mosaics_round_trip(spark, tmp_path, aligned):
    images = {"a": picture(150, 230, 3), "b": picture(64, 64, 3), "m": picture(90, 33, 1)}
    side = 64 if aligned else 50
    rows = []
    for name, px in images.items():
        h, w, c = px.shape
        for y in range(0, h, side):
            for x in range(0, w, side):
                if (name, y, x) == ("a", side, side):
                    px[y : y + side, x : x + side] = 0  # no block: zeros
                    continue
                part = np.ascontiguousarray(px[y : y + side, x : x + side])
                rows.append((name, h, w, y, x, *part.shape[:2], c, bytearray(part.tobytes())))
    made = V.write_mosaics(spark.createDataFrame(rows, E.BLOCK), str(tmp_path / "out"), "_x", tile=32, aligned=aligned).collect()
    assert {r.image_id: r.tiles for r in made} == {"a": 40, "b": 4, "m": 6}
    got = whole(V.read_windows(spark, str(tmp_path / "out"), windowBytes=4000).collect())
    assert set(got) == {"a_x.tif", "b_x.tif", "m_x.tif"}
    for name, px in images.items():
        assert (got[f"{name}_x.tif"] == px).all()
    for r in made:
        assert (tmp_path / "out" / f"{r.image_id}_x.tif").stat().st_size == r.bytes
    assert not list((tmp_path / "out").glob("*.part"))
    assert V.write_mosaics(spark.createDataFrame([], E.BLOCK), str(tmp_path / "none")).count() == 0
