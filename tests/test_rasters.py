"""Codecs: exact round trips, the predictors against their definition, and broken files."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources import rasters as R


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.sampled_from(["u1", "u2"]), st.sampled_from("<>"), st.booleans(), st.integers(0, 2**31))
def test_round_trips(h, w, c, kind, order, deflate, seed):
    px = np.random.default_rng(seed).integers(0, np.iinfo(kind).max, (h, w, c), dtype=kind, endpoint=True)
    assert (R.decode_tiff(R.encode_tiff(px, order, deflate)) == px).all()
    assert (R.decode_png(R.encode_png(px)) == px).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=5, max_size=5), st.integers(0, 2**31))
def test_png_predictors(kinds, seed):
    px = np.random.default_rng(seed).integers(0, 256, (5, 4, 3)).astype(int)
    body = b""
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(4):
            for k in range(3):
                a, b, c = (px[y, x - 1, k] if x else 0), (px[y - 1, x, k] if y else 0), (px[y - 1, x - 1, k] if x and y else 0)
                nearest = sorted([(abs(a + b - c - a), 0, a), (abs(a + b - c - b), 1, b), (abs(a + b - c - c), 2, c)])[0][2]
                line.append((px[y, x, k] - [0, a, b, (a + b) // 2, nearest][kind]) % 256)
        body += bytes(int(v) for v in line)
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + b"\0\0\0\0"
    data = R.PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert (R.decode_png(data) == px).all()


def test_tags():
    data = R.encode_tiff(np.zeros((2, 2), "u1"), ">", extra={33550: (12, [0.5, 0.25, 0.0]), 34735: (3, [1, 1, 0, 1, 1024, 0, 1, 2])})
    tags = R.tiff_tags(data)
    assert tags[33550] == (0.5, 0.25, 0.0) and tags[34735][-1] == 2 and tags[256] == (2,)


def test_normalised():
    wide = np.array([[0, 1000], [500, 250]], "u2")
    assert R.normalised(wide)[..., 0].tolist() == [[0, 255], [127, 63]]
    assert R.normalised(np.full((1, 1, 4), 7, "u1")).shape == (1, 1, 3)


def test_broken_files(spark, tmp_path):
    good = R.encode_png(np.full((2, 3), 9, "u1"))
    for name, data in {"a.png": good, "b.TIF": R.encode_tiff(np.zeros((2, 2), "u1"))[:40], "c.tiff": b"", "d.png": good[:30], "e.jpg": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in R.read_rasters(R.find_rasters(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.png", "b.TIF", "d.png"}  # the reader passes over the empty file
    assert (got["a.png"].height, got["a.png"].width, bytes(got["a.png"].pixels)) == (2, 3, b"\x09" * 18)
    assert all(got[k].error and got[k].pixels is None for k in ("b.TIF", "d.png"))


def test_no_files(spark):
    none = spark.createDataFrame([("x", None), ("y", b"no archive")], "path string, content binary")
    assert R.open_bundles(none).count() == 0 and R.read_tags(none).count() == 0
    assert [r.error is not None for r in R.read_rasters(none).collect()] == [True, True]


def test_bundle_needs_image_and_mask(spark):
    data = R.pack_bundle([("patches/1/image.png", b"i"), ("patches/1/mask.png", b"m"), ("patches/2/image.png", b"i"), ("other/3/mask.png", b"m"), ("patches/1/metadata.json", b"{}")])
    got = R.open_bundles(spark.createDataFrame([("z", bytearray(data))], "path string, content binary")).collect()
    assert [(r.patch_id, bytes(r.mask), r.metadata) for r in got] == [("1", b"m", "{}")]


def test_unreadable_layout():
    with pytest.raises(ValueError):
        R.decode_tiff(b"II\x2b\x00\x08\x00\x00\x00\x00\x00")


def lzw(data: bytes) -> bytes:
    """Greedy packing: codes widen when entry 511, 1023, 2047 is made, and the table is cleared when it is full."""
    codes, table, before = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
    free, width = 258, 9
    for k in range(len(data)):
        one = data[k : k + 1]
        if before + one in table:
            before += one
            continue
        codes.append((table[before], width))
        table[before + one], free, before = free, free + 1, one
        width = next(n for n in (9, 10, 11, 12) if free <= 2**n - 1 or n == 12)
        if free == 4094:
            codes.append((256, width))
            table, free, width = {bytes([k]): k for k in range(256)}, 258, 9
    codes += [(table[before], width)] if before else []
    # the reader counts the last entry too
    codes.append((257, next(n for n in (9, 10, 11, 12) if free + 1 <= 2**n - 1 or n == 12)))
    bits = "".join(f"{c:0{n}b}" for c, n in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_lzw_by_hand():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes).ljust(88, "0")
    assert R.unpack_lzw(int(bits, 2).to_bytes(11, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 30_000), st.integers(1, 256), st.integers(0, 2**31))
def test_lzw_round_trip(n, values, seed):
    data = np.random.default_rng(seed).integers(0, values, n, dtype="u1").tobytes()
    assert R.unpack_lzw(lzw(data)) == data


def laid_out(px, order, packing, predictor, planar, tile):
    """A TIFF of the layout: blocks cut from the image, padded to whole tiles, differences along each line."""
    h, w, c = px.shape
    bh, bw = tile or (3, w)
    blocks = []
    for plane in range(c) if planar == 2 else [slice(None)]:
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                b = px[y : y + bh, x : x + bw, plane].reshape(min(bh, h - y), min(bw, w - x), -1)
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)), constant_values=5)
                if predictor == 2:
                    b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
                raw = b.astype(b.dtype.newbyteorder(order)).tobytes()
                blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[packing](raw))
    sizes = [len(b) for b in blocks]
    at = (8 + np.cumsum([0, *sizes[:-1]])).tolist()
    where = {322: (3, [bw]), 323: (3, [bh]), 324: (4, at), 325: (4, sizes)} if tile else {278: (3, [bh]), 273: (4, at), 279: (4, sizes)}
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [px.dtype.itemsize * 8] * c), 259: (3, [packing]), 277: (3, [c]), 284: (3, [planar]), 317: (3, [predictor])} | where
    body = b"".join(blocks)
    begin = 8 + len(body)
    later, entries, rest = b"", b"", begin + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{R.FIELD_CODE[kind]}", *values)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", rest + len(later)))
        later += raw if len(raw) > 4 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, begin) + body + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + later


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from([1, 3, 4]), st.sampled_from(["u1", "u2"]), st.sampled_from("<>"), st.sampled_from([1, 5, 8]), st.sampled_from([1, 2]), st.sampled_from([1, 2]), st.sampled_from([None, (16, 16), (32, 16)]), st.integers(0, 2**31))
def test_tiff_layouts(h, w, c, kind, order, packing, predictor, planar, tile, seed):
    px = np.random.default_rng(seed).integers(0, np.iinfo(kind).max, (h, w, c), dtype=kind, endpoint=True)
    data = laid_out(px, order, packing, predictor, planar, tile)
    assert (R.decode_tiff(data) == px).all()
    with pytest.raises((ValueError, zlib.error)):
        R.decode_tiff(laid_out(px, order, 1, predictor, planar, tile).replace(struct.pack(order + "HHI", 257, 4, 1) + struct.pack(order + "I", h), struct.pack(order + "HHI", 257, 4, 1) + struct.pack(order + "I", h + 64)))
