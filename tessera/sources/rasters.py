"""Raster and archive formats in plain NumPy, struct, zlib and zipfile, as readers of binary columns.

TIFF (strips or tiles; plain, LZW or deflate; horizontal differences; channels interleaved or in planes; 8 or 16
bits, either byte order) and PNG (8 or 16 bits, gray to RGBA, not interlaced). What the decoders cannot read gives a null image and the reason in ``error``, never a failed job.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: bytes per TIFF field type, PNG signature and channels per colour type.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
PNG_START = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

SUFFIXES = ("tif", "tiff", "TIF", "TIFF", "png", "PNG")


# ---- TIFF

def tiff_tags(data: bytes) -> dict[int, tuple]:
    """Tag to its values, from the first directory; field types without a simple code give their raw bytes."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = FIELD_BYTES.get(kind, 1) * n
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        raw = data[where : where + size]
        if len(raw) < size:
            raise ValueError(f"tag {tag} ends beyond the file")
        out[tag] = struct.unpack(f"{order}{n}{FIELD_CODE[kind]}", raw) if kind in FIELD_CODE else (raw,)
    return out


def encode_tiff(px: np.ndarray, order: str = "<", deflate: bool = False, extra: dict[int, tuple[int, list]] | None = None, strip: int = 4) -> bytes:
    """A strip TIFF of a gray or colour image; ``extra`` adds tags as (field type, values)."""
    px = px.reshape(*px.shape[:2], -1)
    h, w, c = px.shape
    bits = 16 if px.dtype.itemsize == 2 else 8
    strips = [px[y : y + strip].astype(f"{order}u{bits // 8}").tobytes() for y in range(0, h, strip)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    starts = list(np.cumsum([8, *map(len, strips)])[:-1].tolist())
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * c), 259: (3, [8 if deflate else 1]), 262: (3, [2 if c > 2 else 1]), 273: (4, starts), 277: (3, [c]), 278: (4, [strip]), 279: (4, [len(s) for s in strips])} | (extra or {})
    body = b"".join(strips)
    at = 8 + len(body) + len(body) % 2
    later, entries = b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{FIELD_CODE[kind]}", *values)
        if len(raw) <= 4:
            slot = raw.ljust(4, b"\0")
        else:
            slot = struct.pack(order + "I", base + len(later))
            later += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + slot
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + later


def unpack_lzw(data: bytes) -> bytes:
    """Variable-length codes of 9 to 12 bits, the highest bit first; code 256 clears the table, 257 ends."""
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, before, out, held, bits = fresh[:], 9, b"", [], 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = fresh[:], 9, b""
            continue
        if code > len(table) or code == len(table) and not before:
            raise ValueError("LZW code beyond the table")
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
            # codes grow one entry before the table needs it
            width = min(12, max(width, (len(table) + 1).bit_length()))
        before = entry
        out.append(entry)
    return b"".join(out)


UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}


def decode_tiff(data: bytes) -> np.ndarray:
    """Strips or tiles, channels interleaved or in planes, plain, LZW or deflate, with or without horizontal differences."""
    tags, order = tiff_tags(data), "<" if data[:2] == b"II" else ">"
    first = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, c = first(256, 0), first(257, 0), first(277, 1)
    bits, packing, predictor, planar = first(258, 8), first(259, 1), first(317, 1), first(284, 1)
    tiled = 324 in tags
    if bits not in (8, 16) or packing not in UNPACK or predictor not in (1, 2) or planar not in (1, 2) or not (tiled or 273 in tags):
        raise ValueError(f"TIFF layout not supported: {bits} bits, compression {packing}, predictor {predictor}")
    bw, bh = (first(322, 0), first(323, 0)) if tiled else (w, min(h, first(278, h)))
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if min(w, h, c, bw, bh) < 1:
        raise ValueError("TIFF of no pixels")
    planes, deep, across, down = (c, 1, -(-w // bw), -(-h // bh)) if planar == 2 else (1, c, -(-w // bw), -(-h // bh))
    if len(starts) != planes * across * down:
        raise ValueError(f"TIFF of {len(starts)} blocks, not {planes * across * down}")
    blocks = []
    for k, (at, n) in enumerate(zip(starts, sizes)):
        rows = bh if tiled else min(bh, h - k % down * bh)
        block = np.frombuffer(UNPACK[packing](data[at : at + n]), f"{order}u{bits // 8}", rows * bw * deep).astype(f"u{bits // 8}").reshape(rows, bw, deep)
        blocks.append(np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block)
    per = across * down
    whole = [np.concatenate([np.concatenate(blocks[p * per + y * across : p * per + (y + 1) * across], axis=1) for y in range(down)]) for p in range(planes)]
    return np.concatenate(whole, axis=2)[:h, :w]


# ---- PNG

def encode_png(px: np.ndarray) -> bytes:
    px = px.reshape(*px.shape[:2], -1)
    h, w, c = px.shape
    wide = px.dtype.itemsize == 2
    colour = {n: k for k, n in PNG_CHANNELS.items()}[c]
    rows = px.astype(">u2" if wide else "u1").reshape(h, -1).view("u1")
    body = np.concatenate([np.zeros((h, 1), "u1"), rows.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    return PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16 if wide else 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != PNG_START:
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if head is None or head[2] not in (8, 16) or head[3] not in PNG_CHANNELS or head[6]:
        raise ValueError("PNG layout not supported")
    w, h, bits, colour = head[:4]
    step = PNG_CHANNELS[colour] * bits // 8
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), "u1").reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w * step), "u1")
    for y in range(h):
        out[y + 1] = undone_line(int(lines[y, 0]), lines[y, 1:], out[y], step)
    return out[1:].copy().view(">u2" if bits == 16 else "u1").reshape(h, w, -1)


def undone_line(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    """The bytes of a line from its predictor, its differences and the line above."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype="u1").reshape(-1)
    if kind == 2:
        return line + up
    return np.array(_predicted(line.tolist(), up.tolist(), step, kind), "u1")


def _predicted(line: list[int], up: list[int], step: int, kind: int) -> list[int]:
    """Lines of the average (3) and Paeth (4) predictors."""
    row: list[int] = []
    for k, v in enumerate(line):
        a, b, c = (row[k - step] if k >= step else 0), up[k], (up[k - step] if k >= step else 0)
        guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        row.append((v + guess) & 255)
    return row


def normalised(px: np.ndarray) -> np.ndarray:
    """Three byte channels: gray is repeated, alpha dropped, values over 255 scaled by the greatest and cut."""
    px = px.reshape(*px.shape[:2], -1)
    px = np.repeat(px[..., :1], 3, axis=2) if px.shape[2] < 3 else px[..., :3]
    top = int(px.max(initial=0))
    return (px.astype(float) / top * 255 if top > 255 else px).astype("u1")


def decode(data: bytes) -> np.ndarray:
    return normalised(decode_png(data) if data[:8] == PNG_START else decode_tiff(data))


IMAGE = "path string, height int, width int, pixels binary, error string"


def _decoded(batches):
    for b in batches:
        rows = []
        for r in b.to_pylist():
            try:
                px = decode(r["content"])
                rows.append({"path": r["path"], "height": px.shape[0], "width": px.shape[1], "pixels": px.tobytes(), "error": None})
            except (ValueError, TypeError, KeyError, struct.error, zlib.error) as e:
                rows.append({"path": r["path"], "height": None, "width": None, "pixels": None, "error": str(e)[:200]})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]))


def find_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the raster files of a folder; the reader passes over files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder).select("path", "content")


def read_rasters(files: DataFrame) -> DataFrame:
    """Decodes (path, content) rows to interleaved three-byte pixels."""
    return files.select("path", "content").mapInArrow(_decoded, IMAGE)


def read_tags(files: DataFrame) -> DataFrame:
    """(path, tag, values): one row per numeric tag of each TIFF; files that are none give no row."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    tags = tiff_tags(r["content"] or b"")
                except (ValueError, struct.error):
                    continue
                rows += [{"path": r["path"], "tag": t, "values": [float(x) for x in v]} for t, v in sorted(tags.items()) if not isinstance(v[0] if v else 0, bytes)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("tag", pa.int32()), ("values", pa.list_(pa.float64()))]))

    return files.select("path", "content").mapInArrow(run, "path string, tag int, values array<double>")


def encode_patches(p: DataFrame, side: int) -> DataFrame:
    """(path, content) of (path, px, kind) rows; kind is tiff, tiff-be, tiff-deflate, png, png-rgb or png-rgba."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                px, kind = np.array(r["px"], "u1").reshape(-1, side), r["kind"]
                if kind.startswith("png"):
                    data = encode_png(px if kind == "png" else np.stack([px] * 3 + ([px * 0] if kind == "png-rgba" else []), axis=2))
                else:
                    data = encode_tiff(px, ">" if kind == "tiff-be" else "<", kind == "tiff-deflate")
                rows.append({"path": r["path"], "content": data})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return p.select("path", "px", "kind").mapInArrow(run, "path string, content binary")


# ---- bundles

def pack_bundle(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def open_bundles(files: DataFrame) -> DataFrame:
    """(path, patch_id, image, mask, metadata) of each archive's patches/<id>/ folders that hold both image and mask.

    Metadata is optional. Of an entry that is given twice the last counts; what is no archive gives no row.
    """

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                try:
                    z = zipfile.ZipFile(io.BytesIO(r["content"] or b""))
                except zipfile.BadZipFile:
                    continue
                names = set(z.namelist())
                ids = sorted({n.split("/")[1] for n in names if n.startswith("patches/") and n.count("/") == 2})
                rows = []
                for i in ids:
                    get = lambda kind: z.read(f"patches/{i}/{kind}") if f"patches/{i}/{kind}" in names else None  # noqa: B023, E731
                    image, mask, meta = get("image.png"), get("mask.png"), get("metadata.json")
                    if image is not None and mask is not None:
                        rows.append({"path": r["path"], "patch_id": i, "image": image, "mask": mask, "metadata": meta and meta.decode("utf-8", "replace")})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("patch_id", pa.string()), ("image", pa.binary()), ("mask", pa.binary()), ("metadata", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, patch_id string, image binary, mask binary, metadata string")


def pixels(images: DataFrame, channel: int = 0) -> DataFrame:
    """(path, y, x, g) of one channel of decoded images."""
    i = images.filter("pixels IS NOT NULL").select("path", "width", F.explode(F.expr("sequence(0, height * width - 1)")).alias("i"), "pixels")
    return i.selectExpr("path", "CAST(i DIV width AS INT) AS y", "CAST(i % width AS INT) AS x", f"CAST(conv(hex(substring(pixels, i * 3 + {channel + 1}, 1)), 16, 10) AS INT) AS g")
