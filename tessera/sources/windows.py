"""Rasters of any size as a Spark data source of windows, and mosaics written as one tiled file each.

Reading plans from the tag directory alone: a file is cut into windows of about ``window_bytes`` decoded pixels, rows of
strips, tiles, or rows inside one plain strip, and a partition is a range of windows of one file or several small files. A task reads the bytes
of its windows and no others, so a file may be larger than any task's memory; TIFF and BigTIFF, either byte order.
PNG files, and strips that are packed as a whole and larger than a window, are unpacked as streams, a band of rows at a time (LZW strips whole).

Files are opened by ``pyarrow.fs``: local paths, and stores it has a client for.

Writing cuts blocks into tiles where they lie, packs each in a task, and lays a mosaic's tiles one after another in
its file: the file's directory comes last and its place follows from the sum of the tiles' sizes, so a task streams through
sorted tiles and holds one at a time.

Defined cases: what can't be read is one row with ``error`` and null pixels, beside windows of the same file that can; a folder without rasters gives no rows;
tiles that no block covers are zero, written once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.graph import shared
from tessera.sources.rasters import FIELD_BYTES, FIELD_CODE, PNG_CHANNELS, PNG_START, SUFFIXES, UNPACK, normalised, undone_line

WINDOW_BYTES, PARTITION_BYTES = 8 << 20, 64 << 20
#: the eight-byte field types of BigTIFF
WIDE_BYTES, WIDE_CODE = {16: 8, 17: 8, 18: 8}, {16: "Q", 17: "q", 18: "Q"}
SCHEMA = "path string, image_h int, image_w int, y int, x int, h int, w int, bands int, bits int, top int, px binary, error string"
ARROW = pa.schema([("path", pa.string()), *[(c, pa.int32()) for c in ("image_h", "image_w", "y", "x", "h", "w", "bands", "bits", "top")], ("px", pa.binary()), ("error", pa.string())])
BROADCAST_FILES = 100_000  #: files of more than 8 bits whose maxima are broadcast, counted first


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return (pafs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else pafs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


def rasters_of(folder: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in microseconds) of the raster files of a folder, or of one file, by path; files of no bytes are passed over."""
    fs, path = store(folder)
    info = fs.get_file_info(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path)) if info.type == pafs.FileType.Directory else []
    head = folder[: len(folder.rstrip("/")) - len(path.rstrip("/"))] if "://" in folder or folder.startswith("file:") else ""
    return sorted((head + f.path, f.size, (f.mtime_ns or 0) // 1000) for f in found if f.type == pafs.FileType.File and f.size and f.path.rsplit(".", 1)[-1] in SUFFIXES)


class Tiff:
    """A file's first tag directory; arrays of offsets stay in the file and are read by slices."""

    def __init__(self, f):
        self.f = f
        head = self._read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack_from(f"{order}H", head, 2)[0] if order and len(head) >= 8 else 0
        if kind not in (42, 43):
            raise ValueError("not a TIFF file")
        self.order, wide = order, kind == 43
        at = struct.unpack_from(f"{order}Q", head, 8)[0] if wide else struct.unpack_from(f"{order}I", head, 4)[0]
        count, entry, inline = ("Q", "HHQ", 8) if wide else ("H", "HHI", 4)
        skip = struct.calcsize(f"{order}{count}")
        n = struct.unpack(f"{order}{count}", self._read(at, skip))[0]
        size = struct.calcsize(f"{order}{entry}") + inline
        raw = self._read(at + skip, n * size)
        self.entries: dict[int, tuple[int, int, int]] = {}  # tag to (field type, values, where they start)
        for k in range(n):
            tag, field, values = struct.unpack_from(f"{order}{entry}", raw, k * size)
            each = FIELD_BYTES.get(field) or WIDE_BYTES.get(field, 1)
            where = at + skip + (k + 1) * size - inline
            if each * values > inline:
                where = struct.unpack_from(f"{order}{'Q' if wide else 'I'}", raw, (k + 1) * size - inline)[0]
            self.entries[tag] = (field, values, where)

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        got = self.f.read(n)
        if at and len(got) < n:
            raise ValueError("ends beyond the file")
        return got

    def values(self, tag: int, first: int = 0, last: int | None = None) -> tuple:
        """The tag's values from ``first`` up to ``last``; field types without a simple code give none."""
        if tag not in self.entries:
            return ()
        field, n, where = self.entries[tag]
        code = FIELD_CODE.get(field) or WIDE_CODE.get(field)
        if code is None:
            return ()
        last = n if last is None else min(n, last)
        each = FIELD_BYTES.get(field) or WIDE_BYTES[field]
        return struct.unpack(f"{self.order}{max(0, last - first)}{code}", self._read(where + each * first, each * max(0, last - first)))

    def one(self, tag: int, default: int) -> int:
        return (self.values(tag, 0, 1) or (default,))[0]

    def layout(self) -> Tiff:
        """Reads what pixels need; an error if they can't be read."""
        self.w, self.h, self.c = self.one(256, 0), self.one(257, 0), self.one(277, 1)
        self.bits, self.packing, self.predictor, planar = self.one(258, 8), self.one(259, 1), self.one(317, 1), self.one(284, 1)
        self.tiled = 324 in self.entries
        if self.bits not in (8, 16) or self.packing not in UNPACK or self.predictor not in (1, 2) or planar not in (1, 2) or not (self.tiled or 273 in self.entries):
            raise ValueError(f"TIFF layout not supported: {self.bits} bits, compression {self.packing}, predictor {self.predictor}")
        self.bw, self.bh = (self.one(322, 0), self.one(323, 0)) if self.tiled else (self.w, min(self.h, self.one(278, self.h)))
        if min(self.w, self.h, self.c, self.bw, self.bh) < 1:
            raise ValueError("TIFF of no pixels")
        self.starts, self.sizes = (324, 325) if self.tiled else (273, 279)
        self.across, self.down = -(-self.w // self.bw), -(-self.h // self.bh)
        self.planes, self.deep = (self.c, 1) if planar == 2 else (1, self.c)
        if self.entries[self.starts][1] != self.planes * self.across * self.down:
            raise ValueError(f"TIFF of {self.entries[self.starts][1]} blocks, not {self.planes * self.across * self.down}")
        self.pixel = self.c * self.bits // 8
        return self

    def windows(self, window_bytes: int) -> list[tuple[str, int, int, int, int]]:
        """(how, y0, y1, x0, x1): windows along the file's blocks; how is blocks, rows (inside a plain strip) or stream."""
        row = self.bh * self.across * self.bw * self.pixel
        if not self.tiled and row > window_bytes and self.planes == 1 and self.packing != 5:
            if self.packing == 1:
                n = max(1, window_bytes // (self.w * self.pixel))
                return [("rows", y, min(y + n, s + self.bh, self.h), 0, self.w) for s in range(0, self.h, self.bh) for y in range(s, min(s + self.bh, self.h), n)]
            return [("stream", y, min(y + self.bh, self.h), 0, self.w) for y in range(0, self.h, self.bh)]
        down = max(1, window_bytes // row) * self.bh
        wide = max(1, window_bytes // (self.bh * self.bw * self.pixel)) * self.bw if row > window_bytes else self.across * self.bw
        return [("blocks", y, min(y + down, self.h), x, min(x + wide, self.w)) for y in range(0, self.h, down) for x in range(0, self.w, wide)]

    def _pixels(self, raw: bytes, rows: int, cols: int) -> np.ndarray:
        a = np.frombuffer(raw, f"{self.order}u{self.bits // 8}", rows * cols * self.deep).astype(f"u{self.bits // 8}").reshape(rows, cols, self.deep)
        return np.cumsum(a, axis=1, dtype=a.dtype) if self.predictor == 2 else a

    def bands(self, window: tuple[str, int, int, int, int], window_bytes: int):
        """(y, x, pixels) of a window; a stream comes in several bands."""
        how, y0, y1, x0, x1 = window
        if how == "blocks":
            yield y0, x0, self._blocks(y0, y1, x0, x1)
            return
        strip = y0 // self.bh
        start, size = self.values(self.starts, strip, strip + 1)[0], self.values(self.sizes, strip, strip + 1)[0]
        line = self.w * self.pixel
        if how == "rows":
            yield y0, 0, self._pixels(self._read(start + (y0 - strip * self.bh) * line, (y1 - y0) * line), y1 - y0, self.w)
            return
        n, y = max(1, window_bytes // line), y0
        for band in _inflated(_ranges(self, start, size), n * line):
            rows = len(band) // line
            yield y, 0, self._pixels(band[: rows * line], min(rows, y1 - y), self.w)
            y += rows
            if y >= y1:
                return

    def _blocks(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        out = np.zeros((y1 - y0, x1 - x0, self.c), f"u{self.bits // 8}")
        a, b = x0 // self.bw, -(-x1 // self.bw)
        for plane in range(self.planes):
            for r in range(y0 // self.bh, -(-y1 // self.bh)):
                first = (plane * self.down + r) * self.across
                places = zip(self.values(self.starts, first + a, first + b), self.values(self.sizes, first + a, first + b))
                rows = self.bh if self.tiled else min(self.bh, self.h - r * self.bh)
                for k, (at, n) in zip(range(a, b), places):
                    if not n:
                        continue  # a tile that was never written
                    block = self._pixels(UNPACK[self.packing](self._read(at, n)), rows, self.bw)
                    top, left = r * self.bh - y0, k * self.bw - x0
                    part = block[: y1 - y0 - top, : x1 - x0 - left]
                    target = out[top : top + part.shape[0], left : left + part.shape[1]]
                    target[..., plane : plane + self.deep] = part
        return out


def _ranges(tiff: Tiff, start: int, size: int, step: int = 1 << 20):
    for at in range(start, start + size, step):
        yield tiff._read(at, min(step, start + size - at))


def _inflated(chunks, step: int):
    """Unpacked bytes in pieces of ``step``, the last one shorter."""
    z, held = zlib.decompressobj(), b""
    for chunk in chunks:
        while chunk:
            held += z.decompress(chunk, step - len(held))
            chunk = z.unconsumed_tail
            if len(held) == step:
                yield held
                held = b""
            elif not chunk:
                break
    held += z.flush()
    while held:
        yield held[:step]
        held = held[step:]


class Png:
    """A PNG file, read as a stream."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        head = f.read(33)
        if head[:8] != PNG_START or head[12:16] != b"IHDR":
            raise ValueError("not a PNG file")
        self.w, self.h, self.bits, colour, _, _, laced = struct.unpack_from(">IIBBBBB", head, 16)
        if self.bits not in (8, 16) or colour not in PNG_CHANNELS or laced:
            raise ValueError("PNG layout not supported")
        self.c = PNG_CHANNELS[colour]
        self.pixel = self.c * self.bits // 8

    def windows(self, window_bytes: int):
        return [("stream", 0, self.h, 0, self.w)]

    def _packed(self):
        at = 8
        while True:
            self.f.seek(at)
            head = self.f.read(8)
            if len(head) < 8:
                return
            n, kind = struct.unpack(">I4s", head)
            if kind == b"IDAT":
                for k in range(0, n, 1 << 20):
                    yield self.f.read(min(1 << 20, n - k))
            elif kind == b"IEND":
                return
            at += 12 + n

    def bands(self, window, window_bytes: int):
        line = self.w * self.pixel
        y, up = 0, np.zeros(line, np.uint8)
        for band in _inflated(self._packed(), max(1, window_bytes // line) * (line + 1)):
            rows = np.frombuffer(band, np.uint8, len(band) // (line + 1) * (line + 1)).reshape(-1, line + 1)
            out = np.empty((len(rows), line), np.uint8)
            for k, row in enumerate(rows):
                up = out[k] = undone_line(int(row[0]), row[1:], up, self.pixel)
            if len(rows):
                yield y, 0, out.view(">u2" if self.bits == 16 else "u1").astype(f"u{self.bits // 8}").reshape(len(rows), self.w, self.c)
            y += len(rows)
        if y < self.h:
            raise ValueError("PNG ends beyond the file")


def opened(path: str):
    """The raster behind a path, laid out for reading."""
    fs, at = store(path)
    f = fs.open_input_file(at)
    start = f.read(8)
    return Png(f) if start == PNG_START else Tiff(f).layout()


def _shown(px: np.ndarray) -> np.ndarray:
    """The channels that count: the first of gray ones, three of colour ones."""
    return px[..., :1] if px.shape[2] < 3 else px[..., :3]


class Windows(InputPartition):
    """Ranges of windows: (path, first, last)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


FAILED = (ValueError, TypeError, KeyError, OSError, struct.error, zlib.error)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for root in options["path"].split("\n") for p, _, _ in rasters_of(root)]
        self.window, self.most = int(options.get("windowbytes", WINDOW_BYTES)), int(options.get("partitionbytes", PARTITION_BYTES))
        self.deep = options.get("deep", "false") == "true"

    def partitions(self):
        from concurrent.futures import ThreadPoolExecutor

        def plan(path: str):
            try:
                r = opened(path)
                return [] if self.deep and r.bits == 8 else [(y1 - y0) * (x1 - x0) * r.pixel for _, y0, y1, x0, x1 in r.windows(self.window)]
            except FAILED:
                return [] if self.deep else [0]

        out, held, size = [], [], 0
        with ThreadPoolExecutor(16) as pool:
            for path, sizes in zip(self.paths, pool.map(plan, self.paths)):
                first = 0
                for k, n in enumerate(sizes):
                    if size + n > self.most and (held or k > first):
                        out.append(Windows(held + ([(path, first, k)] if k > first else [])))
                        held, size, first = [], 0, k
                    size += n
                if len(sizes) > first:
                    held.append((path, first, len(sizes)))
        return out + ([Windows(held)] if held else []) or [Windows([])]

    def read(self, partition):
        for path, first, last in partition.ranges:
            try:
                r = opened(path)
                for window in r.windows(self.window)[first:last]:
                    for y, x, px in r.bands(window, self.window):
                        px = _shown(px)
                        row = {"path": path, "image_h": r.h, "image_w": r.w, "y": y, "x": x, "h": px.shape[0], "w": px.shape[1], "bands": px.shape[2], "bits": r.bits, "top": int(px.max(initial=0)), "px": px.tobytes(), "error": None}
                        yield pa.RecordBatch.from_pylist([row], ARROW)
            except FAILED as e:
                yield pa.RecordBatch.from_pylist([{**dict.fromkeys(ARROW.names), "path": path, "error": str(e)[:200]}], ARROW)


class RasterWindows(DataSource):
    """``spark.read.format("raster_windows")``: options path (several: a line each), windowBytes, partitionBytes, deep (only files of more than 8 bits)."""

    @classmethod
    def name(cls):
        return "raster_windows"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_windows(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """The windows of all rasters of folders or files."""
    spark.dataSource.register(RasterWindows)
    return spark.read.format("raster_windows").options(path="\n".join(paths), **{k: str(v).lower() for k, v in options.items()}).load()


def read_blocks(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """The windows as the engine's blocks: three byte channels, blue first, values of an image beyond 255 scaled by its greatest."""
    windows = read_windows(spark, *paths, **options).filter("px IS NOT NULL")
    tops = shared(read_windows(spark, *paths, deep="true", **options).filter("top > 255").groupBy("path").agg(F.max("top").alias("most")))
    few = tops.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    both = windows.join(F.broadcast(tops) if few else tops, "path", "left")

    def run(batches):
        fields = [("image_id", pa.string()), *[(c, pa.int32()) for c in ("image_h", "image_w", "y", "x", "h", "w", "bands")], ("px", pa.binary())]
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                px = np.frombuffer(r["px"], f"u{r['bits'] // 8}").reshape(r["h"], r["w"], r["bands"])
                px = np.repeat(px, 3, axis=2) if r["bands"] == 1 else px[..., ::-1]
                px = (px.astype(float) / r["most"] * 255).astype("u1") if r["most"] else px.astype("u1")
                yield pa.RecordBatch.from_pylist([{**{f: r[f] for f in ("image_h", "image_w", "y", "x", "h", "w")}, "image_id": r["path"], "bands": 3, "px": px.tobytes()}], pa.schema(fields))

    cols = ["path", "image_h", "image_w", "y", "x", "h", "w", "bands", "bits", "px", "most"]
    return both.select(*cols).mapInArrow(run, "image_id string, image_h int, image_w int, y int, x int, h int, w int, bands int, px binary")


def list_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of the raster files of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder).select("path", "length", "modificationTime")


def read_directories(files: DataFrame) -> DataFrame:
    """(path, tag, values): the numeric tags of at most a thousand values of each TIFF of ``files`` (path); only directories are read."""

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    fs, at = store(path)
                    t = Tiff(fs.open_input_file(at))
                    rows += [{"path": path, "tag": tag, "values": [float(v) for v in t.values(tag)]} for tag, (_, n, _) in sorted(t.entries.items()) if n <= 1000]
                except FAILED:
                    continue
            yield pa.RecordBatch.from_pylist([r for r in rows if r["values"]], pa.schema([("path", pa.string()), ("tag", pa.int32()), ("values", pa.list_(pa.float64()))]))

    return files.select("path").mapInArrow(run, "path string, tag int, values array<double>")


# ---- mosaics as files

PART = "image_id string, image_h int, image_w int, bands int, k long, data binary"
MADE = "image_id string, path string, bytes long, tiles long"
_part = pa.schema([("image_id", pa.string()), ("image_h", pa.int32()), ("image_w", pa.int32()), ("bands", pa.int32()), ("k", pa.int64()), ("data", pa.binary())])


def _packed_tile(fragments: list[dict], tile: int) -> dict:
    r = fragments[0]
    out = np.zeros((tile, tile, r["bands"]), np.uint8)
    for f in fragments:
        out[f["y"] - f["ty"] :, f["x"] - f["tx"] :][: f["h"], : f["w"]] = np.frombuffer(f["px"], np.uint8).reshape(f["h"], f["w"], -1)
    k = r["ty"] // tile * -(-r["image_w"] // tile) + r["tx"] // tile
    return {"image_id": r["image_id"], "image_h": r["image_h"], "image_w": r["image_w"], "bands": r["bands"], "k": k, "data": zlib.compress(out.tobytes(), 1)}


def tiles_of(blocks: DataFrame, tile: int, aligned: bool) -> DataFrame:
    """Packed tiles of blocks; ``aligned``: blocks start at multiples of the tile and end there or with the image, so no tile is in two."""
    from tessera.operators.engine import _FRAGMENT, _fragments

    places = lambda h, w: (range(0, h, tile), range(0, w, tile), tile, tile)
    parts = blocks.mapInArrow(_fragments(places, "px", 1), _FRAGMENT)
    if not aligned:
        return parts.groupBy("image_id", "ty", "tx").applyInArrow(lambda t: pa.Table.from_pylist([_packed_tile(t.to_pylist(), tile)], _part), PART)

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([_packed_tile([r], tile) for r in b.to_pylist()], _part)

    return parts.mapInArrow(each, PART)


def directory(h: int, w: int, bands: int, tile: int, starts: array, sizes: array, at: int, extra: dict[int, tuple[int, list]]) -> bytes:
    """A BigTIFF tag directory that lies at ``at``, with its arrays behind it."""
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [8] * bands), 259: (3, [8]), 262: (3, [2 if bands > 2 else 1]), 277: (3, [bands]), 284: (3, [1]), 322: (4, [tile]), 323: (4, [tile]), 324: (16, starts), 325: (16, sizes)} | extra
    entries, later = [], []
    end = at + 16 + 20 * len(tags)
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"<{len(values)}{FIELD_CODE.get(kind) or WIDE_CODE[kind]}", *values)
        if len(raw) > 8:
            later.append(raw + b"\0" * (-len(raw) % 8))
            raw = struct.pack("<Q", end)
            end += len(later[-1])
        entries.append(struct.pack("<HHQ", tag, kind, len(values)) + raw.ljust(8, b"\0"))
    return struct.pack("<Q", len(tags)) + b"".join(entries) + struct.pack("<Q", 0) + b"".join(later)


def _written(folder: str, suffix: str, tile: int, extra: dict):
    """Rows sorted by image and tile: a file for each image, put in place when it is whole."""

    def finish(state):
        out, r, starts, sizes, at, temporary, path = (state[k] for k in ("out", "row", "starts", "sizes", "at", "temporary", "path"))
        n = -(-r["image_h"] // tile) * -(-r["image_w"] // tile)
        _gap(state, n)
        out.write(b"\0" * (state["directory"] - state["at"]))
        out.write(directory(r["image_h"], r["image_w"], r["bands"], tile, starts, sizes, state["directory"], extra))
        size = out.tell()
        out.close()
        state["fs"].move(temporary, path)
        return {"image_id": r["image_id"], "path": path, "bytes": size, "tiles": n}

    def _gap(state, upto: int):
        """Tiles without pixels share one of zeros."""
        missing = upto - len(state["starts"])
        if missing > 0:
            if state["zero"] is None:
                state["zero"] = (state["at"], len(state["empty"]))
                state["out"].write(state["empty"])
                state["at"] += len(state["empty"])
            state["starts"].extend([state["zero"][0]] * missing)
            state["sizes"].extend([state["zero"][1]] * missing)

    def begin(r: dict):
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root.rstrip('/')}/{r['image_id']}{suffix}.tif"
        temporary = f"{path}.{uuid.uuid4().hex}.part"
        empty = zlib.compress(bytes(tile * tile * r["bands"]), 1)
        # room for one empty tile is kept whether it is needed or not
        at = 16 + r["total"] + len(empty)
        out = fs.open_output_stream(temporary)
        out.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, at + at % 2))
        return {"fs": fs, "out": out, "row": r, "starts": array("Q"), "sizes": array("Q"), "at": 16, "temporary": temporary, "path": path, "zero": None, "empty": empty, "directory": at + at % 2}

    def run(batches):
        state, schema = None, pa.schema([("image_id", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("tiles", pa.int64())])
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                if state is None or r["image_id"] != state["row"]["image_id"]:
                    if state:
                        yield pa.RecordBatch.from_pylist([finish(state)], schema)
                    state = begin(r)
                data = r.pop("data")
                _gap(state, r["k"])
                state["starts"].append(state["at"])
                state["sizes"].append(len(data))
                state["out"].write(data)
                state["at"] += len(data)
        if state:
            yield pa.RecordBatch.from_pylist([finish(state)], schema)

    return run


def write_mosaics(blocks: DataFrame, folder: str, suffix: str = "", tile: int = 256, aligned: bool = False, extra: dict[int, tuple[int, list]] | None = None) -> DataFrame:
    """(image_id, path, bytes, tiles): one tiled BigTIFF under ``folder`` for each image of ``blocks``; further tags by ``extra``."""
    tiles = shared(tiles_of(blocks, tile, aligned))
    totals = tiles.groupBy("image_id").agg(F.sum(F.length("data")).alias("total"))
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = tiles.join(totals.hint("shuffle_hash"), "image_id").repartition(n, "image_id").sortWithinPartitions("image_id", "k")
    return shared(laid.select("image_id", "image_h", "image_w", "bands", "total", "k", "data").mapInArrow(_written(folder, suffix, tile, extra or {}), MADE))


__all__ = ["RasterWindows", "list_rasters", "normalised", "opened", "rasters_of", "read_blocks", "read_directories", "read_windows", "write_mosaics"]
