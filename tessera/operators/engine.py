"""The raster operators on a user's own tables: images and patches of any size.

Images are stored as blocks, rows of ``BLOCK``; patches have the same columns, y and x being their place in the
image. Kernels run on Arrow batches of rows as they lie; only cutting across blocks, putting patches together and
joining components across blocks shuffle, by (image, place), so no task holds an image.

Defined cases: null or undecodable pixels are passed over; an image smaller than a patch gives one patch filled up
with zeros; empty tables give no rows; other columns are kept where a patch stays a row.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions import raster as K
from tessera.functions.cascade import first_failure
from tessera.functions.graph import components as graph_components
from tessera.functions.graph import shared
from tessera.functions.kernels import label_tile, pieces
from tessera.functions.shapes import distances, edge, filled, shape, split
from tessera.operators.pixels import grid_positions
from tessera.settings import Augmentation, Filters, Labels, Measures, Tiling, Tuning

BLOCK = "image_id string, image_h int, image_w int, y int, x int, h int, w int, bands int, px binary"
KEY = ["image_id", "image_h", "image_w", "y", "x"]
_types = {"image_id": pa.string(), **dict.fromkeys(["image_h", "image_w", "y", "x", "h", "w", "bands"], pa.int32()), "px": pa.binary()}
_block = pa.schema(list(_types.items()))
BATCH = 8  #: patches handed to a scorer at once


def image(row: dict, column: str = "px", kind: str = "u1") -> np.ndarray:
    a = np.frombuffer(row[column], kind)
    return a.reshape(row["h"], row["w"], -1) if kind == "u1" and column == "px" else a.reshape(row["h"], row["w"])


def known(row: dict) -> np.ndarray:
    """Where the row's mask is known: everywhere, unless bytes ``known`` say otherwise."""
    return image(row, "known") > 0 if row.get("known") is not None else np.ones((row["h"], row["w"]), bool)


def each(df: DataFrame, kernel, **new: str) -> DataFrame:
    """Adds (or replaces) columns by a kernel of one row: a dict to a dict, or None to drop it."""
    added = {k: v for k, v in new.items() if k not in df.columns}
    schema = ", ".join([*(f"`{f.name}` {new.get(f.name, f.dataType.simpleString())}" for f in df.schema.fields), *(f"`{k}` {v}" for k, v in added.items())])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in pieces(batches):
            rows = [{**r, **got} for r in b.to_pylist() if r["px"] is not None and (got := kernel(r)) is not None]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, schema)


# ---- blocks and patches

def blocks(rasters: DataFrame) -> DataFrame:
    """One block for each decoded raster (path, height, width, pixels), its channels reversed to blue first; those that could not be read are left out."""
    r = rasters.filter("pixels IS NOT NULL")
    named = r.select(F.col("path").alias("image_id"), F.col("height").alias("image_h"), F.col("width").alias("image_w"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("height").alias("h"), F.col("width").alias("w"), F.lit(3).alias("bands"), F.col("pixels").alias("px"))
    return each(named, lambda b: {"px": np.ascontiguousarray(image(b)[..., ::-1]).tobytes()}, px="binary")


def _fragments(places, column: str, item: int):
    """The parts of each row's rectangle inside every target rectangle it meets; ``places(h, w)`` gives (ys, xs, height, width)."""
    fields = ["image_id", "image_h", "image_w", "ty", "tx", "y", "x", "h", "w", "bands", "px"]
    schema = pa.schema([pa.field(f, _types.get(f, pa.int32())) for f in fields])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                if r[column] is None:
                    continue
                bands = r["bands"] if item == 1 else 1
                a = np.frombuffer(r[column], f"V{item}").reshape(r["h"], r["w"], bands)
                ys, xs, th, tw = places(r["image_h"], r["image_w"])
                out = []
                for ty in ys:
                    y0, y1 = max(ty, r["y"]), min(ty + th, r["y"] + r["h"], r["image_h"])
                    for tx in xs if y0 < y1 else ():
                        x0, x1 = max(tx, r["x"]), min(tx + tw, r["x"] + r["w"], r["image_w"])
                        if x0 < x1:
                            part = a[y0 - r["y"] : y1 - r["y"], x0 - r["x"] : x1 - r["x"]]
                            out.append({"image_id": r["image_id"], "image_h": r["image_h"], "image_w": r["image_w"], "ty": ty, "tx": tx, "y": y0, "x": x0, "h": y1 - y0, "w": x1 - x0, "bands": bands, "px": part.tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


_FRAGMENT = "image_id string, image_h int, image_w int, ty int, tx int, y int, x int, h int, w int, bands int, px binary"


def _filled_patch(size: int, cover: bool):
    schema = _block.append(pa.field("cover", pa.binary())) if cover else _block

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = rows[0]
        out, lies = np.zeros((size, size, r["bands"]), np.uint8), np.zeros((size, size), np.uint8)
        for f in rows:
            at = slice(f["y"] - f["ty"], f["y"] - f["ty"] + f["h"]), slice(f["x"] - f["tx"], f["x"] - f["tx"] + f["w"])
            out[at], lies[at] = image(f), 1
        got = {"image_id": r["image_id"], "image_h": r["image_h"], "image_w": r["image_w"], "y": r["ty"], "x": r["tx"], "h": size, "w": size, "bands": r["bands"], "px": out.tobytes()}
        return pa.Table.from_pylist([got | {"cover": lies.tobytes()} if cover else got], schema)

    return run


def cut(stored: DataFrame, t: Tiling = Tiling(), cover: bool = False) -> DataFrame:
    """Patches of all blocks, in row-major places; what lies outside the image or in no block is zero. ``cover`` adds a column of that name, 1 where a block lies."""
    places = lambda h, w: (grid_positions(h, t.size, t.stride), grid_positions(w, t.size, t.stride), t.size, t.size)
    return stored.mapInArrow(_fragments(places, "px", 1), _FRAGMENT).groupBy("image_id", "ty", "tx").applyInArrow(_filled_patch(t.size, cover), BLOCK + ", cover binary" * cover)


def gate(patches: DataFrame, t: Tiling = Tiling()) -> DataFrame:
    """Adds black, std, mean, noise and reason: the first gate that fails with its value, else ``valid``."""

    def kernel(r: dict) -> dict:
        g = K.gray_of(image(r)).astype(float)
        return {"black": float((g < 5).mean()), "std": float(g.std()), "mean": float(g.mean()), "noise": float(np.median(np.abs(K.stencil(g, K.LAPLACE))))}

    c = F.col
    said = lambda name, form: F.concat(F.lit(f"{name}="), F.format_string(form, c(name if name != "black_fraction" else "black")))
    reason = F.when(c("black") > t.max_black, said("black_fraction", "%.2f")).when(c("std") < t.min_std, said("std", "%.1f")).when(c("mean") < t.min_mean, said("mean", "%.1f"))
    reason = reason.when(c("noise") > t.max_noise, said("noise", "%.1f")) if t.max_noise > 0 else reason
    return each(patches, kernel, black="double", std="double", mean="double", noise="double").withColumn("reason", reason.otherwise("valid"))


def put_together(patches: DataFrame, column: str, side: int = 1024, kind: str = "u1", sigma_scale: float | None = None) -> DataFrame:
    """Blocks of at most ``side`` pixels with the mean of the patches that cover each pixel, 0 where none does.

    ``kind`` is u1 (cut to bytes) or f4. With ``sigma_scale`` patches weigh most in their middle, by a Gaussian of that
    share of their size, at least a thousandth. Where patches have a ``cover``, pixels outside it do not count. Adds ``cover``, 1 where a patch lies.
    """
    covers = "cover" in patches.columns
    item = np.dtype(kind).itemsize

    def places(h: int, w: int):
        return list(range(0, h, side)), list(range(0, w, side)), side, side

    def weight(n: int) -> np.ndarray:
        if sigma_scale is None:
            return np.ones(n)
        k = np.exp(-((np.arange(n) - (n - 1) / 2) ** 2) / (2 * (n * sigma_scale) ** 2))
        return k / k.max()

    def parts(batches):
        # patches carry their own weights along, as a second plane of floats
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r[column] is None:
                    continue
                v = np.frombuffer(r[column], kind).reshape(r["h"], r["w"], -1).astype("f4")
                k = np.clip(np.outer(weight(r["h"]), weight(r["w"])), 1e-3, 1)[..., None].astype("f4")
                if covers and r["cover"] is not None:
                    k = k * image(r, "cover")[..., None]
                rows.append({**{f: r[f] for f in ("image_id", "image_h", "image_w", "y", "x", "h", "w")}, "bands": v.shape[2], "px": np.concatenate([v * k, k], axis=2).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _block)

    def spread(batches):
        for b in parts(batches):
            for r in b.to_pylist():
                step = 4 * (r["bands"] + 1)
                flat = pa.RecordBatch.from_pylist([{**r, "bands": 1}], _block)
                for out in _fragments(places, "px", step)(iter([flat])):
                    yield out.set_column(out.schema.get_field_index("bands"), "bands", pa.array([r["bands"]] * out.num_rows, pa.int32()))

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = rows[0]
        h, w = min(side, r["image_h"] - r["ty"]), min(side, r["image_w"] - r["tx"])
        acc = np.zeros((h, w, r["bands"] + 1))
        for f in rows:
            acc[f["y"] - f["ty"] : f["y"] - f["ty"] + f["h"], f["x"] - f["tx"] : f["x"] - f["tx"] + f["w"]] += np.frombuffer(f["px"], "f4").reshape(f["h"], f["w"], -1)
        weight_ = acc[..., -1:]
        mean = np.where(weight_ > 1e-6, acc[..., :-1] / np.maximum(weight_, 1e-12), 0)
        data = K.byte(mean + 1e-4) if kind == "u1" else mean.astype("f4")
        got = {"image_id": r["image_id"], "image_h": r["image_h"], "image_w": r["image_w"], "y": r["ty"], "x": r["tx"], "h": h, "w": w, "bands": r["bands"], "px": data.tobytes(), "cover": (weight_[..., 0] > 1e-6).astype("u1").tobytes()}
        return pa.Table.from_pylist([got], _block.append(pa.field("cover", pa.binary())))

    laid = patches.select("image_id", "image_h", "image_w", "y", "x", "h", "w", "bands", *(["cover"] if covers else []), column)
    return laid.mapInArrow(spread, _FRAGMENT).groupBy("image_id", "ty", "tx").applyInArrow(total, BLOCK + ", cover binary")


# ---- tuning and filters

def _clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _search(gray: np.ndarray, d: int, colours, spaces) -> tuple[float, float]:
    """The pair of sigmas whose bilateral filter leaves the least median local variance; the last of equal ones."""
    g, r = gray.astype(float), d // 2
    pad, (h, w) = K.padded(g, r), g.shape
    curve = np.exp(-(np.arange(256.0)[None] ** 2) / (2 * np.array(colours, float)[:, None] ** 2))
    total = np.zeros((len(colours), len(spaces), h, w), np.float32)
    weight = np.zeros_like(total)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                near = pad[r + dy : r + dy + h, r + dx : r + dx + w]
                one = curve[:, np.abs(near - g).astype(int)].astype(np.float32)
                for k, s in enumerate(spaces):
                    both = one * np.float32(math.exp(-(dy * dy + dx * dx) / (2 * s * s)))
                    weight[:, k] += both
                    total[:, k] += both * near.astype(np.float32)
    left = np.array([[np.median(K.local_variance(K.byte(np.floor(total[a, b] / weight[a, b] + 0.5)))) for b in range(len(spaces))] for a in range(len(colours))])
    a, b = np.argwhere(left == left.min())[-1]
    return float(colours[a]), float(spaces[b])


def tune(patches: DataFrame, t: Tuning = Tuning(), search: bool = True) -> DataFrame:
    """Adds ``tuned``: a patch's diagnostics and the parameters they choose. Without ``search`` the sigmas are the lower ends."""

    def kernel(r: dict) -> dict:
        bgr = image(r)
        gray, light = K.gray_of(bgr), np.floor(K.lab_of(bgr)[..., 0] + 0.5)
        ok = gray > K.BORDER_GRAY
        out = {"contrast": 0.0, "noise": 0.0, "skew": 0.0, "uniformity": 0.0}
        if ok.sum() >= K.FEW:
            v, std = light[ok], light[ok].std()
            out["contrast"] = float(np.subtract(*np.percentile(v, (75, 25))))
            out["noise"] = float(1.4826 * np.median(np.abs(K.stencil(gray.astype(float), K.LAPLACE))[ok]))
            out["skew"] = float((((v - v.mean()) / std) ** 3).mean()) if std >= 1e-6 else 0.0
            out["uniformity"] = float(K.blur(np.where(ok, light, v.mean()), 30.0)[ok].std())
        var = K.local_variance(gray)
        high = np.percentile(var, 90) or 1
        d = int(np.median(15 - 10 * np.clip(var / high, 0, 1)))
        d += 1 - d % 2
        grown = 1 + 0.5 * min(1.0, out["noise"] / 15)
        grid = lambda lo, hi: list(range(lo, int(hi * grown) + 1, 10))
        colour, space = _search(gray, d, grid(*t.bilateral_colour), grid(*t.bilateral_space)) if search else (float(t.bilateral_colour[0]), float(t.bilateral_space[0]))
        return {"_d": {**out, "bilateral_d": d, "bilateral_colour": colour, "bilateral_space": space}}

    p = each(patches, kernel, _d="struct<contrast:double,noise:double,skew:double,uniformity:double,bilateral_d:int,bilateral_colour:double,bilateral_space:double>")
    d = lambda name: F.col(f"_d.{name}")
    along = lambda ends, at: F.lit(float(ends[0])) + at * float(ends[1] - ends[0])
    odd = lambda c: F.floor(c) + 1 - F.floor(c) % 2
    by_contrast, by_noise, worse = _clip01(d("contrast") / 40), _clip01(d("noise") / 20), _clip01(d("noise") / 15)
    by_skew, by_light = _clip01((d("skew") + 1) / 2), _clip01((d("uniformity") - 2) / 15)
    chosen = {
        "retinex_blend": along(t.msr_blend, by_contrast),
        "clahe_clip": along(t.clahe_clip, by_contrast) * (1 - 0.6 * worse),
        "clahe_blend": along(t.clahe_blend, by_contrast) * (1 - 0.5 * worse),
        "unsharp_strength": along(t.unsharp, by_contrast),
        "block_size": odd(along(t.block_size, by_skew)).cast("double"),
        "c_offset": along(t.c_offset, by_skew),
        "open_side": odd(along(t.open_side, by_light)).cast("double"),
        "close_side": odd(along(t.close_side, by_light)).cast("double"),
        "area_min": F.round(along(t.area_min, by_noise)),
        "area_max": F.lit(float(t.area_max)),
        "max_eccentricity": along(t.eccentricity, by_noise),
        "min_solidity": along(t.solidity[::-1], by_noise),
        "min_circularity": along(t.circularity[::-1], by_noise),
    }
    return p.withColumn("tuned", F.struct("_d.*", *[v.alias(k) for k, v in chosen.items()])).drop("_d")


class Params:
    """A patch's tuned values over the settings."""

    def __init__(self, *sections, **own):
        for s in sections:
            self.__dict__.update(s.__dict__)
        self.__dict__.update(own)


def enhance(patches: DataFrame, f: Filters = Filters(), steps: bool = False) -> DataFrame:
    """Runs the chain of filters with each patch's ``tuned`` values; names that are no filter are passed over.

    With ``steps`` the image after every filter is kept in an array of (name, px).
    """
    chain = [(n, K.FILTERS[n]) for n in f.chain if n in K.FILTERS]

    def kernel(r: dict) -> dict:
        px, p, log = image(r), Params(f, **r["tuned"]), []
        for name, apply in chain:
            px = apply(px, p)
            log.append({"name": name, "px": px.tobytes()})
        return {"px": px.tobytes(), **({"steps": log} if steps else {})}

    return each(patches, kernel, px="binary", **({"steps": "array<struct<name:string,px:binary>>"} if steps else {}))


# ---- proxy labels

REGION = "struct<region:int,area:double,n_inside:int,solidity:double,eccentricity:double,circularity:double,mean_score:double,mean_gray:double,mean_bg:double,starts:array<int>,lengths:array<int>>"


def score(patches: DataFrame, s: Labels = Labels()) -> DataFrame:
    """Adds score (floats), threshold, n_valid and the outer regions above it, with their shapes and pixel runs."""

    def kernel(r: dict) -> dict:
        gray, tuned = K.gray_of(image(r)).astype(float), Params(**r["tuned"])
        ok = gray > K.BORDER_GRAY
        n = int(ok.sum())
        if n < K.FEW:
            return {"score": np.zeros(gray.shape, "f4").tobytes(), "threshold": 0.0, "n_valid": n, "regions": []}
        ratio, around = K.contrast_ratio(gray, ok, s.background_sigma)
        value = np.where(ok, K.top_hat(gray, s.radii, s.texture_sigma, s.texture_most) * ratio, 0)
        limit = _limit(value[ok], tuned.noise, s)
        mask = K.opened(K.closed((value >= limit) & ok, int(tuned.close_side)), int(tuned.open_side)) > 0
        mask = split(mask, image(r), s.split_distance) if s.split_distance else mask
        lab = label_tile(filled(mask))
        return {"score": value.astype("f4").tobytes(), "threshold": limit, "n_valid": n, "regions": list(_regions(lab, value, gray, around))}

    return each(patches, kernel, score="binary", threshold="double", n_valid="int", regions=f"array<{REGION}>")


def _limit(values: np.ndarray, noise: float, s: Labels) -> float:
    """The score threshold: lower where many pixels pass it and noise is low, else that of a high percentile of positive scores."""
    positive = values[values > 0]
    if positive.size <= 100:
        return s.threshold
    dense = min(1.0, float((values > s.threshold).mean()) / s.dense_share) * (1 - float(np.clip((noise - 4) / 4, 0, 1)))
    low = s.threshold + dense * (s.dense_threshold - s.threshold)
    high = float(np.percentile(positive, s.percentiles[1] + dense * (s.percentiles[0] - s.percentiles[1])))
    return low + (1 - dense) * max(0.0, high - low)


def _regions(lab: np.ndarray, value, gray, around):
    flat = lab.reshape(-1)
    order = np.argsort(flat, kind="stable")
    order = order[flat[order] >= 0]
    w = lab.shape[1]
    for at in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1) if len(order) else ():
        ys, xs = at // w, at % w
        box = np.zeros((int(ys.max() - ys.min()) + 1, int(xs.max() - xs.min()) + 1), bool)
        box[ys - ys.min(), xs - xs.min()] = True
        got = shape(box)
        first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (ys[1:] != ys[:-1])])
        mean = lambda a: float(a.reshape(-1)[at].mean())  # noqa: B023, E731
        yield {"region": int(at[0]), "n_inside": len(at), **{k: got[k] for k in ("area", "solidity", "eccentricity", "circularity")}, "mean_score": mean(value), "mean_gray": mean(gray), "mean_bg": mean(around), "starts": at[first].tolist(), "lengths": np.diff(np.r_[first, len(at)]).tolist()}


SHAPE_AREA = 20  #: smaller regions have no shape to test


def verdict(r: Column, tuned: str = "tuned", threshold: str = "threshold", s: Labels = Labels()) -> Column:
    """Why a region is rejected, by the first test that fails in order, else ``kept``."""
    return first_failure(lambda name: r[name], lambda name: F.col(f"{tuned}.{name}"), r["mean_score"] >= s.bypass * F.col(threshold), SHAPE_AREA, s.least_contrast)


def proxy_labels(patches: DataFrame, s: Labels = Labels()) -> DataFrame:
    """Adds mask (0 or 255), candidates, kept, coverage_pct, threshold and rejected (counts by reason) to tuned patches."""
    judged = score(patches, s).withColumn("regions", F.transform("regions", lambda r: F.struct(verdict(r, s=s).alias("verdict"), r["starts"].alias("starts"), r["lengths"].alias("lengths"))))

    def paint(r: dict) -> dict:
        mask = np.zeros(r["h"] * r["w"], np.uint8)
        for g in r["regions"]:
            if g["verdict"] == "kept":
                for a, n in zip(g["starts"], g["lengths"]):
                    mask[a : a + n] = 255
        return {"mask": mask.tobytes(), "coverage_pct": 100.0 * float((mask > 0).mean())}

    out = each(judged, paint, mask="binary", coverage_pct="double")
    said = F.transform("regions", lambda r: r["verdict"])
    counted = F.map_from_entries(F.transform(F.array_distinct(F.filter(said, lambda v: v != "kept")), lambda v: F.struct(v, F.size(F.filter(said, lambda w: w == v)))))
    return out.withColumn("candidates", F.size("regions")).withColumn("kept", F.size(F.filter(said, lambda v: v == "kept"))).withColumn("rejected", counted).drop("regions")


# ---- scoring, agreement, components

def default_scorer(batch: list[np.ndarray]) -> list[np.ndarray]:
    """A deterministic stand-in for a trained model: how dark and round against the surroundings, as a share."""
    out = []
    for bgr in batch:
        gray = K.gray_of(bgr).astype(float)
        ratio, _ = K.contrast_ratio(gray, gray > K.BORDER_GRAY, 30.0)
        value = K.top_hat(gray, (4, 8, 12), 2.0, 18.0) * ratio
        out.append(value / (value + 4.0))
    return out


def predict(patches: DataFrame, scorer=default_scorer, batch: int = BATCH) -> DataFrame:
    """Adds prob (floats) by a scorer of at most ``batch`` colour patches at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema.fields) + ", prob binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, batch):
                rows = [r for r in b.slice(k, batch).to_pylist() if r["px"] is not None]
                probs = scorer([image(r) for r in rows]) if rows else []
                yield pa.RecordBatch.from_pylist([{**r, "prob": np.asarray(p, "f4").tobytes()} for r, p in zip(rows, probs)], arrow)

    return patches.mapInArrow(run, schema)


def agreement(scored: DataFrame, m: Measures = Measures()) -> DataFrame:
    """Adds dice (of known places; null if both masks are empty there), asd and nsd (null if either is) of prob against mask, and pred (0 or 255)."""

    def kernel(r: dict) -> dict:
        p, y = image(r, "prob", "f4") >= m.threshold, image(r, "mask", "u1") > 0
        total = int(p[known(r)].sum() + y.sum())
        out = {"dice": (2 * float((p & y).sum()) + 1e-6) / (total + 1e-6) if total else None, "asd": None, "nsd": None, "pred": (p * np.uint8(255)).tobytes()}
        if p.any() and y.any():
            d = np.concatenate([distances(~b)[edge(a)] for a, b in ((p, y), (y, p))])
            out["asd"], out["nsd"] = float(d.mean()), float((d <= m.tolerance).mean())
        return out

    return each(scored, kernel, dice="double", asd="double", nsd="double", pred="binary")


def confident(scored: DataFrame, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """Adds what a confident prob and the mask disagree in: mean_prob, fp_frac (mask where prob is below ``low``), fn_frac (no mask where it
    is above ``high``), dice_disagreement, combined_score, missed_pixels, the sums and counts that thresholds follow from, and pred (0 or 255)."""

    def kernel(r: dict) -> dict:
        p, y = image(r, "prob", "f4").astype(float), image(r, "mask", "u1") > 0
        n, hard = p.size, p > 0.5
        off = known(r) & ~y
        fp, fn = int((y & (p < low)).sum()), int((off & (p > high)).sum())
        tiny = y.mean() < 0.001 and hard.mean() < 0.001
        dis = 0.0 if tiny else 1 - (2 * int((y & hard).sum()) + 1e-6) / (int(y.sum()) + int(hard.sum()) + 1e-6)
        out = {"mean_prob": float(p.mean()), "fp_frac": fp / n, "fn_frac": fn / n, "dice_disagreement": dis, "combined_score": 0.6 * fp / n + 0.3 * fn / n + 0.1 * dis, "missed_pixels": fn}
        return {**out, "p0": float(p[off].sum()), "n0": int(off.sum()), "p1": float(p[y].sum()), "n1": int(y.sum()), "pred": (hard * np.uint8(255)).tobytes()}

    doubles = ("mean_prob", "fp_frac", "fn_frac", "dice_disagreement", "combined_score", "p0", "p1")
    return each(scored, kernel, **dict.fromkeys(doubles, "double"), missed_pixels="bigint", n0="bigint", n1="bigint", pred="binary")


def components(masks: DataFrame, column: str = "px") -> DataFrame:
    """(image_id, component, area, y0, x0, y1, x1) of the 8-connected foreground of blocks, joined across their borders.

    Blocks are labelled on their own; only pixels on block borders meet, by place.
    """

    def run(batches):
        schema = pa.schema([("image_id", pa.string()), ("node", pa.string()), *[(c, pa.int64()) for c in ("area", "y0", "x0", "y1", "x1", "py", "px")]])
        for b in batches:
            for r in b.to_pylist():
                if r[column] is None:
                    continue
                lab = label_tile(np.frombuffer(r[column], "u1").reshape(r["h"], r["w"]) > 0)
                ys, xs = np.nonzero(lab >= 0)
                names, of, area = np.unique(lab[ys, xs], return_inverse=True, return_counts=True)
                node = [f"{r['image_id']}:{(k // r['w'] + r['y']) * r['image_w'] + k % r['w'] + r['x']:020d}" for k in names.tolist()]
                box = [np.full(len(names), f) for f in (1 << 40, 1 << 40, -1, -1)]
                for at, v, op in ((0, ys + r["y"], np.minimum), (1, xs + r["x"], np.minimum), (2, ys + r["y"], np.maximum), (3, xs + r["x"], np.maximum)):
                    op.at(box[at], of, v)
                rows = [{"image_id": r["image_id"], "node": n, "area": int(a), **{c: int(v[k]) for c, v in zip(("y0", "x0", "y1", "x1"), box)}} for k, (n, a) in enumerate(zip(node, area))]
                rim = (ys == 0) | (xs == 0) | (ys == r["h"] - 1) | (xs == r["w"] - 1)
                rows += [{"image_id": r["image_id"], "node": node[k], "py": int(y + r["y"]), "px": int(x + r["x"])} for y, x, k in zip(ys[rim], xs[rim], of[rim])]
                yield pa.RecordBatch.from_pylist(rows, schema)

    found = masks.mapInArrow(run, "image_id string, node string, area long, y0 long, x0 long, y1 long, x1 long, py long, px long")
    rim = found.filter("py IS NOT NULL").select("image_id", "py", "px", "node")
    steps = F.explode(F.expr("array(struct(0 AS dy, 1 AS dx), struct(1 AS dy, -1 AS dx), struct(1 AS dy, 0 AS dx), struct(1 AS dy, 1 AS dx))"))
    near = rim.withColumn("d", steps).select("image_id", (F.col("py") + F.col("d.dy")).alias("py"), (F.col("px") + F.col("d.dx")).alias("px"), F.col("node").alias("a"))
    links = near.join(rim.withColumnRenamed("node", "b"), ["image_id", "py", "px"]).filter("a <> b").select("a", "b").distinct()
    parts = found.filter("area IS NOT NULL").join(graph_components(links), "node", "left").withColumn("component", F.coalesce("root", "node"))
    return parts.groupBy("image_id", "component").agg(F.sum("area").alias("area"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))


def seafloor_masks(raw: DataFrame, masks: DataFrame, side: int = 1024) -> DataFrame:
    """Masks cut to the pixels that are not black in ``raw``, in blocks of ``side``, with ``sea``, the number of these pixels.

    Both come in blocks of any layout and meet by (image, place); pixels without a mask are 0, those without an image not seafloor.
    """
    places = lambda h, w: (range(0, h, side), range(0, w, side), side, side)
    plain = lambda r: {"px": ((K.gray_of(image(r)) > K.BORDER_GRAY) * np.uint8(1)).tobytes(), "bands": 1}
    floor = each(raw.select(*KEY, "h", "w", "bands", "px"), plain, px="binary", bands="int")
    given = each(masks.select(*KEY, "h", "w", "bands", "px"), lambda r: {"px": ((np.frombuffer(r["px"], "u1") > 0) * np.uint8(2)).tobytes()}, px="binary")
    parts = floor.unionByName(given).mapInArrow(_fragments(places, "px", 1), _FRAGMENT)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = rows[0]
        h, w = min(side, r["image_h"] - r["ty"]), min(side, r["image_w"] - r["tx"])
        bits = np.zeros((h, w), np.uint8)
        for f in rows:
            bits[f["y"] - f["ty"] :, f["x"] - f["tx"] :][: f["h"], : f["w"]] |= np.frombuffer(f["px"], "u1").reshape(f["h"], f["w"])
        got = {"image_id": r["image_id"], "image_h": r["image_h"], "image_w": r["image_w"], "y": r["ty"], "x": r["tx"], "h": h, "w": w, "bands": 1, "px": ((bits == 3) * np.uint8(255)).tobytes(), "sea": int((bits & 1).sum())}
        return pa.Table.from_pylist([got], _block.append(pa.field("sea", pa.int64())))

    return parts.groupBy("image_id", "ty", "tx").applyInArrow(meet, BLOCK + ", sea long")


def coverage(raw: DataFrame, masks: DataFrame, m: Measures = Measures(), pixel_sizes: DataFrame | None = None) -> DataFrame:
    """Coverage, counts, areas and densities of each image over its seafloor; fields in metres are null without a positive pixel size.

    ``pixel_sizes`` has (image_id, meters_per_pixel); without it all images have the settings' size.
    """
    masks = shared(seafloor_masks(raw, masks))
    floor = masks.groupBy("image_id").agg(F.sum("sea").alias("seafloor_pixels"))
    some = components(masks).filter(F.col("area") >= m.least_pixels).groupBy("image_id").agg(F.count("*").alias("nodule_count"), F.sum("area").alias("nodule_pixels"))
    out = floor.join(some, "image_id", "left").fillna(0, ["nodule_count", "nodule_pixels"])
    out = out.join(pixel_sizes, "image_id", "left") if pixel_sizes is not None else out.withColumn("meters_per_pixel", F.lit(m.meters_per_pixel))
    sea, px, n = F.col("seafloor_pixels"), F.col("nodule_pixels"), F.col("nodule_count")
    mpp = F.when(F.col("meters_per_pixel") > 0, F.col("meters_per_pixel"))
    area = sea * mpp * mpp
    share = lambda e, k: F.when(mpp.isNotNull(), F.when(sea > 0, F.round(e / area, k)).otherwise(0.0))
    return out.select("image_id", F.when(sea > 0, F.round(100.0 * px / sea, 4)).otherwise(0.0).alias("coverage_pct"), "nodule_count", "nodule_pixels", "seafloor_pixels", F.round(area, 4).alias("seafloor_area_m2"), F.round(px * mpp * mpp, 4).alias("nodule_area_m2"), share(n, 4).alias("nodule_density_per_m2"), share(px, 2).alias("nodule_px_density_per_m2"), mpp.alias("meters_per_pixel"))


# ---- training views, pictures

def objects(patches: DataFrame, a: Augmentation = Augmentation(), least: int = 4, most_share: float = 0.25) -> DataFrame:
    """(donor, piece, piece_mask, h, w): cut-outs of the mask components of well covered patches."""

    def kernel(r: dict) -> dict | None:
        if r["coverage_pct"] < a.paste_coverage:
            return None
        px, lab, out = image(r), label_tile(image(r, "mask", "u1") > 0), []
        for k in np.unique(lab[lab >= 0]):
            ys, xs = np.nonzero(lab == k)
            y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
            if least <= len(ys) <= most_share * lab.size and y1 - y0 < r["h"] and x1 - x0 < r["w"]:
                out.append({"px": px[y0:y1, x0:x1].tobytes(), "mask": ((lab[y0:y1, x0:x1] == k) * np.uint8(255)).tobytes(), "h": int(y1 - y0), "w": int(x1 - x0)})
        return {"objects": out}

    o = each(patches.select(*KEY, "h", "w", "bands", "px", "mask", "coverage_pct"), kernel, objects="array<struct<px:binary,mask:binary,h:int,w:int>>")
    return o.select(F.xxhash64(*KEY).alias("donor"), F.posexplode("objects").alias("n", "o")).select("donor", "n", "o.px", "o.mask", "o.h", "o.w")


def augment(patches: DataFrame, a: Augmentation = Augmentation(), epoch: int = 0, seed: int = 42) -> DataFrame:
    """One random view of each patch (px, mask): objects of other patches pasted in, then the image-wide changes.

    All chances follow from seed, epoch and the patch's key, so a lost task makes the same views again. Objects are numbered
    once; a patch draws its numbers, each object being as likely as any other, and meets them by an equi-join.
    """
    from tessera.operators.sampling import draw_key, numbered, offers

    every = shared(numbered(objects(patches, a), draw_key(seed, "objects", F.col("donor"), F.col("n"))))
    drawn = offers(patches.select(*KEY), F.concat_ws(":", *KEY), every.count(), a.paste_most, a.paste, seed, epoch)
    met = drawn.join(every.select("number", F.struct("px", "mask", "h", "w").alias("o")), "number")
    few = met.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "o"))).alias("offers"))  # at most paste_most each
    p = patches.join(few.select(*KEY, F.transform("offers", lambda x: x["o"]).alias("offers")), KEY, "left")

    def kernel(r: dict) -> dict:
        rng = np.random.default_rng([seed, epoch, hash_of(r)])
        px, mask = image(r), image(r, "mask", "u1")
        if r["offers"]:
            pieces = [(np.frombuffer(o["px"], "u1").reshape(o["h"], o["w"], -1), np.frombuffer(o["mask"], "u1").reshape(o["h"], o["w"])) for o in r["offers"]]
            px, mask = K.pasted(px, mask, pieces, rng)
        px, mask = K.augmented(px, mask, rng, a)
        return {"px": px.tobytes(), "mask": mask.tobytes()}

    return each(p, kernel).drop("offers")


def hash_of(r: dict) -> int:
    return zlib.crc32(":".join(str(r[k]) for k in KEY).encode())


def overlay(bgr: np.ndarray, mask: np.ndarray, colour=(0, 255, 0), alpha: float = 0.4, contour: bool = False) -> np.ndarray:
    """The image with the mask (or only its contour) in a colour."""
    inside = mask > 0
    if contour:
        return np.where(edge(inside)[..., None], np.array(colour, np.uint8), bgr)
    return np.where(inside[..., None], K.byte(np.floor((1 - alpha) * bgr + alpha * np.array(colour) + 0.5)), bgr)


def sheet(pictures: list[np.ndarray], columns: int = 4, gap: int = 4) -> np.ndarray:
    """Pictures of one size in rows of ``columns``, on black."""
    h, w = pictures[0].shape[:2]
    rows = -(-len(pictures) // columns)
    out = np.zeros((rows * (h + gap) - gap, min(columns, len(pictures)) * (w + gap) - gap, 3), np.uint8)
    for k, p in enumerate(pictures):
        y, x = k // columns * (h + gap), k % columns * (w + gap)
        out[y : y + h, x : x + w] = p
    return out


def pictures(patches: DataFrame, kind: str = "overlay", columns: int = 4) -> DataFrame:
    """(path, content): a PNG for each patch. ``kind``: overlay, contour (mask), audit (image, mask, prediction, both contours) or steps."""
    from tessera.sources.rasters import encode_png

    def kernel(r: dict) -> dict:
        px = image(r)
        mask = image(r, "mask", "u1") if r.get("mask") else np.zeros(px.shape[:2], np.uint8)
        gray = lambda m: np.repeat(m[..., None], 3, axis=2)
        if kind == "steps":
            got = sheet([px, *(np.frombuffer(s["px"], "u1").reshape(px.shape) for s in r["steps"])], columns)
        elif kind == "audit":
            pred = image(r, "pred", "u1")
            got = sheet([px, gray(mask), gray(pred), overlay(overlay(px, mask, (0, 255, 0), contour=True), pred, (0, 0, 255), contour=True)], columns)
        else:
            got = overlay(px, mask, contour=kind == "contour")
        return {"content": encode_png(got[..., ::-1])}

    name = F.concat("image_id", F.format_string("_%06d_%06d", "y", "x"))
    return each(patches, kernel, content="binary").select(F.concat(name, F.lit(f"_{kind}.png")).alias("path"), "content")
