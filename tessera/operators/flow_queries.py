"""Flows over the fixtures, each with an SQL twin: scoring in batches, audit panels, the geo object, archives merged into held masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera import api
from tessera.functions.graph import shared
from tessera.operators import engine as E
from tessera.operators.engine_queries import _bytes, _long, mosaic_blocks
from tessera.operators.geo import _LOC, located
from tessera.registry import query
from tessera.sources import rasters as R
from tessera.sources.fixtures import duck, patches, view


@query("t15_batched_scores", duck("mosaic", "SELECT mosaic_id, CAST(my // 8 * 8 AS INT) AS y, CAST(mx // 8 * 8 AS INT) AS x, CAST(sum(g) AS BIGINT) AS total, CAST(max(g) AS BIGINT) AS most FROM fx_mosaic GROUP BY mosaic_id, my // 8, mx // 8"))
def t15(spark, sf):
    """A scorer gets at most three patches at once; every patch keeps its own score, here its light as a share."""

    def scorer(batch: list[np.ndarray]) -> list[np.ndarray]:
        if len(batch) > 3:
            raise ValueError("batch of more than three patches")
        return [p[..., 0] / 255 for p in batch]

    def back(r: dict) -> dict:
        v = np.rint(np.frombuffer(r["prob"], "f4").astype(float) * 255)
        return {"total": int(v.sum()), "most": int(v.max())}

    got = E.each(E.predict(mosaic_blocks(spark, sf), scorer, batch=3), back, total="bigint", most="bigint")
    return got.select(_long("image_id").alias("mosaic_id"), "y", "x", "total", "most")


@query("w10_audit_panels", duck("gray", "SELECT pid, CAST(8 AS INT) AS height, CAST(44 AS INT) AS width, CAST(sum(g) AS BIGINT) AS image, 255 * count(*) FILTER (g > 127) AS mask, 255 * count(*) FILTER (g > 150) AS pred FROM fx_gray GROUP BY pid"))
def w10(spark, sf):
    """Panels as PNG files, read back: the image, the mask and the prediction side by side, with gaps of four."""
    p = patches(spark, sf).selectExpr("CAST(pid AS STRING) AS image_id", "8 AS image_h", "8 AS image_w", "0 AS y", "0 AS x", "8 AS h", "8 AS w", "3 AS bands", "flatten(transform(px, g -> array(g, g, g))) AS px", "transform(px, g -> IF(g > 127, 255, 0)) AS mask", "transform(px, g -> IF(g > 150, 255, 0)) AS pred")
    files = shared(E.pictures(_bytes(p, px="u1", mask="u1", pred="u1"), "audit"))
    read = R.read_rasters(files)

    def sums(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                a = np.frombuffer(r["pixels"], "u1").reshape(r["height"], r["width"], 3)[..., 0].astype(int)
                rows.append({"pid": int(r["path"].split("_")[0]), "height": r["height"], "width": r["width"], **{n: int(a[:, k : k + 8].sum()) for n, k in (("image", 0), ("mask", 12), ("pred", 24))}})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("pid", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), *[(n, pa.int64()) for n in ("image", "mask", "pred")]]))

    return read.mapInArrow(sums, "pid bigint, height int, width int, image bigint, mask bigint, pred bigint")


_GEO = (
    _LOC + ", k AS (SELECT *, 6000 * mpp AS down, 8000 * mpp AS along, 111320 * cos(radians(lat)) AS east, CASE WHEN source = 'fallback' THEN NULL WHEN crs_code = 1 THEN 'projected' ELSE 'geographic' END AS system FROM l), "
    "m AS (SELECT *, lat IS NOT NULL AND lon IS NOT NULL AND mpp > 0 AND (system IS NULL OR system <> 'geographic' OR east > 0) AS known, CASE WHEN system = 'geographic' THEN down / 111320 ELSE down END AS south, CASE WHEN system = 'geographic' THEN along / east ELSE along END AS right_ FROM k) "
    "SELECT mosaic, system AS crs_type, source AS mpp_source, round(CASE WHEN known THEN lat END, 7) AS top, round(CASE WHEN known THEN lon END, 7) AS left_, round(CASE WHEN known THEN lat - south END, 7) AS bottom, round(CASE WHEN known THEN lon + right_ END, 7) AS right_ FROM m"
)


@query("w07_geo_object", duck("geo", _GEO))
def w07(spark, sf):
    """The geo object of images of 6000 x 8000 pixels: system, source of the pixel size, and opposite corners."""
    g = located(view(spark, sf, "geo")).withColumn("meters_per_pixel", F.col("mpp")).withColumn("height", F.lit(6000)).withColumn("width", F.lit(8000))
    g = g.select("mosaic", api.geo_object().alias("g"))
    corner = lambda name, c: F.round(F.col(f"g.corners.{name}.{c}"), 7)
    return g.select("mosaic", "g.crs_type", "g.mpp_source", corner("top_left", "latitude").alias("top"), corner("top_left", "longitude").alias("left_"), corner("bottom_right", "latitude").alias("bottom"), corner("bottom_right", "longitude").alias("right_"))


_MERGED = "WITH n AS (SELECT doc_id, max(entry_minute) AS minute FROM fx_bundle GROUP BY doc_id) SELECT CAST(coalesce(n.doc_id, c.doc_id) AS VARCHAR) AS patch_id, coalesce({rule}, FALSE) AS taken FROM n FULL JOIN fx_corrected c ON c.doc_id = n.doc_id"
_RULES = {"newest": "n.minute IS NOT NULL AND (c.mtime IS NULL OR n.minute >= c.mtime)", "skip": "n.minute IS NOT NULL AND c.mtime IS NULL", "overwrite": "n.minute IS NOT NULL"}

for _s, _rule in _RULES.items():

    @query(f"r21_merge_archives_{_s}", duck("bundle corrected", _MERGED.format(rule=_rule)))
    def r21_merge(spark, sf, strategy=_s):
        """Archives of white masks merged into held black ones: which masks are white afterwards."""
        def packed(batches):
            white = R.encode_png(np.full((2, 2), 255, np.uint8))
            for b in batches:
                rows = [{"path": f"{r['bundle_id']}-{r['turn']}.zip", "content": R.pack_bundle([(f"patches/{r['doc_id']}/{k}.png", white) for k in ("image", "mask")]), "entry_minute": r["entry_minute"]} for r in b.to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary()), ("entry_minute", pa.int64())]))

        archives = shared(view(spark, sf, "bundle").select("bundle_id", "turn", "doc_id", "entry_minute").mapInArrow(packed, "path string, content binary, entry_minute bigint"))
        held = view(spark, sf, "corrected").select(F.col("doc_id").cast("string").alias("patch_id"), F.expr("X'00000000'").alias("mask"), "mtime")
        return api.import_bundles(archives, held, strategy).select("patch_id", (F.hex("mask") == "FFFFFFFF").alias("taken"))
