"""Queries over formats: rasters, tags and bundles are written and read back; lists of files are plain filters."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.graph import shared, shared_dir
from tessera.registry import query
from tessera.sources import rasters as R
from tessera.sources.fixtures import duck, patches, table, view

KINDS = ("tiff", "tiff-be", "tiff-deflate", "png", "png-rgb", "png-rgba")


@query("s02_decode_rasters", duck("gray", "SELECT pid, y, x, g FROM fx_gray"))
def s02(spark, sf):
    """Patches as TIFF and PNG files of six layouts, decoded again."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("pid") % len(KINDS) + 1).cast("int"))
    files = R.encode_patches(patches(spark, sf).select(F.col("pid").cast("string").alias("path"), "px", kind.alias("kind")), 8)
    return R.pixels(R.read_rasters(files)).select(F.col("path").cast("bigint").alias("pid"), "y", "x", "g")


# Tags of pixel scale, tie point, transformation and key directory; the key of the model type.
SCALE, TIE, MATRIX, KEYS, MODEL_TYPE = 33550, 33922, 34264, 34735, 1024


def tagged(batches):
    """(path, content): a one-pixel TIFF that carries the tags of each fixture row."""
    import numpy as np

    for b in batches:
        rows = []
        for r in b.to_pylist():
            extra = {}
            if r["kind"] in (1, 2):
                extra |= {SCALE: (12, [r["sx"], r["sy"], 0.0]), TIE: (12, [0.0, 0.0, 0.0, r["tx"], r["ty"], 0.0])}
            if r["kind"] in (0, 2):
                extra |= {MATRIX: (12, [r["sx"], 0.0, 0.0, r["tx"], 0.0, -r["sy"], 0.0, r["ty"], *[0.0] * 7, 1.0])}
            if r["crs_code"]:
                extra |= {KEYS: (3, [1, 1, 0, 1, MODEL_TYPE, 0, 1, r["crs_code"]])}
            rows.append({"path": str(r["mosaic"]), "content": R.encode_tiff(np.zeros((1, 1), "u1"), "<" if r["mosaic"] % 2 else ">", extra=extra)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary())]))


@query("s10_s11_tiff_tags", duck("geo", "SELECT mosaic, CASE WHEN kind IN (1, 2) THEN sx END AS scale_x, CASE WHEN kind IN (1, 2) THEN sy END AS scale_y, CASE WHEN kind IN (1, 2) THEN ty END AS tie_lat, CASE WHEN kind IN (0, 2) THEN ty END AS matrix_lat, CASE WHEN kind IN (0, 2) THEN tx END AS matrix_lon, CAST(CASE WHEN crs_code > 0 THEN crs_code END AS INTEGER) AS model_type FROM fx_geo"))
def s10(spark, sf):
    files = view(spark, sf, "geo").mapInArrow(tagged, "path string, content binary")
    tags = R.read_tags(files).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("t"))
    at = lambda tag, k: F.expr(f"try_element_at(try_element_at(t, {tag}), {k + 1})")
    return tags.select(F.col("path").cast("bigint").alias("mosaic"), at(SCALE, 0).alias("scale_x"), at(SCALE, 1).alias("scale_y"), at(TIE, 4).alias("tie_lat"), at(MATRIX, 7).alias("matrix_lat"), at(MATRIX, 3).alias("matrix_lon"), at(KEYS, 7).cast("int").alias("model_type"))


def bundled(batches):
    """(path, content): the archives of (bundle_id, entries) rows; turns that three divides lack the mask, odd ones the metadata."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            entries = []
            for e in r["entries"]:
                folder = f"patches/{e['doc_id']}"
                entries.append((f"{folder}/image.png", b"image"))
                if e["turn"] % 3:
                    entries.append((f"{folder}/mask.png", b"mask"))
                if e["turn"] % 2 == 0:
                    entries.append((f"{folder}/metadata.json", json.dumps({"turn": e["turn"]}).encode()))
            rows.append({"path": str(r["bundle_id"]), "content": R.pack_bundle([*entries, ("metadata.json", b"{}")])})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary())]))


@query("s13_open_bundle", duck("bundle", "SELECT bundle_id, CAST(doc_id AS VARCHAR) AS patch_id, CASE WHEN turn % 2 = 0 THEN turn END AS turn FROM fx_bundle WHERE turn % 3 <> 0"))
def s13(spark, sf):
    b = view(spark, sf, "bundle").groupBy("bundle_id").agg(F.collect_list(F.struct("doc_id", "turn")).alias("entries"))
    files = b.mapInArrow(bundled, "path string, content binary")
    return R.open_bundles(files).select(F.col("path").cast("bigint").alias("bundle_id"), "patch_id", F.get_json_object("metadata", "$.turn").cast("bigint").alias("turn"))


_PATHS = "SELECT concat(source, '/m', CAST(doc_id % 500 AS {s}), '.', CASE doc_id % 7 WHEN 0 THEN 'tif' WHEN 1 THEN 'tiff' WHEN 2 THEN 'TIF' WHEN 3 THEN 'TIFF' WHEN 4 THEN 'png' WHEN 5 THEN 'PNG' ELSE 'jpg' END) AS path FROM {d}"


@query("s01_find_mosaics", "SELECT DISTINCT path FROM (" + _PATHS.format(s="VARCHAR", d="documents") + ") t WHERE path NOT LIKE '%.jpg'")
def s01(spark, sf):
    p = spark.sql(_PATHS.format(s="STRING", d="{docs}"), docs=table(spark, sf, "documents"))
    return p.filter(F.element_at(F.split("path", r"\."), -1).isin(*R.SUFFIXES)).distinct()


@query("s04_gather_inputs", "SELECT DISTINCT path FROM (" + _PATHS.format(s="VARCHAR", d="documents") + ") t WHERE lower(path) LIKE '%.tif' OR lower(path) LIKE '%.tiff'")
def s04(spark, sf):
    p = spark.sql(_PATHS.format(s="STRING", d="{docs}"), docs=table(spark, sf, "documents"))
    return p.filter(F.lower("path").rlike(r"\.tiff?$")).distinct()


# ---- sinks: written to the shared folder and read back

def written(df, kind: str, **options):
    """Writes under the shared folder in ``kind`` and reads it back with the schema of ``df``."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return spark.read.options(**options).schema(df.schema).format(kind).load(path)


@query("w02_patch_manifest", duck("record", "SELECT mosaic_id, patch_id, round(coverage_pct, 6) AS coverage_pct FROM fx_record"))
def w02(spark, sf):
    return shared(view(spark, sf, "record").select("mosaic_id", "patch_id", F.round("coverage_pct", 6).alias("coverage_pct")))


@query("w03_pipeline_manifest", duck("record", "SELECT mosaic_id, count(*) AS patches, count(*) FILTER (files_exist) AS complete FROM fx_record GROUP BY mosaic_id"))
def w03(spark, sf):
    return written(view(spark, sf, "record").groupBy("mosaic_id").agg(F.count("*").alias("patches"), F.count_if("files_exist").alias("complete")), "json")


@query("w06_audit_csv", duck("record", "SELECT patch_id, round(coverage_pct, 6) AS score, CAST(row_number() OVER (ORDER BY round(coverage_pct, 6) DESC, patch_id) AS BIGINT) AS rank FROM fx_record QUALIFY rank <= 150"))
def w06(spark, sf, top: int = 150):
    """The top of the queue as CSV with a header; numbered within its fixed size."""
    from pyspark.sql import Window

    r = view(spark, sf, "record").select("patch_id", F.round("coverage_pct", 6).alias("score")).orderBy(F.desc("score"), "patch_id").limit(top)
    return written(r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "patch_id")).cast("bigint")), "csv", header="true")


@query("w01_w05_patch_images", duck("gray", "SELECT pid, y, x, CASE WHEN g > 127 THEN 255 ELSE 0 END AS g FROM fx_gray"))
def w01(spark, sf):
    """Masks as PNG bytes in a binary column, written and decoded."""
    m = patches(spark, sf).select(F.col("pid").cast("string").alias("path"), F.expr("transform(px, g -> CASE WHEN g > 127 THEN 255 ELSE 0 END)").alias("px"), F.lit("png").alias("kind"))
    return R.pixels(R.read_rasters(shared(R.encode_patches(m, 8)))).select(F.col("path").cast("bigint").alias("pid"), "y", "x", "g")


@query("w08_composite_layout", "SELECT n, i, (i % 4) * 388 + 4 AS x0, (i // 4) * 416 + 4 AS y0, 4 * 388 + 4 AS canvas_w, ((n + 3) // 4) * 416 + 4 AS canvas_h FROM (SELECT n, unnest(range(n)) AS i FROM (SELECT DISTINCT n_chars % 12 + 1 AS n FROM documents) a) t")
def w08(spark, sf, thumb: int = 384, cols: int = 4, gap: int = 4, label: int = 28):
    """Places of the n images of a summary sheet and the size of the sheet, for the sheets the documents ask for."""
    t = table(spark, sf, "documents").select((F.col("n_chars") % 12 + 1).alias("n")).distinct().select("n", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"))
    w, h = thumb + gap, thumb + label + gap
    return t.selectExpr("n", "i", f"i % {cols} * {w} + {gap} AS x0", f"(i DIV {cols}) * {h} + {gap} AS y0", f"CAST({cols * w + gap} AS INT) AS canvas_w", f"((n + {cols - 1}) DIV {cols}) * {h} + {gap} AS canvas_h")


@query("w09_contour_pixels", duck("gray", "SELECT q.pid, q.y, q.x FROM fx_gray q WHERE q.g > 127 AND (SELECT count(*) FROM fx_gray n WHERE n.pid = q.pid AND n.g > 127 AND abs(n.y - q.y) + abs(n.x - q.x) = 1) < 4"))
def w09(spark, sf):
    """Mask pixels that an erosion takes away (outside the patch counts as background)."""
    from tessera.functions import stencil as S
    from tessera.operators.pixels import long

    m = patches(spark, sf).withColumn("m", F.expr("transform(px, g -> CASE WHEN g > 127 THEN 1 ELSE 0 END)"))
    inside = " + ".join(f"CASE WHEN i DIV 8 + {dy} BETWEEN 0 AND 7 AND i % 8 + {dx} BETWEEN 0 AND 7 THEN {S.at('q', dy, dx)} ELSE 0 END" for dy, dx in S.CROSS if dy or dx)
    return long(m.withColumn("a", F.expr(S.let("m", f"transform(sequence(0, 63), i -> CASE WHEN q[i] = 1 AND {inside} < 4 THEN 1 ELSE 0 END)"))), "a").filter("v = 1").drop("v")
