"""The engine's operators over the fixtures, each with the SQL twin of the query it restates on blocks of any size."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.graph import shared_dir
from tessera.operators import engine as E
from tessera.operators.metrics import _AREAS, _CC, _DIS, _EDGE, _M04, BRIGHT, _conf
from tessera.operators.pixels import _RE, _TILED
from tessera.operators.records import DICE
from tessera.registry import query
from tessera.settings import Measures, Tiling
from tessera.sources import windows as V
from tessera.sources.fixtures import duck, patches, predictions

T = Tiling(size=16, overlap=4)


def _bytes(df: DataFrame, **kinds: str) -> DataFrame:
    """Array columns as packed numbers of the given NumPy kinds."""
    schema = ", ".join(f"`{f.name}` {'binary' if f.name in kinds else f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for b in batches:
            cols = []
            for name, col in zip(b.schema.names, b.columns):
                if name in kinds:
                    flat, ends = col.values.to_numpy(zero_copy_only=False).astype(kinds[name]), col.offsets.to_numpy()
                    col = pa.array([flat[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary())
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(run, schema)


def mosaic_blocks(spark, sf: str, border: bool = True) -> DataFrame:
    """The fixture mosaics, 80 x 80, in the 8 x 8 blocks they are stored in; one gray channel, the first column of blocks black if ``border``."""
    p = patches(spark, sf).selectExpr("CAST(pid DIV 100 AS STRING) AS image_id", "80 AS image_h", "80 AS image_w", "CAST((pid % 100) DIV 10 * 8 AS INT) AS y", "CAST(pid % 10 * 8 AS INT) AS x", "8 AS h", "8 AS w", "1 AS bands", "CASE WHEN pid % 10 = 0 THEN transform(px, g -> 0) ELSE px END AS px" if border else "px")
    return _bytes(p, px="u1")


def _long(c: str):
    return F.col(c).cast("bigint")


@query("t02_patches_from_blocks", duck("mosaic", f"WITH {_TILED} SELECT mosaic_id, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, CAST(sum(g) AS BIGINT) AS total FROM t GROUP BY ALL"))
def t02_blocks(spark, sf):
    cut = E.each(E.cut(mosaic_blocks(spark, sf), T), lambda r: {"total": int(np.frombuffer(r["px"], "u1").sum(dtype="i8"))}, total="bigint")
    return cut.select(_long("image_id").alias("mosaic_id"), _long("y").alias("ty"), _long("x").alias("tx"), "total")


@query("t10_blocks_from_patches", duck("mosaic", _RE + " SELECT mosaic_id, CAST(sum(CAST(floor(coalesce(v, 0) + 0.0001) AS BIGINT)) AS BIGINT) AS total, count(v) AS covered FROM r GROUP BY mosaic_id HAVING count(v) > 0"))
def t10_blocks(spark, sf):
    """Means of the tiles that pass the gates, by blocks of 32 pixels; covered pixels and the sum of all. Places whose block is missing count nowhere."""
    cut = E.cut(mosaic_blocks(spark, sf), T, cover=True)

    def passes(r: dict) -> dict | None:
        g = np.frombuffer(r["px"], "u1")[np.frombuffer(r["cover"], bool)].astype(float)
        return {} if (g < 5).mean() <= 0.4 and g.std() >= 30.5 and g.mean() >= 125.0 else None

    back = E.put_together(E.each(cut, passes), "px", 32)
    sums = E.each(back, lambda r: {"total": int(np.frombuffer(r["px"], "u1").sum(dtype="i8")), "covered": sum(r["cover"])}, total="bigint", covered="bigint")
    return sums.groupBy("image_id").agg(F.sum("total").alias("total"), F.sum("covered").alias("covered")).select(_long("image_id").alias("mosaic_id"), "total", "covered")


@query("m01_components_of_blocks", duck("mosaic", f"WITH RECURSIVE {_CC} {_AREAS}").replace("WITH fx_gray", "WITH RECURSIVE fx_gray"))
def m01_blocks(spark, sf):
    masks = E.each(mosaic_blocks(spark, sf), lambda r: {"px": ((np.frombuffer(r["px"], "u1") > BRIGHT) * np.uint8(255)).tobytes()}, px="binary")
    got = E.components(masks)
    return got.select(_long("image_id").alias("mosaic_id"), "area", "y0", "y1", "x0", "x1")


@query("m04_coverage_of_blocks", duck("mosaic", _M04 + " SELECT mosaic_id, CASE WHEN sea > 0 THEN round(100.0 * px / sea, 4) ELSE 0 END AS coverage_pct, n AS nodule_count, px AS nodule_pixels, sea AS seafloor_pixels FROM j"))
def m04_blocks(spark, sf):
    """Coverage by masks that reach beyond the seafloor: what lies on the black border does not count."""
    colour = E.each(mosaic_blocks(spark, sf), lambda r: {"px": np.repeat(np.frombuffer(r["px"], "u1"), 3).tobytes(), "bands": 3}, px="binary", bands="int")
    masks = E.each(mosaic_blocks(spark, sf, border=False), lambda r: {"px": ((np.frombuffer(r["px"], "u1") > BRIGHT) * np.uint8(255)).tobytes()}, px="binary")
    return E.coverage(colour, masks).select(_long("image_id").alias("mosaic_id"), "coverage_pct", "nodule_count", "nodule_pixels", "seafloor_pixels")


@query("w05_mosaic_files", duck("mosaic", "SELECT mosaic_id, CAST(80 AS INT) AS height, CAST(80 AS INT) AS width, CAST(sum(g) AS BIGINT) AS total, CAST(sum(g * (my * 80 + mx)) AS BIGINT) AS placed FROM fx_mosaic GROUP BY mosaic_id"))
def w05_files(spark, sf):
    """Each mosaic as one tiled file, read back by windows of a few rows: the sum of all pixels, and that by their places."""
    at = f"{shared_dir(spark)}/mosaics-{uuid.uuid4().hex}"
    V.write_mosaics(mosaic_blocks(spark, sf), at, tile=16)

    def kernel(r: dict) -> dict:
        px = np.frombuffer(r["px"], "u1").reshape(r["h"], r["w"]).astype("i8")
        place = (np.arange(r["h"])[:, None] + r["y"]) * r["image_w"] + np.arange(r["w"]) + r["x"]
        return {"total": int(px.sum()), "placed": int((px * place).sum())}

    sums = E.each(V.read_windows(spark, at, windowBytes=2000), kernel, total="bigint", placed="bigint")
    sums = sums.groupBy("path").agg(F.max("image_h").alias("height"), F.max("image_w").alias("width"), F.sum("total").alias("total"), F.sum("placed").alias("placed"))
    return sums.select(F.regexp_extract("path", r"([0-9]+)[.]tif$", 1).cast("bigint").alias("mosaic_id"), "height", "width", "total", "placed")


def predicted(spark, sf: str) -> DataFrame:
    """The fixture's patches with probabilities and masks, as the engine has them."""
    p = predictions(spark, sf)
    p = p.select("pid", F.lit("a").alias("image_id"), *[F.lit(n).alias(c) for c, n in (("image_h", 8), ("image_w", 8), ("y", 0), ("x", 0), ("h", 8), ("w", 8), ("bands", 1))], F.lit(b"").alias("px"), F.expr("transform(v, e -> e.p)").alias("prob"), F.expr("transform(v, e -> 255 * CAST(coalesce(e.truth, false) AS INT))").alias("mask"), F.expr("transform(v, e -> CAST(e.truth IS NOT NULL AS INT))").alias("known"))
    return _bytes(p, prob="f4", mask="u1", known="u1")


@query("m09_all_patch_metrics", duck("pred", f"WITH {DICE}, {_EDGE}, s AS (SELECT pid, avg(sqrt(d2)) AS asd, avg(CAST(d2 <= 4 AS INT)) AS nsd FROM ds GROUP BY pid) SELECT dice.pid, round(dice, 6) AS dice, round(asd, 6) AS asd, round(nsd, 6) AS nsd FROM dice LEFT JOIN s ON s.pid = dice.pid"))
def m09_metrics(spark, sf):
    """Dice, surface distance and surface Dice of every patch in one pass over its row."""
    got = E.agreement(predicted(spark, sf), Measures(threshold=0.58))
    return got.select("pid", *[F.round(c, 6).alias(c) for c in ("dice", "asd", "nsd")])


@query("m20_single_pass", duck("pred", f"WITH s AS (SELECT * REPLACE (CAST(CAST(p AS FLOAT) AS DOUBLE) AS p) FROM fx_pred), a AS ({_conf('0.45', '0.55', 's')}) SELECT pid, round(mean_prob, 6) AS mean_prob, round(fp / n, 9) AS fp_frac, round(fn / n, 9) AS fn_frac, round({_DIS}, 9) AS dice_disagreement, round(0.6 * fp / n + 0.3 * fn / n + 0.1 * ({_DIS}), 9) AS combined_score, fn AS missed_pixels, np AS pred_pixels FROM a"))
def m20_pass(spark, sf):
    """One pass over all patches: confident disagreement and the predicted mask, of probabilities stored as floats."""
    got = E.each(E.confident(predicted(spark, sf)), lambda r: {"pred_pixels": sum(1 for v in r["pred"] if v)}, pred_pixels="bigint")
    return got.select("pid", F.round("mean_prob", 6).alias("mean_prob"), *[F.round(c, 9).alias(c) for c in ("fp_frac", "fn_frac", "dice_disagreement", "combined_score")], "missed_pixels", "pred_pixels")
