"""Geospatial scalars from tag values: pixel size, position, corners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.fixtures import duck, view

# Metres per degree of latitude, and the pixel size used when no tag gives one.
METRES_PER_DEGREE = 111_320.0
FALLBACK_MPP = 0.005


def located(geo: DataFrame) -> DataFrame:
    """Position, reference system and metres per pixel: a transformation matrix goes before pixel scales, those before the fallback.

    A matrix or tie point counts only where latitude and longitude are in range; no key directory means geographic.
    """
    g = geo.withColumn("lat", F.when((F.col("kind") != 3) & F.col("ty").between(-90, 90), F.col("ty"))).withColumn("lon", F.when((F.col("kind") != 3) & F.col("tx").between(-180, 180), F.col("tx")))
    g = g.withColumn("geographic", F.col("crs_code") != 1).withColumn("source", F.when(F.col("kind").isin(0, 2), "transformation").when(F.col("kind") == 1, "scale").otherwise("fallback"))
    cos = F.cos(F.radians(F.coalesce("lat", F.lit(0.0))))
    degrees = (F.col("sx") * METRES_PER_DEGREE * cos + F.col("sy") * METRES_PER_DEGREE) / 2
    mpp = F.when(F.col("source") == "fallback", FALLBACK_MPP).when(F.col("geographic"), degrees).otherwise((F.col("sx") + F.col("sy")) / 2)
    return g.withColumn("mpp", mpp)


# Fixed values of the format: tags of pixel scale, tie point, transformation matrix and key directory; the model type's key.
PIXEL_SCALE, TIE_POINT, TRANSFORMATION, KEY_DIRECTORY, MODEL_TYPE = 33550, 33922, 34264, 34735, 1024


def pixel_sizes(tags: DataFrame, fallback: float = FALLBACK_MPP) -> DataFrame:
    """(path, meters_per_pixel, source, lat, lon, crs_code) of files by their tags (path, tag, values): the tags as a row of ``located``."""
    of = lambda tag: F.max_by(F.when(F.col("tag") == tag, F.col("values")), F.when(F.col("tag") == tag, 1))
    t = tags.groupBy("path").agg(of(PIXEL_SCALE).alias("scale"), of(TIE_POINT).alias("tie"), of(TRANSFORMATION).alias("matrix"), of(KEY_DIRECTORY).alias("keys"))
    at = lambda c, k: F.abs(F.get(c, F.lit(k)))
    has = F.size("matrix") >= 16
    model = F.expr(f"filter(sequence(1, greatest(1, size(keys) DIV 4 - 1)), i -> get(keys, 4 * i) = {MODEL_TYPE})")
    code = F.when(F.size("keys") >= 8, F.get("keys", 4 * F.get(model, F.lit(0)) + 3)).cast("int")
    row = t.select(
        "path",
        F.when(has, 0).when(F.size("scale") >= 2, 1).otherwise(3).alias("kind"),
        F.when(has, at("matrix", 0)).otherwise(at("scale", 0)).alias("sx"),
        F.when(has, at("matrix", 5)).otherwise(at("scale", 1)).alias("sy"),
        F.when(has, F.get("matrix", F.lit(3))).otherwise(F.get("tie", F.lit(3))).alias("tx"),
        F.when(has, F.get("matrix", F.lit(7))).otherwise(F.get("tie", F.lit(4))).alias("ty"),
        F.when(code.isin(1, 2), code).otherwise(0).alias("crs_code"),
    )
    mpp = F.when((F.col("source") != "fallback") & (F.col("mpp") > 0), F.col("mpp")).otherwise(fallback)
    return located(row).select("path", mpp.alias("meters_per_pixel"), "source", "lat", "lon", "crs_code")


_LOC = "WITH a AS (SELECT *, CASE WHEN kind <> 3 AND ty >= -90 AND ty <= 90 THEN ty END AS lat, CASE WHEN kind <> 3 AND tx >= -180 AND tx <= 180 THEN tx END AS lon, crs_code IN (0, 2) AS geographic, CASE kind WHEN 0 THEN 'transformation' WHEN 2 THEN 'transformation' WHEN 1 THEN 'scale' ELSE 'fallback' END AS source FROM fx_geo), l AS (SELECT *, CASE WHEN kind = 3 THEN CAST(0.005 AS DOUBLE) WHEN geographic THEN (sx * 111320 * cos(radians(coalesce(lat, 0))) + sy * 111320) / 2 ELSE (sx + sy) / 2 END AS mpp FROM a)"


@query("g01_meters_per_pixel", duck("geo", _LOC + " SELECT mosaic, round(mpp, 12) AS mpp FROM l"))
def g01(spark, sf):
    return located(view(spark, sf, "geo")).select("mosaic", F.round("mpp", 12).alias("mpp"))


@query("g02_geo_metadata", duck("geo", _LOC + " SELECT mosaic, source, lat, lon, CASE WHEN kind = 3 THEN NULL WHEN geographic THEN 'geographic' ELSE 'projected' END AS crs FROM l"))
def g02(spark, sf):
    crs = F.when(F.col("kind") == 3, None).when(F.col("geographic"), "geographic").otherwise("projected")
    return located(view(spark, sf, "geo")).select("mosaic", "source", "lat", "lon", crs.alias("crs"))


@query("g03_latitude_longitude", duck("geo", _LOC + " SELECT mosaic, lat, lon FROM l WHERE lat IS NOT NULL AND lon IS NOT NULL"))
def g03(spark, sf):
    return located(view(spark, sf, "geo")).filter("lat IS NOT NULL AND lon IS NOT NULL").select("mosaic", "lat", "lon")


@query("g04_is_geographic", duck("geo", "SELECT mosaic, crs_code <> 1 AS geographic FROM fx_geo"))
def g04(spark, sf):
    directory = F.when(F.col("crs_code") == 0, None).otherwise(F.col("crs_code") == 2)
    return view(spark, sf, "geo").select("mosaic", F.coalesce(directory, F.lit(True)).alias("geographic"))


for _name, _source in (("g05_mpp_from_transformation", "transformation"), ("g06_mpp_from_pixel_scale", "scale")):

    @query(_name, duck("geo", _LOC + f" SELECT mosaic, round(mpp, 12) AS mpp FROM l WHERE source = '{_source}'"))
    def g05(spark, sf, source=_source):
        return located(view(spark, sf, "geo")).filter(F.col("source") == source).select("mosaic", F.round("mpp", 12).alias("mpp"))


@query("g07_corner_coords", duck("geo", _LOC + " SELECT mosaic, lat AS north, lon AS west, round(lat - 8000 * sy, 9) AS south, round(lon + 8000 * sx, 9) AS east FROM l WHERE geographic"))
def g07(spark, sf, height: int = 8000, width: int = 8000):
    g = located(view(spark, sf, "geo")).filter("geographic")
    return g.select("mosaic", F.col("lat").alias("north"), F.col("lon").alias("west"), F.round(F.col("lat") - height * F.col("sy"), 9).alias("south"), F.round(F.col("lon") + width * F.col("sx"), 9).alias("east"))


@query("g08_coverage_metres", duck("geo", _LOC + " SELECT mosaic, round(8000 * mpp, 2) AS w_m, round(6000 * mpp, 2) AS h_m FROM l"))
def g08(spark, sf, width: int = 8000, height: int = 6000):
    return located(view(spark, sf, "geo")).select("mosaic", F.round(width * F.col("mpp"), 2).alias("w_m"), F.round(height * F.col("mpp"), 2).alias("h_m"))
