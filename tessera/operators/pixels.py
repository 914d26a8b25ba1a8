"""Pixel operators: tiling and gates, diagnostics, filters, features, agreement metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions import stencil as S
from tessera.registry import query
from tessera.sources.fixtures import duck, patches, settled, table, view

N = S.PS


def long(df: DataFrame, column: str, name: str = "v", side: int = N, keep: tuple[str, ...] = ()) -> DataFrame:
    """(pid, y, x, value) of an array column, with the columns of ``keep`` beside them.

    The array goes through an Arrow step first: an explode right above its expression would have the optimiser evaluate it again for each use.
    """
    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = [f"pid {kind('pid')}", "y int", "x int", f"{name} {df.schema[column].dataType.elementType.simpleString()}", *(f"{c} {kind(c)}" for c in keep)]
    return df.select("pid", column, *keep).mapInArrow(exploded(side), ", ".join(schema))


def exploded(side: int):
    def run(batches):
        for b in batches:
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat = pc.list_flatten(lists)
            of, more = pa.array(of), range(2, b.num_columns)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array((place // side).astype(np.int32)), pa.array((place % side).astype(np.int32)), flat, *(b.column(k).take(of) for k in more)], ["pid", "y", "x", "v", *(b.schema.names[k] for k in more)])

    return run


def _nb(taps, source: str = "fx_gray", value: str = "g") -> str:
    rows = ", ".join(f"({dy}, {dx}, {w})" for dy, dx, w in taps)
    return f"SELECT q.pid, q.y, q.x, o.w, n.{value} AS g FROM {source} q CROSS JOIN (VALUES {rows}) o(dy, dx, w) JOIN {source} n ON n.pid = q.pid AND n.y = 7 - abs(7 - abs(q.y + o.dy)) AND n.x = 7 - abs(7 - abs(q.x + o.dx))"


# ---- tiling and gates

def grid_positions(length: int, patch: int, stride: int) -> list[int]:
    """Starts 0, s, 2s ...; one more at the end if the last pixels are not covered."""
    if length <= patch:
        return [0]
    out = list(range(0, length - patch + 1, stride))
    return out if out[-1] + patch >= length else [*out, length - patch]


@query("t01_grid_positions", "SELECT len, unnest(CASE WHEN len <= 16 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, len - 15, 12), [len - 16]))) END) AS start FROM (SELECT DISTINCT n_chars % 600 + 1 AS len FROM documents) t")
def t01(spark, sf):
    lengths = table(spark, sf, "documents").select((F.col("n_chars") % 600 + 1).alias("len")).distinct()
    starts = "CASE WHEN len <= 16 THEN array(0L) ELSE array_sort(array_union(sequence(0L, len - 16, 12L), array(len - 16))) END"
    return lengths.select("len", F.explode(F.expr(starts)).alias("start"))


def tiled(mosaic: DataFrame, patch: int = 16, stride: int = 12, side: int = 80) -> DataFrame:
    """Each pixel under every tile that covers it: the few starts per axis are exploded, nothing is joined."""
    starts = ", ".join(map(str, grid_positions(side, patch, stride)))
    out = mosaic
    for axis, name in (("my", "ty"), ("mx", "tx")):
        out = out.withColumn(name, F.explode(F.expr(f"filter(array({starts}), s -> s <= {axis} AND {axis} < s + {patch})")))
    return out


_TILED = "s AS (SELECT unnest([0, 12, 24, 36, 48, 60, 64]) AS s), t AS (SELECT m.*, a.s AS ty, b.s AS tx FROM fx_mosaic m JOIN s a ON m.my >= a.s AND m.my < a.s + 16 JOIN s b ON m.mx >= b.s AND m.mx < b.s + 16)"


@query("t02_extract_patches", duck("mosaic", f"WITH {_TILED} SELECT mosaic_id, ty, tx, count(*) AS n, sum(g) AS total FROM t GROUP BY ALL").replace("sum(g)", "CAST(sum(g) AS BIGINT)"))
def t02(spark, sf):
    return tiled(view(spark, sf, "mosaic")).groupBy("mosaic_id", "ty", "tx").agg(F.count("*").alias("n"), F.sum("g").alias("total"))


@query("t03_zero_padding", duck("mosaic", "SELECT mosaic_id, k.y AS my, k.x AS mx, coalesce(m.g, 0) AS g FROM (SELECT DISTINCT mosaic_id AS id FROM fx_mosaic) d CROSS JOIN (SELECT a.y, b.x FROM (SELECT unnest(range(72, 88)) AS y) a, (SELECT unnest(range(72, 88)) AS x) b) k LEFT JOIN fx_mosaic m ON m.mosaic_id = d.id AND m.my = k.y AND m.mx = k.x").replace("SELECT mosaic_id, k.y", "SELECT d.id AS mosaic_id, k.y"))
def t03(spark, sf):
    m = view(spark, sf, "mosaic")
    grid = m.select("mosaic_id").distinct().select("mosaic_id", F.explode(F.expr("sequence(72L, 87L)")).alias("my")).select("mosaic_id", "my", F.explode(F.expr("sequence(72L, 87L)")).alias("mx"))
    return grid.join(m, ["mosaic_id", "my", "mx"], "left").select("mosaic_id", "my", "mx", F.coalesce("g", F.lit(0)).alias("g"))


def gated(mosaic: DataFrame, most_black: float = 0.4, least_std: float = 30.5, least_mean: float = 125.0) -> DataFrame:
    """Gate values of every tile and the first gate that fails."""
    t = tiled(mosaic).groupBy("mosaic_id", "ty", "tx").agg(F.avg((F.col("g") < 5).cast("double")).alias("black"), F.stddev_pop("g").alias("std"), F.avg("g").alias("mean"))
    reason = F.when(F.col("black") > most_black, "black_fraction").when(F.col("std") < least_std, "std").when(F.col("mean") < least_mean, "mean").otherwise("valid")
    return t.withColumn("reason", reason)


_GATE = f"WITH {_TILED}, a AS (SELECT mosaic_id, ty, tx, avg(CAST(g < 5 AS INT)) AS black, stddev_pop(g) AS std, avg(g) AS mean FROM t GROUP BY ALL), q AS (SELECT *, CASE WHEN black > {{b}} THEN 'black_fraction' WHEN std < {{s}} THEN 'std' WHEN mean < {{m}} THEN 'mean' ELSE 'valid' END AS reason FROM a)"
_GATE_1 = _GATE.format(b="0.4", s="30.5", m="125")


@query("t04_t06_gate_values", duck("mosaic", _GATE_1 + " SELECT mosaic_id, ty, tx, round(black, 6) AS black, round(std, 6) AS std, round(mean, 6) AS mean FROM q"))
def t04(spark, sf):
    return gated(view(spark, sf, "mosaic")).select("mosaic_id", "ty", "tx", *[F.round(c, 6).alias(c) for c in ("black", "std", "mean")])


@query("t08_quality_check", duck("mosaic", _GATE_1 + " SELECT mosaic_id, ty, tx, reason FROM q"))
def t08(spark, sf):
    return gated(view(spark, sf, "mosaic")).select("mosaic_id", "ty", "tx", "reason")


@query("t09_rejection_summary", duck("mosaic", _GATE_1 + " SELECT mosaic_id, count(*) AS total, count(*) FILTER (reason = 'valid') AS valid FROM q GROUP BY mosaic_id"))
def t09(spark, sf):
    return gated(view(spark, sf, "mosaic")).groupBy("mosaic_id").agg(F.count("*").alias("total"), F.count_if(F.col("reason") == "valid").alias("valid"))


@query("t16_predictor_gate", duck("mosaic", _GATE.format(b="0.999", s="-1", m="-1") + " SELECT mosaic_id, count(*) FILTER (reason = 'valid') AS valid FROM q GROUP BY mosaic_id"))
def t16(spark, sf):
    return gated(view(spark, sf, "mosaic"), 0.999, -1.0, -1.0).groupBy("mosaic_id").agg(F.count_if(F.col("reason") == "valid").alias("valid"))


def reassembled(mosaic: DataFrame) -> DataFrame:
    """Mean over valid tiles of each pixel; 0 where no valid tile lies."""
    ok = gated(mosaic).filter("reason = 'valid'").select("mosaic_id", "ty", "tx")
    mean = tiled(mosaic).join(ok, ["mosaic_id", "ty", "tx"], "left_semi").groupBy("mosaic_id", "my", "mx").agg(F.avg("g").alias("v"))
    return mosaic.join(mean, ["mosaic_id", "my", "mx"], "left")


_RE = _GATE_1 + ", r AS (SELECT m.mosaic_id, m.my, m.mx, m.g, z.v FROM fx_mosaic m LEFT JOIN (SELECT t.mosaic_id, t.my, t.mx, avg(t.g) AS v FROM t JOIN q ON q.mosaic_id = t.mosaic_id AND q.ty = t.ty AND q.tx = t.tx AND q.reason = 'valid' GROUP BY ALL) z ON z.mosaic_id = m.mosaic_id AND z.my = m.my AND z.mx = m.mx)"


@query("t10_reassemble", settled(duck("mosaic", _RE + " SELECT mosaic_id, my, mx, round(coalesce(v, 0), 6) AS v FROM r")))
def t10(spark, sf):
    return reassembled(view(spark, sf, "mosaic")).select("mosaic_id", "my", "mx", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("v"))


@query("t11_binarise_mask", settled(duck("mosaic", _RE + " SELECT mosaic_id, my, mx, CASE WHEN v > 127 THEN 255 ELSE 0 END AS mask FROM r")))
def t11(spark, sf):
    return reassembled(view(spark, sf, "mosaic")).select("mosaic_id", "my", "mx", F.when(F.col("v") > 127, 255).otherwise(0).alias("mask"))


@query("t12_raw_fallback", duck("mosaic", _RE + " SELECT mosaic_id, CAST(sum(CAST(coalesce(floor(v), g) AS BIGINT)) AS BIGINT) AS total, round(100.0 * count(v) / count(*), 4) AS coverage_pct FROM r GROUP BY mosaic_id"))
def t12(spark, sf):
    return reassembled(view(spark, sf, "mosaic")).groupBy("mosaic_id").agg(F.sum(F.coalesce(F.floor("v"), F.col("g"))).alias("total"), F.round(F.lit(100.0) * F.count("v") / F.count("*"), 4).alias("coverage_pct"))


_IMP = "greatest(CAST(1e-3 AS DOUBLE), exp(-(({y} - 7.5) * ({y} - 7.5) + ({x} - 7.5) * ({x} - 7.5)) / (2 * 2.0 * 2.0)) / exp(-(0.25 + 0.25) / (2 * 2.0 * 2.0)))"


@query("t13_importance_map", duck("mosaic", "SELECT mosaic_id, my, mx, round(" + _IMP.format(y="my", x="mx") + ", 6) AS w, round(g * " + _IMP.format(y="my", x="mx") + ", 6) AS weighted FROM fx_mosaic WHERE my < 16 AND mx < 16"))
def t13(spark, sf):
    """The weights of a tile's pixels, and each mosaic's first tile by them."""
    w = F.expr(_IMP.format(y="my", x="mx"))
    return view(spark, sf, "mosaic").filter("my < 16 AND mx < 16").select("mosaic_id", "my", "mx", F.round(w, 6).alias("w"), F.round(F.col("g") * w, 6).alias("weighted"))


@query("t14_weighted_overlap_add", duck("mosaic", _GATE_1 + ", o AS (SELECT t.mosaic_id, t.my, t.mx, sum(t.g / 255.0 * w) AS a, sum(w) AS b FROM (SELECT *, " + _IMP.format(y="(my - ty)", x="(mx - tx)") + " AS w FROM t) t JOIN q ON q.mosaic_id = t.mosaic_id AND q.ty = t.ty AND q.tx = t.tx AND q.reason = 'valid' GROUP BY ALL) SELECT mosaic_id, my, mx, round(least(1, greatest(0, CASE WHEN b > 1e-6 THEN a / b ELSE 0 END)), 6) AS p FROM o"))
def t14(spark, sf):
    m = view(spark, sf, "mosaic")
    ok = gated(m).filter("reason = 'valid'").select("mosaic_id", "ty", "tx")
    t = tiled(m).join(ok, ["mosaic_id", "ty", "tx"], "left_semi").withColumn("w", F.expr(_IMP.format(y="(my - ty)", x="(mx - tx)")))
    o = t.groupBy("mosaic_id", "my", "mx").agg(F.sum(F.col("g") / 255 * F.col("w")).alias("a"), F.sum("w").alias("b"))
    return o.select("mosaic_id", "my", "mx", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("b") > 1e-6, F.col("a") / F.col("b")).otherwise(0.0))), 6).alias("p"))


# ---- stencils

for _name, _taps in (("f10_box_5x5_sum", S.box(2)), ("f11_sobel_x", S.SOBEL_X), ("f11_sobel_y", S.SOBEL_Y), ("f12_laplacian", S.LAPLACE)):

    @query(_name, duck("gray", f"SELECT pid, y, x, CAST(sum(w * g) AS BIGINT) AS v FROM ({_nb(_taps)}) t GROUP BY pid, y, x"))
    def linear(spark, sf, taps=_taps):
        return long(patches(spark, sf).withColumn("a", F.expr(S.weighted("px", taps))), "a").withColumn("v", F.col("v").cast("bigint"))


def _blur_sql(sigma: float, source: str = "fx_gray", value: str = "g", radius: int | None = None) -> str:
    taps = S.gauss(sigma, radius)
    rows = _nb([(0, k, f"CAST({w!r} AS DOUBLE)") for k, w in taps], source, value)
    return f"b1 AS (SELECT pid, y, x, sum(w * g) AS g FROM ({rows}) t GROUP BY pid, y, x), b2 AS (SELECT pid, y, x, sum(w * g) AS bg FROM ({_nb([(k, 0, f'CAST({w!r} AS DOUBLE)') for k, w in taps], 'b1')}) t GROUP BY pid, y, x)"


@query("f09_gaussian_blur", duck("gray", f"WITH {_blur_sql(1.0)} SELECT pid, y, x, round(bg, 4) AS v FROM b2"))
def f09(spark, sf):
    return long(patches(spark, sf).withColumn("a", F.expr(S.blur("px", 1.0))), "a").withColumn("v", F.round("v", 4))


for _name, _kind in (("f13_dilate", "greatest"), ("f13_erode", "least")):

    @query(_name, duck("gray", f"SELECT q.pid, q.y, q.x, {'max' if _kind == 'greatest' else 'min'}(n.g) AS v FROM fx_gray q JOIN fx_gray n ON n.pid = q.pid AND abs(n.y - q.y) + abs(n.x - q.x) <= 1 GROUP BY ALL"))
    def morph(spark, sf, kind=_kind):
        return long(patches(spark, sf).withColumn("a", F.expr(S.extreme("px", S.CROSS, kind))), "a")


def closed(df: DataFrame, first: str = "greatest", then: str = "least") -> DataFrame:
    return df.withColumn("a", F.expr(S.extreme(S.extreme("px", S.CROSS, first), S.CROSS, then)))


for _name, _a, _b in (("f13_close", "max", "min"), ("f13_open", "min", "max")):

    @query(_name, duck("gray", f"WITH d AS (SELECT q.pid, q.y, q.x, {_a}(n.g) AS g FROM fx_gray q JOIN fx_gray n ON n.pid = q.pid AND abs(n.y - q.y) + abs(n.x - q.x) <= 1 GROUP BY ALL) SELECT q.pid, q.y, q.x, {_b}(n.g) AS v FROM d q JOIN d n ON n.pid = q.pid AND abs(n.y - q.y) + abs(n.x - q.x) <= 1 GROUP BY ALL"))
    def opened(spark, sf, a=_a, b=_b):
        word = {"max": "greatest", "min": "least"}
        return long(closed(patches(spark, sf), word[a], word[b]), "a")


@query("f11_sobel_magnitude", duck("gray", f"SELECT a.pid, a.y, a.x, round(sqrt(a.v * a.v + b.v * b.v), 6) AS v FROM (SELECT pid, y, x, sum(w * g) AS v FROM ({_nb(S.SOBEL_X)}) t GROUP BY pid, y, x) a JOIN (SELECT pid, y, x, sum(w * g) AS v FROM ({_nb(S.SOBEL_Y)}) t GROUP BY pid, y, x) b USING (pid, y, x)"))
def f11m(spark, sf):
    p = patches(spark, sf).withColumn("gx", F.expr(S.weighted("px", S.SOBEL_X))).withColumn("gy", F.expr(S.weighted("px", S.SOBEL_Y)))
    return long(p.withColumn("a", F.expr("zip_with(gx, gy, (a, b) -> round(sqrt(a * a + b * b), 6))")), "a")


# ---- colour

@query("f01_gray_world_white_balance", duck("color", "WITH m AS (SELECT *, avg(b) OVER w AS mb, avg(gr) OVER w AS mg, avg(r) OVER w AS mr FROM fx_color WINDOW w AS (PARTITION BY cid)), k AS (SELECT *, (mb + mg + mr) / 3 AS mk, mb < 1 OR mg < 1 OR mr < 1 AS skip FROM m) SELECT cid, y, x, " + ", ".join(f"CASE WHEN skip THEN {c} ELSE CAST(floor(least(255, {c} * (mk / {m}))) AS INTEGER) END AS {c}" for c, m in (("b", "mb"), ("gr", "mg"), ("r", "mr"))) + " FROM k"))
def f01(spark, sf):
    c = view(spark, sf, "color")
    m = c.groupBy("cid").agg(*[F.avg(k).alias(f"m_{k}") for k in ("b", "gr", "r")]).withColumn("mk", (F.col("m_b") + F.col("m_gr") + F.col("m_r")) / 3)
    skip = (F.col("m_b") < 1) | (F.col("m_gr") < 1) | (F.col("m_r") < 1)
    one = lambda k: F.when(skip, F.col(k)).otherwise(F.floor(F.least(F.lit(255.0), F.col(k) * (F.col("mk") / F.col(f"m_{k}")))).cast("int")).alias(k)
    return c.join(m, "cid").select("cid", "y", "x", one("b"), one("gr"), one("r"))


@query("f14_color_to_gray", duck("color", "SELECT cid, y, x, CAST(floor(0.114 * b + 0.587 * gr + 0.299 * r + 0.5) AS INTEGER) AS g FROM fx_color"))
def f14(spark, sf):
    return view(spark, sf, "color").selectExpr("cid", "y", "x", "CAST(floor(0.114 * b + 0.587 * gr + 0.299 * r + 0.5) AS INT) AS g")


@query("s15_bgr_to_rgb", duck("color", "SELECT cid, y, x, r AS c0, gr AS c1, b AS c2 FROM fx_color"))
def s15(spark, sf):
    return view(spark, sf, "color").select("cid", "y", "x", F.col("r").alias("c0"), F.col("gr").alias("c1"), F.col("b").alias("c2"))


@query("s03_dtype_normalisation", duck("mosaic", "SELECT mosaic_id, my, mx, CASE WHEN max(v) OVER (PARTITION BY mosaic_id) > 255 THEN CAST(floor(v * 255.0 / max(v) OVER (PARTITION BY mosaic_id)) AS INTEGER) ELSE v END AS g FROM (SELECT mosaic_id, my, mx, CASE WHEN mosaic_id % 2 = 0 THEN g * 16 ELSE g END AS v FROM fx_mosaic) t"))
def s03(spark, sf):
    m = view(spark, sf, "mosaic").withColumn("v", F.when(F.col("mosaic_id") % 2 == 0, F.col("g") * 16).otherwise(F.col("g")))
    top = m.groupBy("mosaic_id").agg(F.max("v").alias("top"))
    return m.join(top, "mosaic_id").select("mosaic_id", "my", "mx", F.when(F.col("top") > 255, F.floor(F.col("v") * F.lit(255.0) / F.col("top")).cast("int")).otherwise(F.col("v")).alias("g"))


@query("f17_normalized_tensor", duck("color", "SELECT cid, y, x, round((r / 255.0 - 0.485) / 0.229, 6) AS c0, round((gr / 255.0 - 0.456) / 0.224, 6) AS c1, round((b / 255.0 - 0.406) / 0.225, 6) AS c2 FROM fx_color"))
def f17(spark, sf):
    one = lambda c, m, s, n: F.round((F.col(c) / 255 - m) / s, 6).alias(n)
    return view(spark, sf, "color").select("cid", "y", "x", one("r", 0.485, 0.229, "c0"), one("gr", 0.456, 0.224, "c1"), one("b", 0.406, 0.225, "c2"))


# ---- diagnostics of a patch

LAP = f"lap AS (SELECT pid, y, x, abs(sum(w * g)) AS l FROM ({_nb(S.LAPLACE)}) t GROUP BY pid, y, x)"


def diagnostics(p: DataFrame, least_valid: int = 10) -> DataFrame:
    """Contrast (IQR), noise, skewness and number of valid pixels of each patch; 0 below ``least_valid`` valid pixels."""
    z = p.withColumn("lap", F.expr(S.weighted("px", S.LAPLACE))).select("pid", F.explode(F.arrays_zip("px", "lap")).alias("e")).select("pid", F.col("e.px").alias("g"), F.abs("e.lap").alias("l")).filter("g > 10")
    a = z.groupBy("pid").agg(F.count("*").alias("n_valid"), (F.percentile("g", 0.75) - F.percentile("g", 0.25)).alias("contrast"), (1.4826 * F.median("l")).alias("noise"), F.avg("g").alias("m"), F.stddev_pop("g").alias("s"), F.sum(F.pow(F.col("g").cast("double"), 3)).alias("g3"), F.sum(F.col("g") * F.col("g")).alias("g2"))
    third = F.col("g3") / F.col("n_valid") - 3 * F.col("m") * F.col("g2") / F.col("n_valid") + 2 * F.pow("m", F.lit(3.0))
    skew = F.when(F.col("s") < 1e-6, 0.0).otherwise(third / F.pow("s", F.lit(3.0)))
    few = F.col("n_valid") < least_valid
    return a.select("pid", "n_valid", *[F.when(few, 0.0).otherwise(c).alias(n) for c, n in ((F.col("contrast"), "contrast"), (F.col("noise"), "noise"), (skew, "skew"))])


_DIAG = f"{LAP}, z AS (SELECT g.pid, g.g, lap.l FROM fx_gray g JOIN lap USING (pid, y, x) WHERE g.g > 10), st AS (SELECT pid, avg(g) AS m, stddev_pop(g) AS s FROM z GROUP BY pid), di AS (SELECT z.pid, count(*) AS n_valid, CASE WHEN count(*) < 10 THEN 0 ELSE quantile_cont(g, 0.75) - quantile_cont(g, 0.25) END AS contrast, CASE WHEN count(*) < 10 THEN 0 ELSE 1.4826 * median(l) END AS noise, CASE WHEN count(*) < 10 OR any_value(s) < 1e-6 THEN 0 ELSE avg(pow((g - m) / s, 3)) END AS skew FROM z JOIN st ON st.pid = z.pid GROUP BY z.pid)"


@query("a01_a04_diagnostics", duck("gray", f"WITH {_DIAG} SELECT pid, n_valid, round(contrast, 6) AS contrast, round(noise, 6) AS noise, round(skew, 5) AS skew FROM di"))
def a04(spark, sf):
    return diagnostics(patches(spark, sf)).select("pid", "n_valid", F.round("contrast", 6).alias("contrast"), F.round("noise", 6).alias("noise"), F.round("skew", 5).alias("skew"))


_CLIP = "least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {}))"


@query("a07_normalised_signals", duck("gray", f"WITH {_DIAG} SELECT pid, round({_CLIP.format('contrast / 40')}, 6) AS t, round({_CLIP.format('noise / 20')}, 6) AS n, round({_CLIP.format('(skew + 1) / 2')}, 5) AS s, round({_CLIP.format('noise / 15')}, 6) AS np FROM di"))
def a07(spark, sf):
    one = lambda e, k, n: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), e)), k).alias(n)
    c = F.col
    return diagnostics(patches(spark, sf)).select("pid", one(c("contrast") / 40, 6, "t"), one(c("noise") / 20, 6, "n"), one((c("skew") + 1) / 2, 5, "s"), one(c("noise") / 15, 6, "np"))


@query("a08_interpolated_params", duck("gray", f"WITH {_DIAG}, s AS (SELECT pid, {_CLIP.format('contrast / 40')} AS t, {_CLIP.format('noise / 20')} AS n, {_CLIP.format('noise / 15')} AS np FROM di) SELECT pid, round(0.3 + 0.7 * t, 6) AS msr_blend, round((1 + t) * (1 - 0.6 * np), 6) AS clahe_clip, round((0.3 + 0.7 * t) * (1 - 0.5 * np), 6) AS clahe_blend, round(0.1 + 0.4 * t, 6) AS unsharp, round(0.80 + 0.10 * n, 6) AS max_eccentricity, round(0.65 - 0.20 * n, 6) AS min_solidity, round(0.40 - 0.15 * n, 6) AS min_circularity FROM s"))
def a08(spark, sf):
    clip = lambda e: F.least(F.lit(1.0), F.greatest(F.lit(0.0), e))
    d = diagnostics(patches(spark, sf)).select("pid", clip(F.col("contrast") / 40).alias("t"), clip(F.col("noise") / 20).alias("n"), clip(F.col("noise") / 15).alias("np"))
    t, n, q = F.col("t"), F.col("n"), F.col("np")
    out = {"msr_blend": 0.3 + 0.7 * t, "clahe_clip": (1 + t) * (1 - 0.6 * q), "clahe_blend": (0.3 + 0.7 * t) * (1 - 0.5 * q), "unsharp": 0.1 + 0.4 * t, "max_eccentricity": 0.80 + 0.10 * n, "min_solidity": 0.65 - 0.20 * n, "min_circularity": 0.40 - 0.15 * n}
    return d.select("pid", *[F.round(e, 6).alias(k) for k, e in out.items()])


@query("a11_odd_kernels", duck("gray", f"WITH {_DIAG}, s AS (SELECT pid, CAST(floor(11 + 40 * round({_CLIP.format('(skew + 1) / 2')}, 5)) AS BIGINT) AS k FROM di) SELECT pid, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS block_size FROM s"))
def a11(spark, sf):
    s = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("skew") + 1) / 2)), 5)
    k = diagnostics(patches(spark, sf)).select("pid", F.floor(11 + 40 * s).alias("k"))
    return k.select("pid", F.when(F.col("k") % 2 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("block_size"))


@query("t07_noise_gate", duck("gray", f"WITH {LAP} SELECT pid, median(l) AS noise, median(l) > 45 AS rejected FROM lap GROUP BY pid"))
def t07(spark, sf, most: float = 45.0):
    p = patches(spark, sf).select("pid", F.explode(F.expr(S.weighted("px", S.LAPLACE))).alias("l"))
    n = p.groupBy("pid").agg(F.median(F.abs("l")).alias("noise"))
    return n.withColumn("rejected", F.col("noise") > most)


@query("a06_local_variance_u8", duck("gray", f"WITH b AS (SELECT pid, y, x, CAST(floor(sum(g) / 25.0 + 0.5) AS BIGINT) AS m, CAST(floor(sum((g * g) % 256) / 25.0 + 0.5) AS BIGINT) AS q FROM ({_nb(S.box(2))}) t GROUP BY pid, y, x) SELECT pid, y, x, (q - (m * m) % 256 + 256) % 256 AS v FROM b"))
def a06(spark, sf):
    """Mean of squares minus square of the mean in wrapping 8-bit arithmetic."""
    p = patches(spark, sf).withColumn("sq", F.expr("transform(px, g -> (g * g) % 256)"))
    p = p.withColumn("m", F.expr(S.weighted("px", S.box(2)))).withColumn("q", F.expr(S.weighted("sq", S.box(2))))
    return long(p.withColumn("a", F.expr("zip_with(transform(m, s -> CAST(floor(s / 25.0 + 0.5) AS BIGINT)), transform(q, s -> CAST(floor(s / 25.0 + 0.5) AS BIGINT)), (m, q) -> pmod(q - (m * m) % 256, 256))")), "a")


def channel_stats(c: DataFrame) -> DataFrame:
    """(channel, mean, std) of pixels (b, gr, r) as shares, from integer sums, so that the order of addition does not matter."""
    s = c.agg(F.count("*").alias("n"), *[F.sum(k).alias(f"s_{k}") for k in ("b", "gr", "r")], *[F.sum(F.col(k) * F.col(k)).alias(f"q_{k}") for k in ("b", "gr", "r")])
    s = s.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.col(f"s_{k}").alias("s"), F.col(f"q_{k}").alias("q")) for k in ("b", "gr", "r")])).alias("e")).select("n", "e.*")
    return s.select("channel", F.round(F.col("s") / F.col("n") / 255, 4).alias("mean"), F.round(F.sqrt(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0))) / 255, 4).alias("std"))


@query("a14_channel_stats", duck("color", "SELECT 'b' AS channel, round(avg(b / 255.0), 4) AS mean, round(stddev_pop(b / 255.0), 4) AS std FROM fx_color UNION ALL SELECT 'gr', round(avg(gr / 255.0), 4), round(stddev_pop(gr / 255.0), 4) FROM fx_color UNION ALL SELECT 'r', round(avg(r / 255.0), 4), round(stddev_pop(r / 255.0), 4) FROM fx_color"))
def a14(spark, sf):
    return channel_stats(view(spark, sf, "color"))


# ---- features

_LCR = f"{_blur_sql(1.0)}"


@query("l02_local_contrast_ratio", settled(duck("gray", f"WITH {_LCR} SELECT b2.pid, b2.y, b2.x, round(CASE WHEN q.g > 10 THEN greatest(0, least(1, (bg - q.g) / greatest(bg, 1))) ELSE 0 END, 4) AS v FROM b2 JOIN fx_gray q USING (pid, y, x)")))
def l02(spark, sf):
    p = patches(spark, sf).withColumn("bg", F.expr(S.blur("px", 1.0)))
    return long(p.withColumn("a", F.expr("zip_with(px, bg, (g, b) -> round(CASE WHEN g > 10 THEN greatest(0D, least(1D, (b - g) / greatest(b, 1D))) ELSE 0D END, 4))")), "a")


@query("l01_tophat", settled(duck("gray", "WITH d AS (SELECT q.pid, q.y, q.x, max(n.g) AS g FROM fx_gray q JOIN fx_gray n ON n.pid = q.pid AND abs(n.y - q.y) + abs(n.x - q.x) <= 1 GROUP BY ALL), c AS (SELECT q.pid, q.y, q.x, min(n.g) AS g FROM d q JOIN d n ON n.pid = q.pid AND abs(n.y - q.y) + abs(n.x - q.x) <= 1 GROUP BY ALL) SELECT q.pid, q.y, q.x, c.g - q.g AS v FROM fx_gray q JOIN c USING (pid, y, x)")))
def l01(spark, sf):
    return long(closed(patches(spark, sf)).withColumn("a", F.expr("zip_with(a, px, (c, g) -> c - g)")), "a")


@query("l05_normalize_feature", duck("gray", "WITH q AS (SELECT pid, quantile_cont(g, 0.02) AS lo, quantile_cont(g, 0.98) AS hi FROM fx_gray GROUP BY pid) SELECT g.pid, g.y, g.x, round(CASE WHEN hi - lo < 1e-6 THEN 0 ELSE least(1, greatest(0, (g.g - lo) / (hi - lo))) END, 6) AS v FROM fx_gray g JOIN q USING (pid)"))
def l05(spark, sf):
    g = view(spark, sf, "gray")
    q = g.groupBy("pid").agg(F.percentile("g", 0.02).alias("lo"), F.percentile("g", 0.98).alias("hi"))
    v = F.when(F.col("hi") - F.col("lo") < 1e-6, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("g") - F.col("lo")) / (F.col("hi") - F.col("lo")))))
    return g.join(q, "pid").select("pid", "y", "x", F.round(v, 6).alias("v"))


@query("l08_threshold_gate", duck("pred", "SELECT p.pid, count(*) FILTER (p.p >= 0.5 AND g.g > 10) AS n FROM fx_pred p JOIN fx_gray g USING (pid, y, x) GROUP BY p.pid"))
def l08(spark, sf):
    return view(spark, sf, "pred").join(view(spark, sf, "gray").select("pid", "y", "x", "g"), ["pid", "y", "x"]).groupBy("pid").agg(F.count_if((F.col("p") >= 0.5) & (F.col("g") > 10)).alias("n"))


@query("m03_seafloor_mask", duck("mosaic", "SELECT mosaic_id, my, mx, g > 10 AS seafloor FROM fx_mosaic"))
def m03(spark, sf):
    return view(spark, sf, "mosaic").select("mosaic_id", "my", "mx", (F.col("g") > 10).alias("seafloor"))


@query("w11_blend_overlay", duck("gray", "SELECT pid, y, x, CAST(floor(0.6 * g + 0.4 * (CASE WHEN g > 160 THEN 255 ELSE g END) + 0.5) AS INTEGER) AS v FROM fx_gray"))
def w11(spark, sf):
    return view(spark, sf, "gray").selectExpr("pid", "y", "x", "CAST(floor(0.6 * g + 0.4 * (CASE WHEN g > 160 THEN 255 ELSE g END) + 0.5) AS INT) AS v")


@query("k06_flip_rot90", duck("gray", "SELECT pid, y, x, g, 'flip' AS kind FROM (SELECT pid, y, 7 - x AS x, g FROM fx_gray) a UNION ALL SELECT pid, 7 - x AS y, y AS x, g, 'rot90' FROM fx_gray"))
def k06(spark, sf):
    g = view(spark, sf, "gray")
    flip = g.select("pid", "y", (7 - F.col("x")).alias("x"), "g", F.lit("flip").alias("kind"))
    return flip.union(g.select("pid", (7 - F.col("x")).alias("y"), F.col("y").alias("x"), "g", F.lit("rot90")))
