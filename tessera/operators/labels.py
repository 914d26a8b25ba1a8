"""Proxy-label features, threshold, clean-up and the cascade of region tests.

Features, clean-up and regions are NumPy kernels per patch (bounded by the patch size); thresholds and the cascade
that accepts or rejects regions are DataFrame expressions within a patch's row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import raster, shapes
from tessera.functions import stencil as S
from tessera.functions.cascade import first_failure
from tessera.functions.kernels import pieces
from tessera.operators.enhance import duck_blur, duck_filled, unit
from tessera.operators.pixels import LAP, long
from tessera.registry import query
from tessera.sources.fixtures import duck, patches, settled


@dataclass(frozen=True)
class Settings:
    """Parameters of the proxy label; the radii and sigmas are those of the 8x8 fixtures."""

    radii: tuple[int, ...] = (1, 2)
    texture_sigma: float = 1.0
    texture_limit: float = 60.0
    background_sigma: float = 2.0
    score: float = 4.0
    percentiles: tuple[float, float] = (70.0, 90.0)
    dense_score: float = 3.0
    dense_fraction: float = 0.4
    least_positive: int = 10
    least_valid: int = 10
    noise_low: float = 4.0
    noise_span: float = 80.0
    least_contrast: float = 0.02
    bypass: float = 2.0
    most_area: float = 40.0
    least_area: float = 2.0
    shape_area: float = 6.0
    solidity: float = 0.55
    eccentricity: float = 0.9
    circularity: float = 0.3


BASE = Settings()


# ---- features

def _features(c: Settings, side: int):
    """Appends ``th``, ``bg``, ``score`` and ``noise`` of each patch; a null or empty patch stays as it is, without noise."""
    blur = lambda img, sigma: raster.blur(img, sigma, len(S.gauss(sigma)) // 2)

    def of(px):
        if not px:
            return px, px, px, 0.0
        g = np.array(px, float).reshape(-1, side)
        ok = g > 10
        best = np.max([raster.closed(g, 2 * r + 1) for r in c.radii], axis=0) - g
        th = best * np.clip(1 - blur(np.abs(g - blur(g, c.texture_sigma)), 2 * c.texture_sigma) / c.texture_limit, 0, 1)
        if not ok.any():
            return th.reshape(-1).tolist(), [None] * g.size, [0.0] * g.size, 0.0
        bg = blur(np.where(ok, g, g[ok].mean()), c.background_sigma)
        top = np.maximum(bg, 1)
        score = np.where(ok, np.round(th * np.clip((top - g) / top, 0, 1), 6), 0)
        noise = 1.4826 * float(np.median(np.abs(raster.stencil(g, S.LAPLACE))[ok]))
        return th.reshape(-1).tolist(), bg.reshape(-1).tolist(), score.reshape(-1).tolist(), noise

    def run(batches):
        for b in pieces(batches):
            rows = [of(px) for px in b.column(b.schema.get_field_index("px")).to_pylist()]
            new = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.list_(pa.float64())] * 3 + [pa.float64()])]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "th", "bg", "score", "noise"])

    return run


def _ball(r: int) -> str:
    return ", ".join(f"({dy}, {dx})" for dy, dx in S.ellipse(r))


def duck_extreme(name: str, source: str, r: int, kind: str) -> str:
    return f"{name} AS (SELECT q.pid, q.y, q.x, {kind}(n.g) AS g FROM {source} q CROSS JOIN (VALUES {_ball(r)}) o(dy, dx) JOIN {source} n ON n.pid = q.pid AND n.y = q.y + o.dy AND n.x = q.x + o.dx GROUP BY q.pid, q.y, q.x)"


_TH = ", ".join(f"{duck_extreme(f'di{r}', 'fx_gray', r, 'max')}, {duck_extreme(f'cl{r}', f'di{r}', r, 'min')}" for r in BASE.radii)
_TH += f", {duck_blur('fine', BASE.texture_sigma, 'fx_gray')}, df AS (SELECT q.pid, q.y, q.x, abs(q.g - fine.g) AS g FROM fx_gray q JOIN fine USING (pid, y, x)), {duck_blur('tx', 2 * BASE.texture_sigma, 'df')}, th AS (SELECT q.pid, q.y, q.x, (greatest({', '.join(f'cl{r}.g' for r in BASE.radii)}) - q.g) * {unit(f'1 - tx.g / {BASE.texture_limit}')} AS v FROM fx_gray q JOIN tx USING (pid, y, x) {' '.join(f'JOIN cl{r} USING (pid, y, x)' for r in BASE.radii)})"


@query("l01_tophat_textured", settled(duck("gray", f"WITH {_TH} SELECT pid, y, x, round(v, 5) AS v FROM th")))
def l01(spark, sf):
    return long(scored(patches(spark, sf)), "th").withColumn("v", F.round("v", 5))


PAIRS = ((0.5, 1.0), (1.0, 2.0))


@query("l03_difference_of_gaussians", duck("gray", "WITH " + ", ".join(duck_blur(f"g{str(s).replace('.', '_')}", s, "fx_gray") for s in (0.5, 1.0, 2.0)) + " SELECT pid, y, x, round(greatest(0, (g1_0.g - g0_5.g) * 0.75, (g2_0.g - g1_0.g) * 1.5), 5) AS v FROM g0_5 JOIN g1_0 USING (pid, y, x) JOIN g2_0 USING (pid, y, x)"))
def l03(spark, sf, pairs=PAIRS):
    """Scale-normalised difference of Gaussians: the greatest over pairs, not below 0."""
    sigmas = sorted({s for p in pairs for s in p})
    terms = ", ".join(f"(q.b{sigmas.index(b)}[i] - q.b{sigmas.index(a)}[i]) * {(a + b) / 2}D" for a, b in pairs)
    e = S.bound(f"transform(sequence(0, size(q.b0) - 1), i -> greatest(0D, {terms}))", **{f"b{k}": S.blur("px", s) for k, s in enumerate(sigmas)})
    return long(patches(spark, sf).withColumn("a", F.expr(e)), "a").withColumn("v", F.round("v", 5))


@query("l04_smoothness", settled(duck("gray", f"WITH sq AS (SELECT pid, y, x, g * g AS g FROM fx_gray), {duck_blur('mf', 0.5, 'fx_gray')}, {duck_blur('qf', 0.5, 'sq')}, {duck_blur('mc', 2.0, 'fx_gray')}, {duck_blur('qc', 2.0, 'sq')} SELECT q.pid, q.y, q.x, round(CASE WHEN q.g > 10 THEN {unit('1 - greatest(0, qf.g - mf.g * mf.g) / (greatest(0, qc.g - mc.g * mc.g) + 1e-4)')} ELSE 0 END, 5) AS v FROM fx_gray q JOIN mf USING (pid, y, x) JOIN qf USING (pid, y, x) JOIN mc USING (pid, y, x) JOIN qc USING (pid, y, x)")))
def l04(spark, sf):
    """One minus fine over coarse variance; 0 on border pixels."""
    sq = S.let("px", "transform(q, g -> g * g)")
    v = unit("1 - greatest(0D, q.qf[i] - q.mf[i] * q.mf[i]) / (greatest(0D, q.qc[i] - q.mc[i] * q.mc[i]) + 1e-4D)")
    e = S.bound(f"transform(sequence(0, size(q.px) - 1), i -> CASE WHEN q.px[i] > 10 THEN {v} ELSE 0D END)", px="px", mf=S.blur("px", 0.5), qf=S.blur(sq, 0.5), mc=S.blur("px", 2.0), qc=S.blur(sq, 2.0))
    return long(patches(spark, sf).withColumn("a", F.expr(e)), "a").withColumn("v", F.round("v", 5))


# ---- score and threshold

def scored(p: DataFrame, c: Settings = BASE, side: int = S.PS) -> DataFrame:
    """Adds ``th``, the greatest closing minus gray over the radii, damped where the texture is grainy; ``score``, that times local contrast (six places, 0 on border pixels); ``bg`` and ``noise``."""
    return p.mapInArrow(_features(c, side), appended(p, "th array<double>, bg array<double>, score array<double>, noise double"))


def appended(p: DataFrame, columns: str) -> str:
    """The schema of ``p`` with further columns."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema.fields), columns])


_SC = f"{_TH}, {duck_filled(10)}, {duck_blur('bl', BASE.background_sigma, 'fi')}, sc AS (SELECT q.pid, q.y, q.x, q.g AS gray, CASE WHEN q.g > 10 THEN round(th.v * {unit('(greatest(bl.g, 1) - q.g) / greatest(bl.g, 1)')}, 6) ELSE 0 END AS v FROM fx_gray q JOIN th USING (pid, y, x) JOIN bl USING (pid, y, x))"


@query("l06_combined_score", duck("gray", f"WITH {_SC} SELECT pid, y, x, v FROM sc"))
def l06(spark, sf):
    return long(scored(patches(spark, sf)), "score")


def thresholded(p: DataFrame, c: Settings = BASE) -> DataFrame:
    """Adds ``thr``: the plain threshold, or with enough positive scores one that adapts to their density."""
    p = scored(p, c).withColumn("n_valid", F.expr("size(filter(px, g -> g > 10))")).withColumn("pos", F.expr("filter(score, s -> s > 0)"))
    frac = S.bound(f"size(filter(q.s, s -> s > {c.score}D)) / greatest(q.n, 1)", s="score", n="n_valid")
    p = p.withColumn("d", F.expr(f"{unit(f'{frac} / {c.dense_fraction}D')} * (1 - {unit(f'(noise - {c.noise_low}D) / {c.noise_span}D')})"))
    p = p.withColumn("eff", F.expr(f"{c.score}D - d * {c.score - c.dense_score}D"))
    p = p.withColumn("at", F.expr(S.quantile("pos", f"({c.percentiles[1]}D - d * {c.percentiles[1] - c.percentiles[0]}D) / 100")))
    return p.withColumn("thr", F.expr(f"CASE WHEN size(pos) > {c.least_positive} THEN round(eff + (1 - d) * greatest(0D, at - eff), 9) ELSE {c.score}D END"))


_TR = (
    f"{_SC}, {LAP}, no AS (SELECT lap.pid, 1.4826 * median(l) AS noise FROM lap JOIN fx_gray q USING (pid, y, x) WHERE q.g > 10 GROUP BY lap.pid), "
    f"de AS (SELECT sc.pid, {unit(f'CAST(count(*) FILTER (v > {BASE.score}) AS DOUBLE) / greatest(count(*) FILTER (gray > 10), 1) / {BASE.dense_fraction}')} * (1 - {unit(f'(any_value(noise) - {BASE.noise_low}) / {BASE.noise_span}')}) AS d, count(*) FILTER (v > 0) AS np FROM sc LEFT JOIN no ON no.pid = sc.pid GROUP BY sc.pid), "
    # the fraction differs from patch to patch, so the quantile is spelled out over ranks
    f"ef AS (SELECT *, {BASE.score} - d * {BASE.score - BASE.dense_score} AS eff, (np - 1) * ({BASE.percentiles[1]} - d * {BASE.percentiles[1] - BASE.percentiles[0]}) / 100 AS h FROM de), "
    "po AS (SELECT pid, v, row_number() OVER (PARTITION BY pid ORDER BY v) - 1 AS k FROM sc WHERE v > 0), "
    "pa AS (SELECT ef.pid, max(CASE WHEN k = floor(h) THEN v END) AS lo, max(CASE WHEN k = ceil(h) THEN v END) AS hi FROM ef JOIN po ON po.pid = ef.pid GROUP BY ef.pid), "
    f"tr AS (SELECT ef.pid, d, np, CASE WHEN np > {BASE.least_positive} THEN round(eff + (1 - d) * greatest(0, lo + (h - floor(h)) * (hi - lo) - eff), 9) ELSE {BASE.score} END AS thr FROM ef LEFT JOIN pa ON pa.pid = ef.pid)"
)


@query("l07_adaptive_threshold", duck("gray", f"WITH {_TR} SELECT pid, np AS n_positive, round(d, 5) AS density, round(thr, 7) AS threshold FROM tr"))
def l07(spark, sf):
    return thresholded(patches(spark, sf)).select("pid", F.size("pos").cast("bigint").alias("n_positive"), F.round("d", 5).alias("density"), F.round("thr", 7).alias("threshold"))


def cleaned(p: DataFrame, c: Settings = BASE, close: int = 2, open_: int = 1) -> DataFrame:
    """Adds ``mask``: scores at or over the threshold, closed, then opened (0 and 1)."""
    p = thresholded(p, c).withColumn("raw", F.expr(S.bound("zip_with(q.s, q.px, (s, g) -> CASE WHEN s >= q.t AND g > 10 THEN 1 ELSE 0 END)", s="score", px="px", t="thr")))
    return p.mapInArrow(_cleanup(2 * close + 1, 2 * open_ + 1), appended(p, "mask array<int>"))


def _cleanup(close: int, open_: int, side: int = S.PS):
    """Appends ``mask``, the column ``raw`` closed and then opened; a null or empty one stays."""

    def run(batches):
        for b in pieces(batches):
            masks = []
            for raw in b.column(b.schema.get_field_index("raw")).to_pylist():
                masks.append(raw if not raw else raster.opened(raster.closed(np.array(raw).reshape(-1, side), close), open_).astype(int).reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(masks, pa.list_(pa.int32()))], [*b.schema.names, "mask"])

    return run


_CLEAN = f"{_TR}, b0 AS (SELECT sc.pid, y, x, CASE WHEN v >= thr AND gray > 10 THEN 1 ELSE 0 END AS g FROM sc JOIN tr ON tr.pid = sc.pid), {duck_extreme('m1', 'b0', 2, 'max')}, {duck_extreme('m2', 'm1', 2, 'min')}, {duck_extreme('m3', 'm2', 1, 'min')}, {duck_extreme('m4', 'm3', 1, 'max')}"


@query("l09_morphological_cleanup", duck("gray", f"WITH {_CLEAN} SELECT pid, y, x, g AS v FROM m4"))
def l09(spark, sf):
    return long(cleaned(patches(spark, sf)), "mask")


@query("l17_heatmap_values", duck("gray", f"WITH {_SC}, hi AS (SELECT pid, quantile_cont(v, 0.995) FILTER (gray > 10) AS top FROM sc GROUP BY pid) SELECT sc.pid, y, x, CASE WHEN gray > 10 THEN CAST(floor(round(least(255, v / greatest(coalesce(top, 1), 1e-6) * 255), 6)) AS INTEGER) ELSE 0 END AS v FROM sc JOIN hi ON hi.pid = sc.pid"))
def l17(spark, sf):
    p = scored(patches(spark, sf))
    good = S.bound("transform(filter(zip_with(q.px, q.s, (g, s) -> named_struct('g', g, 's', s)), e -> e.g > 10), e -> e.s)", px="px", s="score")
    p = p.withColumn("top", F.expr(f"greatest(coalesce({S.quantile(good, 0.995)}, 1D), 1e-6D)"))
    return long(p.withColumn("a", F.expr(S.bound("zip_with(q.px, q.s, (g, s) -> CASE WHEN g > 10 THEN CAST(floor(round(least(255D, s / q.t * 255), 6)) AS INT) ELSE 0 END)", px="px", s="score", t="top"))), "a")


# ---- regions

def regions(p: DataFrame, side: int = S.PS, outer: bool = False) -> DataFrame:
    """One row per outer region of ``mask`` with its shape features, mean score and mean contrast; holes count as inside.

    With ``outer`` a patch without regions has a row, too, with a null region.
    """
    return p.select("pid", "mask", "score", "px", "bg", "thr", "n_valid").mapInArrow(shapes.region_rows(side, outer), shapes.REGION)


def cascade(r: DataFrame, c: Settings = BASE) -> DataFrame:
    """Adds ``verdict``: the first test that a region fails, or ``kept``. Strong regions skip the shape tests."""
    limits = {"area_max": c.most_area, "area_min": c.least_area, "min_solidity": c.solidity, "max_eccentricity": c.eccentricity, "min_circularity": c.circularity}
    verdict = first_failure(F.col, lambda name: F.lit(limits[name]), F.col("mean_score") >= c.bypass * F.col("thr"), c.shape_area, c.least_contrast)
    return r.withColumn("verdict", verdict)


@query("l10_l11_region_features")
def l11(spark, sf):
    return regions(cleaned(patches(spark, sf))).drop("inside", "n_valid", "size")


_FEATURES = "SELECT doc_id, CAST(n_chars % 60 AS DOUBLE) AS area, CAST(doc_id % 11 AS DOUBLE) AS mean_score, CAST(4 AS DOUBLE) AS thr, CAST(doc_id % 13 AS DOUBLE) / 12 AS solidity, CAST(doc_id % 17 AS DOUBLE) / 16 AS eccentricity, CAST(doc_id % 19 AS DOUBLE) / 18 AS circularity, CAST(doc_id % 50 AS DOUBLE) AS mean_bg, CAST(doc_id % 47 AS DOUBLE) AS mean_gray FROM {docs}"
_VERDICT = f"CASE WHEN area > {BASE.most_area} THEN 'area_too_large' WHEN area < CASE WHEN mean_score >= {BASE.bypass} * thr THEN 1 ELSE {BASE.least_area} END THEN 'area_too_small' WHEN area >= {BASE.shape_area} AND mean_score < {BASE.bypass} * thr AND solidity < {BASE.solidity} THEN 'low_solidity' WHEN area >= {BASE.shape_area} AND mean_score < {BASE.bypass} * thr AND eccentricity > {BASE.eccentricity} THEN 'eccentricity' WHEN area >= {BASE.shape_area} AND mean_score < {BASE.bypass} * thr AND circularity < {BASE.circularity} THEN 'low_circularity' WHEN mean_bg > 1 AND (mean_bg - mean_gray) / mean_bg < {BASE.least_contrast} THEN 'weak_local_contrast' ELSE 'kept' END"


@query("l12_reject_cascade", f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM ({_FEATURES.format(docs='documents')}) t GROUP BY 1")
def l12(spark, sf):
    r = spark.sql(_FEATURES, docs=spark.read.parquet(f"{sf}/documents.parquet"))
    return cascade(r).groupBy("verdict").agg(F.count("*").alias("n"))


def proxy_label(p: DataFrame, c: Settings = BASE) -> DataFrame:
    """Label statistics per patch: candidates, kept regions, coverage, threshold and rejections by reason.

    A patch with too few valid pixels or without regions has no candidates.
    """
    kept = F.col("verdict") == "kept"
    v = cascade(regions(cleaned(p, c), outer=True), c).groupBy("pid", F.when(F.col("region").isNotNull(), F.col("verdict")).alias("verdict"))
    v = v.agg(F.count("region").alias("n"), F.sum("n_inside").alias("px"), *[F.first(k).alias(k) for k in ("n_valid", "thr", "size")])
    v = v.groupBy("pid").agg(
        F.sum("n").alias("candidates"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(kept, F.col("px")).otherwise(0)).alias("kept_px"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~kept, F.struct("verdict", "n"))))).alias("rejected"),
        *[F.first(k).alias(k) for k in ("n_valid", "thr", "size")],
    )
    few = F.col("n_valid") < c.least_valid
    zero = lambda k: F.when(few, 0).otherwise(F.col(k))
    return v.select("pid", zero("candidates").alias("candidates"), zero("kept").alias("kept"), (100.0 * zero("kept_px") / F.nullif("size", F.lit(0))).alias("coverage_pct"), F.when(few, 0.0).otherwise(F.col("thr")).alias("threshold"), "rejected")


@query("l14_l15_proxy_label")
def l15(spark, sf):
    return proxy_label(patches(spark, sf))


# ---- regions in SQL: what no way of 4-neighbours from the border reaches is inside; shapes come from the 2 x 2 squares of pixels that regions touch

_RING = "(VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1))"
#: the clockwise steps of an outline across a square, by the pixels of it that a region holds (1, 2: upper, 4, 8: lower): start in the square, direction
_STEPS = "(VALUES (12, 1, 0, 0), (3, 0, 1, 4), (5, 0, 0, 2), (10, 1, 1, 6), (14, 1, 0, 7), (13, 0, 0, 1), (11, 1, 1, 5), (7, 0, 1, 3), (9, 0, 0, 1), (9, 1, 1, 5), (6, 0, 1, 3), (6, 1, 0, 7))"
_SAME = "{b}.pid = {a}.pid AND {b}.region = {a}.region"
_FE = (
    f"{_CLEAN}, ma AS MATERIALIZED (SELECT pid, y, x, g FROM m4), bk AS MATERIALIZED (SELECT pid, y, x FROM ma WHERE g = 0), "
    "ou(pid, y, x) AS (SELECT pid, y, x FROM bk WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT bk.pid, bk.y, bk.x FROM ou JOIN bk ON bk.pid = ou.pid AND abs(bk.y - ou.y) + abs(bk.x - ou.x) = 1), "
    "ins AS MATERIALIZED (SELECT pid, y * 8 + x AS n, y, x FROM ma ANTI JOIN ou USING (pid, y, x)), "
    "rl(pid, n, o) AS (SELECT pid, n, n FROM ins UNION SELECT i.pid, i.n, r.o FROM rl r JOIN ins i ON i.pid = r.pid AND abs(i.y - r.n // 8) <= 1 AND abs(i.x - r.n % 8) <= 1 WHERE r.o < i.n), "
    "rg AS MATERIALIZED (SELECT pid, n // 8 AS y, n % 8 AS x, min(o) AS region FROM rl GROUP BY pid, n), "
    "ce AS (SELECT pid, region, y - dy AS cy, x - dx AS cx, sum(CASE WHEN dy = 0 THEN 1 ELSE 4 END * (1 + dx)) AS b FROM rg, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx) GROUP BY ALL), "
    "ar AS (SELECT pid, region, sum(CASE WHEN b = 15 THEN 1.0 WHEN b IN (7, 11, 13, 14) THEN 0.5 ELSE 0 END)::DOUBLE AS area FROM ce GROUP BY ALL), "
    f"sp AS MATERIALIZED (SELECT ce.pid, region, cy + dy AS y, cx + dx AS x, d FROM ce JOIN {_STEPS} v(b, dy, dx, d) ON v.b = ce.b), "
    f"nx AS (SELECT sp.pid, sp.region, sp.y, sp.x, sp.d, min((o.d - sp.d + 11) % 8) AS turn FROM sp JOIN {_RING} s(d, dy, dx) ON s.d = sp.d CROSS JOIN {_RING} o(d, dy, dx) JOIN rg ON {_SAME.format(a='sp', b='rg')} AND rg.y = sp.y + s.dy + o.dy AND rg.x = sp.x + s.dx + o.dx GROUP BY ALL), "
    "le AS (SELECT pid, region, count(*) FILTER (d % 2 = 0) + count(*) FILTER (d % 2 = 1) * sqrt(2) AS length, count(*) FILTER (turn <> 3) AS bends FROM nx GROUP BY ALL), "
    "pt AS MATERIALIZED (SELECT pid, region, y, min(x) AS x FROM rg GROUP BY ALL UNION SELECT pid, region, y, max(x) FROM rg GROUP BY pid, region, y), "
    f"hu AS (SELECT p.pid, p.region, p.y * q.x - p.x * q.y AS c FROM pt p JOIN pt q ON {_SAME.format(a='p', b='q')} AND (q.y <> p.y OR q.x <> p.x) JOIN pt r ON {_SAME.format(a='p', b='r')} GROUP BY p.pid, p.region, p.y, p.x, q.y, q.x HAVING bool_and((q.y - p.y) * (r.x - p.x) > (q.x - p.x) * (r.y - p.y) OR ((q.y - p.y) * (r.x - p.x) = (q.x - p.x) * (r.y - p.y) AND (r.y - p.y) * (r.y - q.y) + (r.x - p.x) * (r.x - q.x) <= 0))), "
    "wh AS (SELECT pid, region, abs(sum(c)) / 2 AS whole FROM hu GROUP BY ALL), "
    "mn AS (SELECT rg.pid, rg.region, count(*) AS n_inside, avg(sc.v) AS mean_score, avg(sc.gray) AS mean_gray, avg(bl.g) AS mean_bg FROM rg JOIN sc USING (pid, y, x) JOIN bl USING (pid, y, x) GROUP BY ALL), "
    "fe AS MATERIALIZED (SELECT mn.*, tr.thr, ar.area, CASE WHEN whole > 0 THEN area / whole ELSE 0 END AS solidity, 0.0 AS eccentricity, CASE WHEN length > 0 THEN 4 * pi() * area / (length * length) ELSE 0 END AS circularity, greatest(coalesce(bends, 0), 1) AS n_points FROM mn JOIN ar USING (pid, region) JOIN tr ON tr.pid = mn.pid LEFT JOIN le ON le.pid = mn.pid AND le.region = mn.region LEFT JOIN wh ON wh.pid = mn.pid AND wh.region = mn.region)"
)
ROUND = replace(BASE, eccentricity=1.0)  #: no region is too long for it, so that SQL, which fits no ellipse, decides alike
_SHAPE = ("area", "solidity", "circularity", "mean_gray", "mean_bg")
# scores have six places, so their sums do, while means would lie halfway between two values at times
_ROUNDED = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _SHAPE) + ", round(CAST(mean_score * n_inside AS DOUBLE), 6) AS sum_score"
_REAL = _VERDICT.replace(f"eccentricity > {BASE.eccentricity}", f"eccentricity > {ROUND.eccentricity}")


@query("l10_outline_features", duck("gray", f"WITH RECURSIVE {_FE} SELECT pid, CAST(region AS INTEGER) AS region, n_inside, CAST(n_points AS INTEGER) AS n_points, {_ROUNDED} FROM fe"))
def l10(spark, sf):
    """Area, outline, hull and means of every region of the cleaned masks."""
    return regions(cleaned(patches(spark, sf))).select("pid", "region", "n_inside", "n_points", *[F.round(c, 6).alias(c) for c in _SHAPE], F.round(F.col("mean_score") * F.col("n_inside"), 6).alias("sum_score"))


@query("l13_region_verdicts", duck("gray", f"WITH RECURSIVE {_FE} SELECT pid, CAST(region AS INTEGER) AS region, round(CAST(CASE WHEN mean_bg > 1 THEN (mean_bg - mean_gray) / mean_bg END AS DOUBLE), 6) AS contrast, {_REAL} AS verdict FROM fe"))
def l13(spark, sf):
    """The cascade, local contrast included, over the regions of the cleaned masks."""
    r = cascade(regions(cleaned(patches(spark, sf), ROUND)), ROUND)
    return r.select("pid", "region", F.round(F.when(F.col("mean_bg") > 1, (F.col("mean_bg") - F.col("mean_gray")) / F.col("mean_bg")), 6).alias("contrast"), "verdict")


_STATS = (
    f"{_FE}, vc AS (SELECT pid, {_REAL} AS verdict, count(*) AS n, sum(n_inside) AS px FROM fe GROUP BY ALL), nv AS (SELECT pid, count(*) FILTER (gray > 10) < {BASE.least_valid} AS few, count(*) AS size FROM sc GROUP BY pid), "
    "la AS (SELECT nv.pid, any_value(few) AS few, any_value(size) AS size, coalesce(sum(n), 0) AS n, coalesce(sum(n) FILTER (verdict = 'kept'), 0) AS k, coalesce(sum(px) FILTER (verdict = 'kept'), 0) AS px, coalesce(string_agg(verdict || ':' || n, ',' ORDER BY verdict) FILTER (verdict <> 'kept'), '') AS rejected FROM nv LEFT JOIN vc ON vc.pid = nv.pid GROUP BY nv.pid) "
    "SELECT la.pid, CAST(CASE WHEN few THEN 0 ELSE n END AS BIGINT) AS candidates, CAST(CASE WHEN few THEN 0 ELSE k END AS BIGINT) AS kept, round(100.0::DOUBLE * CASE WHEN few THEN 0 ELSE px END / size, 6) AS coverage_pct, round(CASE WHEN few THEN 0 ELSE thr END, 7) AS threshold, rejected FROM la JOIN tr ON tr.pid = la.pid"
)


@query("l14_label_statistics", duck("gray", f"WITH RECURSIVE {_STATS}"))
def l14(spark, sf):
    """The proxy label of every patch: candidates, kept regions, coverage, threshold, and rejections as ``reason:count``."""
    rejected = F.concat_ws(",", F.transform(F.map_entries("rejected"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return proxy_label(patches(spark, sf), ROUND).select("pid", "candidates", "kept", F.round("coverage_pct", 6).alias("coverage_pct"), F.round("threshold", 7).alias("threshold"), rejected.alias("rejected"))


@query("l16_watershed_split")
def l16(spark, sf):
    """Splits wide components of bright pixels (over 90) along the watersheds of the pixels between their inner peaks."""
    p = patches(spark, sf).select("pid", F.expr("transform(px, g -> CASE WHEN g > 90 THEN 1 ELSE 0 END)").alias("mask"), "px")
    return p.mapInArrow(shapes.split_rows(S.PS, 1.0, 12), "pid bigint, n_before int, n_after int, mask array<int>")


# A tile has 16 pixels and a limit of one a value, so what is cut is 16 less the values seen; it is spread from 0 in even steps.
_CLAHE = (
    "WITH se AS (SELECT DISTINCT pid, y // 4 AS j, x // 4 AS i, g FROM fx_gray), re AS (SELECT pid, j, i, 16 - count(*) AS rest FROM se GROUP BY pid, j, i), "
    "co AS (SELECT q.pid, q.y, q.x, q.g, least(1, greatest(0, floor(q.y / 4.0::DOUBLE - 0.5) + a)) AS j, least(1, greatest(0, floor(q.x / 4.0::DOUBLE - 0.5) + b)) AS i, "
    "abs(1 - a - (q.y / 4.0::DOUBLE - 0.5 - floor(q.y / 4.0::DOUBLE - 0.5))) * abs(1 - b - (q.x / 4.0::DOUBLE - 0.5 - floor(q.x / 4.0::DOUBLE - 0.5))) AS w FROM fx_gray q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b)), "
    "cu AS (SELECT co.pid, y, x, co.g, co.j, co.i, any_value(co.w) AS w, count(*) FILTER (se.g <= co.g) AS seen FROM (SELECT pid, y, x, g, j, i, sum(w) AS w FROM co GROUP BY ALL) co JOIN se ON se.pid = co.pid AND se.j = co.j AND se.i = co.i GROUP BY ALL), "
    "va AS (SELECT cu.pid, y, x, g, round_even(sum(w * round_even((seen + CASE WHEN rest > 0 THEN least(rest, g // greatest(1, 256 // greatest(rest, 1)) + 1) ELSE 0 END) * 15.9375::DOUBLE, 0)), 0) AS v FROM cu JOIN re ON re.pid = cu.pid AND re.j = cu.j AND re.i = cu.i GROUP BY cu.pid, y, x, g) "
    "SELECT pid, y, x, CAST(least(255, greatest(0, round_even(v * 0.5 + g * 0.5, 0))) AS INTEGER) AS v FROM va"
)


@query("f03_clahe", duck("gray", _CLAHE))
def f03(spark, sf):
    """Contrast-limited equalisation over a 2x2 grid of tiles, blended half and half."""
    return long(patches(spark, sf).select("pid", "px").mapInArrow(shapes.clahe_rows(S.PS, 2, 2.0, 0.5), "pid bigint, a array<int>"), "a")
