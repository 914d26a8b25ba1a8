"""Enhancement filters, parameter search and proxy-label features of patches.

A patch stays one row: blurs, morphology and statistics are array expressions inside it, so none of these
operators shuffles. Grids are scaled to 8x8 patches; a patch with fewer than ``FEW`` valid pixels is left as it is.
Values are rounded to six places before they are truncated or compared, so that both engines decide alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import stencil as S
from tessera.operators.pixels import LAP, _nb, long
from tessera.registry import query
from tessera.sources.fixtures import duck, patches, settled

FEW = 10

U8 = "floor(round(least(CAST(255 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {})), 6))"
UNIT = "least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {}))"


def unit(e: str) -> str:
    return UNIT.format(e)


def byte(e: str) -> str:
    return f"CAST({U8.format(e)} AS INT)"


def duck_blur(name: str, sigma: float, source: str, value: str = "g") -> str:
    """CTEs of a separable Gaussian; the last one, ``name``, has (pid, y, x, g)."""
    taps = S.gauss(sigma)
    rows = _nb([(0, k, f"CAST({w!r} AS DOUBLE)") for k, w in taps], source, value)
    cols = _nb([(k, 0, f"CAST({w!r} AS DOUBLE)") for k, w in taps], f"{name}_1")
    return f"{name}_1 AS (SELECT pid, y, x, sum(w * g) AS g FROM ({rows}) t GROUP BY pid, y, x), {name} AS (SELECT pid, y, x, sum(w * g) AS g FROM ({cols}) t GROUP BY pid, y, x)"


def filled(border: int) -> str:
    """The patch as doubles with pixels up to ``border`` set to the mean of the others."""
    return S.bound(f"transform(q.px, g -> CASE WHEN g > {border} THEN CAST(g AS DOUBLE) ELSE q.m END)", px="px", m=S.mean(f"filter(px, g -> g > {border})"))


def duck_filled(border: int, st: str = "st") -> str:
    return f"{st} AS (SELECT pid, avg(g) FILTER (g > {border}) AS vm, stddev_pop(g) FILTER (g > {border}) AS vs, count(*) FILTER (g > {border}) AS nv FROM fx_gray GROUP BY pid), fi AS (SELECT q.pid, q.y, q.x, CASE WHEN q.g > {border} THEN q.g ELSE {st}.vm END AS g FROM fx_gray q JOIN {st} ON {st}.pid = q.pid)"


# ---- filter chain

def illumination_normalize(p: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Divides out the low-frequency light; border pixels stay 0."""
    value = byte("e.g / greatest(e.b, 1D) * q.vm")
    out = S.bound(
        f"CASE WHEN q.nv < {FEW} THEN q.px ELSE transform(zip_with(q.px, q.bg, (g, b) -> named_struct('g', g, 'b', b)), e -> CASE WHEN e.g > 8 THEN {value} ELSE 0 END) END",
        px="px", bg=S.blur(filled(8), sigma), vm=S.mean("filter(px, g -> g > 8)"), nv="size(filter(px, g -> g > 8))",
    )
    return p.withColumn("a", F.expr(out))


@query("f02_illumination_normalize", duck("gray", f"WITH {duck_filled(8)}, {duck_blur('bl', 2.0, 'fi')} SELECT q.pid, q.y, q.x, CASE WHEN nv < {FEW} THEN q.g WHEN q.g > 8 THEN {byte('q.g / greatest(bl.g, 1) * vm')} ELSE 0 END AS v FROM fx_gray q JOIN bl USING (pid, y, x) JOIN st ON st.pid = q.pid"))
def f02(spark, sf):
    return long(illumination_normalize(patches(spark, sf)), "a")


SCALES = (0.5, 1.0, 2.0)


def retinex(p: DataFrame, scales=SCALES, blend: float = 0.65) -> DataFrame:
    """Log reflectance averaged over scales, matched to the brightness of the valid pixels and blended in."""
    logs = S.bound(
        "transform(sequence(0, size(q.f) - 1), i -> ln(1 + q.f[i]) - (" + " + ".join(f"ln(1 + q.b{k}[i])" for k in range(len(scales))) + f") / {len(scales)}D)",
        f="f", **{f"b{k}": S.blur("f", s) for k, s in enumerate(scales)},
    )
    p = p.withColumn("f", F.expr(filled(8))).withColumn("r", F.expr(logs))
    p = p.withColumn("ok", F.expr(S.bound("transform(filter(zip_with(q.px, q.r, (g, r) -> named_struct('g', g, 'r', r)), e -> e.g > 8), e -> e.r)", px="px", r="r")))
    p = p.withColumn("lo", F.expr(S.quantile("ok", 0.01))).withColumn("hi", F.expr(S.quantile("ok", 0.99)))
    p = p.withColumn("rm", F.expr(S.mean("ok"))).withColumn("rs", F.expr(S.spread("ok")))
    good = "filter(px, g -> g > 8)"
    # the stretch to 0..255 is linear, so matching mean and deviation needs only those of the logs
    value = f"CASE WHEN e.g > 8 THEN {byte(f'(CASE WHEN 255 * q.rs / (q.hi - q.lo) > 1e-6 THEN (e.r - q.rm) / q.rs * q.vs + q.vm ELSE (e.r - q.lo) / (q.hi - q.lo) * 255 END) * {blend}D + e.g * (1 - {blend}D)')} ELSE 0 END"
    out = S.bound(
        f"CASE WHEN size(q.ok) < {FEW} OR q.hi - q.lo < 1e-6 THEN q.px ELSE transform(zip_with(q.px, q.r, (g, r) -> named_struct('g', g, 'r', r)), e -> {value}) END",
        px="px", r="r", ok="ok", lo="lo", hi="hi", rm="rm", rs="rs", vm=S.mean(good), vs=S.spread(good),
    )
    return p.withColumn("a", F.expr(out))


_RETINEX = (
    f"WITH {duck_filled(8)}, " + ", ".join(duck_blur(f"s{k}", s, "fi") for k, s in enumerate(SCALES))
    + ", re AS (SELECT fi.pid, fi.y, fi.x, ln(1 + fi.g) - (" + " + ".join(f"ln(1 + s{k}.g)" for k in range(3)) + ") / 3 AS r FROM fi" + "".join(f" JOIN s{k} USING (pid, y, x)" for k in range(3))
    + "), rs AS (SELECT q.pid, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi, avg(r) AS rm, stddev_pop(r) AS rs FROM re JOIN fx_gray q USING (pid, y, x) WHERE q.g > 8 GROUP BY q.pid) "
    + f"SELECT q.pid, q.y, q.x, CASE WHEN nv < {FEW} OR hi - lo < 1e-6 THEN q.g WHEN q.g > 8 THEN {byte('(CASE WHEN 255 * rs / (hi - lo) > 1e-6 THEN (r - rm) / rs * vs + vm ELSE (r - lo) / (hi - lo) * 255 END) * 0.65 + q.g * 0.35')} ELSE 0 END AS v "
    + "FROM fx_gray q JOIN re USING (pid, y, x) JOIN st ON st.pid = q.pid LEFT JOIN rs ON rs.pid = q.pid"
)


@query("f05_multi_scale_retinex", duck("gray", _RETINEX))
def f05(spark, sf):
    return long(retinex(patches(spark, sf)), "a")


def sediment_fade(p: DataFrame, sigma: float = 2.0, soft: float = 1.0, strength: float = 0.6, default: float = 80.0) -> DataFrame:
    """Blends what is brighter than the median toward the blurred patch."""
    p = p.withColumn("smooth", F.expr(S.blur("px", sigma))).withColumn("thr", F.expr(f"coalesce({S.quantile('filter(px, g -> g > 10)', 0.5)}, {default}D)"))
    p = p.withColumn("soft", F.expr(S.blur(S.bound(f"transform(q.px, g -> {unit('(g - q.t) / 40')})", px="px", t="thr"), soft)))
    value = byte(f"q.px[i] * (1 - q.w[i] * {strength}D) + q.s[i] * q.w[i] * {strength}D")
    return p.withColumn("a", F.expr(S.bound(f"transform(sequence(0, size(q.px) - 1), i -> {value})", px="px", s="smooth", w="soft")))


_FADE = f"WITH th AS (SELECT pid, coalesce(median(g) FILTER (g > 10), 80) AS thr FROM fx_gray GROUP BY pid), mk AS (SELECT q.pid, q.y, q.x, {unit('(q.g - thr) / 40')} AS g FROM fx_gray q JOIN th ON th.pid = q.pid), {duck_blur('sm', 2.0, 'fx_gray')}, {duck_blur('so', 1.0, 'mk')} SELECT q.pid, q.y, q.x, {byte('q.g * (1 - so.g * 0.6) + sm.g * so.g * 0.6')} AS v FROM fx_gray q JOIN sm USING (pid, y, x) JOIN so USING (pid, y, x)"


@query("f06_sediment_fade", duck("gray", _FADE))
def f06(spark, sf):
    return long(sediment_fade(patches(spark, sf)), "a")


def with_sobel(p: DataFrame) -> DataFrame:
    p = p.withColumn("gx", F.expr(S.weighted("px", S.SOBEL_X))).withColumn("gy", F.expr(S.weighted("px", S.SOBEL_Y)))
    return p.withColumn("edge", F.expr("zip_with(gx, gy, (a, b) -> sqrt(CAST(a * a + b * b AS DOUBLE)))"))


DUCK_EDGE = f"ed AS (SELECT a.pid, a.y, a.x, sqrt(CAST(a.v * a.v + b.v * b.v AS DOUBLE)) AS g FROM (SELECT pid, y, x, sum(w * g) AS v FROM ({_nb(S.SOBEL_X)}) t GROUP BY pid, y, x) a JOIN (SELECT pid, y, x, sum(w * g) AS v FROM ({_nb(S.SOBEL_Y)}) t GROUP BY pid, y, x) b USING (pid, y, x))"


def unsharp(p: DataFrame, sigma: float = 1.0, strength: float = 0.5) -> DataFrame:
    """Adds detail where the gradient is strong against its median over valid pixels."""
    p = with_sobel(p).withColumn("bg", F.expr(S.blur("px", sigma)))
    good = S.bound("transform(filter(zip_with(q.px, q.e, (g, e) -> named_struct('g', g, 'e', e)), s -> s.g > 8), s -> s.e)", px="px", e="edge")
    p = p.withColumn("thr", F.expr(f"coalesce({S.quantile(good, 0.5)}, 1D)"))
    value = byte(f"q.px[i] + {strength}D * (q.px[i] - q.b[i]) * {unit('q.e[i] / (q.t * 2 + 1e-6D)')}")
    return p.withColumn("a", F.expr(S.bound(f"transform(sequence(0, size(q.px) - 1), i -> {value})", px="px", b="bg", e="edge", t="thr")))


_UNSHARP = f"WITH {DUCK_EDGE}, {duck_blur('bl', 1.0, 'fx_gray')}, th AS (SELECT q.pid, coalesce(median(ed.g) FILTER (q.g > 8), 1) AS thr FROM fx_gray q JOIN ed USING (pid, y, x) GROUP BY q.pid) SELECT q.pid, q.y, q.x, {byte('q.g + 0.5 * (q.g - bl.g) * ' + unit('ed.g / (thr * 2 + 1e-6)'))} AS v FROM fx_gray q JOIN ed USING (pid, y, x) JOIN bl USING (pid, y, x) JOIN th ON th.pid = q.pid"


@query("f07_unsharp_mask", settled(duck("gray", _UNSHARP)))
def f07(spark, sf):
    return long(unsharp(patches(spark, sf)), "a")


CHAIN = {"illumination_normalize": illumination_normalize, "multi_scale_retinex": retinex, "sediment_fade": sediment_fade, "unsharp_mask": unsharp}


def run_chain(p: DataFrame, steps: list[str]) -> DataFrame:
    """Folds the named filters over px; a name that is not registered is passed over and listed in ``skipped``."""
    skipped = [s for s in steps if s not in CHAIN]
    for s in steps:
        if s in CHAIN:
            p = CHAIN[s](p).select("pid", F.col("a").alias("px"))
    return p.withColumn("skipped", F.array(*map(F.lit, skipped)) if skipped else F.expr("CAST(array() AS ARRAY<STRING>)"))


_CHAINED = (
    f"WITH s1 AS MATERIALIZED (SELECT pid, y, x, v AS g FROM ({_RETINEX}) t), s2 AS MATERIALIZED (SELECT pid, y, x, v AS g FROM ({_FADE.replace('fx_gray', 's1')}) t), "
    f"s3 AS MATERIALIZED (SELECT pid, y, x, v FROM ({_UNSHARP.replace('fx_gray', 's2')}) t) SELECT pid, y, x, v, 'no_such_step' AS skipped FROM s3"
)


@query("f08_filter_chain", duck("gray", _CHAINED))
def f08(spark, sf):
    """The pixels after a chain of three filters, and the names of the steps that were passed over."""
    c = run_chain(patches(spark, sf), ["multi_scale_retinex", "sediment_fade", "no_such_step", "unsharp_mask"])
    return long(c.withColumn("skipped", F.concat_ws(",", "skipped")), "px", keep=("skipped",))


@query("f15_engineered_channels", settled(duck("gray", f"WITH {DUCK_EDGE}, {duck_blur('bl', 2.0, 'fx_gray')} SELECT q.pid, q.y, q.x, q.g AS c0, {byte('ed.g')} AS c1, {byte('(bl.g - q.g) / (bl.g + 1e-6) * 255')} AS c2 FROM fx_gray q JOIN ed USING (pid, y, x) JOIN bl USING (pid, y, x)")))
def f15(spark, sf):
    return engineered(patches(spark, sf), "engineered")


def engineered(p: DataFrame, mode: str, sigma: float = 2.0) -> DataFrame:
    """Model channels of each pixel: lightness, clipped gradient, contrast to the background (mode ``engineered``); the gray value thrice (``rgb``)."""
    if mode not in ("rgb", "engineered"):
        raise ValueError(f"unknown input mode {mode!r}")
    if mode == "rgb":
        return long(p, "px", "c0").select("*", F.col("c0").alias("c1"), F.col("c0").alias("c2"))
    p = with_sobel(p).withColumn("bg", F.expr(S.blur("px", sigma)))
    z = p.select("pid", F.posexplode(F.expr("zip_with(zip_with(px, edge, (g, e) -> named_struct('g', g, 'e', e)), bg, (s, b) -> named_struct('g', s.g, 'e', s.e, 'b', b))")).alias("i", "s"))
    return z.selectExpr("pid", "CAST(i DIV 8 AS INT) AS y", "CAST(i % 8 AS INT) AS x", "s.g AS c0", f"{byte('s.e')} AS c1", f"{byte('(s.b - s.g) / (s.b + 1e-6D) * 255')} AS c2")


@query("f16_prepare_image", duck("gray", "SELECT pid, y, x, g AS c0, g AS c1, g AS c2 FROM fx_gray"))
def f16(spark, sf):
    return engineered(patches(spark, sf), "rgb")


# ---- bilateral filter and the search for its parameters

def bilateral(px: str, radius: int, sc: str, ss: str) -> str:
    """Edge-preserving mean over a disc as rounded bytes; ``sc`` and ``ss`` are expressions of the row."""
    offs = S.disc(radius)
    w = [f"exp(-pow({S.at('q.px', dy, dx)} - q.px[i], 2) / (2 * q.sc * q.sc) - {dy * dy + dx * dx} / (2 * q.ss * q.ss))" for dy, dx in offs]
    terms = "array(" + ", ".join(f"named_struct('w', {e}, 'g', {S.at('q.px', dy, dx)})" for e, (dy, dx) in zip(w, offs)) + ")"
    ratio = f"aggregate({terms}, named_struct('n', 0D, 'd', 0D), (s, e) -> named_struct('n', s.n + e.w * e.g, 'd', s.d + e.w), s -> CAST(floor(round(s.n / s.d, 6) + 0.5D) AS INT))"
    return S.bound(f"transform(sequence(0, size(q.px) - 1), i -> {ratio})", px=px, sc=f"CAST({sc} AS DOUBLE)", ss=f"CAST({ss} AS DOUBLE)")


def duck_bilateral(name: str, radius: int, sc: str, ss: str, more: str = "", keys: str = "") -> str:
    """CTE with (pid, y, x, g); ``more`` joins a table of parameters and ``keys`` names its columns."""
    rows = ", ".join(f"({dy}, {dx})" for dy, dx in S.disc(radius))
    e = f"exp(-pow(n.g - q.g, 2) / (2 * {sc} * {sc}) - (o.dy * o.dy + o.dx * o.dx) / (2 * {ss} * {ss}))"
    return f"{name} AS (SELECT q.pid, q.y, q.x{keys}, CAST(floor(round(sum({e} * n.g) / sum({e}), 6) + 0.5) AS INTEGER) AS g FROM fx_gray q{more} CROSS JOIN (VALUES {rows}) o(dy, dx) JOIN fx_gray n ON n.pid = q.pid AND n.y = 7 - abs(7 - abs(q.y + o.dy)) AND n.x = 7 - abs(7 - abs(q.x + o.dx)) GROUP BY q.pid, q.y, q.x{keys})"


@query("f04_bilateral_denoise", duck("gray", f"WITH {duck_bilateral('bi', 2, 'CAST(40 AS DOUBLE)', 'CAST(30 AS DOUBLE)')} SELECT pid, y, x, g AS v FROM bi"))
def f04(spark, sf):
    return long(patches(spark, sf).withColumn("a", F.expr(bilateral("px", 2, "40", "30"))), "a")


def rough(px: str) -> str:
    """Median of the 5x5 local variance in wrapping bytes (no clamp is needed: bytes are never negative)."""
    whole = "transform({}, s -> CAST(floor(s / 25.0D + 0.5D) AS BIGINT))"
    sq = S.let(px, "transform(q, g -> (g * g) % 256)")
    return S.quantile(S.bound("zip_with(q.m, q.s, (m, s) -> pmod(s - (m * m) % 256, 256))", m=whole.format(S.weighted(px, S.box(2))), s=whole.format(S.weighted(sq, S.box(2)))), 0.5)


GRID = [(c, s) for c in (30, 45, 60) for s in (30, 60)]


def sigma_search(p: DataFrame, radius: int = 2, grid=GRID) -> DataFrame:
    """The pair of the grid that leaves the least median local variance; of equal ones the last."""
    tries = ", ".join(f"named_struct('k', {k}, 'sc', {c}, 'ss', {s})" for k, (c, s) in enumerate(grid))
    t = p.select("pid", "px", F.explode(F.expr(f"array({tries})")).alias("t")).select("pid", "px", "t.*")
    t = t.withColumn("f", F.expr(bilateral("px", radius, "sc", "ss"))).withColumn("left", F.expr(rough("f")))
    return t.groupBy("pid").agg(F.min_by(F.struct("sc", "ss", "left"), F.struct("left", -F.col("k"))).alias("b")).select("pid", "b.*")


_ROUGH = "lv AS (SELECT pid, k, y, x, (CAST(floor(sum((g * g) % 256) / 25.0 + 0.5) AS BIGINT) - (CAST(floor(sum(g) / 25.0 + 0.5) AS BIGINT) * CAST(floor(sum(g) / 25.0 + 0.5) AS BIGINT)) % 256 + 256) % 256 AS v FROM (SELECT q.pid, q.k, q.y, q.x, n.g FROM bi q CROSS JOIN (VALUES " + ", ".join(f"({dy}, {dx})" for dy, dx, _ in S.box(2)) + ") o(dy, dx) JOIN bi n ON n.pid = q.pid AND n.k = q.k AND n.y = 7 - abs(7 - abs(q.y + o.dy)) AND n.x = 7 - abs(7 - abs(q.x + o.dx))) t GROUP BY pid, k, y, x)"
_GRID = "gr(k, sc, ss) AS (VALUES " + ", ".join(f"({k}, {c}, {s})" for k, (c, s) in enumerate(GRID)) + ")"


@query("a10_sigma_grid_search", duck("gray", f"WITH {_GRID}, {duck_bilateral('bi', 2, 'gr.sc', 'gr.ss', ' CROSS JOIN gr', ', gr.k')}, {_ROUGH}, md AS (SELECT pid, k, median(v) AS left FROM lv GROUP BY pid, k), rk AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY md.left, k DESC) AS n FROM md) SELECT rk.pid, gr.sc, gr.ss, rk.left FROM rk JOIN gr ON gr.k = rk.k WHERE n = 1".replace("AS left", 'AS "left"').replace("md.left", 'md."left"').replace("rk.left", 'rk."left"')))
def a10(spark, sf):
    return sigma_search(patches(spark, sf))


_LV = f"lv AS (SELECT pid, y, x, (CAST(floor(sum((g * g) % 256) / 25.0 + 0.5) AS BIGINT) - (CAST(floor(sum(g) / 25.0 + 0.5) AS BIGINT) * CAST(floor(sum(g) / 25.0 + 0.5) AS BIGINT)) % 256 + 256) % 256 AS v FROM ({_nb(S.box(2))}) t GROUP BY pid, y, x)"


@query("a09_bilateral_diameter", duck("gray", f"WITH {_LV}, p AS (SELECT pid, CASE WHEN quantile_cont(v, 0.9) = 0 THEN 1 ELSE quantile_cont(v, 0.9) END AS top FROM lv GROUP BY pid), d AS (SELECT lv.pid, CAST(floor(round(median(15 - 10 * least(1, v / top)), 6)) AS INTEGER) AS d FROM lv JOIN p ON p.pid = lv.pid GROUP BY lv.pid) SELECT pid, d + (1 - d % 2) AS d FROM d"))
def a09(spark, sf):
    """15 for smooth to 5 for rough surroundings, the median made odd."""
    whole = "transform({}, s -> CAST(floor(s / 25.0D + 0.5D) AS BIGINT))"
    sq = S.let("px", "transform(q, g -> (g * g) % 256)")
    lv = S.bound("zip_with(q.m, q.s, (m, s) -> pmod(s - (m * m) % 256, 256))", m=whole.format(S.weighted("px", S.box(2))), s=whole.format(S.weighted(sq, S.box(2))))
    p = patches(spark, sf).withColumn("lv", F.expr(lv)).withColumn("top", F.expr(f"coalesce(nullif({S.quantile('lv', 0.9)}, 0D), 1D)"))
    d = F.expr(S.quantile(S.bound("transform(q.lv, v -> 15 - 10 * least(1D, v / q.top))", lv="lv", top="top"), 0.5))
    return p.select("pid", F.floor(F.round(d, 6)).cast("int").alias("d")).select("pid", (F.col("d") + 1 - F.col("d") % 2).alias("d"))


@query("a05_illumination_uniformity", duck("gray", f"WITH {duck_filled(10)}, {duck_blur('bl', 2.0, 'fi')} SELECT q.pid, round(CASE WHEN any_value(nv) < {FEW} THEN 0 ELSE coalesce(stddev_pop(bl.g) FILTER (q.g > 10), 0) END, 6) AS uniformity FROM fx_gray q JOIN bl USING (pid, y, x) JOIN st ON st.pid = q.pid GROUP BY q.pid"))
def a05(spark, sf):
    p = patches(spark, sf).withColumn("bg", F.expr(S.blur(filled(10), 2.0)))
    good = S.bound("transform(filter(zip_with(q.px, q.b, (g, b) -> named_struct('g', g, 'b', b)), s -> s.g > 10), s -> s.b)", px="px", b="bg")
    p = p.withColumn("ok", F.expr(good))
    return p.select("pid", F.round(F.expr(f"CASE WHEN size(ok) < {FEW} THEN 0D ELSE {S.spread('ok')} END"), 6).alias("uniformity"))
