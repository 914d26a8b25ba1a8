"""Training inputs, normalisation statistics, schedules, augmentation and the tuned parameter record."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import stencil as S
from tessera.functions.graph import shared_dir
from tessera.operators.enhance import FEW, duck_blur, duck_filled, filled
from tessera.operators.metrics import _AREAS, _CC, mosaic_components, stats
from tessera.operators.pixels import _DIAG, _TILED, channel_stats, diagnostics, tiled
from tessera.registry import oracle_sql, query
from tessera.sources.fixtures import duck, patches, settled, table, view


def plateau(history: DataFrame, start: float = 1e-4, factor: float = 0.5, patience: int = 7, least: float = 1e-7, better: float = 1e-4) -> DataFrame:
    """(run_id, lr, cuts) after each run: the rate is cut when the score has not risen for more than ``patience`` epochs.

    A rise must exceed the best so far by the relative margin ``better``. The fold holds one run's epochs at a time.
    """
    steps = history.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("epoch", "val_dice"))).alias("h"))
    state = f"named_struct('best', CAST(NULL AS DOUBLE), 'bad', 0, 'lr', {start!r}D, 'cuts', 0)"
    up = f"s.best IS NULL OR e.val_dice > s.best * (1 + {better!r}D)"
    cut = f"NOT ({up}) AND s.bad + 1 > {patience}"
    fold = f"named_struct('best', CASE WHEN {up} THEN e.val_dice ELSE s.best END, 'bad', CASE WHEN {up} OR {cut} THEN 0 ELSE s.bad + 1 END, 'lr', CASE WHEN {cut} THEN greatest(s.lr * {factor}D, {least!r}D) ELSE s.lr END, 'cuts', CASE WHEN {cut} THEN s.cuts + 1 ELSE s.cuts END)"
    return steps.select("run_id", F.expr(f"aggregate(h, {state}, (s, e) -> {fold})").alias("s")).select("run_id", "s.lr", "s.cuts")


_UP = "(r.best IS NULL OR h.val_dice > r.best * (1 + 1e-4))"
_CUT = f"(NOT {_UP} AND r.bad + 1 > 7)"
_PLATEAU = (
    "WITH RECURSIVE hm AS MATERIALIZED (SELECT * FROM fx_history), r(run_id, epoch, best, bad, lr, cuts) AS (SELECT run_id, epoch, val_dice, 0, CAST(1e-4 AS DOUBLE), 0 FROM hm WHERE epoch = 0 "
    f"UNION ALL SELECT h.run_id, h.epoch, CASE WHEN {_UP} THEN h.val_dice ELSE r.best END, CASE WHEN {_UP} OR {_CUT} THEN 0 ELSE r.bad + 1 END, CASE WHEN {_CUT} THEN greatest(r.lr * 0.5, CAST(1e-7 AS DOUBLE)) ELSE r.lr END, CASE WHEN {_CUT} THEN r.cuts + 1 ELSE r.cuts END FROM r JOIN hm h ON h.run_id = r.run_id AND h.epoch = r.epoch + 1) "
    "SELECT run_id, round(lr, 12) AS lr, cuts FROM r QUALIFY epoch = max(epoch) OVER (PARTITION BY run_id)"
)


@query("k04_lr_plateau", duck("history", _PLATEAU))
def k04(spark, sf):
    return plateau(view(spark, sf, "history")).withColumn("lr", F.round("lr", 12))


@query("s16_training_item", settled(duck("pred gray corrected", "SELECT p.pid, p.y, p.x, q.g, CASE WHEN c.doc_id IS NOT NULL THEN q.g > 100 ELSE p.truth END AS mask, CASE WHEN c.doc_id IS NOT NULL THEN 'corrected' ELSE 'proxy' END AS source FROM fx_pred p JOIN fx_gray q USING (pid, y, x) LEFT JOIN fx_corrected c ON c.doc_id = p.pid")))
def s16(spark, sf):
    """Image and mask of each patch; a corrected mask (here: over 100) goes before the proxy mask."""
    c = view(spark, sf, "corrected").select(F.col("doc_id").alias("pid"), F.lit(True).alias("has"))
    p = view(spark, sf, "pred").select("pid", "y", "x", "truth").join(view(spark, sf, "gray").select("pid", "y", "x", "g"), ["pid", "y", "x"]).join(c, "pid", "left")
    return p.select("pid", "y", "x", "g", F.when(F.col("has"), F.col("g") > 100).otherwise(F.col("truth")).alias("mask"), F.when(F.col("has"), "corrected").otherwise("proxy").alias("source"))


# The statistics that stand in where there is nothing to compute from.
PLAIN_MEAN, PLAIN_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def fingerprint(rows: DataFrame) -> str:
    """Of a set of rows, whatever their order and partitions: their number and the sum of their hashes; one scan."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{n}-{total or 0}"


def norm_stats(rows: DataFrame, compute, at: str, channels=("r", "g", "b")) -> DataFrame:
    """(channel, mean, std, source): what is stored under ``at`` for exactly these rows, else computed by ``compute(rows)`` and stored.

    Any change of a row is another fingerprint, so what is stored is never out of date; entries of other states stay beside it. Without
    rows, the plain statistics.
    """
    spark, key = rows.sparkSession, fingerprint(rows)
    if key.startswith("0-"):
        return spark.createDataFrame([(c, m, d, "plain") for c, m, d in zip(channels, PLAIN_MEAN, PLAIN_STD)], "channel string, mean double, std double, source string")
    path = f"{at}/stats-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    held = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if not held:
        compute(rows).select("channel", "mean", "std").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("source", F.lit("cache" if held else "computed"))


@query("a15_norm_stats_cache", "SELECT *, 'cache' AS source FROM (" + oracle_sql()["a14_channel_stats"] + ")")
def a15(spark, sf):
    """The second call for the same pixels reads what the first has stored."""
    at = f"{shared_dir(spark)}/norm-{uuid.uuid4().hex}"
    for _ in range(2):
        got = norm_stats(view(spark, sf, "color"), channel_stats, at, ("r", "gr", "b"))
    return got


@query("a16_sampled_stats", duck("mosaic", f"WITH {_TILED}, sums AS (SELECT mosaic_id, ty, tx, count(*) AS n, sum(g) AS sg, sum(g * g) AS qg FROM t GROUP BY ALL HAVING avg(CAST(g < 5 AS INT)) <= 0.3), k AS (SELECT *, row_number() OVER (PARTITION BY mosaic_id ORDER BY md5(concat('0:', CAST(mosaic_id AS VARCHAR), ':', CAST(ty AS VARCHAR), ':', CAST(tx AS VARCHAR)))) AS rank FROM sums) SELECT mosaic_id, round(sum(sg) / sum(n) / 255, 6) AS mean, round(greatest(1e-4, sqrt(sum(qg) / sum(n) - pow(sum(sg) / sum(n), 2)) / 255), 6) AS std FROM k WHERE rank <= 8 GROUP BY mosaic_id"))
def a16(spark, sf, samples: int = 8, most_black: float = 0.3):
    """Mean and deviation over sampled tiles that are mostly not black, from integer sums; tiles are drawn by hash."""
    t = tiled(view(spark, sf, "mosaic")).groupBy("mosaic_id", "ty", "tx").agg(F.count("*").alias("n"), F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("g")).alias("qg"), F.avg((F.col("g") < 5).cast("double")).alias("black")).filter(F.col("black") <= most_black)
    draw = F.md5(F.concat(F.lit("0:"), F.concat_ws(":", "mosaic_id", "ty", "tx")))
    k = t.withColumn("rank", F.row_number().over(W.partitionBy("mosaic_id").orderBy(draw))).filter(F.col("rank") <= samples)
    s = k.groupBy("mosaic_id").agg(F.sum("n").alias("n"), F.sum("sg").alias("sg"), F.sum("qg").alias("qg"))
    mean = F.col("sg") / F.col("n")
    return s.select("mosaic_id", F.round(mean / 255, 6).alias("mean"), F.round(F.greatest(F.lit(1e-4), F.sqrt(F.col("qg") / F.col("n") - mean * mean) / 255), 6).alias("std"))


# ---- the tuned parameter record

_ODD = "CASE WHEN {k} % 2 = 0 THEN {k} + 1 ELSE {k} END"
_TUNED = (
    f"WITH {_DIAG}, {duck_filled(10, 'sv')}, {duck_blur('bl', 2.0, 'fi')}, un AS (SELECT q.pid, CASE WHEN any_value(nv) < {FEW} THEN 0 ELSE coalesce(stddev_pop(bl.g) FILTER (q.g > 10), 0) END AS uniformity FROM fx_gray q JOIN bl USING (pid, y, x) JOIN sv ON sv.pid = q.pid GROUP BY q.pid), "
    "k AS (SELECT un.pid, least(1, greatest(0, coalesce(noise, 0) / 20)) AS n, round(least(1, greatest(0, (coalesce(skew, 0) + 1) / 2)), 5) AS s, round(least(1, greatest(0, (uniformity - 2) / 15)), 6) AS u FROM un LEFT JOIN di ON di.pid = un.pid), "
    "o AS (SELECT pid, CAST(floor(11 + 40 * s) AS BIGINT) AS block, CAST(floor(1 + 2 * u) AS BIGINT) AS op, CAST(floor(5 + 6 * u) AS BIGINT) AS cl, round(2 + 13 * s, 6) AS c_offset, CAST(floor(2 + 6 * n + 0.5) AS BIGINT) AS min_area FROM k) "
    f"SELECT pid, {_ODD.format(k='block')} AS block_size, c_offset, {_ODD.format(k='op')} AS open_k, {_ODD.format(k='cl')} AS close_k, min_area FROM o"
)


def tuned(p: DataFrame) -> DataFrame:
    """Kernel sizes, threshold offset and least area of each patch, from its noise, skewness and evenness of light."""
    good = S.bound("transform(filter(zip_with(q.px, q.b, (g, b) -> named_struct('g', g, 'b', b)), s -> s.g > 10), s -> s.b)", px="px", b=S.blur(filled(10), 2.0))
    u = p.withColumn("ok", F.expr(good)).select("pid", F.expr(f"CASE WHEN size(ok) < {FEW} THEN 0D ELSE {S.spread('ok')} END").alias("uniformity"))
    clip = lambda e: F.least(F.lit(1.0), F.greatest(F.lit(0.0), e))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    k = u.join(diagnostics(p), "pid", "left").select("pid", clip(zero("noise") / 20).alias("n"), F.round(clip((zero("skew") + 1) / 2), 5).alias("s"), F.round(clip((F.col("uniformity") - 2) / 15), 6).alias("u"))
    odd = lambda e, n: (F.floor(e) + 1 - F.floor(e) % 2).alias(n)
    return k.select("pid", odd(11 + 40 * F.col("s"), "block_size"), F.round(2 + 13 * F.col("s"), 6).alias("c_offset"), odd(1 + 2 * F.col("u"), "open_k"), odd(5 + 6 * F.col("u"), "close_k"), F.floor(2 + 6 * F.col("n") + 0.5).alias("min_area"))


@query("a12_tuned_params", duck("gray", _TUNED))
def a12(spark, sf):
    return tuned(patches(spark, sf))


_DOC = ", ".join(f"'{',' if k else '{'}\"{c}\":', CAST({c} AS VARCHAR)" for k, c in enumerate(("block_size", "c_offset", "open_k", "close_k", "min_area")))


@query("a13_params_document", duck("gray", _TUNED.replace(" SELECT pid, CASE WHEN block", ", tu AS (SELECT pid, CASE WHEN block") + f") SELECT pid, concat({_DOC}, '}}') AS doc FROM tu"))
def a13(spark, sf):
    """The parameters as a JSON document."""
    t = tuned(patches(spark, sf))
    return t.select("pid", F.to_json(F.struct(*[c for c in t.columns if c != "pid"])).alias("doc"))


# ---- augmentation

@query("k06_brightness", duck("gray", "SELECT pid, y, x, CAST(floor(round(least(255, g * (0.8 + 0.4 * (CAST(concat('0x', substr(md5(concat('7:', CAST(pid AS VARCHAR))), 1, 6)) AS BIGINT) / 16777216.0))), 6)) AS INTEGER) AS v FROM fx_gray"))
def k06b(spark, sf, seed: int = 7):
    """Brightness factor of 0.8 to 1.2, drawn per patch by hash."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("pid").cast("string"))), 1, 6), 16, 10).cast("double") / 16777216
    g = view(spark, sf, "gray")
    return g.select("pid", "y", "x", F.floor(F.round(F.least(F.lit(255.0), F.col("g") * (0.8 + 0.4 * h)), 6)).cast("int").alias("v"))


_PASTE = "area BETWEEN 4 AND 128 AND x1 - x0 + 1 < 80 AND y1 - y0 + 1 < 80"


@query("r19_paste_candidates", duck("mosaic", f"WITH RECURSIVE {_CC}, a AS ({_AREAS}) SELECT mosaic_id, area, y0, x0 FROM a WHERE {_PASTE} QUALIFY row_number() OVER (PARTITION BY mosaic_id ORDER BY area DESC, y0, x0, y1, x1) <= 3").replace("WITH fx_gray", "WITH RECURSIVE fx_gray"))
def r19(spark, sf, most: int = 3):
    """Objects small enough to paste: the largest few of each mosaic."""
    c = stats(mosaic_components(spark, sf)).filter(_PASTE)
    c = c.withColumn("k", F.row_number().over(W.partitionBy("mosaic_id").orderBy(F.desc("area"), "y0", "x0", "y1", "x1"))).filter(F.col("k") <= most)
    return c.select("mosaic_id", "area", F.col("y0").cast("bigint").alias("y0"), F.col("x0").cast("bigint").alias("x0"))


_CONFIG = "concat('{{\"architecture\": \"Unet\", \"in_channels\": 3, ', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '\"input_mode\": \"engineered\", ' END, '\"patch_size\": ', CAST(64 * (1 + c_custkey % 4) AS {0}), ', \"overlap\": ', CAST(16 * (c_custkey % 9) AS {0}), CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(', \"threshold\": 0.', CAST(3 + c_custkey % 5 AS {0})) END, '}}')"


@query("s12_model_config", f"WITH d AS (SELECT c_custkey AS model, CAST({_CONFIG.format('VARCHAR')} AS JSON) AS c FROM customer) SELECT model, c ->> 'input_mode' AS input_mode, CAST(c ->> 'patch_size' AS INTEGER) AS patch_size, CAST(c ->> 'overlap' AS INTEGER) AS overlap, CAST(c ->> 'threshold' AS DOUBLE) AS threshold FROM d")
def s12(spark, sf):
    """Fields of models' JSON sidecars, a document for each customer; absent ones are null."""
    doc = table(spark, sf, "customer").select(F.col("c_custkey").alias("model"), F.from_json(F.expr(_CONFIG.format("STRING")), "input_mode string, patch_size int, overlap int, threshold double").alias("c"))
    return doc.select("model", "c.*")
