"""The flows over folders: preprocess, split, evaluate, annotate, audit, predict.

Each is a composition of the engine's operators. Tables are written under ``out`` as Parquet or JSON lines by Spark's
own writers, so ``out`` may be in any store all executors share. A flow whose result is there is skipped unless ``force``.
"""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import engine as E
from tessera.operators import training as T
from tessera.operators.geo import METRES_PER_DEGREE, pixel_sizes
from tessera.operators.records import coverage_bin, import_actions, split_records, with_mask_source
from tessera.settings import Settings
from tessera.sources import rasters as R
from tessera.sources import windows as V

def patch_id():
    """image_yyyyyy_xxxxxx"""
    return F.concat("image_id", F.format_string("_%06d_%06d", "y", "x"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole."""
    return _exists(spark, f"{path}/_SUCCESS")


def kept(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _name(path: str):
    """File name without folders and extension."""
    return F.regexp_replace(path, r"^.*/|\.[^.]*$", "")


def name_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _blocks(spark: SparkSession, *paths: str) -> DataFrame:
    return V.read_blocks(spark, *paths).withColumn("image_id", _name("image_id"))


JOURNAL = "image_id string, stamp string, path string, patches long, kept long, coverage_pct double, settings string, at timestamp"


def journal(spark: SparkSession, out: str) -> DataFrame:
    """The last entry of each image: what is listed here is complete."""
    path = f"{out}/journal"
    if not _exists(spark, path):
        return spark.createDataFrame([], JOURNAL)
    j = spark.read.schema(JOURNAL).parquet(path)
    return j.groupBy("image_id").agg(F.max_by(F.struct(*[c for c in j.columns if c != "image_id"]), "at").alias("j")).select("image_id", "j.*")


def manifest(spark: SparkSession, out: str) -> dict:
    """The run's manifest document, or the default one if there is none: an entry for each complete image."""
    rows = journal(spark, out).sort("image_id").collect()  # a document for people: a line an image
    return {"images": {r.image_id: {"patches": r.patches, "kept": r.kept, "coverage_pct": r.coverage_pct} for r in rows}, "settings": rows[-1].settings if rows else None}


def complete(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of a table under ``out`` that belong to the last complete state of their image."""
    rows = spark.read.parquet(f"{out}/{table}")
    return rows.join(journal(spark, out).select("image_id", "stamp"), ["image_id", "stamp"], "left_semi").drop("stamp", "image")


def _put(df: DataFrame, stamps: DataFrame, path: str) -> DataFrame:
    """Replaces the partitions of the images in ``df``, and no others; rows carry their image's stamp."""
    stamped = df.join(F.broadcast(stamps), "image_id").withColumn("image", F.col("image_id"))  # at most MOSAICS rows
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image").parquet(path)
    images = [r.image_id for r in stamps.collect()]
    return df.sparkSession.read.schema(stamped.schema).parquet(path).filter(F.col("image").isin(images)).join(F.broadcast(stamps), ["image_id", "stamp"], "left_semi").select(df.columns)


MOSAICS = 64  #: images that are worked on, and become complete, together


def preprocess(spark: SparkSession, folder: str, out: str, s: Settings = Settings(), force: bool = False, mosaics: int = MOSAICS) -> DataFrame:
    """Rasters of ``folder`` to ``out/patches`` (valid patches, enhanced, with proxy masks), ``out/gates``, ``out/masks``,
    ``out/enhanced`` (whole images, raw pixels where no patch lies) and ``out/mosaics`` (one file each of mask, overlay and enhanced
    image); returns the patches of all complete images.

    Tables are partitioned by image. The journal gets an image's line when all else is written: a rerun works on images that have
    none, whose file or whose settings have changed (all with ``force``), so a run may stop anywhere. What a stopped
    run left is replaced, and not read before.
    """
    found = {name_of(p): (p, f"{size}:{time}:{zlib.crc32(repr(s).encode())}") for p, size, time in V.rasters_of(folder)}
    known = {} if force else {r.image_id: r.stamp for r in journal(spark, out).select("image_id", "stamp").toLocalIterator()}
    todo = sorted((name, path, stamp) for name, (path, stamp) in found.items() if known.get(name) != stamp)
    for k in range(0, len(todo), mosaics):
        _preprocess(spark, todo[k : k + mosaics], out, s)
    if not _exists(spark, f"{out}/patches"):
        raise FileNotFoundError(f"no patches under {out} and no rasters in {folder}")
    return complete(spark, out, "patches")


def _preprocess(spark: SparkSession, images: list[tuple[str, str, str]], out: str, s: Settings) -> None:
    stamps = spark.createDataFrame([(name, stamp) for name, _, stamp in images], "image_id string, stamp string")
    put = lambda df, table: _put(df, stamps, f"{out}/{table}")
    raw = put(_blocks(spark, *[path for _, path, _ in images]), "raw")
    gated = put(E.gate(E.cut(raw, s.tiling), s.tiling), "gated")
    put(gated.groupBy("image_id", "reason").agg(F.count("*").alias("n")), "gates")
    tuned = E.tune(gated.filter("reason = 'valid'"), s.tuning)
    done = put(E.proxy_labels(E.enhance(tuned, s.filters), s.labels).withColumn("patch_id", patch_id()), "patches")
    side = 4 * s.tiling.size
    whole = E.put_together(done, "px", side)
    # raw pixels of the same blocks fill what no patch covers
    base = E.put_together(raw, "px", side).select("image_id", "image_h", "image_w", "y", "x", "h", "w", "bands", F.col("px").alias("raw"))
    masks = E.put_together(done.select("image_id", "image_h", "image_w", "y", "x", "h", "w", "bands", "mask"), "mask", side)
    masks = put(E.each(masks.drop("cover"), lambda r: {"px": _bright(r["px"])}, px="binary"), "masks")
    at = ["image_id", "y", "x"]
    seen = base.join(whole.select(*at, "px", "cover"), at, "left").join(masks.select(*at, F.col("px").alias("mask")), at, "left")
    blend = lambda r: {"px": _under(r["px"], r["raw"], r["cover"])}
    full = put(E.each(seen.drop("mask").withColumn("px", F.coalesce("px", "raw")), blend, px="binary").drop("raw", "cover"), "enhanced")
    mark = lambda r: {"px": E.overlay(E.image(r), E.image(r, "mask", "u1")).tobytes() if r["mask"] else r["px"]}
    marked = E.each(seen.drop("px", "cover").withColumnRenamed("raw", "px"), mark, px="binary").drop("mask")
    for suffix, df in (("_mask", _masked(seen.drop("px", "raw", "cover"))), ("_overlay", _rgb(marked)), ("_enhanced", _rgb(full))):
        V.write_mosaics(df, f"{out}/mosaics", suffix, aligned=True)
    sums = done.groupBy("image_id").agg(F.count("*").alias("patches"), F.sum("kept").alias("kept"), F.avg("coverage_pct").alias("coverage_pct"))
    paths = spark.createDataFrame([(name, stamp, path) for name, path, stamp in images], "image_id string, stamp string, path string")
    # files that can't be read, or not as a whole, get no line and are tried again
    read = raw.groupBy("image_id", "image_h", "image_w").agg(F.sum(F.col("h").cast("long") * F.col("w")).alias("n")).filter("n = CAST(image_h AS BIGINT) * image_w")
    lines = paths.join(read, "image_id", "left_semi").join(sums, "image_id", "left").fillna(0, ["patches", "kept"])
    lines = lines.withColumn("settings", F.lit(repr(s))).withColumn("at", F.current_timestamp())
    lines.select("image_id", "stamp", "path", "patches", "kept", "coverage_pct", "settings", "at").coalesce(1).write.mode("append").parquet(f"{out}/journal")


def _bright(px: bytes) -> bytes:
    import numpy as np

    return ((np.frombuffer(px, "u1") > 127) * np.uint8(255)).tobytes()


def _masked(blocks: DataFrame) -> DataFrame:
    """Blocks with their mask as pixels, zeros where there is none."""
    some = blocks.withColumn("px", F.coalesce("mask", F.lit(b""))).drop("mask")
    return E.each(some, lambda r: {"px": r["px"] or bytes(r["h"] * r["w"]), "bands": 1}, px="binary", bands="int")


def _rgb(blocks: DataFrame) -> DataFrame:
    """Blocks with their channels reversed, as files have them."""
    import numpy as np

    return E.each(blocks, lambda r: {"px": np.ascontiguousarray(E.image(r)[..., ::-1]).tobytes()}, px="binary")


def _under(px: bytes, raw: bytes, cover: bytes) -> bytes:
    import numpy as np

    if cover is None:
        return raw
    a, b, c = (np.frombuffer(x, "u1") for x in (px, raw, cover))
    n = len(a) // len(c)
    return np.where(np.repeat(c, n) > 0, a, b).tobytes()


def split(spark: SparkSession, out: str, s: Settings = Settings()) -> DataFrame:
    """(patch_id, stratum, split) of the patches by coverage, and channel statistics of the training ones, under ``out``."""
    patches = complete(spark, out, "patches")
    got = kept(split_records(patches.select("patch_id", "coverage_pct"), s.seed, "patch_id").select("patch_id", "stratum", "split"), f"{out}/split")
    train = patches.join(got.filter("split = 'train'").select("patch_id"), "patch_id", "left_semi")
    kept(channel_stats(train), f"{out}/channels")
    return got


def train(spark: SparkSession, out: str, s: Settings = Settings(), t: T.Training = T.Training(), multiplier: float = 5.0, augmented: bool = True, corrected: DataFrame | None = None) -> DataFrame:
    """Trains the pixel model on the split's training patches, drawn by their coverage, and judges it by the validation ones.

    ``corrected`` (patch_id, mask) goes before the proxy masks. Checkpoints are under ``out/training``, the best model is promoted; a stopped
    run goes on after its last epoch. Returns the history; ``out/test`` has the test patches' loss and Dice as JSON.
    """
    patches = complete(spark, out, "patches").select("patch_id", *E.KEY, "h", "w", "bands", "px", "mask", "coverage_pct")
    if corrected is not None:
        better = corrected.select("patch_id", F.col("mask").alias("better"))
        patches = patches.join(better, "patch_id", "left").withColumn("mask", F.coalesce("better", "mask")).drop("better")
    parts = spark.read.parquet(f"{out}/split").select("patch_id", "split")
    of = lambda name: patches.join(parts.filter(F.col("split") == name).select("patch_id"), "patch_id", "left_semi")
    weight = 1 + coverage_bin(F.col("coverage_pct")) / F.lit(4.0) * (multiplier - 1)
    views = (lambda p, epoch: E.augment(p, s.augmentation, epoch, s.seed)) if augmented else None
    history = T.fit(of("train"), of("val"), f"{out}/training", t, weight, views)
    model = T.load_model(spark, f"{out}/training")
    n, loss, _ = T.gradient_sums(of("test"), model, t)
    spark.createDataFrame([(n, loss, T.sweep(of("test"), model)[1])], "patches long, test_loss double, test_dice double").write.mode("overwrite").json(f"{out}/test")
    return history


def channel_stats(patches: DataFrame) -> DataFrame:
    """(channel, mean, std) of all pixels as shares, from integer sums; a table of three rows."""

    def kernel(r: dict) -> dict:
        v = E.image(r).reshape(-1, r["bands"]).astype("i8")
        return {"sums": v.sum(axis=0).tolist(), "squares": (v * v).sum(axis=0).tolist(), "n": len(v)}

    t = E.each(patches.select(*E.KEY, "h", "w", "bands", "px"), kernel, sums="array<bigint>", squares="array<bigint>", n="bigint")
    t = t.select("n", F.posexplode(F.arrays_zip("sums", "squares")).alias("channel", "v")).groupBy("channel").agg(F.sum("n").alias("n"), F.sum("v.sums").alias("s"), F.sum("v.squares").alias("q"))
    mean = F.col("s") / F.col("n")
    return t.select("channel", F.round(mean / 255, 4).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)) / 255, 4).alias("std"))


def evaluate(spark: SparkSession, out: str, s: Settings = Settings(), scorer=E.default_scorer, corrected: DataFrame | None = None) -> DataFrame:
    """Scores all patches against their masks (``corrected``: patch_id, mask; these go first): ``out/metrics`` as JSON lines,
    ``out/summary``, ``out/predictions``; returns the metrics."""
    patches = complete(spark, out, "patches")
    if corrected is not None:
        better = corrected.select("patch_id", F.col("mask").alias("better"))
        patches = patches.join(better, "patch_id", "left").withColumn("is_corrected", F.col("better").isNotNull()).withColumn("mask", F.coalesce("better", "mask")).drop("better")
    else:
        patches = patches.withColumn("is_corrected", F.lit(False))
    patches = patches.drop("tuned", "rejected", "score")
    scored = kept(E.agreement(E.predict(patches, scorer), s.measures), f"{out}/predictions")
    m = scored.select("patch_id", "image_id", "is_corrected", "coverage_pct", "dice", "asd", "nsd")
    m.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/metrics")
    m.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("dice", "asd", "nsd") for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]).write.mode("overwrite").json(f"{out}/summary")
    return load_metrics(spark, out)


def load_metrics(spark: SparkSession, out: str) -> DataFrame:
    """The patch metrics of ``evaluate``; an error names what to run if there are none."""
    if not there(spark, f"{out}/metrics"):
        raise FileNotFoundError(f"no metrics under {out}: run evaluate first")
    return spark.read.schema("patch_id string, image_id string, is_corrected boolean, coverage_pct double, dice double, asd double, nsd double").json(f"{out}/metrics")


def audit(spark: SparkSession, out: str, s: Settings = Settings(), top_k: int | None = None, include_corrected: bool = False) -> DataFrame:
    """The patches of least Dice, worst first, as CSV and JSON under ``out/audit``, with a panel of each; ties by id."""
    m = load_metrics(spark, out).filter("dice IS NOT NULL")
    m = m if include_corrected else m.filter("NOT is_corrected")
    queue = m.orderBy("dice", "patch_id").limit(top_k or s.audit_size)
    queue = kept(queue, f"{out}/audit/queue")  # a report of top_k rows
    for kind in ("csv", "json"):
        queue.coalesce(1).write.mode("overwrite").option("header", "true").format(kind).save(f"{out}/audit/{kind}")
    chosen = spark.read.parquet(f"{out}/predictions").join(F.broadcast(queue.select("patch_id")), "patch_id", "left_semi")
    kept(E.pictures(chosen, "audit"), f"{out}/audit/panels")
    return queue


def audit_labels(spark: SparkSession, out: str, s: Settings = Settings(), scorer=E.default_scorer, top_k: int | None = None, low: float | None = None, high: float | None = None, corrected: DataFrame | None = None) -> DataFrame:
    """Proxy masks that a confident model contradicts, the worst first: (patch_id, fp_frac, fn_frac, dice_disagreement, combined_score, missed_pixels).

    Patches of ``corrected`` (patch_id) are passed over. Without ``low`` and ``high`` they follow from a first pass: the mean probability off
    and on the masks. Scores and predicted masks of all patches are under ``out/label_scores``, the queue under ``out/label_queue``.
    """
    patches = complete(spark, out, "patches").select("patch_id", *E.KEY, "h", "w", "bands", "px", "mask")
    patches = patches.join(corrected.select("patch_id"), "patch_id", "left_anti") if corrected is not None else patches
    prob = kept(E.predict(patches, scorer).withColumn("px", F.lit(b"")), f"{out}/label_probabilities")
    if low is None or high is None:
        sums = E.confident(prob).agg(*[F.sum(c).alias(c) for c in ("p0", "n0", "p1", "n1")]).first()
        off, on = (sums.p0 or 0.0) / max(1, sums.n0 or 0), (sums.p1 or 0.0) / max(1, sums.n1 or 0)
        low, high = min(0.5, max(1e-3, off)), min(1 - 1e-3, max(0.5, on))
    scored = kept(E.confident(prob, low, high).drop("px", "prob", "p0", "n0", "p1", "n1"), f"{out}/label_scores")
    queue = scored.select("patch_id", "fp_frac", "fn_frac", "dice_disagreement", "combined_score", "missed_pixels").orderBy(F.desc("fp_frac"), "patch_id").limit(top_k or s.audit_size)
    return kept(queue, f"{out}/label_queue")  # a report of top_k rows


def edit_selection(patches: DataFrame, corrected: DataFrame, image: str | None = None, worst: int = 0, metrics: DataFrame | None = None, unannotated: bool = False, most: int | None = None) -> DataFrame:
    """The patches to edit: those of an image before the ``worst`` by Dice (of ``metrics``) before all; then those without a corrected mask; then the first ``most`` by id."""
    if image:
        chosen = patches.filter(F.col("image_id").contains(image))
    elif worst:
        if metrics is None:
            raise ValueError("the worst patches need metrics")
        few = metrics.filter("dice IS NOT NULL").orderBy("dice", "patch_id").limit(worst).select("patch_id")
        chosen = patches.join(F.broadcast(few), "patch_id", "left_semi")
    else:
        chosen = patches
    chosen = chosen.join(corrected.select("patch_id"), "patch_id", "left_anti") if unannotated else chosen
    return chosen.orderBy("patch_id").limit(most) if most else chosen


def inspect(bundles: DataFrame) -> DataFrame:
    """(path, patches, corrected, annotators): what archives (path, content) hold, by their patches' metadata; one without patches gives no row."""
    told = R.open_bundles(bundles).select("path", F.get_json_object("metadata", "$.annotator").alias("annotator"), (F.get_json_object("metadata", "$.mask_source") == "corrected").alias("corrected"))
    return told.groupBy("path").agg(F.count("*").alias("patches"), F.count_if("corrected").alias("corrected"), F.array_sort(F.collect_set("annotator")).alias("annotators"))


def repack(bundles: DataFrame, corrected: DataFrame, annotator: str) -> DataFrame:
    """(path, content, patches, corrected): each archive again, with the masks of ``corrected`` (patch_id, mask) for its patches; all others stay as they were.

    The new archive is named for its annotator; its patches say whether their mask is corrected.
    """
    both = R.open_bundles(bundles).join(corrected.select("patch_id", F.col("mask").alias("better")), "patch_id", "left")

    def pack(table: pa.Table) -> pa.Table:
        import numpy as np

        entries, n, rows = [], 0, sorted(table.to_pylist(), key=lambda r: r["patch_id"])
        for r in rows:
            at, mask = f"patches/{r['patch_id']}", r["mask"]
            if r["better"] is not None:
                mask = R.encode_png(np.frombuffer(r["better"], "u1").reshape(R.decode_png(mask).shape[:2]))
            n += r["better"] is not None
            meta = {**(json.loads(r["metadata"]) if r["metadata"] else {}), "annotator": annotator, "mask_source": "corrected" if r["better"] is not None else "untouched"}
            entries += [(f"{at}/image.png", r["image"]), (f"{at}/mask.png", mask), (f"{at}/metadata.json", json.dumps(meta).encode())]
        stem = rows[0]["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return pa.table({"path": [f"{stem}_corrected_by_{annotator}.zip"], "content": pa.array([R.pack_bundle(entries)], pa.binary()), "patches": pa.array([len(rows)], pa.int64()), "corrected": pa.array([n], pa.int64())})

    return both.groupBy("path").applyInArrow(pack, "path string, content binary, patches long, corrected long")


def export(patches: DataFrame, annotator: str, per_bundle: int = 50) -> DataFrame:
    """(path, content): archives of at most about ``per_bundle`` patches with image, mask and metadata; dealt by a hash of the id."""
    n = F.broadcast(patches.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_bundle)).alias("bundles")))
    dealt = patches.select("patch_id", "h", "w", "bands", "px", "mask", "coverage_pct").crossJoin(n).withColumn("bundle", F.pmod(F.xxhash64("patch_id"), "bundles").cast("int")).drop("bundles")

    def pack(table: pa.Table) -> pa.Table:
        entries, rows = [], sorted(table.to_pylist(), key=lambda r: r["patch_id"])
        for r in rows:
            at = f"patches/{r['patch_id']}"
            meta = json.dumps({"patch_id": r["patch_id"], "coverage_pct": r["coverage_pct"], "annotator": annotator})
            entries += [(f"{at}/image.png", R.encode_png(E.image(r)[..., ::-1])), (f"{at}/mask.png", R.encode_png(E.image(r, "mask", "u1"))), (f"{at}/metadata.json", meta.encode())]
        return pa.table({"path": [f"{annotator}_{rows[0]['bundle']:05d}.zip"], "content": pa.array([R.pack_bundle(entries)], pa.binary())})

    return dealt.groupBy("bundle").applyInArrow(pack, "path string, content binary")


def import_bundles(bundles: DataFrame, corrected: DataFrame, strategy: str = "newest") -> DataFrame:
    """(patch_id, mask): the corrected masks after merging archives (path, content, entry_minute) into those held (patch_id, mask, mtime).

    ``newest`` takes the later of two (what comes in, if both are of one time), ``skip`` what is held, ``overwrite`` what comes in; of several in one delivery the latest.
    """
    if strategy not in ("newest", "skip", "overwrite"):
        raise ValueError(f"unknown strategy {strategy!r}")
    minutes = bundles.select("path", "entry_minute")
    opened = R.open_bundles(bundles).join(minutes, "path")
    last = opened.groupBy("patch_id").agg(F.max_by(F.struct("mask", "entry_minute"), F.struct("entry_minute", "path")).alias("new"))

    def decoded(batches):
        for b in batches:
            rows = [{**r, "mask": ((R.decode_png(r["mask"])[..., 0] > 127) * 255).astype("u1").tobytes()} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, b.schema)

    last = last.select("patch_id", "new.mask", "new.entry_minute")
    last = last.mapInArrow(decoded, last.schema)
    entries = last.select(F.col("patch_id").alias("doc_id"), "entry_minute", F.lit(False).alias("has_list"), F.lit(False).alias("in_list"), F.lit("corrected").alias("mask_source"))
    actions = import_actions(entries, corrected.select(F.col("patch_id").alias("doc_id"), "mtime"), strategy).select(F.col("doc_id").alias("patch_id"), "action")
    both = corrected.select("patch_id", F.col("mask").alias("old")).join(last, "patch_id", "full").join(actions, "patch_id", "left")
    return both.select("patch_id", F.when(F.col("action").isin("imported", "conflict"), F.col("mask")).otherwise(F.col("old")).alias("mask"))


def status(patches: DataFrame, corrected: DataFrame) -> DataFrame:
    """One row: patches, corrected, left, share done."""
    c = corrected.select("patch_id").distinct().withColumn("done", F.lit(1))
    return patches.select("patch_id").join(c, "patch_id", "left").agg(F.count("*").alias("total"), F.count("done").alias("corrected"), (F.count("*") - F.count("done")).alias("left"), F.round(100 * F.count("done") / F.greatest(F.count("*"), F.lit(1)), 2).alias("done_pct"))


def predict(spark: SparkSession, folder: str, out: str, s: Settings = Settings(), scorer=E.default_scorer, threshold: float | None = None, model: T.Model | None = None) -> DataFrame:
    """Masks and metrics of the rasters of ``folder``: ``out/masks``, one mask and one overlay file a mosaic under ``out/mosaics``, and per
    image ``out/metrics`` (JSON, with the geo object and its corners), ``out/reports`` (text, a folder an image) and ``out/summary``; returns the metrics.

    A trained ``model`` scores by itself, with its own threshold unless one is given.
    """
    if model is not None:
        scorer, threshold = model.scorer(), model.threshold if threshold is None else threshold
    limit, s = s.measures.threshold if threshold is None else threshold, s.predictor()
    raw = kept(_blocks(spark, folder), f"{out}/raw")
    valid = E.gate(E.cut(raw, s.tiling), s.tiling).filter("reason = 'valid'").select(*E.KEY, "h", "w", "bands", "px")
    side = 4 * s.tiling.size
    prob = E.put_together(E.predict(valid, scorer), "prob", side, "f4", s.measures.sigma_scale)

    def binary(r: dict) -> dict:
        import numpy as np

        return {"px": ((np.frombuffer(r["px"], "f4") > limit) * np.uint8(255)).tobytes()}

    masks = kept(E.each(prob.drop("cover"), binary, px="binary"), f"{out}/masks")
    at = ["image_id", "y", "x"]
    over = E.put_together(raw, "px", side).drop("cover").join(masks.select(*at, F.col("px").alias("mask")), at, "left")
    outline = lambda r: {"px": E.overlay(E.image(r), E.image(r, "mask", "u1"), OUTLINE, contour=True).tobytes() if r["mask"] else r["px"]}
    V.write_mosaics(_masked(over.drop("px")), f"{out}/mosaics", "_mask", aligned=True)
    V.write_mosaics(_rgb(E.each(over, outline, px="binary").drop("mask")), f"{out}/mosaics", "_overlay", aligned=True)
    shapes = raw.groupBy("image_id").agg(F.max("image_h").alias("height"), F.max("image_w").alias("width"))
    files = V.list_rasters(spark, folder).withColumn("image_id", _name("path"))
    sizes = pixel_sizes(V.read_directories(files), s.measures.meters_per_pixel).withColumn("image_id", _name("path")).drop("path")
    geo = kept(shapes.join(sizes, "image_id", "left").fillna(s.measures.meters_per_pixel, ["meters_per_pixel"]).fillna("fallback", ["source"]), f"{out}/geo")
    got = kept(E.coverage(raw, masks, s.measures, geo.select("image_id", "meters_per_pixel")), f"{out}/table")
    names = files.select("image_id", F.element_at(F.split("path", "/"), -1).alias("mosaic"))
    told = got.join(geo.select("image_id", geo_object().alias("geo")), "image_id", "left").join(names, "image_id", "left").withColumn("threshold", F.lit(float(limit)))
    told = kept(told, f"{out}/told")
    told.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/metrics")
    report(told).write.mode("overwrite").partitionBy("image_id").text(f"{out}/reports")
    got.agg(F.count("*").alias("images"), F.sum("nodule_count").alias("nodules"), F.round(F.avg("coverage_pct"), 4).alias("mean_coverage_pct")).write.mode("overwrite").json(f"{out}/summary")
    return got


OUTLINE = (255, 255, 0)  #: cyan, in the order of channels that images have here
CORNERS = {"top_left": (0, 0), "top_right": (0, 1), "bottom_left": (1, 0), "bottom_right": (1, 1)}


def geo_object():
    """The geo object of a row with height, width, meters_per_pixel, source, lat, lon and crs_code: position, system and the corners of a north-up image."""
    c = F.col
    system = F.when(c("source") == "fallback", F.lit(None)).when(c("crs_code") == 1, "projected").otherwise("geographic")
    down, right = c("height") * c("meters_per_pixel"), c("width") * c("meters_per_pixel")
    east = METRES_PER_DEGREE * F.cos(F.radians("lat"))
    known = c("lat").isNotNull() & c("lon").isNotNull() & (c("meters_per_pixel") > 0) & ((system != "geographic") | system.isNull() | (east > 0))
    # degrees, or the units of a projected system
    south, along = F.when(system == "geographic", down / METRES_PER_DEGREE).otherwise(down), F.when(system == "geographic", right / east).otherwise(right)
    corner = lambda y, x: F.struct(F.when(known, c("lat") - y * south).alias("latitude"), F.when(known, c("lon") + x * along).alias("longitude"))
    corners = F.struct(*[corner(y, x).alias(name) for name, (y, x) in CORNERS.items()])
    return F.struct(c("meters_per_pixel"), c("source").alias("mpp_source"), c("lat").alias("latitude"), c("lon").alias("longitude"), system.alias("crs_type"), corners.alias("corners"))


def report(metrics: DataFrame) -> DataFrame:
    """(image_id, value): the text report of each image."""
    line = lambda label, form, c: F.coalesce(F.format_string(f"{label:<22}{form}", c), F.lit(f"{label:<22}n/a"))
    c = F.col
    lines = [F.concat(F.lit("Image: "), "image_id")]
    if "geo" in metrics.columns:
        at = lambda name: F.when(c(f"geo.corners.{name}.latitude").isNull(), F.lit(f"  {name:<20}n/a")).otherwise(F.format_string(f"  {name:<20}%.6f, %.6f", c(f"geo.corners.{name}.latitude"), c(f"geo.corners.{name}.longitude")))
        lines += [F.format_string("Threshold: %.3f", c("threshold")), F.format_string("metres per pixel: %.6f (%s)", c("geo.meters_per_pixel"), c("geo.mpp_source")), F.concat(F.lit("reference system: "), F.coalesce(c("geo.crs_type"), F.lit("n/a"))), F.lit("corners (lat, lon):"), *map(at, CORNERS)]
    lines += [line("coverage (%%)", "%.4f", c("coverage_pct")), line("components", "%d", c("nodule_count")), line("foreground pixels", "%d", c("nodule_pixels")), line("seafloor pixels", "%d", c("seafloor_pixels"))]
    for label, name in (("seafloor area (m2)", "seafloor_area_m2"), ("foreground area (m2)", "nodule_area_m2"), ("components per m2", "nodule_density_per_m2"), ("pixels per m2", "nodule_px_density_per_m2")):
        lines.append(F.when(c(name).isNull(), F.lit(f"{label:<22}n/a")).otherwise(F.format_string(f"{label:<22}%.4f", c(name))))
    return metrics.select("image_id", F.concat_ws("\n", *lines).alias("value"))


__all__ = ["audit", "audit_labels", "channel_stats", "complete", "edit_selection", "evaluate", "export", "import_actions", "import_bundles", "inspect", "journal", "load_metrics", "manifest", "predict", "preprocess", "repack", "report", "split", "status", "train", "with_mask_source"]
