"""Runs over folders: resumed by image, wrong answers of earlier versions, files of whole mosaics."""

import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import engine as E
from tessera.operators import training as T
from tessera.settings import Measures, Tiling
from tessera.sources import rasters as R
from tessera.sources import windows as V
from tessera.operators import lifecycle
from tests.test_engine import SMALL, scene


def test_coverage_counts_only_seafloor(spark):
    # the right half is black and the mask covers everything: it counts on the left half alone
    px = np.zeros((60, 80, 3), np.uint8)
    px[:, :40] = 120
    raw = spark.createDataFrame([("a", 60, 80, y, 0, 20, 80, 3, bytearray(px[y : y + 20].tobytes())) for y in (0, 20, 40)], E.BLOCK)
    masks = spark.createDataFrame([("a", 60, 80, 0, x, 60, 40, 1, bytearray(b"\xff" * 2400)) for x in (0, 40)], E.BLOCK)
    got = E.coverage(raw, masks, Measures(meters_per_pixel=0.1)).first()
    assert (got.coverage_pct, got.nodule_pixels, got.seafloor_pixels, got.nodule_count, got.nodule_area_m2) == (100.0, 2400, 2400, 1, 24.0)


def test_components_beyond_the_seafloor_are_cut_in_two(spark):
    px = np.full((40, 60, 3), 100, np.uint8)
    px[:, 28:32] = 0
    raw = spark.createDataFrame([("a", 40, 60, 0, 0, 40, 60, 3, bytearray(px.tobytes()))], E.BLOCK)
    mask = np.zeros((40, 60), np.uint8)
    mask[10:20, 10:50] = 255
    got = E.coverage(raw, spark.createDataFrame([("a", 40, 60, 0, 0, 40, 60, 1, bytearray(mask.tobytes()))], E.BLOCK)).first()
    assert (got.nodule_count, got.nodule_pixels, got.seafloor_pixels) == (2, 360, 2240)


def test_newest_bundle_wins_on_equal_times(spark):
    png = R.encode_png(np.full((8, 8), 255, np.uint8))
    bundle = R.pack_bundle([(f"patches/{i}/{k}.png", png) for i in ("older", "same", "newer", "fresh") for k in ("image", "mask")])
    bundles = spark.createDataFrame([("b.zip", bytearray(bundle), 5)], "path string, content binary, entry_minute long")
    held = spark.createDataFrame([(i, bytearray(64), t) for i, t in (("older", 4), ("same", 5), ("newer", 6), ("alone", 1))], "patch_id string, mask binary, mtime long")
    took = lambda how: {r.patch_id for r in api.import_bundles(bundles, held, how).collect() if bytes(r.mask) == b"\xff" * 64}
    assert took("newest") == {"older", "same", "fresh"}
    assert took("skip") == {"fresh"} and took("overwrite") == {"older", "same", "newer", "fresh"}
    assert api.import_bundles(bundles, held).count() == 5


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    for k in (1, 2, 3):
        (at / f"00{k}.tif").write_bytes(R.encode_tiff(scene(130, 100 + k, k)[..., ::-1]))
    (at / "bad.tif").write_bytes(b"II*\0nothing")
    return at


def files_of(out, image):
    return {str(p): p.stat().st_mtime_ns for p in Path(out).glob(f"*/image={image}/*.parquet")}


def test_a_stopped_run_is_completed_and_a_new_raster_is_the_only_work(spark, folder, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    calls, write = [], V.write_mosaics

    def failing(blocks, at, suffix, **how):
        calls.append(suffix)
        if len(calls) == 5:  # in the middle of the second image
            raise RuntimeError("stopped")
        return write(blocks, at, suffix, **how)

    monkeypatch.setattr(V, "write_mosaics", failing)
    with pytest.raises(RuntimeError):
        api.preprocess(spark, str(folder), out, SMALL, mosaics=1)
    assert set(api.manifest(spark, out)["images"]) == {"001"}
    # the second image's patches are written, but nobody reads them
    assert files_of(out, "002") and {r.image_id for r in api.complete(spark, out, "patches").collect()} == {"001"}
    monkeypatch.setattr(V, "write_mosaics", write)
    first = files_of(out, "001")
    done = api.preprocess(spark, str(folder), out, SMALL, mosaics=2)
    assert {r.image_id for r in done.select("image_id").distinct().collect()} == {"001", "002", "003"}
    assert files_of(out, "001") == first  # not done again
    n, ids = done.count(), done.select("patch_id").distinct().count()
    assert n == ids
    # nothing to do; then one more raster; then a changed one
    before = {i: files_of(out, i) for i in ("001", "002", "003")}
    assert api.preprocess(spark, str(folder), out, SMALL).count() == n
    (folder / "004.png").write_bytes(R.encode_png(scene(100, 100, 4)[..., ::-1]))
    assert api.preprocess(spark, str(folder), out, SMALL).count() > n
    assert {i: files_of(out, i) for i in before} == before and files_of(out, "004")
    (folder / "002.tif").write_bytes(R.encode_tiff(np.zeros((130, 90, 3), np.uint8)))
    os.utime(folder / "002.tif", (2_000_000_000, 2_000_000_000))
    after = api.preprocess(spark, str(folder), out, SMALL)
    # the new file has no valid patch: none of the old one's is left
    assert {r.image_id for r in after.select("image_id").distinct().collect()} == {"001", "003", "004"}
    assert {i: files_of(out, i) for i in ("001", "003")} == {i: before[i] for i in ("001", "003")}
    left = after.count()
    doc = api.manifest(spark, out)
    assert set(doc["images"]) == {"001", "002", "003", "004"} and doc["images"]["002"]["patches"] == 0
    # other settings are another run
    other = api.preprocess(spark, str(folder), out, type(SMALL)(**{**SMALL.__dict__, "tiling": Tiling(size=64, overlap=0)}))
    assert other.count() > 0 and left > 0 and files_of(out, "001").keys().isdisjoint(before["001"])


def test_mosaic_files_of_a_run(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    api.preprocess(spark, str(folder), out, SMALL)
    got = {}
    for r in V.read_windows(spark, f"{out}/mosaics").collect():
        a = got.setdefault(r.path.rsplit("/", 1)[-1], np.zeros((r.image_h, r.image_w, r.bands), np.uint8))
        a[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.px, "u1").reshape(r.h, r.w, -1)
    assert set(got) == {f"00{k}_{s}.tif" for k in (1, 2, 3) for s in ("mask", "overlay", "enhanced")}
    for k in (1, 2, 3):
        mask = np.zeros((130, 100 + k), np.uint8)
        for r in api.complete(spark, out, "masks").filter(f"image_id = '00{k}'").collect():
            mask[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.px, "u1").reshape(r.h, r.w)
        assert (got[f"00{k}_mask.tif"][..., 0] == mask).all() and mask.any()
        assert (got[f"00{k}_overlay.tif"] == E.overlay(scene(130, 100 + k, k), mask)[..., ::-1]).all()


def test_predictions_have_files_and_corners(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    geographic = {33550: (12, [1e-7, 1e-7, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 10.0, 60.0, 0.0])}
    projected = {33550: (12, [0.5, 0.5, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 100.0, 50.0, 0.0]), 34735: (3, [1, 1, 0, 1, 1024, 0, 1, 1])}
    for name, extra in (("deg", geographic), ("metre", projected), ("plain", {})):
        (at / f"{name}.tif").write_bytes(R.encode_tiff(scene(130, 100, 1)[..., ::-1], extra=extra))
    out = str(tmp_path / "out")
    api.predict(spark, str(at), out, SMALL)
    doc = {d["image_id"]: d for d in (json.loads(r.value) for r in spark.read.text(f"{out}/metrics").collect())}
    g = doc["deg"]["geo"]
    mpp = (1e-7 * 111320 * 0.5 + 1e-7 * 111320) / 2
    assert doc["deg"]["mosaic"] == "deg.tif" and doc["deg"]["threshold"] == 0.5
    assert (g["crs_type"], g["mpp_source"], g["latitude"], g["longitude"]) == ("geographic", "scale", 60.0, 10.0) and g["meters_per_pixel"] == pytest.approx(mpp)
    assert g["corners"]["top_left"] == {"latitude": 60.0, "longitude": 10.0}
    low = g["corners"]["bottom_right"]
    assert low["latitude"] == pytest.approx(60 - 130 * mpp / 111320, abs=1e-9) and low["longitude"] == pytest.approx(10 + 100 * mpp / (111320 * 0.5), abs=1e-9)
    assert doc["metre"]["geo"]["corners"]["bottom_right"] == {"latitude": 50 - 65.0, "longitude": 100 + 50.0}
    assert doc["plain"]["geo"]["corners"]["top_right"] == {"latitude": None, "longitude": None} and doc["plain"]["geo"]["mpp_source"] == "fallback"
    text = "\n".join(r.value for r in spark.read.text(f"{out}/reports/image_id=deg").collect())
    assert "corners (lat, lon):" in text and "60.000000, 10.000000" in text
    assert {p.name for p in (tmp_path / "out" / "mosaics").iterdir() if p.suffix == ".tif"} == {f"{n}_{s}.tif" for n in doc for s in ("mask", "overlay")}
    over = V.read_windows(spark, f"{out}/mosaics/plain_overlay.tif").first()
    a = np.frombuffer(over.px, "u1").reshape(130, 100, 3)
    assert ((a == (0, 255, 255)).all(axis=2)).any()
    assert api.complete is not None and spark.read.parquet(f"{out}/geo").select(F.count("*")).first()[0] == 3


def test_training_flow_and_prediction_by_the_model(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    for k in range(3):
        (at / f"m{k}.tif").write_bytes(R.encode_tiff(scene(200, 200, k, dots=20)[..., ::-1]))
    out = str(tmp_path / "out")
    api.preprocess(spark, str(at), out, SMALL)
    api.split(spark, out, SMALL)
    h = api.train(spark, out, SMALL, T.Training(epochs=3, batch=16, hidden=3, rate=0.05), augmented=False).collect()
    assert [r.epoch for r in h] == [0, 1, 2] and h[2].loss < h[0].loss
    test = json.loads(spark.read.text(f"{out}/test").first()[0])
    assert test["patches"] > 0 and 0 <= test["test_dice"] <= 1
    model = T.load_model(spark, f"{out}/training")
    got = api.predict(spark, str(at), str(tmp_path / "p"), SMALL, model=model)
    assert got.count() == 3
    doc = json.loads(spark.read.text(f"{tmp_path}/p/metrics").first()[0])
    assert doc["threshold"] == pytest.approx(model.threshold)


def test_label_audit_and_edit_selection(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    patches = api.preprocess(spark, str(folder), out, SMALL)
    everything = lambda batch: [np.full(p.shape[:2], 0.9) for p in batch]
    queue = api.audit_labels(spark, out, SMALL, everything, top_k=5, low=0.4, high=0.6).collect()
    # a model that finds all pixels contradicts no mask where it has one, and all where it has none
    assert len(queue) == 5 and all(r.fp_frac == 0 and r.fn_frac > 0.5 and r.missed_pixels > 0 for r in queue)
    assert [r.patch_id for r in queue] == sorted(r.patch_id for r in queue)
    scores = spark.read.parquet(f"{out}/label_scores")
    assert scores.count() == patches.count() and all(set(bytes(r.pred)) == {255} for r in scores.select("pred").collect())
    nothing = api.audit_labels(spark, out, SMALL, lambda batch: [np.zeros(p.shape[:2]) for p in batch], low=0.4, high=0.6).collect()
    assert nothing[0].fp_frac == max(r.fp_frac for r in nothing) > 0 and nothing[0].fn_frac == 0
    # thresholds that follow from the scores themselves lie between the means off and on the masks
    assert all(r.fn_frac == 0 for r in api.audit_labels(spark, out, SMALL, everything, top_k=5).collect())
    held = patches.select("patch_id", "mask").orderBy("patch_id").limit(3)
    assert api.audit_labels(spark, out, SMALL, everything, top_k=999, corrected=held).count() == patches.count() - 3
    ids = sorted(r.patch_id for r in patches.collect())
    chosen = lambda **how: sorted(r.patch_id for r in api.edit_selection(patches, held, **how).collect())
    assert chosen() == ids and chosen(unannotated=True) == ids[3:] and chosen(unannotated=True, most=4) == ids[3:7]
    assert chosen(image="002") == [i for i in ids if i.startswith("002")]
    m = api.evaluate(spark, out, SMALL)
    worst = sorted((r.dice, r.patch_id) for r in m.collect() if r.dice is not None)[:4]
    assert chosen(worst=4, metrics=m) == sorted(i for _, i in worst)
    with pytest.raises(ValueError):
        chosen(worst=4)


def test_archives_are_inspected_and_repacked(spark):
    png = lambda v: R.encode_png(np.full((8, 8), v, np.uint8))
    entries = [(f"patches/{i}/{k}.png", png(0)) for i in ("a", "b") for k in ("image", "mask")] + [("patches/a/metadata.json", b'{"annotator": "eva", "mask_source": "corrected"}')]
    bundles = spark.createDataFrame([("x/one.zip", bytearray(R.pack_bundle(entries))), ("x/two.zip", bytearray(b"no archive"))], "path string, content binary")
    assert [tuple(r) for r in api.inspect(bundles).collect()] == [("x/one.zip", 2, 1, ["eva"])]
    better = spark.createDataFrame([("b", bytearray(b"\xff" * 64)), ("c", bytearray(64))], "patch_id string, mask binary")
    got = api.repack(bundles, better, "ann").collect()
    assert [(r.path, r.patches, r.corrected) for r in got] == [("one_corrected_by_ann.zip", 2, 1)]
    again = {r.patch_id: r for r in R.open_bundles(spark.createDataFrame([(r.path, r.content) for r in got], "path string, content binary")).collect()}
    assert bytes(again["a"].mask) == png(0) and (R.decode_png(bytes(again["b"].mask)) == 255).all()
    assert json.loads(again["b"].metadata) == {"annotator": "ann", "mask_source": "corrected"} and json.loads(again["a"].metadata)["mask_source"] == "untouched"


def test_statistics_are_stored_by_what_they_are_of(spark, tmp_path):
    at, calls = str(tmp_path), []
    rows = spark.createDataFrame([(k, k % 3, k) for k in range(40)], "id int, ch int, v int")

    def compute(df):
        calls.append(1)
        return df.groupBy(F.col("ch").cast("string").alias("channel")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))

    get = lambda df: lifecycle.norm_stats(df, compute, at).collect()
    first, again = get(rows), get(rows.repartition(7).orderBy(F.desc("v")))
    assert len(calls) == 1 and {r.source for r in first} == {"computed"} and {r.source for r in again} == {"cache"}
    assert sorted((r.channel, r.mean, r.std) for r in first) == sorted((r.channel, r.mean, r.std) for r in again)
    changed = rows.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v")))
    assert {r.source for r in get(changed)} == {"computed"} and len(calls) == 2 and {r.source for r in get(rows)} == {"cache"}
    assert [(r.channel, r.mean, r.source) for r in get(rows.filter("false"))] == [("r", 0.485, "plain"), ("g", 0.456, "plain"), ("b", 0.406, "plain")]
