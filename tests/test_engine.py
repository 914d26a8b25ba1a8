"""The raster engine on patches and images of several sizes: kernels against plain loops, flows from a folder to its metrics."""

import json
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import raster as K
from tessera.operators import engine as E
from tessera.operators.geo import pixel_sizes
from tessera.settings import Augmentation, Filters, Labels, Measures, Settings, Tiling, Tuning
from tessera.sources import rasters as R
from tessera.sources import windows as V

rng = np.random.default_rng(7)


def scene(h, w, seed=0, dots=12):
    """Bright grainy ground with dark discs."""
    r = np.random.default_rng(seed)
    img = np.clip(r.normal(150, 1, (h, w, 1)) + r.normal(0, 0.5, (h, w, 3)) + np.linspace(-20, 20, w)[None, :, None], 0, 255)
    y, x = np.mgrid[:h, :w]
    for _ in range(dots):
        cy, cx, rad = r.integers(10, h - 10), r.integers(10, w - 10), r.integers(4, 9)
        img[(y - cy) ** 2 + (x - cx) ** 2 <= rad * rad] = r.normal(60, 4)
    return np.clip(img, 0, 255).astype(np.uint8)


def rows(images):
    return [(n, i.shape[0], i.shape[1], 0, 0, i.shape[0], i.shape[1], 3, bytearray(i.tobytes())) for n, i in images]


def stored(spark, images):
    return spark.createDataFrame(rows(images), E.BLOCK)


def test_blur_against_loops():
    img = rng.random((9, 14)) * 255
    for sigma in (0.7, 3.0, 12.0):
        r = max(1, round(4 * sigma))
        w = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
        w /= w.sum()
        m = lambda v, n: v if 0 <= (v := abs(v) % (2 * n - 2)) < n else 2 * n - 2 - v
        rowed = np.array([[sum(w[k + r] * img[y, m(x + k, 14)] for k in range(-r, r + 1)) for x in range(14)] for y in range(9)])
        want = np.array([[sum(w[k + r] * rowed[m(y + k, 9), x] for k in range(-r, r + 1)) for x in range(14)] for y in range(9)])
        assert np.allclose(K.blur(img, sigma), want)
    flat = np.full((256, 256), 77.0)
    assert np.allclose(K.blur(flat, 80.0), 77.0)


@pytest.mark.parametrize("side", [1, 3, 5, 9, 41])
def test_morphology_against_loops(side):
    img = rng.integers(0, 256, (30, 23)).astype(float)
    r = side // 2
    inside = [(dy, dx) for dy, half in K.disc_rows(side) for dx in range(-half, half + 1)]
    for highest in (True, False):
        want = np.array([[(max if highest else min)(img[y + dy, x + dx] for dy, dx in inside if 0 <= y + dy < 30 and 0 <= x + dx < 23) for x in range(23)] for y in range(30)])
        assert (K.extreme(img, side, highest) == want).all(), (side, r)


def test_stencils_and_bilateral_against_loops():
    img = rng.integers(0, 256, (12, 10)).astype(float)
    pad = np.pad(img, 2, mode="reflect")
    want = np.array([[pad[y : y + 5, x : x + 5].mean() for x in range(10)] for y in range(12)])
    assert np.allclose(K.stencil(img, K.BOX), want)
    gx = pad[1:-3, 3:-1] + 2 * pad[2:-2, 3:-1] + pad[3:-1, 3:-1] - pad[1:-3, 1:-3] - 2 * pad[2:-2, 1:-3] - pad[3:-1, 1:-3]
    gy = pad[3:-1, 1:-3] + 2 * pad[3:-1, 2:-2] + pad[3:-1, 3:-1] - pad[1:-3, 1:-3] - 2 * pad[1:-3, 2:-2] - pad[1:-3, 3:-1]
    assert np.allclose(K.gradient(img), np.hypot(gx, gy))
    colour = rng.integers(0, 256, (8, 9, 3))
    got, p = K.bilateral(colour, 5, 30, 20), np.pad(colour.astype(float), ((2, 2), (2, 2), (0, 0)), mode="reflect")
    for y in range(8):
        for x in range(9):
            num, den = np.zeros(3), 0.0
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    if dy * dy + dx * dx <= 4:
                        n = p[y + 2 + dy, x + 2 + dx]
                        k = math.exp(-(np.abs(n - colour[y, x]).sum() ** 2) / 1800 - (dy * dy + dx * dx) / 800)
                        num, den = num + k * n, den + k
            assert (got[y, x] == np.floor(num / den + 0.5)).all()


def test_colour_round_trip_and_known_values():
    x = rng.integers(0, 256, (64, 64, 3)).astype(np.uint8)
    assert (K.bgr_of(K.lab_of(x)) == x).all()
    lab = K.lab_of(np.array([[[255, 255, 255], [0, 0, 0], [0, 0, 255]]], np.uint8))[0]
    assert np.allclose(lab, [[255, 128, 128], [0, 128, 128], [53.24 * 2.55, 80.09 + 128, 67.20 + 128]], atol=0.1)


def test_filters_keep_what_they_promise():
    img, p = scene(256, 256), E.Params(Filters(), retinex_blend=1.0, clahe_clip=2.0, clahe_blend=0.5, unsharp_strength=0.5, bilateral_d=7, bilateral_colour=30.0, bilateral_space=30.0)
    dark = np.zeros((64, 64, 3), np.uint8)
    for name, f in K.FILTERS.items():
        out = f(img, p)
        assert out.shape == img.shape and out.dtype == np.uint8, name
        assert name == "clahe_lab" or (f(dark, p) == 0).all(), name  # equalisation lifts a flat image
    tinted = np.clip(img * np.array([0.5, 1.0, 0.8]), 0, 255).astype(np.uint8)
    means = K.white_balance(tinted, p).reshape(-1, 3).mean(axis=0)
    assert means.max() - means.min() < 1.5
    # the slope across the image is divided out; retinex returns to the old mean and spread
    light = lambda i: K.lab_of(i)[..., 0]
    slope = lambda i: abs(np.median(light(i)[:, -40:]) - np.median(light(i)[:, :40]))
    assert slope(K.illumination(img, p)) < slope(img) / 2 and slope(K.retinex(img, p)) < slope(img)
    assert abs(light(K.retinex(img, p)).mean() - light(img).mean()) < 2
    assert light(K.denoise(img, p)).std() < light(img).std()
    assert light(K.unsharp(img, p)).std() > light(img).std()
    bright = light(img) > np.median(light(img)) + 10
    assert light(K.fade(img, p))[bright].mean() < light(img)[bright].mean()


def test_patches_of_any_size_and_back(spark):
    images = [("a", scene(300, 170, 1)), ("b", scene(40, 90, 2)), ("c", np.zeros((70, 70, 3), np.uint8))]
    t = Tiling(size=64, overlap=16)
    whole = E.cut(stored(spark, images), t)
    # the same images in uneven blocks give the same patches
    parts = [("a", 300, 170, y, x, min(130, 300 - y), min(77, 170 - x), 3, bytearray(np.ascontiguousarray(images[0][1][y : y + 130, x : x + 77]).tobytes())) for y in range(0, 300, 130) for x in range(0, 170, 77)]
    again = E.cut(spark.createDataFrame(parts, E.BLOCK), t)
    got = {(r.image_id, r.y, r.x): bytes(r.px) for r in whole.collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {(r.image_id, r.y, r.x): bytes(r.px) for r in again.collect()}
    assert sorted(y for i, y, x in got if i == "a" and x == 0) == [0, 48, 96, 144, 192, 236] and len([k for k in got if k[0] == "b"]) == 2
    full = np.zeros((64, 64, 3), np.uint8)
    full[:40] = images[1][1][:, 26:]
    assert got["b", 0, 26] == full.tobytes()
    gates = {r.image_id: r.reason for r in E.gate(whole, t).filter("y = 0 AND x = 0").collect()}
    assert gates["c"] == "black_fraction=1.00" and gates["b"] == "valid"
    for scale in (None, 0.125):
        back = E.put_together(whole, "px", 100, "u1", scale).collect()
        for name, img in images:
            out = np.zeros_like(img)
            for r in back:
                if r.image_id == name:
                    out[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.px, "u1").reshape(r.h, r.w, 3)
                    assert set(r.cover) == {1}
            assert (out == img).all()


def test_weighted_mean_against_loops(spark):
    parts = [("a", 20, 30, 0, x, 20, 20, 1, None) for x in (0, 10)]
    probs = [rng.random((20, 20)).astype("f4") for _ in parts]
    df = spark.createDataFrame([(*p, bytearray(q.tobytes())) for p, q in zip(parts, probs)], E.BLOCK + ", prob binary")
    got = E.put_together(df, "prob", 64, "f4", 0.125).collect()
    k = np.exp(-((np.arange(20) - 9.5) ** 2) / (2 * 2.5**2))
    w = np.clip(np.outer(k, k) / k.max() ** 2, 1e-3, 1)
    num, den = np.zeros((20, 30)), np.zeros((20, 30))
    for (_, _, _, _, x, *_), q in zip(parts, probs):
        num[:, x : x + 20] += w * q
        den[:, x : x + 20] += w
    assert np.allclose(np.frombuffer(got[0].px, "f4").reshape(20, 30), num / den, atol=1e-5)


def labelled(spark, seeds=(1, 2)):
    t = Tiling(size=128, overlap=0)
    p = E.gate(E.cut(stored(spark, [(f"i{k}", scene(128, 128, k)) for k in seeds]), t), t).filter("reason = 'valid'")
    return E.tune(p, Tuning(), search=False)


def test_tuning_follows_its_ranges(spark):
    t = labelled(spark).select("tuned.*").collect()
    assert len(t) == 2
    for r in t:
        assert 0.3 <= r.retinex_blend <= 1 and 0.4 <= r.clahe_clip <= 2 and r.bilateral_d % 2 == 1 and 5 <= r.bilateral_d <= 15
        assert r.open_side in (1, 3) and r.close_side in (5, 7, 9, 11) and 11 <= r.block_size <= 51
        share = min(1.0, r.contrast / 40)
        assert r.unsharp_strength == pytest.approx(0.1 + 0.4 * share) and r.min_solidity == pytest.approx(0.65 - 0.2 * min(1.0, r.noise / 20))


def test_sigma_search_against_single_filters():
    gray = K.gray_of(scene(40, 40, 3))
    colours, spaces = [20, 30], [10, 30]
    left = {(c, s): np.median(K.local_variance(K.bilateral(gray, 5, c, s)[..., 0])) for c in colours for s in spaces}
    assert left[E._search(gray, 5, colours, spaces)] == min(left.values())


def test_proxy_labels_find_the_discs(spark):
    out = E.proxy_labels(labelled(spark), Labels(radii=(2, 4, 8), background_sigma=20.0)).collect()
    assert len(out) == 2
    for r in out:
        img = scene(128, 128, int(r.image_id[1:]))
        truth, mask = K.gray_of(img) < 100, np.frombuffer(r.mask, "u1").reshape(128, 128) > 0
        dice = 2 * (truth & mask).sum() / (truth.sum() + mask.sum())
        assert dice > 0.6 and r.kept > 0 and r.candidates == r.kept + sum(r.rejected.values())
        assert r.coverage_pct == pytest.approx(100 * mask.mean())


def test_region_verdicts_in_order(spark):
    tuned = dict(area_max=100.0, area_min=5.0, max_eccentricity=0.9, min_solidity=0.5, min_circularity=0.3)
    base = dict(area=50.0, solidity=0.9, eccentricity=0.5, circularity=0.8, mean_score=5.0, mean_gray=50.0, mean_bg=100.0)
    cases = [({}, "kept"), ({"area": 101.0}, "area_too_large"), ({"area": 4.0}, "area_too_small"), ({"area": 4.0, "mean_score": 8.0}, "kept"), ({"solidity": 0.4, "eccentricity": 0.95}, "low_solidity"), ({"eccentricity": 0.95}, "eccentricity"), ({"circularity": 0.2}, "low_circularity"), ({"circularity": 0.2, "area": 19.0}, "kept"), ({"circularity": 0.2, "mean_score": 9.0}, "kept"), ({"mean_gray": 99.0}, "weak_local_contrast"), ({"mean_gray": 9.0, "mean_bg": 0.5}, "kept")]
    fields = list(base)
    df = spark.createDataFrame([(k, tuple(tuned.values()), 4.0, tuple({**base, **c}[f] for f in fields)) for k, (c, _) in enumerate(cases)], f"k int, tuned struct<{','.join(f'{f}:double' for f in tuned)}>, threshold double, r struct<{','.join(f'{f}:double' for f in fields)}>")
    got = {r.k: r.v for r in df.select("k", E.verdict(F.col("r")).alias("v")).collect()}
    assert [got[k] for k in range(len(cases))] == [v for _, v in cases]


def test_components_across_blocks(spark):
    """Snakes over many block borders: areas and boxes equal those of the whole mask."""
    mask = np.zeros((60, 70), np.uint8)
    mask[5, 2:65] = mask[5:50, 64] = mask[49, 10:65] = 255
    mask[20:30, 20:30] = 255
    mask[31, 31] = mask[30, 30] = 255
    noise = np.random.default_rng(3).random((60, 70)) < 0.3
    for m in (mask, (noise * 255).astype(np.uint8)):
        parts = [("a", 60, 70, y, x, min(16, 60 - y), min(16, 70 - x), 1, bytearray(np.ascontiguousarray(m[y : y + 16, x : x + 16]).tobytes())) for y in range(0, 60, 16) for x in range(0, 70, 16)]
        got = sorted((r.area, r.y0, r.x0, r.y1, r.x1) for r in E.components(spark.createDataFrame(parts, E.BLOCK)).collect())
        lab = E.label_tile(m > 0)
        want = sorted((int((lab == k).sum()), *(int(v) for v in (*np.argwhere(lab == k).min(axis=0), *np.argwhere(lab == k).max(axis=0)))) for k in np.unique(lab[lab >= 0]))
        assert got == want


def test_agreement_against_loops(spark):
    p, y = (np.zeros((24, 31), bool) for _ in range(2))
    p[3:12, 4:15], y[5:14, 6:18] = True, True
    row = lambda a, b: ("a", 24, 31, 0, 0, 24, 31, 1, bytearray(b"x"), bytearray(a.astype("f4").tobytes()), bytearray((b * 255).astype("u1").tobytes()))
    df = spark.createDataFrame([row(p, y), row(p, p & False), row(p & False, p & False)], E.BLOCK + ", prob binary, mask binary")
    got = E.agreement(df, Measures()).collect()
    edge = lambda m: [(a, b) for a, b in np.argwhere(m) if not all(0 <= a + u < 24 and 0 <= b + v < 31 and m[a + u, b + v] for u, v in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
    d = [min(math.hypot(a - u, b - v) for u, v in np.argwhere(t)) for f, t in ((p, y), (y, p)) for a, b in edge(f)]
    assert got[0].dice == pytest.approx(2 * (p & y).sum() / (p.sum() + y.sum()), abs=1e-6)
    assert got[0].asd == pytest.approx(np.mean(d)) and got[0].nsd == pytest.approx(np.mean(np.array(d) <= 2))
    assert got[1].dice < 1e-6 and got[1].asd is None and got[2].dice is None


def test_regions_are_split_by_the_image(spark):
    px = np.full((128, 128, 3), 170, np.uint8)
    y, x = np.mgrid[:128, :128]
    px[((y - 60) ** 2 + (x - 52) ** 2 <= 121) | ((y - 60) ** 2 + (x - 72) ** 2 <= 121)] = 60
    p = E.tune(stored(spark, [("a", px)]), search=False)
    count = lambda d: E.score(p, Labels(radii=(8, 12, 16), background_sigma=20.0, split_distance=d)).select(F.size("regions")).first()[0]
    assert (count(0), count(6)) == (1, 2)


def test_augmentation_is_repeatable_and_pastes(spark):
    p = E.proxy_labels(labelled(spark, (1, 2, 3)), Labels(radii=(2, 4, 8), background_sigma=20.0)).select(*E.KEY, "h", "w", "bands", "px", "mask", "coverage_pct").cache()
    still = Augmentation(flip=0, turn=0, affine=0, elastic=0, light=0, blur=0, noise=0, paste=1.0)
    out = {r.image_id: r for r in E.augment(p, still).collect()}
    for r in p.collect():
        a, b = np.frombuffer(r.mask, "u1"), np.frombuffer(out[r.image_id].mask, "u1")
        assert (b >= a).all()
    assert any(bytes(out[r.image_id].mask) != bytes(r.mask) for r in p.collect())
    views = [{r.image_id: (bytes(r.px), bytes(r.mask)) for r in E.augment(p, Augmentation(), epoch).collect()} for epoch in (0, 0, 1)]
    assert views[0] == views[1] != views[2]
    img, mask = scene(64, 64), np.zeros((64, 64), np.uint8)
    same = K.augmented(img, mask, np.random.default_rng(0), Augmentation(**{k: 0 for k in ("flip", "turn", "affine", "elastic", "light", "blur", "noise")}))
    assert (same[0] == img).all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("rasters")
    geo = {33550: (12, [0.01, 0.01, 0.0]), 33922: (12, [0.0] * 6), 34735: (3, [1, 1, 0, 1, 1024, 0, 1, 1])}
    (at / "one.tif").write_bytes(R.encode_tiff(scene(200, 150, 1)[..., ::-1], extra=geo))
    (at / "two.png").write_bytes(R.encode_png(scene(130, 130, 2)[..., ::-1]))
    (at / "bad.tif").write_bytes(b"II*\0nothing")
    return str(at)


SMALL = Settings(tiling=Tiling(size=64, overlap=16), tuning=replace(Tuning(), bilateral_colour=(30, 30), bilateral_space=(30, 30)), labels=Labels(radii=(2, 4, 8), background_sigma=20.0), filters=replace(Filters(), retinex_sigmas=(5, 20)), audit_size=4)


def test_flow_from_folder_to_audit(spark, folder, tmp_path):
    out = str(tmp_path / "run")
    assert api.manifest(spark, out) == {"images": {}, "settings": None}
    with pytest.raises(FileNotFoundError):
        api.load_metrics(spark, out)
    patches = api.preprocess(spark, folder, out, SMALL)
    n = patches.count()
    assert n > 12 and api.preprocess(spark, "/nowhere", out, SMALL).count() == n
    doc = api.manifest(spark, out)
    assert set(doc["images"]) == {"one", "two"} and sum(v["patches"] for v in doc["images"].values()) == n
    split = api.split(spark, out, SMALL)
    assert split.count() == n and {r.split for r in split.collect()} >= {"train", "val"}
    stats = spark.read.parquet(f"{out}/channels").orderBy("channel").collect()
    assert [r.channel for r in stats] == [0, 1, 2] and all(0 < r.mean < 1 and r.std > 0 for r in stats)
    metrics = api.evaluate(spark, out, SMALL)
    assert metrics.count() == n and metrics.filter("dice > 0.3").count() > 0
    queue = api.audit(spark, out, SMALL).collect()
    scored = sorted((r.dice, r.patch_id) for r in metrics.collect() if r.dice is not None)
    assert sorted((r.dice, r.patch_id) for r in queue) == scored[:4]
    panel = spark.read.parquet(f"{out}/audit/panels").first()
    assert R.decode_png(bytes(panel.content)).shape == (64, 4 * 68 - 4, 3) and panel.path.endswith("_audit.png")
    # annotators get archives; what comes back goes first in the next evaluation
    made = api.export(patches, "ann", 6)
    assert made.count() > 1
    back = made.withColumn("entry_minute", F.lit(5).cast("long"))
    held = spark.createDataFrame([(queue[0].patch_id, bytearray(64 * 64), 9)], "patch_id string, mask binary, mtime long")
    got = {r.patch_id: bytes(r.mask) for r in api.import_bundles(back, held, "newest").collect()}
    want = {r.patch_id: bytes(r.mask) for r in patches.collect()}
    assert got == {**want, queue[0].patch_id: bytes(64 * 64)}
    assert {r.patch_id: bytes(r.mask) for r in api.import_bundles(back, held, "overwrite").collect()} == want
    assert api.status(patches, held).first().asDict() == {"total": n, "corrected": 1, "left": n - 1, "done_pct": round(100 / n, 2)}
    again = api.evaluate(spark, out, SMALL, corrected=held)
    assert again.filter("is_corrected").count() == 1 and queue[0].patch_id not in {r.patch_id for r in api.audit(spark, out, SMALL, 100).collect()}
    assert queue[0].patch_id in {r.patch_id for r in api.audit(spark, out, SMALL, 100, include_corrected=True).collect()}


def test_prediction_flow(spark, folder, tmp_path):
    out = str(tmp_path / "predicted")
    got = {r.image_id: r for r in api.predict(spark, folder, out, SMALL).collect()}
    assert set(got) == {"one", "two"} and got["one"].meters_per_pixel == 0.01 and got["two"].meters_per_pixel == 0.005
    for name, img in (("one", scene(200, 150, 1)), ("two", scene(130, 130, 2))):
        truth = E.label_tile(K.gray_of(img) < 100)
        assert 1 <= got[name].nodule_count <= len(np.unique(truth[truth >= 0])) + 1
        assert got[name].seafloor_pixels == img.shape[0] * img.shape[1]
    lines = [json.loads(r.value) for r in spark.read.text(f"{out}/metrics").collect()]
    assert {x["image_id"] for x in lines} == {"one", "two"}
    text = "\n".join(r.value for r in spark.read.text(f"{out}/reports/image_id=one").collect())
    assert "Image: one" in text and "components per m2" in text
    over = V.read_blocks(spark, f"{out}/mosaics/one_overlay.tif", f"{out}/mosaics/two_overlay.tif").collect()
    assert {r.image_id.rsplit("/", 1)[-1]: r.image_w for r in over} == {"one_overlay.tif": 150, "two_overlay.tif": 130}
    assert api.predict(spark, folder, out, SMALL, threshold=1.1).agg(F.sum("nodule_count")).first()[0] == 0


def test_pixel_sizes_from_tags(spark):
    rows = [("a", 34264, [2e-7, 0.0, 0.0, 10.0, 0.0, -2e-7, 0.0, 60.0] + [0.0] * 8), ("b", 33550, [0.5, 0.5, 0.0]), ("b", 34735, [1.0, 1.0, 0.0, 1.0, 1024.0, 0.0, 1.0, 1.0]), ("c", 256, [10.0])]
    got = {r.path: r for r in pixel_sizes(spark.createDataFrame(rows, "path string, tag int, values array<double>"), 0.02).collect()}
    assert got["a"].meters_per_pixel == pytest.approx((2e-7 * 111320 * math.cos(math.radians(60)) + 2e-7 * 111320) / 2)
    assert (got["b"].meters_per_pixel, got["c"].meters_per_pixel, got["c"].source) == (0.5, 0.02, "fallback")


def test_empty_tables(spark):
    e = spark.createDataFrame([], E.BLOCK)
    assert E.cut(e).count() == 0 and E.put_together(E.cut(e), "px").count() == 0 and E.components(e).count() == 0
    assert E.proxy_labels(E.enhance(E.tune(E.gate(E.cut(e))))).count() == 0 and E.coverage(e, e).count() == 0
