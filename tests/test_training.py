"""The trainable pixel model: gradients against differences, falling loss, plateau and early stop, restored runs."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import engine as E
from tessera.operators import training as T
from tests.test_engine import scene

rng = np.random.default_rng(5)


@pytest.mark.parametrize("hidden", [0, 4])
def test_gradient_against_differences(hidden):
    t = T.Training(hidden=hidden)
    s = T.fresh(np.zeros(3), np.ones(3), t)
    m = s.model
    m.theta = rng.normal(0, 0.5, len(m.theta))
    x, y = rng.normal(0, 1, (40, 3)), (rng.random(40) < 0.3).astype(float)
    _, g = T.patch_loss(m, x, y, t)
    for k in range(len(m.theta)):
        ends = []
        for d in (1e-6, -1e-6):
            theta = m.theta.copy()
            theta[k] += d
            ends.append(T.patch_loss(replace(m, theta=theta), x, y, t)[0])
        assert g[k] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-7)


def labelled(spark, seeds, side=64):
    rows = []
    for k in seeds:
        px = scene(side, side, k, dots=4)
        mask = (E.K.gray_of(px) < 100) * np.uint8(255)
        rows.append((f"p{k}", "a", side, side, 0, k, side, side, 3, bytearray(px.tobytes()), bytearray(mask.tobytes()), float(100 * (mask > 0).mean())))
    return spark.createDataFrame(rows, "patch_id string, " + E.BLOCK + ", mask binary, coverage_pct double")


QUICK = T.Training(epochs=8, batch=4, hidden=4, rate=0.05, least_epochs=2, patience=3)


def test_loss_falls_and_the_restored_model_scores_alike(spark, tmp_path):
    at, train, val = str(tmp_path / "m"), labelled(spark, range(10)).cache(), labelled(spark, range(20, 23)).cache()
    h = T.fit(train, val, at, QUICK).collect()
    assert [r.epoch for r in h] == list(range(len(h))) and h[-1].loss < 0.6 * h[0].loss and max(r.val_dice for r in h) > 0.8
    best, last = T.load_model(spark, at), T.load_model(spark, at, "last")
    first_best = max(h, key=lambda r: (r.val_dice, -r.epoch))
    assert best.epoch == first_best.epoch and best.threshold == first_best.threshold and last.epoch == h[-1].epoch
    assert 0.3 <= best.threshold <= 0.7
    # by the engine, in tasks
    p = E.predict(val, best.scorer(), 2)
    for r in p.collect():
        px = np.frombuffer(r.px, "u1").reshape(64, 64, 3)
        assert np.allclose(np.frombuffer(r.prob, "f4").reshape(64, 64), best.score(px), atol=1e-6)
    dice = E.agreement(p).agg(F.avg("dice")).first()[0]
    assert dice > 0.7
    with pytest.raises(FileNotFoundError):
        T.load_model(spark, at, 99)


def test_a_stopped_run_goes_on_as_if_it_had_not_stopped(spark, tmp_path):
    train, val = labelled(spark, range(6)).cache(), labelled(spark, range(20, 22)).cache()
    whole = T.fit(train, val, str(tmp_path / "a"), replace(QUICK, epochs=4)).collect()
    T.fit(train, val, str(tmp_path / "b"), replace(QUICK, epochs=2))
    parts = T.fit(train, val, str(tmp_path / "b"), replace(QUICK, epochs=4)).collect()
    assert len(parts) == 4
    for a, b in zip(whole, parts):
        assert a.loss == pytest.approx(b.loss, rel=1e-9) and a.val_dice == pytest.approx(b.val_dice, abs=1e-9) and a.rate == b.rate
    assert np.allclose(T.load_model(spark, str(tmp_path / "a"), 3).theta, T.load_model(spark, str(tmp_path / "b"), 3).theta)


def test_weighted_draws_and_views(spark, tmp_path):
    train, val = labelled(spark, range(9)).cache(), labelled(spark, range(20, 22)).cache()
    seen = []

    def views(p, epoch):
        seen.append(epoch)
        return E.augment(p, E.Augmentation(elastic=0.0, paste_coverage=0.5), epoch)

    h = T.fit(train, val, str(tmp_path / "w"), replace(QUICK, epochs=2), weight=1 + F.col("coverage_pct"), augment=views).collect()
    assert seen == [0, 1] and len(h) == 2 and all(np.isfinite(r.loss) for r in h)


def test_plateau_and_early_stop():
    t = T.Training(patience=4, least_epochs=6, plateau=2, rate=0.1)
    s = T.fresh(np.zeros(2), np.ones(2), replace(t, hidden=0))
    values, rates, stops = [0.5, 0.6, 0.6, 0.60001, 0.59, 0.6, 0.58, 0.6, 0.6], [], []
    for epoch, v in enumerate(values):
        stops.append(s.judge(epoch, v, t))
        rates.append(s.rate)
    # strict improvement counts for the best, a relative margin for the plateau
    assert (s.best_epoch, s.best_dice) == (3, 0.60001)
    assert rates == [0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.025, 0.025]
    assert stops == [False] * 7 + [True, True]


def test_sums_of_thresholds_against_loops(spark):
    val = labelled(spark, range(3))
    m = T.fresh(*T.feature_scale(val), T.Training(hidden=3)).model
    dice, half = T.sweep(val, m)
    p = [(m.score(np.frombuffer(r.px, "u1").reshape(64, 64, 3)), np.frombuffer(r.mask, "u1").reshape(64, 64) > 0) for r in val.collect()]
    for k, limit in enumerate(T.THRESHOLDS):
        both, total = sum(((a >= limit) & y).sum() for a, y in p), sum((a >= limit).sum() + y.sum() for a, y in p)
        assert dice[k] == pytest.approx((2 * both + 1e-6) / (total + 1e-6))
    assert half == pytest.approx(2 * sum(((a > 0.5) & y).sum() for a, y in p) / sum((a > 0.5).sum() + y.sum() for a, y in p), abs=1e-6)


def test_nothing_to_train_on(spark, tmp_path):
    none = labelled(spark, range(1)).filter("false")
    with pytest.raises(ValueError):
        T.fit(none, none, str(tmp_path / "n"), QUICK)
