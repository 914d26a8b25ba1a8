"""Hand-made cases of guards and thresholds."""

import numpy as np
import pytest

from tessera.functions.graph import components
from tessera.functions.kernels import label_tile
from tessera.operators import metrics, pixels, records


@pytest.mark.parametrize("length, want", [(10, [0]), (16, [0]), (80, [0, 12, 24, 36, 48, 60, 64]), (88, [0, 12, 24, 36, 48, 60, 72])])
def test_grid(length, want):
    assert pixels.grid_positions(length, 16, 12) == want


def test_bins(spark):
    df = spark.createDataFrame([(1.0,), (1.0001,), (20.0,), (500.0,), (None,)], "c double")
    assert [r.b for r in df.select(records.coverage_bin(df.c).alias("b")).collect()] == [0, 1, 3, 4, 0]


def test_both_masks_empty_is_null(spark):
    rows = [(1, 0.1, False), (1, 0.2, False), (2, 0.9, True), (2, 0.1, False), (3, 0.9, False)]
    got = {r.pid: r.dice for r in records.patch_dice(spark.createDataFrame(rows, "pid int, p double, truth boolean")).collect()}
    assert got[1] is None and got[2] == pytest.approx(1) and got[3] == pytest.approx(0, abs=1e-5)


def test_newest_overwrites_equal_times(spark):
    e = spark.createDataFrame([(1, 5, True, True, "x"), (2, 4, True, True, "x"), (3, 9, True, False, "x"), (4, 1, False, False, "untouched"), (5, 1, False, False, "corrected")], "doc_id long, entry_minute long, has_list boolean, in_list boolean, mask_source string")
    c = spark.createDataFrame([(1, 5), (2, 5)], "doc_id long, mtime long")
    got = {r.doc_id: r.action for r in records.import_actions(e, c, "newest").collect()}
    assert got == {1: "conflict", 2: "skipped", 3: "untouched", 4: "untouched", 5: "imported"}


def test_labels():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert label_tile(m).tolist() == [[0, -1, -1, 3], [-1, 0, -1, 3], [-1, -1, -1, -1], [12, 12, -1, 15]]


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (7, 7), (300, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, 100: 100, 101: 100, 300: 100}


def test_early_stop_floor(spark):
    h = spark.createDataFrame([(1, k, 0.5 if k == 3 else 0.1) for k in range(120)] + [(2, k, k / 100) for k in range(100)], "run_id int, epoch long, val_dice double")
    assert {r.run_id: r.stop_epoch for r in metrics.early_stop(h).collect()} == {1: 85, 2: None}
