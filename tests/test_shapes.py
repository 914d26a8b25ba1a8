"""Kernels against brute force and hand-made shapes."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import shapes
from tessera.functions import stencil as S

bits = st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=6, max_size=6).map(lambda r: np.array(r, bool))


@settings(max_examples=60, deadline=None)
@given(bits)
def test_distances(m):
    got, off = shapes.distances(m), np.argwhere(~m)
    for y, x in np.argwhere(m):
        assert got[y, x] == pytest.approx(min((math.dist((y, x), o) for o in off), default=math.inf))
    assert (got[~m] == 0).all()


@settings(max_examples=60, deadline=None)
@given(bits)
def test_filled(m):
    free, todo = set(), [(y, x) for y in range(-1, 7) for x in range(-1, 8) if y in (-1, 6) or x in (-1, 7)]
    while todo:
        y, x = todo.pop()
        if (y, x) in free or not (-1 <= y <= 6 and -1 <= x <= 7) or (0 <= y < 6 and 0 <= x < 7 and m[y, x]):
            continue
        free.add((y, x))
        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    assert shapes.filled(m).tolist() == [[(y, x) not in free for x in range(7)] for y in range(6)]


@settings(max_examples=60, deadline=None)
@given(bits)
def test_outline_visits_only_the_region(m):
    lab = shapes.label_tile(shapes.filled(m))
    for name in np.unique(lab[lab >= 0]):
        one = lab == name
        seen = {(y, x) for y, x, _ in shapes.outline(one)}
        assert all(one[p] for p in seen)
        if one.sum() > 1:  # every pixel with a 4-neighbour outside lies on the outline
            pad = np.pad(one, 1)
            edge = {(y, x) for y, x in map(tuple, np.argwhere(one)) if not (pad[y, x + 1] and pad[y + 2, x + 1] and pad[y + 1, x] and pad[y + 1, x + 2])}
            assert edge <= seen


def test_shape_of_square_and_dot():
    m = np.zeros((6, 6), bool)
    m[1:4, 1:4] = True
    got = shapes.shape(m)
    assert (got["area"], got["solidity"], got["n_points"], got["eccentricity"]) == (4, 1, 4, 0)
    assert got["circularity"] == pytest.approx(4 * math.pi * 4 / 64)
    m[:] = False
    m[2, 2] = True
    assert shapes.shape(m)["area"] == 0


def test_long_region_is_eccentric():
    m = np.zeros((12, 30), bool)
    y, x = np.mgrid[:12, :30]
    m[((y - 6) / 3) ** 2 + ((x - 15) / 12) ** 2 <= 1] = True
    assert shapes.shape(m)["eccentricity"] == pytest.approx(math.sqrt(1 - (3 / 12) ** 2), abs=0.02)


def test_split_two_discs():
    y, x = np.mgrid[:20, :34]
    m = ((y - 10) ** 2 + (x - 9) ** 2 <= 60) | ((y - 10) ** 2 + (x - 23) ** 2 <= 60)
    assert len(np.unique(shapes.label_tile(m))) == 2
    flat = np.zeros((20, 34), np.uint8)
    cut = shapes.split(m, flat, 3.0, 50)
    assert len(np.unique(shapes.label_tile(cut, diagonal=False))) == 3 and 0 < m.sum() - cut.sum() < 30
    assert (shapes.split(m, flat, 3.0, 10_000) == m).all()


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**31), st.sampled_from([0.0, 1.0, 2.0, 40.0]))
def test_equalized(seed, clip):
    px = np.random.default_rng(seed).integers(0, 256, (8, 8))
    got = shapes.equalized(px, 2, clip, 1.0)
    for y in range(8):
        for x in range(8):
            fy, fx, v = y / 4 - 0.5, x / 4 - 0.5, 0.0
            for j, wy in ((math.floor(fy), 1 - fy % 1), (math.floor(fy) + 1, fy % 1)):
                for i, wx in ((math.floor(fx), 1 - fx % 1), (math.floor(fx) + 1, fx % 1)):
                    j_, i_ = min(max(j, 0), 1), min(max(i, 0), 1)
                    v += wy * wx * shapes.tile_curve(px[j_ * 4 : j_ * 4 + 4, i_ * 4 : i_ * 4 + 4], clip)[px[y, x]]
            assert abs(got[y, x] - v) <= 0.5 + 1e-9


def test_plain_curve_is_the_distribution():
    px = np.arange(256).reshape(16, 16)
    assert shapes.tile_curve(px, 0).tolist() == np.rint((np.arange(256) + 1) * 255 / 256).tolist()


def test_array_statistics(spark):
    rows = [(1, [3, 1, 2, 10]), (2, [5]), (3, [])]
    df = spark.createDataFrame(rows, "k int, a array<int>").selectExpr("k", f"{S.mean('a')} AS m", f"{S.spread('a')} AS s", f"{S.quantile('a', 0.75)} AS q")
    for r in df.collect():
        a = rows[r.k - 1][1]
        want = (np.mean(a), np.std(a), np.percentile(a, 75)) if a else (None, None, None)
        assert (r.m, r.s, r.q) == (pytest.approx(want) if a else want)


@settings(max_examples=80, deadline=None)
@given(st.floats(2, 40), st.floats(0.2, 1.0), st.floats(0, math.pi), st.floats(-30, 30), st.integers(5, 40))
def test_ellipses_are_found_again(long, share, turn, at, n):
    a = np.linspace(0, 2 * math.pi, n, endpoint=False) + 0.1
    p = np.stack([long * np.cos(a), long * share * np.sin(a)], axis=1) @ np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]]) + at
    got = shapes.fitted_ellipse(p)
    assert got == pytest.approx((long, long * share), rel=1e-3)


def test_what_no_ellipse_fits():
    assert shapes.fitted_ellipse(np.array([[k, 2 * k] for k in range(9)])) is None
    assert shapes.fitted_ellipse(np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 3)) is None


def test_fit_is_the_least_among_ellipses_nearby():
    rng = np.random.default_rng(2)
    a = rng.random(30) * 2 * math.pi
    p = np.stack([9 * np.cos(a), 5 * np.sin(a)], axis=1) + rng.normal(0, 0.2, (30, 2))
    long, short = shapes.fitted_ellipse(p)
    assert (long, short) == (pytest.approx(9, abs=0.4), pytest.approx(5, abs=0.4))


def slow_watershed(image, markers, inside):
    """One pixel after another: the lowest step, then the earliest reached."""
    label, h, w = markers.copy(), *markers.shape
    waits, n = {}, 0

    def reach(y, x):
        nonlocal n
        for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
            if 0 <= v < h and 0 <= u < w and inside[v, u] and markers[v, u] < 0 and (v, u) not in done and (v, u) not in waits:
                waits[v, u] = (max(abs(int(a) - int(b)) for a, b in zip(image[v, u], image[y, x])), n)
                n += 1

    done = set()
    for y, x in np.argwhere(markers >= 0).tolist():
        reach(y, x)
    while waits:
        p = min(waits, key=waits.get)
        del waits[p]
        done.add(p)
        names = {int(label[q]) for q in ((p[0], p[1] - 1), (p[0], p[1] + 1), (p[0] - 1, p[1]), (p[0] + 1, p[1])) if 0 <= q[0] < h and 0 <= q[1] < w and label[q] >= 0}
        if len(names) == 1:
            label[p] = names.pop()
            reach(*p)
    return label


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31), st.sampled_from([2, 12, 256]))
def test_watershed(seed, values):
    rng = np.random.default_rng(seed)
    image, inside = rng.integers(0, values, (11, 13, 3)).astype(np.uint8), rng.random((11, 13)) < 0.85
    markers = np.where(inside & (rng.random((11, 13)) < 0.05), rng.integers(0, 4, (11, 13)), -1)
    assert (shapes.watershed(image, markers, inside) == slow_watershed(image, markers, inside)).all()


def test_split_follows_the_image():
    # two discs that touch, and a dark line between them beside the waist: the cut is where the image has it
    y, x = np.mgrid[:40, :80]
    m = ((y - 20) ** 2 + (x - 25) ** 2 <= 240) | ((y - 20) ** 2 + (x - 52) ** 2 <= 240)
    image = np.full((40, 80, 3), 120, np.uint8)
    image[:, 42:] = 160
    cut = shapes.split(m, image, 5)
    lab = shapes.label_tile(cut, diagonal=False)
    assert len(np.unique(lab[lab >= 0])) == 2 and 0 < (m & ~cut).sum() < 60
    assert set(np.nonzero(m & ~cut)[1]) <= {40, 41, 42, 43}
    assert (shapes.split(m, image, 20) == m).all() and (shapes.split(m & (x < 38), image, 5) == (m & (x < 38))).all()


def test_boundary_distances_of_larger_masks():
    """Against all pairs of pixels, on masks that touch no common border."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = [[[{"y": int(y), "x": int(x)} for y, x in np.argwhere(rng.random((40, 30)) < share)] for share in shares] for shares in ((0.3, 0.02), (0.9, 0.5), (0.01, 0.01))]
    batch = pa.RecordBatch.from_pylist([{"pid": k, "a": a, "b": b} for k, (a, b) in enumerate(rows)] + [{"pid": 9, "a": [], "b": rows[0][1]}, {"pid": 10, "a": None, "b": None}])
    got = {}
    for b in shapes.boundary_rows(iter([batch])):
        got.setdefault(b.column(0)[0].as_py(), []).extend(b.column(1).to_pylist())
    assert sorted(got) == [0, 1, 2]
    for k, masks in enumerate(rows):
        sets, want = [{(p["y"], p["x"]) for p in m} for m in masks], []
        for one, two in (sets, sets[::-1]):
            for y, x in one:
                if any(q not in one for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))):
                    want.append(min((y - v) ** 2 + (x - u) ** 2 for v, u in two))
        assert sorted(got[k]) == sorted(want)
