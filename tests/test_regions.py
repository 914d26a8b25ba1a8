"""Region, label and split queries on the fixture's patches against plain loops that share no code with them."""

import itertools
import math

import numpy as np
import pytest

from tessera import registry
from tessera.operators import labels
from tessera.sources.fixtures import patches
from tests.conftest import SF_SMALL
from tests.test_shapes import slow_watershed

SIDE = 8


def around(p, inside, diagonal=True):
    y, x = p
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not dy or not dx)]
    return [(y + dy, x + dx) for dy, dx in steps if (y + dy, x + dx) in inside]


def parts(pixels, diagonal=True):
    left, out = set(pixels), []
    while left:
        one, todo = set(), [min(left)]
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                one.add(p)
                todo += around(p, left, diagonal)
        out.append(one)
    return out


def without_holes(pixels):
    frame = {(y, x) for y in range(-1, SIDE + 1) for x in range(-1, SIDE + 1)}
    outside = next(b for b in parts(frame - pixels, diagonal=False) if (-1, -1) in b)
    return frame - outside


def squares(one):
    """Over all 2x2 squares of places: how many hold four, three, two adjacent and two opposite pixels."""
    n = {"four": 0, "three": 0, "side": 0, "cross": 0}
    for y, x in itertools.product(range(-1, SIDE), repeat=2):
        a, b, c, d = ((y + dy, x + dx) in one for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)))
        total = a + b + c + d
        kind = {4: "four", 3: "three", 2: "cross" if a == d else "side"}.get(total)
        if kind:
            n[kind] += 1
    return n


def hull_area(one):
    """Sum over the pairs that have all other pixels on their left."""
    cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    twice = 0
    for p, q in itertools.permutations(sorted(one), 2):
        sides = [(cross(p, q, r), r) for r in one if r not in (p, q)]
        # of pixels on one line the two outermost are the edge
        if all(s > 0 or s == 0 and min(p, q) < r < max(p, q) for s, r in sides):
            twice += p[0] * q[1] - p[1] * q[0]
    return abs(twice) / 2


def bends(one):
    """Border pixels in whose place the way around the region turns: those walked through in another way than straight on."""
    from tessera.functions import shapes  # the walk itself has its own test

    mask = np.zeros((SIDE, SIDE), bool)
    for p in one:
        mask[p] = True
    path = shapes.outline(mask)
    return [(y, x) for k, (y, x, d) in enumerate(path) if d != path[k - 1][2]]


def eccentricity(points):
    """By the full six by six eigenproblem of the direct fit."""
    p = np.array(sorted(set(points)), float)
    if len(p) < 5:
        return 0.0
    if len(p) == 5:
        return None  # an exact conic: tested by ellipses of known axes
    p = (p - p.mean(axis=0)) / np.abs(p - p.mean(axis=0)).max()
    x, y = p[:, 1], p[:, 0]
    d = np.stack([x * x, x * y, y * y, x, y, np.ones(len(x))], axis=1)
    c = np.zeros((6, 6))
    c[0, 2] = c[2, 0] = 2
    c[1, 1] = -1
    try:
        w, v = np.linalg.eig(np.linalg.solve(d.T @ d, c))
    except np.linalg.LinAlgError:
        return None
    if np.linalg.cond(d) > 1e4:
        return None
    a, b, cc, dd, e, f = np.real(v[:, np.argmax(np.real(w))])
    q = np.array([[a, b / 2], [b / 2, cc]])
    if np.linalg.det(q) <= 0:
        return 0.0
    centre = np.linalg.solve(2 * q, [-dd, -e])
    half = -(f + (dd * centre[0] + e * centre[1]) / 2) / np.linalg.eigvalsh(q)
    return math.sqrt(max(0.0, 1 - half.min() / half.max())) if half.min() > 0 else 0.0


def grid(values):
    return {(k // SIDE, k % SIDE) for k, v in enumerate(values) if v}


@pytest.fixture(scope="module")
def cleaned(spark):
    return labels.cleaned(patches(spark, SF_SMALL)).select("pid", "mask", "score", "px", "bg", "thr", "n_valid").collect()


@pytest.fixture(scope="module")
def regions(spark):
    return registry.queries()["l10_l11_region_features"](spark, SF_SMALL).collect()


def test_region_features(cleaned, regions):
    got = {(r.pid, r.region): r for r in regions}
    seen = fitted = 0
    for row in cleaned:
        for one in parts(without_holes(grid(row["mask"]))):
            at = sorted(y * SIDE + x for y, x in one)
            r, n = got[row["pid"], at[0]], squares(one)
            area, length, whole = n["four"] + n["three"] / 2, n["side"] + math.sqrt(2) * (n["three"] + 2 * n["cross"]), hull_area(one)
            mean = lambda c: sum(row[c][k] for k in at) / len(at)  # noqa: B023, E731
            ecc = eccentricity(bends(one)) if r.n_points >= 5 else 0
            fitted += bool(ecc)
            ecc = r.eccentricity if ecc is None else ecc
            want = (len(one), area, area / whole if whole else 0, 4 * math.pi * area / length**2 if length else 0, ecc, mean("score"), mean("px"), mean("bg"), row["thr"])
            assert (r.n_inside, r.area, r.solidity, r.circularity, r.eccentricity, r.mean_score, r.mean_gray, r.mean_bg, r.thr) == pytest.approx(want)
            seen += 1
    assert seen == len(regions) > 0 and fitted > 0


def verdict(r, c):
    strong = r.mean_score >= c.bypass * r.thr
    if r.area > c.most_area:
        return "area_too_large"
    if r.area < (1 if strong else c.least_area):
        return "area_too_small"
    if not strong and r.area >= c.shape_area:
        if r.solidity < c.solidity:
            return "low_solidity"
        if r.eccentricity > c.eccentricity:
            return "eccentricity"
        if r.circularity < c.circularity:
            return "low_circularity"
    if r.mean_bg > 1 and (r.mean_bg - r.mean_gray) / r.mean_bg < c.least_contrast:
        return "weak_local_contrast"
    return "kept"


def test_proxy_label(spark, cleaned, regions):
    c, got = labels.BASE, {r.pid: r for r in registry.queries()["l14_l15_proxy_label"](spark, SF_SMALL).collect()}
    assert len(got) == len(cleaned)
    for row in cleaned:
        own = [(verdict(r, c), r.n_inside) for r in regions if r.pid == row["pid"]]
        reasons = [v for v, _ in own if v != "kept"]
        few = row["n_valid"] < c.least_valid
        kept = [n for v, n in own if v == "kept"]
        want = (0, 0, 0, 0) if few else (len(own), len(kept), 100 * sum(kept) / SIDE**2, row["thr"])
        g = got[row["pid"]]
        assert (g.candidates, g.kept, g.coverage_pct, g.threshold) == pytest.approx(want)
        assert g.rejected == {v: reasons.count(v) for v in reasons}


def cut(one, px, least_distance, least_area):
    """The pixels that the split takes away from one component."""
    off = {(y, x) for y in range(SIDE) for x in range(SIDE)} - one
    if len(one) < least_area or not off:
        return set()
    # background counts within the component's box and one pixel around it
    ys, xs = [p[0] for p in one], [p[1] for p in one]
    off = {q for q in off if min(ys) - 1 <= q[0] <= max(ys) + 1 and min(xs) - 1 <= q[1] <= max(xs) + 1}
    dist = {p: min((math.dist(p, q) for q in off), default=math.inf) for p in one}
    top, r = max(dist.values()), max(1, math.ceil(least_distance))
    if top < least_distance or top == math.inf:
        return set()
    peaks = {p for p in one if dist[p] > max(least_distance, 0.3 * top) and all(dist[q] <= dist[p] for q in one if max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= r)}
    markers, inside = np.full((SIDE, SIDE), -1), np.zeros((SIDE, SIDE), bool)
    for k, part in enumerate(parts(peaks)):
        for p in part:
            markers[p] = k
    if markers.max() < 1:
        return set()
    for p in one:
        inside[p] = True
    label = slow_watershed(np.array(px).reshape(SIDE, SIDE, 1), markers, inside)
    return {p for p in one if label[p] < 0}


def test_split(spark):
    got = {r.pid: r for r in registry.queries()["l16_watershed_split"](spark, SF_SMALL).collect()}
    rows = patches(spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    split = 0
    for row in rows:
        m = grid(g > 90 for g in row["px"])
        left = m - set().union(*(cut(one, row["px"], 1.0, 12) for one in parts(m)))
        g = got[row["pid"]]
        assert (g.n_before, g.n_after, grid(g.mask)) == (len(parts(m)), len(parts(left)), left)
        split += left != m
    assert split > 0
