"""The lightness filters on colour images against plain loops: conversion, blur and each rule written out pixel by pixel."""

import math

import numpy as np
import pytest

from tessera.functions import raster as K
from tessera.functions import shapes
from tessera.operators.engine import Params
from tessera.settings import Filters

H, W = 17, 19
P = Params(Filters(illumination_sigma=3.0, retinex_sigmas=(1, 2), fade_sigma=2.0, unsharp_sigma=1.0, clahe_grid=2), retinex_blend=0.7, clahe_clip=2.0, clahe_blend=0.5, unsharp_strength=0.5)
# fixed values: the matrix of the sRGB primaries and the white point D65
XYZ, WHITE = [(0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227)], (0.950456, 1.0, 1.088754)


def lab(b, g, r):
    line = [v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in (r / 255, g / 255, b / 255)]
    x, y, z = (sum(m * v for m, v in zip(row, line)) / w for row, w in zip(XYZ, WHITE))
    f = lambda t: t ** (1 / 3) if t > (6 / 29) ** 3 else t / 3 * (29 / 6) ** 2 + 4 / 29
    return [math.floor(v + 0.5) for v in ((116 * f(y) - 16) * 2.55, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128)]


def bgr(light, a, b):
    fy = (light / 2.55 + 16) / 116
    back = lambda t: t**3 if t > 6 / 29 else 3 * (6 / 29) ** 2 * (t - 4 / 29)
    xyz = [back(t) * w for t, w in zip((fy + (a - 128) / 500, fy, fy - (b - 128) / 200), WHITE)]
    line = np.linalg.solve(np.array(XYZ), xyz)
    out = [12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055 for v in (min(1.0, max(0.0, v)) for v in line)]
    return [math.floor(255 * v + 0.5) for v in out[::-1]]


def blurred(img, sigma):
    r = max(1, round(4 * sigma))
    taps = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    total = sum(taps)

    def at(v, n):
        v = abs(v) % (2 * n - 2)
        return v if v < n else 2 * n - 2 - v

    rows = [[sum(t * img[y][at(x + k, W)] for k, t in zip(range(-r, r + 1), taps)) / total for x in range(W)] for y in range(H)]
    return [[sum(t * rows[at(y + k, H)][x] for k, t in zip(range(-r, r + 1), taps)) / total for x in range(W)] for y in range(H)]


def each(rule):
    return [[rule(y, x) for x in range(W)] for y in range(H)]


def flat(img, ok):
    return [img[y][x] for y in range(H) for x in range(W) if ok[y][x]]


def levelled(light):
    ok = each(lambda y, x: light[y][x] > 8)
    mean = float(np.mean(flat(light, ok)))
    return ok, mean, each(lambda y, x: light[y][x] if ok[y][x] else mean)


def illumination(light):
    ok, mean, full = levelled(light)
    wide = blurred(full, 3.0)
    return each(lambda y, x: light[y][x] / max(wide[y][x], 1) * mean if ok[y][x] else 0)


def retinex(light):
    ok, mean, full = levelled(light)
    blurs = [blurred(full, s) for s in (1, 2)]
    detail = each(lambda y, x: sum(math.log(1 + full[y][x]) - math.log(1 + b[y][x]) for b in blurs) / 2)
    low, high = np.percentile(flat(detail, ok), (1, 99))
    wide = each(lambda y, x: (detail[y][x] - low) / (high - low) * 255)
    m, s = np.mean(flat(wide, ok)), np.std(flat(wide, ok))
    new = each(lambda y, x: (wide[y][x] - m) / s * np.std(flat(light, ok)) + mean)
    return each(lambda y, x: 0.7 * new[y][x] + 0.3 * light[y][x] if ok[y][x] else 0)


def fade(light):
    ok = each(lambda y, x: light[y][x] > 10)
    median = float(np.median(flat(light, ok)))
    weight, soft = blurred(each(lambda y, x: min(1.0, max(0.0, (light[y][x] - median) / 40))), 2.0), blurred(light, 2.0)
    return each(lambda y, x: light[y][x] + 0.6 * weight[y][x] * (soft[y][x] - light[y][x]))


def unsharp(light):
    at = lambda y, x: light[(H - 1) - abs((H - 1) - abs(y))][(W - 1) - abs((W - 1) - abs(x))]
    gx = lambda y, x: sum(w * (at(y + d, x + 1) - at(y + d, x - 1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
    gy = lambda y, x: sum(w * (at(y + 1, x + d) - at(y - 1, x + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
    edge = each(lambda y, x: math.hypot(gx(y, x), gy(y, x)))
    usual = float(np.median(flat(edge, each(lambda y, x: light[y][x] > 8))))
    soft = blurred(light, 1.0)
    return each(lambda y, x: light[y][x] + 0.5 * (light[y][x] - soft[y][x]) * min(1.0, edge[y][x] / (2 * usual + 1e-6)))


def clahe(light):
    return shapes.equalized(np.array(light), 2, 2.0, 0.5).tolist()  # tested against loops by itself


def picture(seed):
    rng = np.random.default_rng(seed)
    img = rng.integers(40, 220, (1, 1, 3)) + rng.normal(0, 25, (H, W, 3)) + np.linspace(-30, 30, W)[None, :, None]
    img[rng.random((H, W)) < 0.08] = 0
    return np.clip(img, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("name, rule", [("illumination_normalize", illumination), ("multi_scale_retinex", retinex), ("sediment_fade", fade), ("unsharp_mask", unsharp), ("clahe_lab", clahe)])
def test_filters_by_loops(name, rule, seed):
    img = picture(seed)
    labs = each(lambda y, x: lab(*map(int, img[y, x])))
    new = rule(each(lambda y, x: float(labs[y][x][0]) if name != "clahe_lab" else labs[y][x][0]))
    want = np.array(each(lambda y, x: bgr(math.floor(min(255, max(0, new[y][x])) + 1e-9), *labs[y][x][1:])))
    got = K.FILTERS[name](img, P).astype(int)
    off = np.abs(got - want)
    # a level of lightness where a value lies on the edge of two, else equal
    assert off.max() <= 4 and (off > 1).any(axis=2).mean() < 0.02, (off.max(), (off > 1).mean())
    assert (got != img).any()
