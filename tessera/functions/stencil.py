"""Stencils on square patches held as arrays: neighbours are array elements, so no join or shuffle is needed.

Borders are mirrored without repeating the edge pixel.
"""

from __future__ import annotations

import math

PS = 8

SOBEL_X = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
SOBEL_Y = [(dx, dy, w) for dy, dx, w in SOBEL_X]
LAPLACE = [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)]
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def box(radius: int) -> list[tuple[int, int, int]]:
    return [(dy, dx, 1) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def gauss(sigma: float, radius: int | None = None) -> list[tuple[int, float]]:
    """One-dimensional normalised taps; the default radius spans three sigmas."""
    r = radius if radius is not None else int(round(6 * sigma + 1) | 1) // 2
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [(k, v / sum(w)) for k, v in zip(range(-r, r + 1), w)]


def mirrored(v: str, n: int = PS) -> str:
    return f"({n - 1} - abs({n - 1} - abs({v})))"


def at(px: str, dy: int, dx: int, n: int = PS) -> str:
    """The neighbour of place i."""
    return f"{px}[{mirrored(f'i DIV {n} + {dy}', n)} * {n} + {mirrored(f'i % {n} + {dx}', n)}]"


def let(px: str, body: str) -> str:
    """``body`` over q, which is ``px`` evaluated once (a plain reference would be inlined into the lambda)."""
    return f"transform(array({px}), q -> {body})[0]"


def weighted(px: str, taps, n: int = PS) -> str:
    """Array of the weighted sums at all places."""
    terms = " + ".join(f"{w!r}{'D' if isinstance(w, float) else ''} * {at('q', dy, dx, n)}" for dy, dx, w in taps)
    return let(px, f"transform(sequence(0, {n * n - 1}), i -> {terms})")


def extreme(px: str, offsets, kind: str, n: int = PS) -> str:
    """Array of greatest or least values over the offsets that lie inside the patch."""
    terms = []
    for dy, dx in offsets:
        inside = f"i DIV {n} + {dy} BETWEEN 0 AND {n - 1} AND i % {n} + {dx} BETWEEN 0 AND {n - 1}"
        terms.append(f"CASE WHEN {inside} THEN {at('q', dy, dx, n)} END")
    return let(px, f"transform(sequence(0, {n * n - 1}), i -> {kind}({', '.join(terms)}))")


def blur(px: str, sigma: float, n: int = PS, radius: int | None = None) -> str:
    """Separable Gaussian: rows, then columns."""
    taps = gauss(sigma, radius)
    return weighted(weighted(px, [(0, k, w) for k, w in taps], n), [(k, 0, w) for k, w in taps], n)


def bound(body: str, **values: str) -> str:
    """``body`` over q.name, where each value is evaluated once per row."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"transform(array(named_struct({fields})), q -> {body})[0]"


def mean(a: str) -> str:
    """Mean of an array's values; null if it is empty."""
    return bound("aggregate(q.a, 0D, (s, v) -> s + v) / nullif(size(q.a), 0)", a=f"transform({a}, v -> CAST(v AS DOUBLE))")


def spread(a: str) -> str:
    """Population standard deviation of an array's values; null if it is empty."""
    return bound("sqrt(aggregate(q.a, 0D, (s, v) -> s + (v - q.m) * (v - q.m)) / nullif(size(q.a), 0))", a=f"transform({a}, v -> CAST(v AS DOUBLE))", m=mean(a))


def quantile(a: str, q: str | float) -> str:
    """Linearly interpolated quantile of an array's values; null if it is empty."""
    at_ = bound("q.s[CAST(floor(q.h) AS INT)] + (q.h - floor(q.h)) * (q.s[CAST(ceil(q.h) AS INT)] - q.s[CAST(floor(q.h) AS INT)])", s="q.s", h="(size(q.s) - 1) * q.at")
    return bound(f"CASE WHEN size(q.s) > 0 THEN {at_} END", s=f"array_sort(transform({a}, v -> CAST(v AS DOUBLE)))", at=f"CAST({q} AS DOUBLE)")


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptical structuring element of side 2 * radius + 1."""
    out = []
    for dy in range(-radius, radius + 1):
        half = round(math.sqrt(radius * radius - dy * dy))
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets within ``radius`` of the centre."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
