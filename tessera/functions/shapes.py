"""Array kernels on one patch: region shapes, distance maps, splitting, limited equalisation.

Each kernel holds one patch at a time, so memory is bounded by the patch size. Rows with a null array are passed over.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa

from tessera.functions.kernels import label_tile, pieces

REGION = "pid bigint, region int, area double, n_inside bigint, solidity double, eccentricity double, circularity double, n_points int, mean_score double, mean_gray double, mean_bg double, thr double, inside array<int>, n_valid int, size int"
_REGION = pa.schema([("pid", pa.int64()), ("region", pa.int32()), *[(c, pa.float64()) for c in ("area",)], ("n_inside", pa.int64()), *[(c, pa.float64()) for c in ("solidity", "eccentricity", "circularity")], ("n_points", pa.int32()), *[(c, pa.float64()) for c in ("mean_score", "mean_gray", "mean_bg", "thr")], ("inside", pa.list_(pa.int32())), ("n_valid", pa.int32()), ("size", pa.int32())])

#: the eight neighbours clockwise from east, y downward
RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes; a hole is background that no 4-connected way leads out of."""
    lab = label_tile(np.pad(~mask, 1, constant_values=True), diagonal=False)
    return (lab != lab[0, 0])[1:-1, 1:-1]


def outline(mask: np.ndarray) -> list[tuple[int, int, int]]:
    """(y, x, step to the next) around one 8-connected region, clockwise; empty for a single pixel."""
    pad = np.pad(mask, 1)
    y, x = map(int, np.argwhere(pad)[0])
    path: list[tuple[int, int, int]] = []
    came = 0
    while True:
        for turn in range(8):
            d = (came + 5 + turn) % 8
            if pad[y + RING[d][0], x + RING[d][1]]:
                break
        else:
            return []
        if path and (y - 1, x - 1, d) == path[0]:
            return path
        path.append((y - 1, x - 1, d))
        y, x, came = y + RING[d][0], x + RING[d][1], d


def polygon_area(points) -> float:
    p = np.asarray(points, float)
    if len(p) < 3:
        return 0.0
    return abs(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)))) / 2


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Convex hull; of points on one line the two ends."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    sides = []
    for order in (pts, pts[::-1]):
        side: list[tuple[int, int]] = []
        for p in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return sides


def fitted_ellipse(points: np.ndarray) -> tuple[float, float] | None:
    """Long and short half axis of the conic of least squares among ellipses, by the reduced eigenproblem of the direct fit.

    Points are centred and scaled first. None for fewer than five different points, points on a line, or a conic without real axes.
    """
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 5:
        return None
    p = p - p.mean(axis=0)
    size = np.abs(p).max()
    x, y = p[:, 1] / size, p[:, 0] / size
    square, line = np.stack([x * x, x * y, y * y], axis=1), np.stack([x, y, np.ones(len(x))], axis=1)
    cross, plain = square.T @ line, line.T @ line
    if abs(np.linalg.det(plain)) < 1e-9:
        return None
    back = -np.linalg.solve(plain, cross.T)
    m = square.T @ square + cross @ back
    # the constraint 4 a c - b^2 = 1 that only ellipses meet
    _, v = np.linalg.eig(np.stack([m[2] / 2, -m[1], m[0] / 2]))
    v = np.real(v)
    good = np.flatnonzero(4 * v[0] * v[2] - v[1] ** 2 > 1e-12)
    if not len(good):
        return None
    a, b, c = v[:, good[0]]
    d, e, f = back @ v[:, good[0]]
    q = np.array([[a, b / 2], [b / 2, c]])
    centre = np.linalg.solve(2 * q, -np.array([d, e]))
    level = -(f + (d * centre[0] + e * centre[1]) / 2)
    half = level / np.linalg.eigvalsh(q)
    return (size * math.sqrt(half.max()), size * math.sqrt(half.min())) if half.min() > 0 else None


def shape(mask: np.ndarray) -> dict[str, float]:
    """Area, solidity, eccentricity, circularity and number of corners of one region without holes.

    Area and length are those of the polygon through the centres of the border pixels, so a single pixel has area 0.
    Eccentricity is that of the ellipse fitted to the corners; 0 for fewer than five, or where no ellipse fits them.
    """
    path = outline(mask)
    at = [(y, x) for y, x, _ in path] or [tuple(map(int, p)) for p in np.argwhere(mask)]
    area = polygon_area(at)
    length = sum(math.sqrt(2) if d % 2 else 1.0 for _, _, d in path)
    whole = polygon_area(hull(at))
    corners = sum(d != path[k - 1][2] for k, (_, _, d) in enumerate(path)) or 1
    bends = [(y, x) for k, (y, x, d) in enumerate(path) if d != path[k - 1][2]]
    axes = fitted_ellipse(np.array(bends)) if corners >= 5 else None
    ecc = math.sqrt(max(0.0, 1 - (axes[1] / axes[0]) ** 2)) if axes else 0.0
    return {"area": area, "solidity": area / whole if whole else 0.0, "eccentricity": ecc, "circularity": 4 * math.pi * area / length**2 if length else 0.0, "n_points": corners}


def region_rows(side: int, outer: bool = False):
    """mapInArrow over (pid, mask, score, px, bg, thr, n_valid): one row per outer region, named by its first place.

    With ``outer`` also one row, of a null region, for each patch that has none.
    """

    def run(batches):
        for b in pieces(batches):
            rows = []
            for r in b.to_pylist():
                of = {"pid": r["pid"], "thr": r["thr"], "n_valid": r["n_valid"], "size": None if r["px"] is None else len(r["px"])}
                lab = label_tile(filled(np.array(r["mask"], bool).reshape(-1, side))) if r["mask"] else np.zeros((0, side), int)
                flat = lab.reshape(-1)
                names = np.unique(flat[flat >= 0])
                if outer and not len(names):
                    rows.append(of)
                for name in names:
                    at = np.flatnonzero(flat == name)
                    mean = lambda k: float(np.array(r[k], float)[at].mean())  # noqa: B023, E731
                    rows.append(of | {"region": int(name), "n_inside": len(at), **shape(lab == name), "mean_score": mean("score"), "mean_gray": mean("px"), "mean_bg": mean("bg"), "inside": at.tolist()})
            yield pa.RecordBatch.from_pylist(rows, _REGION)

    return run


def distances(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each foreground pixel to the nearest background pixel of the patch; inf if it has none."""
    h, w = mask.shape
    gap = np.abs(np.arange(h)[:, None] - np.arange(h)[None, :]).astype(float) ** 2
    down = np.stack([np.where(mask[:, x][None, :], np.inf, gap).min(axis=1) for x in range(w)], axis=1)
    across = np.abs(np.arange(w)[:, None] - np.arange(w)[None, :]).astype(float) ** 2
    return np.sqrt(np.stack([(down[y][None, :] + across).min(axis=1) for y in range(h)]))


def edge(mask: np.ndarray) -> np.ndarray:
    """Mask pixels with a 4-neighbour outside the mask or the patch."""
    pad = np.pad(mask, 1)
    return mask & ~(pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:])


def boundary_rows(batches):
    """mapInArrow over (pid, a, b), lists of the (y, x) of two masks' pixels: pid and squared distance d2 of each boundary pixel to the other mask.

    A distance map of the patch gives all distances of a mask at once; patches with an empty mask have no rows.
    """
    for b in pieces(batches):
        for pid, one, two in zip(*(c.to_pylist() for c in b.columns)):
            at = [np.array([(p["y"], p["x"]) for p in m], int).reshape(-1, 2) for m in (one or [], two or [])]
            if not (len(at[0]) and len(at[1])):
                continue
            low = np.concatenate(at).min(axis=0)
            masks = [np.zeros(np.concatenate(at).max(axis=0) - low + 1, bool) for _ in at]
            for m, places in zip(masks, at):
                m[tuple((places - low).T)] = True
            d2 = np.concatenate([np.rint(distances(~t)[edge(f)] ** 2) for f, t in (masks, masks[::-1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([pid] * len(d2), pa.int64()), pa.array(d2)], ["pid", "d2"])


def watershed(image: np.ndarray, markers: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Floods ``inside`` from the markers (0 and more; -1: none): the label of each pixel, -1 on the lines where floods meet.

    A pixel waits at the height of the step to it, the greatest difference of a channel, from the pixel that reached it; the lowest step goes
    first, of equal ones the one that waits longest. It takes the label of its 4-neighbours, or is a line if they have several.
    """
    px = image.reshape(*image.shape[:2], -1).astype(int)
    label, (h, w) = markers.copy(), markers.shape
    seen, heap, n = markers >= 0, [], 0
    sides = ((0, -1), (0, 1), (-1, 0), (1, 0))

    def reach(y: int, x: int) -> None:
        nonlocal n
        for dy, dx in sides:
            v, u = y + dy, x + dx
            if 0 <= v < h and 0 <= u < w and inside[v, u] and not seen[v, u]:
                seen[v, u] = True
                heapq.heappush(heap, (int(np.abs(px[v, u] - px[y, x]).max()), n, v, u))
                n += 1

    for y, x in np.argwhere(markers >= 0).tolist():
        reach(y, x)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        names = {int(label[y + dy, x + dx]) for dy, dx in sides if 0 <= y + dy < h and 0 <= x + dx < w} - {-1}
        if len(names) == 1:
            label[y, x] = names.pop()
            reach(y, x)
    return label


def split(mask: np.ndarray, image: np.ndarray, least_distance: float, least_area: int | None = None, window: int | None = None, floor: float = 2.0) -> np.ndarray:
    """Cuts each large 8-connected component along the lines of ``watershed`` over the image, from the peaks of its distance map.

    A component stays whole under ``least_area`` (four times the area of a single object of the least distance, 50 pixels at least), if
    it is thinner than the least distance, or has one peak. Peaks are the greatest within ``window`` pixels (the least
    distance, 3 at least) and above ``floor`` and three tenths of the greatest distance.
    """
    least_area = 4 * max(50, int(math.pi * least_distance**2)) if least_area is None else least_area
    r = max(math.ceil(least_distance), 3) if window is None else window
    out, lab = mask.copy(), label_tile(mask)
    for name in np.unique(lab[lab >= 0]):
        one = lab == name
        if one.sum() < least_area:
            continue
        ys, xs = np.nonzero(one)
        box = slice(max(0, int(ys.min()) - 1), int(ys.max()) + 2), slice(max(0, int(xs.min()) - 1), int(xs.max()) + 2)
        part = one[box]
        dist = distances(part)
        top = dist[part].max()
        if not np.isfinite(top) or top < least_distance:
            continue
        pad = np.pad(np.where(part, dist, 0), r)
        rows = np.max([pad[k : k + part.shape[0]] for k in range(2 * r + 1)], axis=0)
        near = np.max([rows[:, k : k + part.shape[1]] for k in range(2 * r + 1)], axis=0)
        peaks = label_tile(part & (dist == near) & (dist > max(floor, 0.3 * top)))
        if len(np.unique(peaks[peaks >= 0])) < 2:
            continue
        out[box] &= ~(part & (watershed(image[box], peaks, part) < 0))
    return out


def split_rows(side: int, least_distance: float, least_area: int):
    """mapInArrow over (pid, mask, px): components before and after the split of the mask by the pixels, and the mask."""

    def run(batches):
        for b in pieces(batches):
            rows = []
            for r in b.to_pylist():
                if r["mask"] is None:
                    continue
                m = np.array(r["mask"], bool).reshape(-1, side)
                s = split(m, np.array(r["px"]).reshape(-1, side), least_distance, least_area, max(1, math.ceil(least_distance)), least_distance)
                n = [len(np.unique(k[k >= 0])) for k in (label_tile(m), label_tile(s))]
                rows.append({"pid": r["pid"], "n_before": n[0], "n_after": n[1], "mask": s.astype(int).reshape(-1).tolist()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("pid", pa.int64()), ("n_before", pa.int32()), ("n_after", pa.int32()), ("mask", pa.list_(pa.int32()))]))

    return run


def tile_curve(tile: np.ndarray, clip: float) -> np.ndarray:
    """256-entry curve of one tile: its histogram with the excess over the limit spread evenly, summed and scaled."""
    n = tile.size
    hist = np.bincount(tile.reshape(-1), minlength=256)
    if clip > 0:
        limit = max(1, int(clip * n / 256))
        over = int(np.maximum(hist - limit, 0).sum())
        hist = np.minimum(hist, limit) + over // 256
        rest = over % 256
        if rest:
            hist[np.arange(rest) * max(256 // rest, 1)] += 1
    return np.clip(np.rint(np.cumsum(hist) * (255.0 / n)), 0, 255)


def equalized(px: np.ndarray, grid: int, clip: float, blend: float) -> np.ndarray:
    """Contrast-limited adaptive equalisation of bytes: curves of grid x grid tiles, mixed linearly between tile centres."""
    h, w = px.shape
    full = np.pad(px, ((0, -h % grid), (0, -w % grid)), mode="reflect" if min(h, w) > grid else "edge")
    th, tw = full.shape[0] // grid, full.shape[1] // grid
    curves = np.array([[tile_curve(full[j * th : (j + 1) * th, i * tw : (i + 1) * tw], clip) for i in range(grid)] for j in range(grid)])

    def place(n: int, size: int):
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, grid - 1), np.clip(low + 1, 0, grid - 1), at - low

    y0, y1, fy = place(h, th)
    x0, x1, fx = place(w, tw)
    take = lambda ys, xs: curves[ys[:, None], xs[None, :], px]
    upper = take(y0, x0) * (1 - fx) + take(y0, x1) * fx
    lower = take(y1, x0) * (1 - fx) + take(y1, x1) * fx
    new = np.rint(upper * (1 - fy)[:, None] + lower * fy[:, None])
    return np.clip(np.rint(new * blend + px * (1 - blend)), 0, 255).astype(int)


def clahe_rows(side: int, grid: int, clip: float, blend: float):
    """mapInArrow over (pid, px): equalised pixels."""

    def run(batches):
        for b in pieces(batches):
            rows = [{"pid": r["pid"], "a": equalized(np.array(r["px"], np.int64).reshape(-1, side), grid, clip, blend).reshape(-1).tolist()} for r in b.to_pylist() if r["px"] is not None]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("pid", pa.int64()), ("a", pa.list_(pa.int32()))]))

    return run
