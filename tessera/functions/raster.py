"""NumPy kernels on one image of any size: stencils, morphology, colour and the enhancement filters.

Colour images are height x width x 3 bytes in the order blue, green, red. Borders are mirrored without repeating
the edge pixel. A kernel holds one patch, so memory is bounded by the patch size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from tessera.functions.shapes import equalized

BORDER_L, BORDER_GRAY, FEW = 8, 10, 100


def mirror(at: np.ndarray, n: int) -> np.ndarray:
    """Places inside 0..n-1 of places on an axis mirrored at its ends."""
    if n == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * n - 2)
    return np.where(at < n, at, 2 * n - 2 - at)


def padded(img: np.ndarray, r: int) -> np.ndarray:
    h, w = img.shape[:2]
    return img[mirror(np.arange(-r, h + r), h)][:, mirror(np.arange(-r, w + r), w)]


@lru_cache(maxsize=64)
def blur_matrix(n: int, sigma: float, radius: int | None = None) -> np.ndarray:
    """n x n matrix of a Gaussian over four sigmas (or ``radius`` pixels) each way; the mirrored taps are folded into it."""
    r = max(1, round(4 * sigma)) if radius is None else radius
    k = np.arange(-r, r + 1)
    taps = np.exp(-(k**2) / (2 * sigma * sigma))
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), len(k)), mirror(np.arange(n)[:, None] + k, n).reshape(-1)), np.tile(taps / taps.sum(), n))
    return out


def blur(img: np.ndarray, sigma: float, radius: int | None = None) -> np.ndarray:
    """Separable Gaussian as two matrix products, whatever sigma is."""
    return blur_matrix(img.shape[0], float(sigma), radius) @ img.astype(float) @ blur_matrix(img.shape[1], float(sigma), radius).T


def stencil(img: np.ndarray, taps) -> np.ndarray:
    """Weighted sum over (dy, dx, weight)."""
    r = max(max(abs(dy), abs(dx)) for dy, dx, _ in taps)
    pad, (h, w) = padded(img.astype(float), r), img.shape
    return sum(weight * pad[r + dy : r + dy + h, r + dx : r + dx + w] for dy, dx, weight in taps)


SOBEL = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
LAPLACE = [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)]
BOX = [(dy, dx, 1 / 25) for dy in range(-2, 3) for dx in range(-2, 3)]


def gradient(img: np.ndarray) -> np.ndarray:
    """Magnitude of the Sobel gradient."""
    return np.hypot(stencil(img, SOBEL), stencil(img, [(x, y, w) for y, x, w in SOBEL]))


def local_variance(gray: np.ndarray) -> np.ndarray:
    """Mean of squares less square of the mean over 5 x 5, in wrapping 8-bit arithmetic."""
    g = gray.astype(np.int64)
    mean, square = (np.floor(stencil(x, BOX) + 0.5).astype(np.int64) for x in (g, g * g % 256))
    return (square - mean * mean % 256) % 256


# ---- morphology

def disc_rows(side: int) -> list[tuple[int, int]]:
    """(row, half width) of the elliptical element of odd side ``side``."""
    r = side // 2
    return [(dy, round(math.sqrt(r * r - dy * dy))) for dy in range(-r, r + 1)]


def _slide(img: np.ndarray, half: int, op, blank) -> np.ndarray:
    """``op`` over the 2 * half + 1 pixels around each in its row, by doubling."""
    w, size = img.shape[1], 2 * half + 1
    run, length = np.pad(img, ((0, 0), (half, half)), constant_values=blank), 1
    while 2 * length <= size:
        run, length = op(run[:, : run.shape[1] - length], run[:, length:]), 2 * length
    return op(run[:, :w], run[:, size - length : size - length + w])


def extreme(img: np.ndarray, side: int, highest: bool) -> np.ndarray:
    """Greatest (or least) value under an elliptical element; pixels outside do not count."""
    op, blank = (np.maximum, -np.inf) if highest else (np.minimum, np.inf)
    img, h = img.astype(float), img.shape[0]
    rows, slid, out = disc_rows(side), {}, np.full(img.shape, blank)
    for dy, half in rows:
        if half not in slid:
            slid[half] = _slide(img, half, op, blank)
        lo, hi = max(0, -dy), min(h, h - dy)
        if lo < hi:
            out[lo:hi] = op(out[lo:hi], slid[half][lo + dy : hi + dy])
    return out


def closed(img: np.ndarray, side: int) -> np.ndarray:
    return extreme(extreme(img, side, True), side, False)


def opened(img: np.ndarray, side: int) -> np.ndarray:
    return extreme(extreme(img, side, False), side, True)


# ---- colour; fixed values: sRGB primaries for the D65 white, BT.601 luma

_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])
_LUMA = np.array([0.114, 0.587, 0.299])


def byte(x: np.ndarray) -> np.ndarray:
    """Cut to 0..255 and truncated."""
    return np.clip(x, 0, 255).astype(np.uint8)


def gray_of(bgr: np.ndarray) -> np.ndarray:
    return byte(np.floor(bgr @ _LUMA + 0.5))


def lab_of(bgr: np.ndarray) -> np.ndarray:
    """L, a, b as floats on byte scales: L over 100 is 255, a and b are shifted by 128."""
    c = bgr[..., ::-1] / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = linear @ _XYZ.T / _WHITE
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    light = 116 * f[..., 1] - 16
    return np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)


def bgr_of(lab: np.ndarray) -> np.ndarray:
    """Bytes of an image in the scales of ``lab_of``."""
    fy = (lab[..., 0] / 2.55 + 16) / 116
    f = np.stack([fy + (lab[..., 1] - 128) / 500, fy, fy - (lab[..., 2] - 128) / 200], axis=-1)
    xyz = np.where(f > 6 / 29, f**3, (116 * f - 16) * 27 / 24389) * _WHITE
    linear = np.clip(xyz @ np.linalg.inv(_XYZ).T, 0, 1)
    c = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return byte(np.floor(c[..., ::-1] * 255 + 0.5))


def on_lightness(change):
    """A filter of colour images from one of lightness: ``change(L, params)`` gives the new L, or None to leave the image."""

    def run(bgr: np.ndarray, p) -> np.ndarray:
        lab = np.floor(lab_of(bgr) + 0.5)
        new = change(lab[..., 0], p)
        return bgr if new is None else bgr_of(np.concatenate([byte(new)[..., None].astype(float), lab[..., 1:]], axis=-1))

    return run


def _levelled(light: np.ndarray):
    """Valid pixels, their mean, and the image with the others set to it; None if there are too few."""
    ok = light > BORDER_L
    if ok.sum() < FEW:
        return None
    mean = light[ok].mean()
    return ok, mean, np.where(ok, light, mean)


def white_balance(bgr: np.ndarray, p) -> np.ndarray:
    """Every channel's mean becomes the mean of the three; dark images stay."""
    means = bgr.reshape(-1, 3).mean(axis=0)
    return bgr if (means < 1).any() else byte(bgr * (means.mean() / means))


@on_lightness
def illumination(light, p):
    """Lightness over its wide blur, at the old mean."""
    if (got := _levelled(light)) is None:
        return None
    ok, mean, full = got
    return np.where(ok, light / np.maximum(blur(full, p.illumination_sigma), 1) * mean, 0)


@on_lightness
def local_equalisation(light, p):
    """Contrast-limited equalisation, mixed with the image."""
    return equalized(light.astype(np.int64), p.clahe_grid, p.clahe_clip, p.clahe_blend)


def bilateral(img: np.ndarray, d: int, colour: float, space: float) -> np.ndarray:
    """Edge-preserving mean over a disc; colours differ by the sum of the channels' differences."""
    img = img.astype(float).reshape(*img.shape[:2], -1)
    r, (h, w) = d // 2, img.shape[:2]
    pad, total, weight = padded(img, r), np.zeros_like(img), np.zeros((h, w, 1))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                near = pad[r + dy : r + dy + h, r + dx : r + dx + w]
                k = np.exp(-(np.abs(near - img).sum(axis=2, keepdims=True) ** 2) / (2 * colour * colour) - (dy * dy + dx * dx) / (2 * space * space))
                total, weight = total + k * near, weight + k
    return byte(np.floor(total / weight + 0.5))


def denoise(bgr: np.ndarray, p) -> np.ndarray:
    return bilateral(bgr, p.bilateral_d, p.bilateral_colour, p.bilateral_space)


@on_lightness
def retinex(light, p):
    """Mean over the scales of log lightness less log blur, brought to the old mean and spread and mixed with the image."""
    if (got := _levelled(light)) is None:
        return None
    ok, mean, full = got
    detail = np.mean([np.log1p(full) - np.log1p(blur(full, s)) for s in p.retinex_sigmas], axis=0)
    low, high = np.percentile(detail[ok], (1, 99))
    if high - low < 1e-6:
        return None
    # stretching, gain and the return to the old statistics are one linear map; only a flat result shows the stretch
    spread = detail[ok].std()
    scale = 255 / (high - low) * p.retinex_gain
    new = (detail - detail[ok].mean()) / spread * light[ok].std() + mean if spread * scale > 1e-6 else (detail - low) * scale
    return np.where(ok, p.retinex_blend * new + (1 - p.retinex_blend) * light, 0)


@on_lightness
def fade(light, p):
    """What is brighter than the median gives way to its blur."""
    ok = light > BORDER_GRAY
    median = np.median(light[ok]) if ok.any() else p.fade_threshold
    weight = p.fade_strength * blur(np.clip((light - median) / 40, 0, 1), 2.0)
    return light + weight * (blur(light, p.fade_sigma) - light)


@on_lightness
def unsharp(light, p):
    """Adds detail where the gradient is strong against its median."""
    edges, ok = gradient(light), light > BORDER_L
    usual = np.median(edges[ok]) if ok.any() else 1.0
    return light + p.unsharp_strength * (light - blur(light, p.unsharp_sigma)) * np.clip(edges / (2 * usual + 1e-6), 0, 1)


#: the filters by name; a chain is a list of names
FILTERS = {"gray_world_white_balance": white_balance, "illumination_normalize": illumination, "multi_scale_retinex": retinex, "clahe_lab": local_equalisation, "bilateral_denoise": denoise, "sediment_fade": fade, "unsharp_mask": unsharp}


# ---- features of a gray patch

def contrast_ratio(gray: np.ndarray, ok: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """How much darker than its surroundings each pixel is (0..1), and the surroundings."""
    around = blur(np.where(ok, gray, gray[ok].mean() if ok.any() else 0), sigma)
    return np.where(ok, np.clip((around - gray) / np.maximum(around, 1), 0, 1), 0), around


def top_hat(gray: np.ndarray, radii, texture_sigma: float, texture_most: float) -> np.ndarray:
    """Greatest of closing less image over the radii, weakened where the image is grainy."""
    best = np.max([closed(gray, 2 * r + 1) - gray for r in radii], axis=0)
    grain = blur(np.abs(gray - blur(gray, texture_sigma)), 2 * texture_sigma)
    return np.maximum(best, 0) * np.clip(1 - grain / texture_most, 0, 1)


def blobs(gray: np.ndarray, pairs) -> np.ndarray:
    """Greatest scale-normalised difference of Gaussians over pairs of sigmas."""
    return np.max([np.maximum((blur(gray, b) - blur(gray, a)) * (a + b) / 2, 0) for a, b in pairs], axis=0)


def smoothness(gray: np.ndarray, ok: np.ndarray, inner: float, outer: float) -> np.ndarray:
    """1 less fine over coarse variance."""
    g = gray.astype(float)
    fine, coarse = (np.maximum(blur(g * g, s) - blur(g, s) ** 2, 0) for s in (inner, outer))
    return np.where(ok, np.clip(1 - fine / (coarse + 1e-4), 0, 1), 0)


def rescaled(feature: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """0..1 between the second and the 98th percentile of the valid pixels."""
    if ok.sum() < FEW:
        return np.zeros_like(feature)
    low, high = np.percentile(feature[ok], (2, 98))
    return np.where(ok, np.clip((feature - low) / (high - low), 0, 1), 0) if high - low >= 1e-6 else np.zeros_like(feature)


def engineered(bgr: np.ndarray, sigma: float) -> np.ndarray:
    """Lightness, gradient and contrast ratio as byte channels."""
    light = np.floor(lab_of(bgr)[..., 0] + 0.5)
    ratio, _ = contrast_ratio(light, gray_of(bgr) > BORDER_GRAY, sigma)
    return np.stack([byte(light), byte(gradient(light)), byte(ratio * 255)], axis=-1)


# ---- augmentation

def warped(img: np.ndarray, back: np.ndarray, bend: np.ndarray | None = None) -> np.ndarray:
    """The image at ``back`` (2 x 3, from new to old places), plus a field of shifts; nearest pixels, mirrored borders."""
    h, w = img.shape[:2]
    y, x = np.mgrid[:h, :w].astype(float)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy, sx = (back[k, 0] * (y - cy) + back[k, 1] * (x - cx) + back[k, 2] + c for k, c in ((0, cy), (1, cx)))
    if bend is not None:
        sy, sx = sy + bend[0], sx + bend[1]
    return img[mirror(np.rint(sy).astype(int), h), mirror(np.rint(sx).astype(int), w)]


def augmented(img: np.ndarray, mask: np.ndarray, rng: np.random.Generator, s) -> tuple[np.ndarray, np.ndarray]:
    """A random view of image and mask: flips, quarter turns, affine, elastic, brightness and contrast, blur, noise, each with its own chance."""
    for axis in (0, 1):
        if rng.random() < s.flip:
            img, mask = np.flip(img, axis), np.flip(mask, axis)
    if rng.random() < s.turn and img.shape[0] == img.shape[1]:
        k = int(rng.integers(1, 4))
        img, mask = np.rot90(img, k), np.rot90(mask, k)
    if rng.random() < s.affine:
        a, zoom = np.deg2rad(rng.uniform(-s.degrees, s.degrees)), 1 / rng.uniform(1 - s.zoom, 1 + s.zoom)
        shift = rng.uniform(-s.shift, s.shift, 2) * img.shape[:2]
        back = np.array([[zoom * np.cos(a), zoom * np.sin(a), shift[0]], [-zoom * np.sin(a), zoom * np.cos(a), shift[1]]])
        img, mask = warped(img, back), warped(mask, back)
    if rng.random() < s.elastic:
        bend = [s.elastic_alpha * blur(rng.uniform(-1, 1, img.shape[:2]), s.elastic_sigma) for _ in range(2)]
        same = np.array([[1.0, 0, 0], [0, 1, 0]])
        img, mask = warped(img, same, bend), warped(mask, same, bend)
    if rng.random() < s.light:
        img = byte(img * (1 + rng.uniform(-s.contrast, s.contrast)) + 255 * rng.uniform(-s.brightness, s.brightness))
    if rng.random() < s.blur:
        sigma = rng.uniform(0.5, s.blur_sigma)
        img = byte(np.stack([blur(img[..., c], sigma) for c in range(img.shape[2])], axis=-1) + 0.5)
    if rng.random() < s.noise:
        img = byte(img + rng.normal(0, s.noise_std, img.shape) + 0.5)
    return np.ascontiguousarray(img), np.ascontiguousarray(mask)


def pasted(img: np.ndarray, mask: np.ndarray, pieces, rng: np.random.Generator, feather: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pastes (image, mask) cut-outs at random places with soft edges; the masks are joined by the greater value."""
    img, mask = img.copy(), mask.copy()
    h, w = mask.shape
    for piece, shape in pieces:
        ph, pw = shape.shape
        if ph >= h or pw >= w:
            continue
        y, x = int(rng.integers(0, h - ph)), int(rng.integers(0, w - pw))
        inside = shape > 0
        alpha = np.where(inside, np.maximum(blur(inside.astype(float), feather), 0.5), 0)[..., None]
        spot = img[y : y + ph, x : x + pw]
        img[y : y + ph, x : x + pw] = byte(alpha * piece + (1 - alpha) * spot + 0.5)
        mask[y : y + ph, x : x + pw] = np.maximum(mask[y : y + ph, x : x + pw], shape)
    return img, mask
