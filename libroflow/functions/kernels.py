"""Pixel kernels on numpy arrays: grey images of bytes, dark ink on light ground.

Windows reach over the edges by repeating the edge pixels. They stand in for a native image library where there is none;
medians of large windows are the slow ones.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def _windows(img: np.ndarray, k: int) -> np.ndarray:
    return sliding_window_view(np.pad(img, k // 2, mode="edge"), (k, k))


def dilate(img: np.ndarray, k: int) -> np.ndarray:
    """The largest pixel of each k x k window; rows and columns one after the other."""
    return -erode(-img.astype(np.int16), k)


def erode(img: np.ndarray, k: int) -> np.ndarray:
    """The smallest pixel of each k x k window."""
    wide = np.pad(img, ((0, 0), (k // 2, k // 2)), mode="edge")
    rows = sliding_window_view(wide, k, axis=1).min(axis=-1)
    return sliding_window_view(np.pad(rows, ((k // 2, k // 2), (0, 0)), mode="edge"), k, axis=0).min(axis=-1)


def median(img: np.ndarray, k: int) -> np.ndarray:
    """The middle pixel of each k x k window, a band of rows at a time."""
    win = _windows(img, k)
    return np.concatenate([np.median(win[i : i + 32].reshape(min(32, len(win) - i), win.shape[1], -1), axis=-1) for i in range(0, len(win), 32)]).astype(img.dtype)


def stretched(img: np.ndarray, low: float = 0.0, high: float = 255.0) -> np.ndarray:
    """Values stretched to span low to high; an even image becomes all low."""
    span = float(img.max()) - float(img.min())
    return np.rint((img - float(img.min())) / span * (high - low) + low).astype(np.uint8) if span else np.full(img.shape, low, np.uint8)


def grey(planes: np.ndarray) -> np.ndarray:
    """Height x width x 3 (blue, green, red) to grey by the usual luma weights."""
    return np.rint(planes @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def without_ground(planes: np.ndarray, grow: int = 7, blur: int = 21) -> np.ndarray:
    """The ink of a colour image on an even ground: in each plane, the difference from the blurred ground, stretched."""
    out = []
    for p in np.moveaxis(planes, -1, 0):
        ground = median(dilate(p, grow), blur).astype(np.int16)
        out.append(stretched(255 - np.abs(p.astype(np.int16) - ground)))
    return grey(np.stack(out, axis=-1))


def otsu(img: np.ndarray) -> int:
    """The threshold that parts the values into the two most different classes; ink is at or below it."""
    n = np.bincount(img.ravel(), minlength=256).astype(np.float64)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * w / w[-1] - s) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1.0)))


def local_threshold(img: np.ndarray, block: int, below: float) -> np.ndarray:
    """Whether each pixel is darker than the Gaussian mean of its block less `below`."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    g /= g.sum()
    wide = np.pad(img.astype(np.float64), block // 2, mode="edge")
    mean = sliding_window_view(sliding_window_view(wide, block, axis=1) @ g, block, axis=0) @ g
    return img < mean - below


def closed(mask: np.ndarray, k: int = 3) -> np.ndarray:
    """Small gaps between strokes filled."""
    return erode(dilate(mask.astype(np.int16), k), k) > 0


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(left, top, right, bottom, area) of the 8-connected regions, by joining the runs of neighbouring rows."""
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    runs, before = [], []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            parent.append(at := len(parent))
            for c, d, other in before:
                if c <= b and a <= d:  # corners touch
                    parent[find(other)] = find(at)
            here.append((a, b, at))
            runs.append((y, a, b, at))
        before = here
    out: dict[int, list[int]] = {}
    for y, a, b, at in runs:
        box = out.setdefault(find(at), [a, y, b, y + 1, 0])
        box[:] = [min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1), box[4] + b - a]
    return sorted(map(tuple, out.values()), key=lambda b: (b[1], b[0]))


def page_components(img: np.ndarray, least: int = 100, most: int = 50_000) -> list[tuple[int, int, int, int]]:
    """Boxes of the page's strokes whose area is within bounds. (Contrast is evened by the local threshold alone.)"""
    return [b[:4] for b in components(closed(local_threshold(img, 25, 30))) if least <= b[4] <= most]


def folio_box(img: np.ndarray, least: int = 10_000, pad: int = 20) -> tuple[int, int, int, int] | None:
    """The box of the largest region, widened by `pad`; None where none is larger than `least`."""
    mask = local_threshold(stretched(img, 50), 11, 2)
    found = [b for b in components(dilate(erode(mask.astype(np.int16), 5), 5) > 0) if b[4] > least]
    if not found:
        return None
    a, t, b, u, _ = max(found, key=lambda x: x[4])
    return max(0, a - pad), max(0, t - pad), min(img.shape[1], b + pad), min(img.shape[0], u + pad)


def rotated(img: np.ndarray, degrees: float, fill: int) -> np.ndarray:
    """Turned counter-clockwise about the middle, nearest pixels, the size kept."""
    h, w = img.shape
    r, y, x = math.radians(degrees), *np.mgrid[0:h, 0:w]
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sx, sy = np.rint(math.cos(r) * dx - math.sin(r) * dy + (w - 1) / 2).astype(int), np.rint(math.sin(r) * dx + math.cos(r) * dy + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full(img.shape, fill, img.dtype)
    out[inside] = img[sy[inside], sx[inside]]
    return out


def level_angle(img: np.ndarray, angles: range = range(-10, 10)) -> int:
    """The angle at which the ink of the rows differs most, the first among equals."""
    return max(angles, key=lambda a: (np.std((255.0 - rotated(img, a, 255)).sum(axis=1)), -a))


def line_score(ink: np.ndarray) -> float:
    """How unlike even lines of writing the rows' ink is: spread of heights and cubed spread of distances of its peaks and
    troughs, against their contrast and number; infinite where there are too few."""
    inner = ink[1:-1]
    up = np.flatnonzero((inner > ink[:-2]) & (inner > ink[2:])) + 1
    down = np.flatnonzero((inner < ink[:-2]) & (inner < ink[2:])) + 1
    if len(up) < 3 or len(down) < 3:
        return math.inf
    contrast = (ink[up].mean() - ink[down].mean()) ** 3 * len(up) ** 4 * len(down) ** 4
    spread = (np.std(ink[up]) + np.std(ink[down])) * (np.std(np.diff(up)) + np.std(np.diff(down))) ** 3
    return float(abs(spread / contrast)) if contrast else math.inf


def sheared(mask: np.ndarray, s: float, fill: int = 0) -> np.ndarray:
    """Each row moved by s times its height above the base, to the right for positive s."""
    h, w = mask.shape
    shift = np.rint(s * np.arange(h) + max(-h * s, 0)).astype(int)
    out = np.full((h, w + int(abs(h * s)) + 1), fill, mask.dtype)
    for y in range(h):
        out[y, shift[y] : shift[y] + w] = mask[y, : out.shape[1] - shift[y]]
    return out


def upright_score(mask: np.ndarray) -> int:
    """Squared heights of the columns whose ink is in one piece."""
    some = mask.any(axis=0)
    first, last, n = mask.argmax(axis=0), mask.shape[0] - mask[::-1].argmax(axis=0), mask.sum(axis=0)
    tall = (last - first)[some & (last - first == n)]
    return int((tall.astype(np.int64) ** 2).sum())


def deslant(img: np.ndarray, bounds: tuple[float, float] = (-2.0, 2.0), steps: int = 20) -> tuple[float, np.ndarray]:
    """The shear that makes the writing most upright, the first among equals, and the image sheared by it."""
    mask = img <= otsu(img)
    tries = [bounds[0] + i * (bounds[1] - bounds[0]) / steps for i in range(steps + 1)]
    best = max(tries, key=lambda s: (upright_score(sheared(mask, s)), -tries.index(s)))
    return best, sheared(img, best, 255)


def blank_rows(img: np.ndarray, quantile: float = 0.1) -> np.ndarray:
    """Rows that are nine tenths white in their left half and in their last tenth."""
    white = img > np.quantile(img, quantile)
    w = img.shape[1]
    return (white[:, : w // 2].sum(axis=1) >= 0.9 * (w // 2)) & (white[:, -math.ceil(w * 0.1) :].sum(axis=1) >= 0.9 * (w // 10))


def signature_rows(img: np.ndarray, least: int = 100) -> list[tuple[int, int]]:
    """(first, last) of the runs of at least `least` blank rows, where a signature ends an entry."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], blank_rows(img).astype(np.int8), [0]])))
    return [(a, b - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def shrunk(width: int, height: int, size: int, most: int = 3_000_000, ratio: float = 0.75) -> tuple[int, int]:
    """Width and height after as many steps as bring the size, taken as proportional to the area, to `most`."""
    while size > most:
        to = round(width * ratio), round(height * ratio)
        size = int(size * (to[0] * to[1]) / (width * height))
        width, height = to
    return width, height
