"""Image kernels on arrays (numpy) for use inside mapInPandas: similarity signals, depth, masks, projection."""

from __future__ import annotations

import numpy as np


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def half_size(a: np.ndarray, nearest: bool = False) -> np.ndarray:
    """Every second pixel, or the mean of two by two; odd sizes round half to even, an edge repeated if need be."""
    h, w = 2 * round(a.shape[0] / 2), 2 * round(a.shape[1] / 2)
    if h > a.shape[0] or w > a.shape[1]:
        a = np.pad(a, ((0, max(0, h - a.shape[0])), (0, max(0, w - a.shape[1]))) + ((0, 0),) * (a.ndim - 2), mode="edge")
    if nearest:
        return a[0:h:2, 0:w:2]
    return (a[0:h:2, 0:w:2].astype(float) + a[1:h:2, 0:w:2] + a[0:h:2, 1:w:2] + a[1:h:2, 1:w:2]) / 4


def resized(a: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """The nearest pixel at or before each place of a grid of ``size``."""
    return a[np.ix_(*(np.arange(n) * m // n for n, m in zip(size, a.shape[:2], strict=True)))]


def _blur(a: np.ndarray, size: int = 7, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    pad = np.pad(a, size // 2, mode="reflect")
    rows = sum(k[i] * pad[:, i : i + a.shape[1]] for i in range(size))
    return sum(k[i] * rows[i : i + a.shape[0]] for i in range(size))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of two gray images of 0 to 255."""
    a, b = a.astype(float), b.astype(float)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = _blur(a), _blur(b)
    va, vb, cov = _blur(a * a) - ma * ma, _blur(b * b) - mb * mb, _blur(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def sharpness(a: np.ndarray) -> float:
    """Variance of the Laplacian."""
    p = np.pad(a.astype(float), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def sharpness_ratio(a: np.ndarray, b: np.ndarray) -> float:
    """The smaller sharpness over the larger; 1 where neither image has any."""
    x, y = sharpness(a), sharpness(b)
    return 1.0 if max(x, y) < 1e-6 else min(x, y) / max(x, y)


def hue_histogram(rgb: np.ndarray, bins: tuple[int, int] = (30, 32)) -> np.ndarray:
    x = rgb[..., :3].reshape(-1, 3).astype(float)
    top, low = x.max(axis=1), x.min(axis=1)
    d = np.where(top > low, top - low, 1)
    r, g, b = x.T
    hue = np.where(top == r, (g - b) / d % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) / 6 % 1 * (top > low)
    sat = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    h, _, _ = np.histogram2d(hue, sat, bins=bins, range=((0, 1), (0, 1.0000001)))
    return h.ravel() / max(len(x), 1)


def color_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of hue and saturation histograms, as 0 to 1."""
    x, y = hue_histogram(a), hue_histogram(b)
    x, y = x - x.mean(), y - y.mean()
    den = np.sqrt((x @ x) * (y @ y))
    return float((x @ y / den + 1) / 2) if den > 0 else 1.0


def log_hu(mask: np.ndarray) -> np.ndarray:
    """Logarithms of the seven moment invariants of a mask."""
    y, x = np.nonzero(mask)
    m = max(len(x), 1)
    dx, dy = x - x.mean() if len(x) else x, y - y.mean() if len(y) else y

    def n(p, q):
        return float((dx**p * dy**q).sum()) / m ** (1 + (p + q) / 2)

    a, b, c, d = n(3, 0) + n(1, 2), n(2, 1) + n(0, 3), n(3, 0) - 3 * n(1, 2), 3 * n(2, 1) - n(0, 3)
    s, t, u = n(2, 0) + n(0, 2), n(2, 0) - n(0, 2), n(1, 1)
    hu = np.array([s, t**2 + 4 * u**2, c**2 + d**2, a**2 + b**2, c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2), t * (a**2 - b**2) + 4 * u * a * b, d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2)])
    return -np.sign(hu) * np.log10(np.abs(hu) + 1e-12)


def mask_iou(a: np.ndarray, b: np.ndarray) -> float:
    union = np.logical_or(a, b).sum()
    return float(np.logical_and(a, b).sum() / union) if union else 0.0


def shape_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """0.6 overlap and 0.4 nearness of the moment invariants."""
    return 0.6 * mask_iou(a, b) + 0.4 * float(np.exp(-np.abs(log_hu(a) - log_hu(b)).mean() / 3))


def clip_outliers(depth: np.ndarray, share: float = 98.0) -> np.ndarray:
    """Depths above the percentile of the positive ones become 0."""
    good = depth[depth > 0]
    return depth if not len(good) else np.where(depth > np.percentile(good, share), 0, depth)


def median_depth(depth: np.ndarray, box: tuple, inner: float = 0.8, least: int = 16, image: tuple | None = None) -> float | None:
    """Median of valid depths (0.05 to 20) in the inner part of a box, scaled to the depth's grid."""
    h, w = depth.shape
    sy, sx = (h / image[0], w / image[1]) if image else (1.0, 1.0)
    x1, y1, x2, y2 = box[0] * sx, box[1] * sy, box[2] * sx, box[3] * sy
    mx, my = (x2 - x1) * (1 - inner) / 2, (y2 - y1) * (1 - inner) / 2
    part = depth[max(0, int(y1 + my)) : max(0, int(np.ceil(y2 - my))), max(0, int(x1 + mx)) : max(0, int(np.ceil(x2 - mx)))]
    good = part[np.isfinite(part) & (part > 0.05) & (part < 20)]
    return float(np.median(good)) if len(good) >= least else None


def project(points: np.ndarray, k: np.ndarray, world_to_camera: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """A mask of where world points fall in an image; points behind the camera do not."""
    cam = points @ world_to_camera[:3, :3].T + world_to_camera[:3, 3]
    cam = cam[cam[:, 2] > 1e-6]
    uv = cam @ k.T
    x, y = np.rint(uv[:, 0] / uv[:, 2]).astype(int), np.rint(uv[:, 1] / uv[:, 2]).astype(int)
    ok = (x >= 0) & (x < size[1]) & (y >= 0) & (y < size[0])
    out = np.zeros(size, bool)
    out[y[ok], x[ok]] = True
    return out


def dilate(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    p = np.pad(mask, radius)
    h, w = mask.shape
    return np.logical_or.reduce([p[i : i + h, j : j + w] for i in range(2 * radius + 1) for j in range(2 * radius + 1)])


def closed(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    """Dilation, then erosion."""
    return ~dilate(~dilate(mask, radius), radius)
