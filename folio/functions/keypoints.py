"""Keypoints of a grey image: corners over scales, turned binary descriptors. Matching them is for DataFrames."""

from __future__ import annotations

import numpy as np

from folio.functions.raster import resize_bicubic

#: Three scales an octave, down to pages this small; strongest corners kept at each.
STEP, SMALLEST, STRONGEST = 2 ** (1 / 3), 40, 500
#: Reach of a descriptor's points and of the patch that tells its direction, in pixels of its scale.
REACH, AROUND = 13, 9
#: Bits of a descriptor, in longs.
BITS, LONGS = 256, 4


def blurred(f: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, round(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(f, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        f = sum(w * np.take(p, np.arange(i, i + f.shape[axis]), axis=axis) for i, w in enumerate(k))
    return f


def corners(f: np.ndarray, strongest: int = STRONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Places (y, x) of local maxima of the lesser curvature, strongest first, away from the edge."""
    gy, gx = np.gradient(f)
    xx, yy, xy = blurred(gx * gx, 2), blurred(gy * gy, 2), blurred(gx * gy, 2)
    strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    edge = REACH + 2
    top = strength[1:-1, 1:-1]
    peak = np.ones(top.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                beside = strength[1 + dy : strength.shape[0] - 1 + dy, 1 + dx : strength.shape[1] - 1 + dx]
                peak &= top > beside if (dy, dx) > (0, 0) else top >= beside
    peak = np.pad(peak, 1)
    peak[:edge], peak[-edge:], peak[:, :edge], peak[:, -edge:] = False, False, False, False
    y, x = np.nonzero(peak & (strength > max(1.0, 0.01 * strength.max(initial=0))))
    order = np.argsort(-strength[y, x], kind="stable")[:strongest]
    return y[order], x[order]


def _points() -> np.ndarray:
    """Pairs of places that a descriptor compares: (2, BITS, x and y), the same ones always."""
    p = np.random.RandomState(7).normal(0, REACH / 2, (2, BITS, 2))
    return np.clip(p, -REACH / 2**0.5, REACH / 2**0.5)


PAIRS = _points()
_DY, _DX = (g.ravel() for g in np.mgrid[-AROUND : AROUND + 1, -AROUND : AROUND + 1])
_ROUND = _DY**2 + _DX**2 <= AROUND**2
_DY, _DX = _DY[_ROUND], _DX[_ROUND]


def described(f: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Direction (towards the patch's bright side) and bits of each place: angles, longs (n, LONGS)."""
    patch = f[y[:, None] + _DY, x[:, None] + _DX]
    angle = np.arctan2((patch * _DY).sum(1), (patch * _DX).sum(1))
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    value = []
    for p in PAIRS:
        px = x[:, None] + c * p[:, 0] - s * p[:, 1]
        py = y[:, None] + s * p[:, 0] + c * p[:, 1]
        x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
        u, v = px - x0, py - y0
        at = lambda i, j: f[y0 + i, x0 + j]  # noqa: B023, E731
        value.append((1 - v) * ((1 - u) * at(0, 0) + u * at(0, 1)) + v * ((1 - u) * at(1, 0) + u * at(1, 1)))
    bits = np.packbits(value[0] < value[1], axis=1)
    return angle, np.ascontiguousarray(bits).view(np.int64).reshape(-1, LONGS)


def keypoints(image: np.ndarray, strongest: int = STRONGEST) -> tuple[np.ndarray, ...]:
    """x, y, size (of a pixel of its scale), angle and descriptor (longs) of a grey image's keypoints."""
    found, size, h, w = [], 1.0, *image.shape
    while min(h, w) / size >= SMALLEST:
        shape = round(w / size), round(h / size)
        small = image.astype(float) if size == 1 else resize_bicubic(image, shape).astype(float)
        smooth = blurred(small, 1.6)
        y, x = corners(smooth, strongest)
        if len(x):
            angle, bits = described(smooth, y, x)
            fx, fy = w / shape[0], h / shape[1]
            found.append(((x + 0.5) * fx, (y + 0.5) * fy, np.full(len(x), size), angle, bits))
        size *= STEP
    if not found:
        return np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((0, LONGS), np.int64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(5))


def warped(image: np.ndarray, a: tuple[float, ...], size: tuple[int, int], side: int = 64) -> np.ndarray:
    """The part of ``image`` that an affine map (x' = a0 x + a1 y + a2, y' = a3 x + a4 y + a5) takes a picture of ``size`` to, as a square."""
    x, y = np.meshgrid((np.arange(side) + 0.5) * size[0] / side, (np.arange(side) + 0.5) * size[1] / side)
    px, py = a[0] * x + a[1] * y + a[2] - 0.5, a[3] * x + a[4] * y + a[5] - 0.5
    px, py = np.clip(px, 0, image.shape[1] - 1.001), np.clip(py, 0, image.shape[0] - 1.001)
    x0, y0 = px.astype(int), py.astype(int)
    u, v, f = px - x0, py - y0, image.astype(float)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    return (1 - v) * ((1 - u) * f[y0, x0] + u * f[y0, x1]) + v * ((1 - u) * f[y1, x0] + u * f[y1, x1])
