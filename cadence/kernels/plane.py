"""Kernels over image planes (height x width, or with channels last), numpy only.

Borders: ``reflect`` leaves the edge out (dcb|abcd|cba), ``symmetric`` repeats it, ``edge`` holds it.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: The small Gaussian kernels, whose weights are binary fractions.
SMALL = {3: [1 / 4, 1 / 2, 1 / 4], 5: [1 / 16, 1 / 4, 3 / 8, 1 / 4, 1 / 16], 7: [1 / 32, 7 / 64, 7 / 32, 9 / 32, 7 / 32, 7 / 64, 1 / 32]}


def gray(frame: np.ndarray) -> np.ndarray:
    """Luma of a blue-green-red frame (float32); one plane passes through."""
    if frame.ndim == 2:
        return frame.astype(np.float32)
    return (frame.astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32)).astype(np.float32)


def rounded(x: np.ndarray) -> np.ndarray:
    """To 8 bits, halves up, saturating."""
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def gray8(frame: np.ndarray) -> np.ndarray:
    return rounded(gray(frame))


def gaussian_weights(size: int, sigma: float = 0) -> np.ndarray:
    if not sigma and size in SMALL:
        return np.array(SMALL[size])
    if not size:
        size = int(round(sigma * 8 + 1)) | 1
    sigma = sigma or 0.3 * ((size - 1) / 2 - 1) + 0.8
    x = np.arange(size) - size // 2
    w = np.exp(-x * x / (2 * sigma * sigma))
    return w / w.sum()


def convolve(plane: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Separable correlation, reflected borders."""
    out = plane.astype(np.float64)
    for axis, w in ((0, down), (1, across)):
        if len(w) == 1:
            out = out * w[0]
            continue
        r = len(w) // 2
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        padded = np.pad(out, pad, "reflect" if out.shape[axis] > r else "symmetric")
        n = out.shape[axis]
        out = sum(c * np.take(padded, range(k, k + n), axis) for k, c in enumerate(w))
    return out


def blur(plane: np.ndarray, size: int, sigma: float = 0) -> np.ndarray:
    """Gaussian blur; 8-bit planes stay 8-bit."""
    if plane.dtype == np.uint8 and not sigma and size == 5 and min(plane.shape[:2]) > 2:
        return _blur5(plane)
    w = gaussian_weights(size, sigma)
    out = convolve(plane, w, w)
    return rounded(out) if plane.dtype == np.uint8 else out.astype(np.float32)


def _blur5(plane: np.ndarray) -> np.ndarray:
    """The same in 16-bit integers: the weights are sixteenths, and 255 * 256 + 128 still fits."""
    out = plane.astype(np.uint16)
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (2, 2)
        p, n = np.pad(out, pad, "reflect"), out.shape[axis]
        a, b, c, d, e = (p[(slice(None),) * axis + (slice(k, k + n),)] for k in range(5))
        out = (a + e) + ((b + d) << 2) + (c << 2) + (c << 1)
    return ((out + 128) >> 8).astype(np.uint8)


def sobel(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients across and down."""
    smooth, slope = np.array([1.0, 2, 1]), np.array([-1.0, 0, 1])
    return convolve(plane, smooth, slope), convolve(plane, slope, smooth)


def laplacian(plane: np.ndarray) -> np.ndarray:
    """The 3 x 3 form with 2 at the corners and -8 in the middle."""
    side, ones = np.array([1.0, 0, 1]), np.array([1.0])
    return 2 * convolve(plane, side, side) - 8 * convolve(plane, ones, ones)


def _moving(plane: np.ndarray, height: int, width: int, best: np.ufunc, outside: float) -> np.ndarray:
    a, b = height // 2, width // 2
    padded = np.pad(plane, ((a, height - 1 - a), (b, width - 1 - b)), constant_values=outside)
    rows = best.reduce([padded[k : k + plane.shape[0]] for k in range(height)])
    return best.reduce([rows[:, k : k + plane.shape[1]] for k in range(width)])


def _least(plane: np.ndarray, low: bool) -> float:
    if plane.dtype == bool:
        return low
    info = np.iinfo(plane.dtype) if plane.dtype.kind in "ui" else np.finfo(plane.dtype)
    return info.max if low else info.min


def erode(plane: np.ndarray, height: int, width: int | None = None) -> np.ndarray:
    """Least value of a rectangle around each place; what is outside doesn't count."""
    return _moving(plane, height, width or height, np.minimum, _least(plane, True))


def dilate(plane: np.ndarray, height: int, width: int | None = None) -> np.ndarray:
    return _moving(plane, height, width or height, np.maximum, _least(plane, False))


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return dilate(erode(mask, size), size)


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    return erode(dilate(mask, size), size)


def moving_median(plane: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Median along one axis, edges repeated."""
    r = size // 2
    pad = [(0, 0)] * plane.ndim
    pad[axis] = (r, r)
    return np.median(sliding_window_view(np.pad(plane, pad, "symmetric"), size, axis), -1)


def median3(frame: np.ndarray) -> np.ndarray:
    """Median of 3 x 3, edges held, by channel."""
    padded = np.pad(frame, ((1, 1), (1, 1), *[(0, 0)] * (frame.ndim - 2)), "edge")
    h, w = frame.shape[:2]
    return np.median([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)], 0).astype(frame.dtype)


def area_matrix(n: int, to: int) -> np.ndarray:
    """Weights (to x n) with which n cells are averaged into ``to`` of equal size."""
    edges = np.arange(to + 1) * n / to
    cells = np.arange(n)
    part = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.maximum(part, 0) * to / n


def shrink(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average."""
    return area_matrix(plane.shape[0], height) @ plane.astype(np.float64) @ area_matrix(plane.shape[1], width).T


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def perceptual_hash(frame: np.ndarray) -> int:
    """64 bits, first coefficient highest: which of the 8 x 8 lowest cosine coefficients are above their median."""
    y = np.floor(frame.astype(np.float64) @ np.array([0.114, 0.587, 0.299]) + 0.5) if frame.ndim == 3 else frame
    basis = dct_matrix(32)[:8]
    low = (basis @ rounded(shrink(y, 32, 32)).astype(np.float64) @ basis.T).ravel()
    return int("".join("1" if b else "0" for b in low > np.median(low)), 2)


def _sums7(z: np.ndarray, axis: int) -> np.ndarray:
    """Sums of seven values side by side."""
    c = np.cumsum(z, axis)
    n = c.shape[axis]
    first, rest = np.take(c, [6], axis), np.take(c, range(7, n), axis) - np.take(c, range(n - 7), axis)
    return np.concatenate([first, rest], axis)


def block_similarity(a: np.ndarray, b: np.ndarray, block: int = 32, flat: float = 2.0) -> float:
    """Mean structural similarity of whole blocks of two 8-bit planes (7 x 7 windows); blocks that are flat in both go by their difference. No block: 1."""
    h, w = (x // block * block for x in a.shape)
    if not h or not w:
        return 1.0
    cut = lambda x: x[:h, :w].astype(np.float64).reshape(h // block, block, w // block, block).swapaxes(1, 2).reshape(-1, block, block)
    x, y = cut(a), cut(b)
    plain = (x.std((1, 2)) < flat) & (y.std((1, 2)) < flat)
    out = np.maximum(0.0, 1 - np.abs(x - y).mean((1, 2)) / 255)
    if not plain.all():
        x, y = x[~plain], y[~plain]
        mean = lambda z: _sums7(_sums7(z, 1), 2) / 49
        mx, my = mean(x), mean(y)
        scale = 49 / 48
        vx, vy, vxy = (scale * (mean(p * q) - mp * mq) for p, q, mp, mq in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
        c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
        s = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
        out[~plain] = s.mean((1, 2))
    return float(out.mean())


def components(mask: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Labels (0: none) of the 8-connected parts, and area, top, left, height, width of each (from label 1).

    Runs of each row are joined with those of the row above that they touch; the joins settle by least labels.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    if not n:
        return np.zeros((h, w), np.int32), {k: np.zeros(0, np.int64) for k in ("area", "top", "left", "height", "width")}
    # touching: same column or one beside; keys grow with row, then column
    wide = w + 2
    first = np.searchsorted(row * wide + end, (row - 1) * wide + begin, "left")
    last = np.searchsorted(row * wide + begin, (row - 1) * wide + end, "right")
    count = np.maximum(last - first, 0)
    u = np.repeat(np.arange(n), count)
    v = np.arange(len(u)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    same = row[v] == row[u] - 1
    u, v = u[same], v[same]
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    _, label = np.unique(label, return_inverse=True)
    out = np.zeros((h, w + 1), np.int32)
    np.add.at(out, (row, begin), label + 1)
    np.add.at(out, (row, end), -(label + 1))
    parts = int(label.max()) + 1
    area = np.bincount(label, end - begin, parts).astype(np.int64)
    extreme = lambda x, f, start: f.at(s := np.full(parts, start), label, x) or s
    top, left = extreme(row, np.minimum, h), extreme(begin, np.minimum, w)
    bottom, right = extreme(row, np.maximum, -1), extreme(end, np.maximum, -1)
    return out.cumsum(1)[:, :w].astype(np.int32), {"area": area, "top": top, "left": left, "height": bottom - top + 1, "width": right - left}


def canny(plane: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thin edges of an 8-bit plane: weak ones stay where they touch strong ones."""
    gx, gy = sobel(plane)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    tan = np.tan(np.pi / 8)
    flat, steep = np.abs(gy) < tan * np.abs(gx), np.abs(gx) < tan * np.abs(gy)
    rising = gx * gy < 0
    one = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(rising, at(-1, 1), at(-1, -1))))
    two = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(rising, at(1, -1), at(1, 1))))
    peak = (size > low) & (size > one) & (size >= two)
    labels, _ = components(peak)
    strong = np.unique(labels[peak & (size > high)])
    return peak & np.isin(labels, strong[strong > 0])


def line_art(frame: np.ndarray, grow: int = 3) -> np.ndarray:
    """Dark lines: where the difference of two Gaussians dips, in parts of 12 pixels or more, grown."""
    y = gray(frame)
    dark = blur(y, 0, 1.4) - 0.98 * blur(y, 0, 2.24) < -0.3
    labels, stats = components(opened(dark, 2))
    kept = np.concatenate([[False], stats["area"] >= 12])[labels]
    return dilate(kept, grow) if grow > 1 else kept


def warp(plane: np.ndarray, matrix: np.ndarray, lanczos: bool = False, outside: float | None = None) -> np.ndarray:
    """The plane read at matrix @ (x, y, 1): linear or Lanczos of 4 lobes; edges held, or ``outside``."""
    h, w = plane.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    sx, sy = (m[0] * x + m[1] * y + m[2] for m in np.asarray(matrix, np.float64))
    lobes = 4 if lanczos else 1
    fx, fy = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)

    def weights(t: np.ndarray) -> list[np.ndarray]:
        d = [t - k for k in range(1 - lobes, lobes + 1)]
        out = [np.sinc(v) * np.sinc(v / 4) if lanczos else 1 - np.abs(v) for v in d]
        total = sum(out)
        return [v / total for v in out]

    wx, wy = weights(sx - fx), weights(sy - fy)
    data = plane.astype(np.float64).reshape(h, w, -1)
    out = np.zeros(data.shape)
    for j in range(2 * lobes):
        row = np.clip(fy + j + 1 - lobes, 0, h - 1)
        line = sum(wx[i][..., None] * data[row, np.clip(fx + i + 1 - lobes, 0, w - 1)] for i in range(2 * lobes))
        out += wy[j][..., None] * line
    if outside is not None:
        out[(sx < 0) | (sy < 0) | (sx > w - 1) | (sy > h - 1)] = outside
    return out.reshape(plane.shape).astype(np.float32)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy) by which b's content lies from a's, and how clear the peak is (0 to 1)."""
    cross = np.conj(np.fft.rfft2(a)) * np.fft.rfft2(b)
    peak = np.fft.fftshift(np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), a.shape))
    y, x = np.unravel_index(int(peak.argmax()), peak.shape)
    ys, xs = (np.arange(max(c - 2, 0), min(c + 3, n)) for c, n in zip((y, x), peak.shape, strict=True))
    near = np.maximum(peak[np.ix_(ys, xs)], 0)
    mass = near.sum()
    return float((near.sum(0) * xs).sum() / mass - peak.shape[1] // 2), float((near.sum(1) * ys).sum() / mass - peak.shape[0] // 2), float(mass)


def correlate_warp(target: np.ndarray, source: np.ndarray, euclidean: bool, rounds: int, start: np.ndarray | None = None, eps: float = 1e-5) -> np.ndarray | None:
    """The matrix whose warp of ``source`` correlates best with ``target`` (Gauss-Newton on the normalised planes); None if it doesn't converge to one."""
    a, b = (blur(x.astype(np.float32), 5).astype(np.float64) for x in (target, source))
    m = np.eye(2, 3) if start is None else np.array(start, np.float64)
    gx, gy = (g / 8 for g in sobel(b))
    y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]].astype(np.float64)
    last = -2.0
    for _ in range(rounds):
        seen = warp(np.ones_like(b, np.float32), m, outside=0.0) > 0.5
        if seen.sum() < 64:
            return None
        v, dx, dy = (warp(p, m).astype(np.float64)[seen] for p in (b, gx, gy))
        t = a[seen] - a[seen].mean()
        v = v - v.mean()
        norm_t, norm_v = np.linalg.norm(t), np.linalg.norm(v)
        if norm_t < 1e-9 or norm_v < 1e-9:
            return None
        rho = float(t @ v / (norm_t * norm_v))
        if abs(rho - last) < eps:
            break
        last = rho
        px, py = x[seen], y[seen]
        if euclidean:
            angle = np.arctan2(m[1, 0], m[0, 0])
            c, s = np.cos(angle), np.sin(angle)
            jac = np.stack([dx * (-px * s - py * c) + dy * (px * c - py * s), dx, dy], 1)
        else:
            jac = np.stack([dx * px, dy * px, dx * py, dy * py, dx, dy], 1)
        jac -= jac.mean(0)
        step, *_ = np.linalg.lstsq(jac.T @ jac, jac.T @ (t * norm_v / norm_t - v), rcond=None)
        if not np.isfinite(step).all():
            return None
        if euclidean:
            c, s = np.cos(angle + step[0]), np.sin(angle + step[0])
            m = np.array([[c, -s, m[0, 2] + step[1]], [s, c, m[1, 2] + step[2]]])
        else:
            m = m + np.array([[step[0], step[2], step[4]], [step[1], step[3], step[5]]])
    return m


def local_means(frame: np.ndarray, strength: float, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it, weighted by how alike their surroundings are."""
    data = frame.astype(np.float32).reshape(*frame.shape[:2], -1)
    r, t = search // 2, template // 2
    h, w = data.shape[:2]
    padded = np.pad(data, ((r, r), (r, r), (0, 0)), "reflect" if min(h, w) > r else "symmetric")
    total, weight = np.zeros_like(data), np.zeros((h, w), np.float32)
    box = np.full(2 * t + 1, 1 / (2 * t + 1))
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            other = padded[dy : dy + h, dx : dx + w]
            far = convolve(((data - other) ** 2).mean(-1), box, box)
            g = np.exp(-np.maximum(far, 0) / (strength * strength)).astype(np.float32)
            total += g[..., None] * other
            weight += g
    return rounded(total / weight[..., None]).reshape(frame.shape)
