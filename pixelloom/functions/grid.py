"""Numpy kernels over one image (height x width x channels); they run inside Arrow batches on the executors.

border: `symmetric` repeats the edge, `reflect` doesn't, `zero` fills with zeros.
"""

from __future__ import annotations

import numpy as np

#: The three high-pass residual kernels and their divisors.
RESIDUALS = (
    (4.0, [[0, 0, 0, 0, 0], [0, -1, 2, -1, 0], [0, 2, -4, 2, 0], [0, -1, 2, -1, 0], [0, 0, 0, 0, 0]]),
    (12.0, [[-1, 2, -2, 2, -1], [2, -6, 8, -6, 2], [-2, 8, -12, 8, -2], [2, -6, 8, -6, 2], [-1, 2, -2, 2, -1]]),
    (2.0, [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 1, -2, 1, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]),
)
#: The high-pass decomposition filter of the 8-tap Daubechies wavelet.
WAVELET = (
    -0.0544158422, 0.3128715909, -0.6756307363, 0.5853546837, 0.0158291053, -0.2840155430, -0.0004724846, 0.1287474266,
    0.0173693010, -0.0440882539, -0.0139810279, 0.0087460940, 0.0048703530, -0.0003917404, -0.0006754494, -0.0001174768,
)


def as_image(px, h: int, w: int, c: int = 1) -> np.ndarray:
    return np.asarray(px, np.float64).reshape(h, w, c)


def pad(x: np.ndarray, r: int, border: str = "symmetric") -> np.ndarray:
    around = [(r, r), (r, r)] + [(0, 0)] * (x.ndim - 2)
    return np.pad(x, around) if border == "zero" else np.pad(x, around, mode=border)


def windows(x: np.ndarray, size: int, stride: int = 1, dilate: int = 1) -> np.ndarray:
    """Valid windows in raster order: rows x columns x size^2 x channels."""
    reach = (size - 1) * dilate + 1
    v = np.lib.stride_tricks.sliding_window_view(x, (reach, reach), axis=(0, 1))[::stride, ::stride, :, ::dilate, ::dilate]
    v = np.moveaxis(v, 2, -1)
    return v.reshape(*v.shape[:2], size * size, v.shape[-1])


def pool(x: np.ndarray, how: str = "max", k: int = 2) -> np.ndarray:
    """k x k blocks; odd edges are filled with zeros first."""
    h, w = -x.shape[0] % k, -x.shape[1] % k
    x = np.pad(x, [(0, h), (0, w)] + [(0, 0)] * (x.ndim - 2))
    v = x.reshape(x.shape[0] // k, k, x.shape[1] // k, k, *x.shape[2:])
    return v.max(axis=(1, 3)) if how == "max" else v.mean(axis=(1, 3))


def gather(x: np.ndarray, size: int = 5, border: str | None = "symmetric", pool_first: str | None = None, stride: int = 1, pool_after: str | None = None) -> np.ndarray:
    """Neighbourhood features of every pixel: optional pooling, padding, windows, flattened to one axis, optional pooling."""
    if pool_first:
        x = pool(x, pool_first)
    if border:
        x = pad(x, size // 2, border)
    v = windows(x, size, stride)
    v = v.reshape(*v.shape[:2], -1)
    return pool(v, pool_after) if pool_after else v


def ungather(v: np.ndarray, size: int) -> np.ndarray:
    """Back from windows that don't overlap (stride = size)."""
    h, w = v.shape[:2]
    c = v.shape[2] // (size * size)
    v = v.reshape(h, w, size, size, c)
    return v.transpose(0, 2, 1, 3, 4).reshape(h * size, w * size, c)


def neighbours(x: np.ndarray, reach: int = 1, dilate: int = 1, border: str = "reflect", centre_last: bool = True) -> np.ndarray:
    """Dilated (2 reach + 1)^2 neighbourhoods; the centre stands last, or in raster order."""
    size = 2 * reach + 1
    v = windows(pad(x, reach * dilate, border), size, 1, dilate)
    if centre_last:
        mid = size * size // 2
        v = np.concatenate([v[:, :, :mid], v[:, :, mid + 1 :], v[:, :, mid : mid + 1]], axis=2)
    return v.reshape(*v.shape[:2], -1)


def aggregate_neighbours(x: np.ndarray, size: int = 3, modes: tuple[int, ...] = (1, 2, 3), border: str = "reflect") -> np.ndarray:
    """Features with the maximum (1), minimum (2) and mean (3) of their neighbourhood appended."""
    v = windows(pad(x, size // 2, border), size)
    made = {1: v.max, 2: v.min, 3: v.mean}
    return np.concatenate([x, *[made[m](axis=2) for m in modes]], axis=2)


def convolve(x: np.ndarray, kernel: np.ndarray, border: str = "symmetric") -> np.ndarray:
    """Correlation of a 2-D image with a kernel, same size; even kernels are centred at k // 2."""
    kh, kw = kernel.shape
    around = ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2))
    p = np.pad(x, around) if border == "zero" else np.pad(x, around, mode=border)
    return np.einsum("ijab,ab->ij", np.lib.stride_tricks.sliding_window_view(p, (kh, kw)), kernel)


def gaussian(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    return convolve(convolve(x, k[:, None]), k[None])


def sobel(x: np.ndarray, blur: float | None = None) -> np.ndarray:
    """Gradient magnitude, scaled to a largest value of 1."""
    x = gaussian(x, blur) if blur else x
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
    g = np.hypot(convolve(x, k), convolve(x, k.T))
    return g / g.max() if g.max() else g


def roberts(x: np.ndarray, in_place: bool = True) -> np.ndarray:
    """Cross differences; the last row and column stay. A raster scan over one buffer (in_place) gives the same: a pixel looks at itself, its
    right neighbour and the row below, none of which the scan has reached."""
    out = x.astype(float).copy()
    out[:-1, :-1] = np.abs(x[1:, 1:] - x[:-1, :-1]) + np.abs(x[1:, :-1] - x[:-1, 1:])
    return out


def residual_maps(x: np.ndarray, limit: float = 2.0) -> np.ndarray:
    """Truncated, rounded noise residuals of the three fixed kernels, one channel each."""
    return np.stack([np.round(np.clip(convolve(x, np.array(k, float) / q), -limit, limit)) for q, k in RESIDUALS], axis=-1)


def dilate(x: np.ndarray, k: int = 3) -> np.ndarray:
    p = np.pad(x, ((k // 2, k - 1 - k // 2),) * 2)
    return np.lib.stride_tricks.sliding_window_view(p, (k, k)).max(axis=(2, 3))


def suppress_nonmaxima(g: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Keep gradient values that no neighbour along the gradient's direction exceeds; the border becomes 0."""
    out = np.zeros_like(g)
    sector = (np.round(np.rad2deg(angle) % 180 / 45).astype(int)) % 4
    for s, (di, dj) in enumerate(((0, 1), (1, -1), (1, 0), (1, 1))):
        c = g[1:-1, 1:-1]
        a = g[1 + di : g.shape[0] - 1 + di, 1 + dj : g.shape[1] - 1 + dj]
        b = g[1 - di : g.shape[0] - 1 - di, 1 - dj : g.shape[1] - 1 - dj]
        keep = (sector[1:-1, 1:-1] == s) & (c >= a) & (c >= b)
        out[1:-1, 1:-1][keep] = c[keep]
    return out


def hysteresis(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """1 from `high` on, -1 below `low`; between them 1 next to a strong pixel of the input, else -1."""
    strong = x >= high
    near = dilate(strong.astype(float), 3) > 0
    return np.where(strong | ((x >= low) & near), 1.0, -1.0)


def canny(x: np.ndarray, low: float, high: float, sigma: float = 1.0) -> np.ndarray:
    """Edges by blurred gradients, thinning and a double threshold."""
    s = gaussian(x, sigma)
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
    gx, gy = convolve(s, k), convolve(s, k.T)
    return (hysteresis(suppress_nonmaxima(np.hypot(gx, gy), np.arctan2(gy, gx)), low, high) > 0).astype(float)


def resize(x: np.ndarray, h: int, w: int, how: str = "nearest") -> np.ndarray:
    if how == "nearest":
        return x[np.arange(h) * x.shape[0] // h][:, np.arange(w) * x.shape[1] // w]

    def at(n: int, m: int):
        p = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.floor(p).astype(int)
        return lo, np.minimum(lo + 1, m - 1), p - lo

    (i0, i1, fi), (j0, j1, fj) = at(h, x.shape[0]), at(w, x.shape[1])
    shape = (-1, 1) + (1,) * (x.ndim - 2)
    rows = x[i0] * (1 - fi).reshape(shape) + x[i1] * fi.reshape(shape)
    shape = (1, -1) + (1,) * (x.ndim - 2)
    return rows[:, j0] * (1 - fj).reshape(shape) + rows[:, j1] * fj.reshape(shape)


def wavelet_cost(x: np.ndarray) -> np.ndarray:
    """Embedding cost per pixel: reciprocal suitabilities of three directional wavelet residuals, added up. Flat
    surroundings have no suitability and an infinite cost."""
    high = np.array(WAVELET)
    low = high[::-1] * (-1.0) ** np.arange(len(high))
    n = len(high)
    p = np.pad(x, n, mode="symmetric") if min(x.shape) >= n else np.pad(np.pad(x, min(x.shape), mode="symmetric"), n - min(x.shape), mode="symmetric")
    total = np.zeros(x.shape)
    with np.errstate(divide="ignore"):
        for a, b in ((high, low), (low, high), (high, high)):
            k = np.outer(a, b)
            residual = convolve(p, k[::-1, ::-1])
            suit = np.roll(np.roll(convolve(np.abs(residual), np.abs(k)), 1, 0), 1, 1)
            top, left = (suit.shape[0] - x.shape[0]) // 2, (suit.shape[1] - x.shape[1]) // 2
            total += 1.0 / suit[top : top + x.shape[0], left : left + x.shape[1]]
    return total


def high_frequency_share(kernel: np.ndarray, mask: str = "cross") -> float:
    """Share of a square kernel's spectrum outside the low frequencies (a cross through the centre, a plus of the centre and its four neighbours, or the 3x3 middle)."""
    s = np.abs(np.fft.fftshift(np.fft.fft2(kernel)))
    m = np.ones(s.shape, bool)
    c = s.shape[0] // 2
    if mask == "cross":
        m[c], m[:, c] = False, False
    elif mask == "plus":
        m[c - 1 : c + 2, c], m[c, c - 1 : c + 2] = False, False
    else:
        m[c - 1 : c + 2, c - 1 : c + 2] = False
    return float(s[m].sum() / s.sum()) if s.sum() else 0.0


def thin(diff: np.ndarray, reach: int = 10) -> np.ndarray:
    """Keep the first changed pixel in raster order and clear `reach` around it, again and again."""
    out, free = np.zeros_like(diff), diff != 0
    for i, j in np.argwhere(free):
        if free[i, j]:
            out[i, j] = 1
            free[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1] = False
    return out


def ring(diff: np.ndarray, reach: int = 1) -> np.ndarray:
    """Invert the box around changed pixels that no earlier box took in; what is left are hard negatives."""
    out, seen = diff.copy(), np.zeros(diff.shape, bool)
    for i in range(diff.shape[0]):
        for j in range(diff.shape[1]):
            if out[i, j] != 0 and not seen[i, j]:
                box = np.s_[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1]
                out[box] = 1 - out[box]
                seen[box] = True
    return out


def dense_windows(diff: np.ndarray, size: int = 32, share: float = 0.2) -> list[tuple[int, int]]:
    """Corners of windows whose middle changed by 1 and that hold enough change; later ones near a taken one are skipped."""
    rows, cols = diff.shape[0] - size + 1, diff.shape[1] - size + 1
    enough = np.lib.stride_tricks.sliding_window_view(np.abs(diff), (size, size)).sum(axis=(2, 3)) >= share * size * size
    free, half, out = np.ones((rows, cols), bool), size // 2, []
    for i in range(rows):
        for j in range(cols):
            if free[i, j] and enough[i, j] and diff[i + half, j + half] == 1:
                out.append((i, j))
                free[max(0, i - half) : i + half, max(0, j - half) : j + half] = False
                free[i, j] = False
    return out


def picks(x: np.ndarray, count: int, reach: int, largest: bool = True) -> list[tuple[int, int]]:
    """Extremes one after the other, each clearing its neighbourhood."""
    work, out = (x if largest else -x).astype(float).copy(), []
    for _ in range(count):
        i, j = np.unravel_index(int(np.argmax(work)), work.shape)
        if work[i, j] == -np.inf:
            break
        out.append((int(i), int(j)))
        work[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1] = -np.inf
    return out


def orientation_descriptor(block: np.ndarray, cells: int = 4, bins: int = 8) -> np.ndarray:
    """128 numbers of gradient orientations in 4x4 cells of a block alone; sift() has the full descriptor."""
    gy, gx = np.gradient(block)
    m, a = np.hypot(gx, gy), np.arctan2(gy, gx) % (2 * np.pi)
    b = np.minimum((a / (2 * np.pi) * bins).astype(int), bins - 1)
    out = np.zeros((cells, cells, bins))
    rows = np.arange(block.shape[0]) * cells // block.shape[0]
    cols = np.arange(block.shape[1]) * cells // block.shape[1]
    np.add.at(out, (np.repeat(rows, block.shape[1]), np.tile(cols, block.shape[0]), b.ravel()), m.ravel())
    out = out.ravel()
    n = np.linalg.norm(out)
    return out / n if n else out


def sift(x: np.ndarray, size: int = 32, cell: float | None = None, blur: float = 1.6, cells: int = 4, bins: int = 8, clip: float = 0.2) -> np.ndarray:
    """Dense SIFT of an image: a descriptor of cells x cells x bins numbers, of norm 1, for the key point in the middle of every size x size
    block, upright. The image is blurred to `blur` (it is taken to have 0.5 already); a cell is 1.5 sizes wide unless said otherwise, as
    usual for a key point of that size, so descriptors reach beyond their block. Gradients weigh by a Gaussian of half the descriptor's
    width and are shared linearly between the two nearest rows, columns and angles of cells; numbers are cut at `clip` and
    normalised again. Flat surroundings give zeros; blocks cut off at the lower and right border have none."""
    cell = 1.5 * size if cell is None else cell
    y = gaussian(x.astype(float), np.sqrt(max(blur**2 - 0.25, 0.01)))
    gx, gy = np.zeros(y.shape), np.zeros(y.shape)
    gx[:, 1:-1], gy[1:-1] = y[:, 2:] - y[:, :-2], y[:-2] - y[2:]
    inner = np.zeros(y.shape, bool)
    inner[1:-1, 1:-1] = True
    i, j = np.nonzero(inner)
    strength, turn = np.hypot(gx, gy)[i, j], (np.arctan2(gy, gx)[i, j] / (2 * np.pi) * bins) % bins
    out = np.zeros((x.shape[0] // size, x.shape[1] // size, cells * cells * bins))
    for a in range(out.shape[0]):
        for b in range(out.shape[1]):
            r, c = (i - (a * size + size // 2)) / cell, (j - (b * size + size // 2)) / cell
            row, col = r + cells / 2 - 0.5, c + cells / 2 - 0.5
            own = np.flatnonzero((row > -1) & (row < cells) & (col > -1) & (col < cells))
            w = strength[own] * np.exp(-(r[own] ** 2 + c[own] ** 2) / (cells * cells * 0.5))
            hist = np.zeros((cells + 2, cells + 2, bins))
            at = [np.floor(v[own]).astype(int) for v in (row, col, turn)]
            rest = [v[own] - k for v, k in zip((row, col, turn), at)]
            for p in range(8):
                step = (p >> 2, p >> 1 & 1, p & 1)
                part = w.copy()
                for s, f in zip(step, rest):
                    part *= f if s else 1 - f
                np.add.at(hist, (at[0] + 1 + step[0], at[1] + 1 + step[1], (at[2] + step[2]) % bins), part)
            d = hist[1:-1, 1:-1].ravel()
            d = np.minimum(d, clip * np.linalg.norm(d))
            n = np.linalg.norm(d)
            out[a, b] = d / n if n else d
    return out


def shapes(size: int = 160, kind: str = "circle", tile: int | None = None) -> np.ndarray:
    """A synthetic 0/1 shape, or small copies of it tiled over the image."""
    n = tile or size
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    one = {"circle": x * x + y * y <= (n * 0.3) ** 2, "square": np.maximum(abs(x), abs(y)) <= n * 0.3, "cross": (abs(x) <= n * 0.1) | (abs(y) <= n * 0.1)}[kind].astype(float)
    return np.tile(one, (size // n, size // n)) if tile else one
