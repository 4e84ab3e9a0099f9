"""Numpy kernels for steps that are sequential or need two-dimensional neighbourhoods."""

from __future__ import annotations

import bisect

import numpy as np


def savgol(y: np.ndarray, window: int = 51, order: int = 3) -> np.ndarray:
    """Savitzky-Golay smoothing; the ends are the polynomial of the first and last window."""
    n, half = len(y), window // 2
    if n < window:
        raise ValueError(f"{n} values are fewer than the window of {window}")
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], "same")
    out[:half] = np.vander(x[:half], order + 1, increasing=True) @ (fit @ y[:window])
    out[n - half :] = np.vander(x[half + 1 :], order + 1, increasing=True) @ (fit @ y[n - window :])
    return out


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interpolating cubic spline with not-a-knot ends; with under four points the polynomial through them."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, max(0, n - 1)), at - x[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    # second derivatives m: a tridiagonal system, the ends eliminated with m0 and mn from third-derivative continuity
    lower, diag, upper, rhs = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
    a, b = h[0] / h[1], h[-1] / h[-2]
    diag[0] += h[0] * (1 + a)
    upper[0] -= h[0] * a
    diag[-1] += h[-1] * (1 + b)
    lower[-1] -= h[-1] * b
    m = np.zeros(n)
    k = n - 2
    if k == 1:
        m[1] = rhs[0] / diag[0]
    else:
        c, r = np.zeros(k), np.zeros(k)
        c[0], r[0] = upper[0] / diag[0], rhs[0] / diag[0]
        for i in range(1, k):
            den = diag[i] - lower[i] * c[i - 1]
            c[i], r[i] = upper[i] / den, (rhs[i] - lower[i] * r[i - 1]) / den
        m[k] = r[-1]
        for i in range(k - 2, -1, -1):
            m[i + 1] = r[i] - c[i] * m[i + 2]
    m[0], m[-1] = (1 + a) * m[1] - a * m[2], (1 + b) * m[-2] - b * m[-3]
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t, s = at - x[i], x[i + 1] - at
    return (m[i] * s**3 + m[i + 1] * t**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * s + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * t


def drop_jumps(y: np.ndarray, floor: float = 1.0, spikes: bool = True) -> np.ndarray:
    """Null out one-ping spikes above `floor` (if `spikes`), then, round by round, the later side of each step between kept values above max(floor, 6 MAD of the steps), until nothing changes.

    Steps are kept sorted, so a round costs what it changes and a run of any length is peeled without rereading the beam.
    """
    out = y.astype(float).copy()
    out[~np.isfinite(out)] = np.nan
    while spikes:
        at = np.flatnonzero(np.isfinite(out))
        d = np.diff(out[at])
        bad = at[1:-1][(np.abs(d[:-1]) > floor) & (np.abs(d[1:]) > floor) & (np.sign(d[:-1]) != np.sign(d[1:]))]
        if not len(bad):
            break
        out[bad] = np.nan
    at = np.flatnonzero(np.isfinite(out))
    v, n = out[at].tolist(), len(at)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    step = [0.0] + [abs(v[i] - v[i - 1]) for i in range(1, n)]
    steps = sorted((step[i], i) for i in range(1, n))
    while steps:
        k = len(steps)
        mid = (steps[(k - 1) // 2][0] + steps[k // 2][0]) / 2
        mad = (_nearest(steps, mid, (k + 1) // 2) + _nearest(steps, mid, k // 2 + 1)) / 2
        cut = bisect.bisect_right(steps, (max(floor, 6 * mad), n))
        if cut == k:
            break
        bad = sorted(i for _, i in steps[cut:])
        del steps[cut:]
        for i in bad:
            out[at[i]] = np.nan
            a, b = before[i], after[i]
            after[a] = b  # the first value has no step before it, so a >= 0
            if b < n:
                before[b] = a
        gone = set(bad)
        for b in {after[i] for i in bad} - gone - {n}:
            del steps[bisect.bisect_left(steps, (step[b], b))]
            step[b] = abs(v[b] - v[before[b]])
            bisect.insort(steps, (step[b], b))
    return out


def _nearest(steps: list[tuple[float, int]], mid: float, count: int) -> float:
    """The count-th smallest distance to `mid` of sorted steps: the farther end of the closest window of `count`."""
    lo, hi = 0, len(steps) - count
    while lo < hi:
        i = (lo + hi) // 2
        if mid - steps[i][0] > steps[i + count][0] - mid:
            lo = i + 1
        else:
            hi = i
    return max(mid - steps[lo][0], steps[lo + count - 1][0] - mid)


def label(mask: np.ndarray, eight: bool = True) -> tuple[np.ndarray, int]:
    """Connected regions of a mask, numbered from 1 in scan order.

    Runs of each row are united with those they touch in the row before, whatever way a region winds.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge > 0)
    stop = np.nonzero(edge < 0)[1]  # one past the end, in the same order
    up = list(range(len(row)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if eight else 0
    starts, stops = start.tolist(), stop.tolist()
    for r in range(1, h):
        a, b = int(first[r - 1]), int(first[r])
        i, j = a, b
        while i < b and j < first[r + 1]:
            if starts[i] < stops[j] + reach and starts[j] < stops[i] + reach:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
            if stops[i] < stops[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(x) for x in range(len(up))], np.int64)
    numbers, number = np.unique(roots, return_inverse=True)
    fill = np.zeros((h, w + 1), np.int64)
    np.add.at(fill, (row, start), number + 1)
    np.add.at(fill, (row, stop), -(number + 1))
    return np.cumsum(fill, axis=1)[:, :w], len(numbers)


def without_small(mask: np.ndarray, least: int, eight: bool = True) -> np.ndarray:
    """The mask without regions of fewer than `least` cells."""
    regions, n = label(mask, eight)
    size = np.bincount(regions.ravel(), minlength=n + 1)
    return mask & (size >= least)[regions]


def without_holes(mask: np.ndarray, least: int) -> np.ndarray:
    return ~without_small(~mask, least, False)


def edge_region(mask: np.ndarray) -> np.ndarray:
    """The cells of regions that touch the last row."""
    regions, _ = label(mask)
    return mask & np.isin(regions, np.setdiff1d(regions[-1], [0]))


def erode(labels: np.ndarray, times: int = 1) -> np.ndarray:
    """Each label eroded by a cross; what is taken becomes 0."""
    out = labels.copy()
    for _ in range(times):
        p = np.pad(out, 1, constant_values=0)
        same = (p[:-2, 1:-1] == out) & (p[2:, 1:-1] == out) & (p[1:-1, :-2] == out) & (p[1:-1, 2:] == out)
        out = np.where(same, out, 0)
    return out


def sieve(labels: np.ndarray, least: int) -> np.ndarray:
    """Small regions of a label map are given to the label next to them, round by round."""
    out = labels.copy()
    hole = np.zeros(out.shape, bool)
    for v in np.unique(out):
        m = out == v
        hole |= m & ~without_small(m, least)
    out[hole] = 0
    while True:
        gap = (out == 0) & hole
        p = np.pad(out, 1)
        near = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]).max(0)
        if not (gap & (near > 0)).any():
            return out
        out = np.where(gap, near, out)


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, p)
    return a


def resize(a: np.ndarray, shape: tuple[int, int], nearest: bool = False) -> np.ndarray:
    """Bilinear (or nearest) resampling with pixel centres aligned."""
    pos = [np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1) for m, n in zip(shape, a.shape)]
    if nearest:
        i, j = (np.floor(p + 0.5).astype(int).clip(0, n - 1) for p, n in zip(pos, a.shape))
        return a[np.ix_(i, j)]
    lo = [np.floor(p).astype(int) for p in pos]
    hi = [np.minimum(i + 1, n - 1) for i, n in zip(lo, a.shape)]
    fy, fx = (pos[0] - lo[0])[:, None], (pos[1] - lo[1])[None]
    top = a[np.ix_(lo[0], lo[1])] * (1 - fx) + a[np.ix_(lo[0], hi[1])] * fx
    low = a[np.ix_(hi[0], lo[1])] * (1 - fx) + a[np.ix_(hi[0], hi[1])] * fx
    return top * (1 - fy) + low * fy


def otsu(a: np.ndarray, bins: int = 256) -> float:
    """The threshold that separates two classes with the largest variance between them."""
    n, edge = np.histogram(a, bins)
    mid = (edge[1:] + edge[:-1]) / 2
    k, s = np.cumsum(n), np.cumsum(n * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * k / k[-1] - s) ** 2 / (k * (k[-1] - k))
    return float(mid[np.nanargmax(np.where(np.isfinite(between), between, -1))])


def clahe(a: np.ndarray, tiles: int = 8, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited histogram equalisation of values in 0..1: clipped histograms per tile, blended bilinearly."""
    h, w = a.shape
    q = np.clip((a * (bins - 1)).astype(int), 0, bins - 1)
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, bins))
    for i in range(tiles):
        for j in range(tiles):
            part = q[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            n = np.bincount(part.ravel(), minlength=bins).astype(float)
            top = max(1.0, clip * part.size)
            n = np.minimum(n, top) + np.maximum(n - top, 0).sum() / bins
            maps[i, j] = np.cumsum(n) / n.sum()
    py = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    px = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    i0, j0 = py.astype(int), px.astype(int)
    i1, j1 = np.minimum(i0 + 1, tiles - 1), np.minimum(j0 + 1, tiles - 1)
    fy, fx = (py - i0)[:, None], (px - j0)[None]
    m = lambda i, j: maps[i[:, None], j[None], q]
    return (m(i0, j0) * (1 - fx) + m(i0, j1) * fx) * (1 - fy) + (m(i1, j0) * (1 - fx) + m(i1, j1) * fx) * fy


def warp_triangle(out: np.ndarray, xs: np.ndarray, ys: np.ndarray, corners: np.ndarray, uv: np.ndarray, values: np.ndarray) -> None:
    """Fill those of the points (ys by xs, both ascending) that lie in a triangle, with the values that its affine map to (row, column) coordinates uv takes there."""
    m = np.column_stack([corners[1] - corners[0], corners[2] - corners[0]])
    if abs(np.linalg.det(m)) < 1e-12:
        return
    (j0, j1), (i0, i1) = (np.searchsorted(v, (c.min() - 1e-6, c.max() + 1e-6)) for v, c in ((xs, corners[:, 0]), (ys, corners[:, 1])))
    if j0 == j1 or i0 == i1:
        return
    j, i = (g.ravel() for g in np.meshgrid(np.arange(j0, j1), np.arange(i0, i1)))
    b = np.linalg.solve(m, np.stack([xs[j] - corners[0, 0], ys[i] - corners[0, 1]]))
    ok = (b[0] >= -1e-9) & (b[1] >= -1e-9) & (b.sum(0) <= 1 + 1e-9)
    at = uv[0][:, None] + (uv[1] - uv[0])[:, None] * b[0] + (uv[2] - uv[0])[:, None] * b[1]
    r, c = (np.clip(np.rint(v[ok]).astype(int), 0, k - 1) for v, k in zip(at, values.shape))
    out[i[ok], j[ok]] = values[r, c]


def warp_quad(out: np.ndarray, xs: np.ndarray, ys: np.ndarray, ends: np.ndarray, values: np.ndarray) -> None:
    """Fill the points between two neighbouring pings, as two triangles. ends: track point and range point of the first, then of the second; values: a column each."""
    a, c, b, d = ends.reshape(4, 2)
    n = len(values) - 1
    warp_triangle(out, xs, ys, np.array([a, b, c]), np.array([[0, 0], [0, 1], [n, 0]], float), values)
    warp_triangle(out, xs, ys, np.array([b, d, c]), np.array([[0, 1], [n, 1], [n, 0]], float), values)


def strip_warp(values: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, step: float) -> tuple[np.ndarray, float, float]:
    """Pings as columns between a track edge (x0, y0) and a range edge (x1, y1), warped to one grid of `step`: (grid with NaN outside, left x, top y)."""
    left, top = min(x0.min(), x1.min()), max(y0.max(), y1.max())
    w = int(np.ceil((max(x0.max(), x1.max()) - left) / step)) + 1
    h = int(np.ceil((top - min(y0.min(), y1.min())) / step)) + 1
    out = np.full((h, w), np.nan)
    xs, ys = left + np.arange(w) * step, top - np.arange(h)[::-1] * step
    for k in range(len(x0) - 1):
        ends = np.array([x0[k], y0[k], x1[k], y1[k], x0[k + 1], y0[k + 1], x1[k + 1], y1[k + 1]], float)
        warp_quad(out[::-1], xs, ys, ends, values[:, k : k + 2])
    return out, float(left), float(top)


def bed_rows(image: np.ndarray, around: np.ndarray, reach: int = 20, sigma: float = 1.0, least: int = 30) -> np.ndarray:
    """First row of the bed in each column near a sensor pick: smoothed, above the larger of the column's median and mean, in a region that reaches the last row."""
    g = gaussian(image.astype(float), sigma)
    mask = g > np.maximum(np.median(g, 0), g.mean(0))[None]
    rows = np.arange(image.shape[0])[:, None]
    mask &= rows >= np.maximum(around - reach, 0)[None]
    mask = edge_region(without_small(without_holes(mask, least), least)) if mask.any() else mask
    found = mask.any(0)
    return np.where(found, mask.argmax(0), around)


class Delaunay:
    """Delaunay triangles of distinct points with whole coordinates, in exact arithmetic; not for points on one line.

    `to` has the third corner of the triangle left of each directed edge; beyond the hull it is -1.
    """

    def __init__(self, x: list[int], y: list[int]) -> None:
        self.x, self.y, self.to = x, y, {}
        c = next(i for i in range(2, len(x)) if self.side(0, 1, x[i], y[i]))
        a, b = (0, 1) if self.side(0, 1, x[c], y[c]) > 0 else (1, 0)
        for u, v, w in ((a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)):
            self._add(u, v, w)
        self.at = (a, b)
        for i in range(2, len(x)):
            if i != c:
                self._insert(i)

    def _add(self, u: int, v: int, w: int) -> None:
        self.to[u, v], self.to[v, w], self.to[w, u] = w, u, v

    def side(self, u: int, v: int, px: int, py: int) -> int:
        """Twice the area of (u, v, p): above 0 where p is left of the edge."""
        return (self.x[v] - self.x[u]) * (py - self.y[u]) - (self.y[v] - self.y[u]) * (px - self.x[u])

    def find(self, px: int, py: int) -> tuple[int, int, int]:
        """The triangle around a point, or a hull edge and -1, by a walk from the last one found."""
        u, v = self.at
        s = self.side(u, v, px, py)
        if s < 0 or (s == 0 and self.to[u, v] < 0):
            u, v = v, u
        while (w := self.to[u, v]) >= 0:
            if self.side(v, w, px, py) < 0:
                u = w
            elif self.side(w, u, px, py) < 0:
                v = w
            else:
                break
        self.at = (u, v)
        return u, v, w

    def _near(self, u: int, v: int, w: int, px: int, py: int) -> bool:
        """Whether p is within the circle of a triangle, or beyond or on a hull edge."""
        if u < 0 or v < 0 or w < 0:
            u, v = (v, w) if u < 0 else (w, u) if v < 0 else (u, v)
            s = self.side(u, v, px, py)
            return s > 0 or (s == 0 and (px - self.x[u]) * (px - self.x[v]) + (py - self.y[u]) * (py - self.y[v]) < 0)
        ax, ay, bx, by, cx, cy = self.x[u] - px, self.y[u] - py, self.x[v] - px, self.y[v] - py, self.x[w] - px, self.y[w] - py
        return (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    def _insert(self, i: int) -> None:
        px, py, to = self.x[i], self.y[i], self.to
        u, v, w = self.find(px, py)
        for e in ((u, v), (v, w), (w, u)):
            del to[e]
        stack, rim = [(u, v), (v, w), (w, u)], []
        while stack:
            a, b = stack.pop()
            c = to[b, a]
            if self._near(b, a, c, px, py):
                for e in ((b, a), (a, c), (c, b)):
                    del to[e]
                stack += [(a, c), (c, b)]
            else:
                rim.append((a, b))
        for a, b in rim:
            self._add(a, b, i)
        self.at = next(e for e in rim if min(e) >= 0)


def within(mask: np.ndarray, reach: int) -> np.ndarray:
    """Cells whose distance to a cell of the mask is at most `reach`."""
    h, w = mask.shape
    out = np.zeros((h, w), bool)
    total = np.pad(np.cumsum(mask, 1), ((0, 0), (1, 0)))
    for d in range(min(reach, h - 1) + 1):
        half = int((reach * reach - d * d) ** 0.5)
        row = total[:, np.minimum(np.arange(w) + half + 1, w)] > total[:, np.maximum(np.arange(w) - half, 0)]
        out[d:] |= row[: h - d]
        out[: h - d] |= row[d:]
    return out


def fill_between(image: np.ndarray, reach: int = 50) -> np.ndarray:
    """NaN cells between filled ones, linear over Delaunay triangles, where all cells around within `reach` steps have a filled one within `reach`.

    Corners with eight filled neighbours touch no triangle that has an empty cell, so they are left out.
    """
    some = np.isfinite(image)
    p = np.pad(image, reach, constant_values=np.nan)
    near = erode(within(np.isfinite(p), reach).astype(np.int8), reach)[reach : len(p) - reach, reach : p.shape[1] - reach] > 0
    q = np.pad(some, 1)
    h, w = image.shape
    inner = np.logical_and.reduce([q[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r, c = np.nonzero(some & ~inner)
    out = image.astype(float).copy()
    if len(r) < 3 or not np.any((r - r[0]) * (c[-1] - c[0]) - (c - c[0]) * (r[-1] - r[0])):  # on one line: the mask leaves nothing beside it
        return out
    strip = r // max(1, int((h * w / len(r)) ** 0.5) * 4)
    order = np.lexsort((np.where(strip % 2, -c, c), strip))
    r, c = r[order], c[order]
    x, y, v = c.tolist(), r.tolist(), image[r, c].tolist()
    mesh = Delaunay(x, y)
    for i, j in np.argwhere(near & ~some).tolist():
        a, b, d = mesh.find(j, i)
        if d >= 0:
            wa, wb, wd = mesh.side(b, d, j, i), mesh.side(d, a, j, i), mesh.side(a, b, j, i)
            out[i, j] = (wa * v[a] + wb * v[b] + wd * v[d]) / (wa + wb + wd)
    return out


def cycle_ends(codes: np.ndarray) -> np.ndarray:
    """For a cycle that starts at each place, the place where a code comes again that it has: the least next place of a code from there on; n if there is none."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    again = np.full(n, n)
    same = codes[order[1:]] == codes[order[:-1]]
    again[order[:-1][same]] = order[1:][same]
    return np.minimum.accumulate(again[::-1])[::-1]


def cycles_from(ends: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the number of cycles if one starts there, and where the last of them starts, up to the end of its group (`bounds`: the groups' starts and n)."""
    n = len(ends)
    edge = np.zeros(n + 1, bool)
    edge[n if bounds is None else bounds] = True
    count, last, stop, hop = [1] * n, list(range(n)), edge.tolist(), ends.tolist()
    for i in range(n - 1, -1, -1):
        if not stop[hop[i]]:
            count[i], last[i] = count[hop[i]] + 1, last[hop[i]]
    return np.array(count, np.int64), np.array(last, np.int64)


def simplify_ring(p: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring's corners (n, 2) without those that stand within tolerance of what is left.

    The first corner and the one farthest from it stay; between two that stay, the corner
    farthest from their line does (the first of equal ones), if it is farther than tolerance. A
    ring that would have fewer than three corners is given back as it was.
    """
    n = len(p)
    if n < 4:
        return p
    far = int(np.argmax(((p - p[0]) ** 2).sum(1)))
    whole = np.vstack([p, p[:1]])
    keep = np.zeros(n + 1, bool)
    keep[[0, far, n]] = True
    open_ = [(0, far), (far, n)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        line, rest = whole[b] - whole[a], whole[a + 1 : b] - whole[a]
        along = np.clip(rest @ line / max(float(line @ line), 1e-300), 0, 1)
        off = ((rest - along[:, None] * line) ** 2).sum(1)
        k = int(np.argmax(off))
        if off[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep[:n]] if keep[:n].sum() > 2 else p
