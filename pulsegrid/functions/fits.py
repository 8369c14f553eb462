"""Fits of one feature to one target on arrays (numpy only).

``x`` and ``y`` are one fit's training rows, ``w`` their weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPSILON, ALPHA = 1.35, 1e-4  # fixed values of the robust loss
SVR_C, SVR_EPS = 10.0, 0.5  # fixed values of the support vector fits
TREES, DEPTH, RATE = 200, 3, 0.05  # fixed values of the boosted trees


def scaling(x: np.ndarray) -> tuple[float, float]:
    """Mean and population deviation; a constant feature keeps scale 1."""
    sd = float(x.std())
    return float(x.mean()), sd if sd > 0 else 1.0


def robust_step(sums: np.ndarray, sigma: float) -> tuple[float, float, float]:
    """New ``(slope, intercept, sigma)`` of the Huber loss with its scale, for a
    fixed split into near and far rows; see ``robust_steps``."""
    slope, cept, scale = robust_steps(np.asarray(sums, float)[:, None], np.array([float(sigma)]))
    return float(slope[0]), float(cept[0]), float(scale[0])


def robust_steps(sums: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``robust_step`` of many groups, one in each column.

    ``sums`` over near rows: w, wz, wy, wzz, wzy, wyy; over far rows: w,
    w*sign*z, w*sign; last the weight of all rows.  With the split fixed the
    optimum in (slope, intercept) is linear and the one in sigma explicit, so
    the two are alternated until they agree; no further look at the rows.
    """
    s, sz, sy, szz, szy, syy, far, far_z, far_1, total = sums
    slope, cept, sigma = np.zeros(len(sigma)), np.zeros(len(sigma)), sigma.copy()
    room = total - EPSILON**2 * far
    going = np.ones(len(sigma), bool)
    for _ in range(200):
        a11, a12, a22 = szz + ALPHA * sigma, sz, s
        b1, b2 = szy + EPSILON * sigma * far_z, sy + EPSILON * sigma * far_1
        det = a11 * a22 - a12 * a12
        going &= det > 0
        if not going.any():
            break
        safe = np.where(going, det, 1.0)
        slope = np.where(going, (b1 * a22 - b2 * a12) / safe, slope)
        cept = np.where(going, (a11 * b2 - a12 * b1) / safe, cept)
        rest = syy - 2 * slope * szy - 2 * cept * sy + slope**2 * szz + 2 * slope * cept * sz + cept**2 * s
        new = np.where(room > 0, np.sqrt(np.maximum(rest, 0.0) / np.where(room > 0, room, 1.0)), sigma)
        new = np.maximum(new, 1e-10)
        done = np.abs(new - sigma) <= 1e-13 * np.maximum(1.0, sigma)
        sigma = np.where(going, new, sigma)
        going &= ~done
    return slope, cept, sigma


def hash_int(value: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of an integer column after columns whose hash is ``seed``, as 64-bit words."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed.astype(np.uint64) + p5 + np.uint64(4)) ^ (np.asarray(value).astype(np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def medians(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The middle of each group, or half way between the two middle ones."""
    n = np.diff(bounds)
    by = v[np.lexsort((v, np.repeat(np.arange(len(n)), n)))]
    low, high = by[bounds[:-1] + (n - 1) // 2], by[bounds[:-1] + n // 2]
    return np.where(n % 2 == 1, low, low * 0.5 + high * 0.5)


#: Values of rows under drawn lines that are looked at together: about as many as stay in a core's memory.
LOOKS = 1 << 17


def consensus_lines(x: np.ndarray, y: np.ndarray, w: np.ndarray, bounds: np.ndarray, salt: np.ndarray, seed: int, trials: int) -> np.ndarray:
    """``p0, p1`` of the consensus line of each group of rows in order, NaN where there is none.

    ``trials`` pairs of a group are drawn by hashes over its ``salt``, the hash of its keys; the line of a pair that most rows agree with
    (then the best fitting, then the first) is fitted again to those rows.
    """
    n = np.diff(bounds)
    first, group = bounds[:-1], np.repeat(np.arange(len(n)), n)
    limit = medians(np.abs(y - medians(y, bounds)[group]), bounds)
    place = hash_int(np.arange(trials)[None, :], salt[:, None])
    draw = [hash_int(seed * 10 + s, place).view(np.int64) for s in (0, 1)]
    out = np.full((len(n), 2), np.nan)
    some = np.flatnonzero(n >= 2)
    order, at = some[np.argsort(-n[some], kind="stable")], 0
    while at < len(order):
        part = order[at : at + max(1, LOOKS // int(n[order[at]] * trials))]
        at += len(part)
        m = n[part][:, None]
        i = draw[0][part] % m
        j = (i + 1 + draw[1][part] % (m - 1)) % m
        real = np.arange(int(m.max())) < m
        here = np.where(real, first[part][:, None] + np.arange(real.shape[1]), 0)
        px, py, pw = (np.where(real, v[here], 0.0) for v in (x, y, w))
        xi, yi, xj, yj = (np.take_along_axis(v, k, 1) for k in (i, j) for v in (px, py))
        same = xi == xj
        slope = np.where(same, 0.0, (yj - yi) / np.where(same, 1.0, xj - xi))
        cept = np.where(same, (yi + yj) / 2, yi - slope * xi)
        most = limit[part][:, None]
        e = py[:, None, :] - cept[:, :, None] - slope[:, :, None] * px[:, None, :]
        ok = (np.abs(e) <= most[:, :, None]) & real[:, None, :]
        agree = ok.sum(axis=2)
        as_number = ok.astype(float)
        e *= as_number
        sse = np.einsum("gtn,gtn->gt", e, e)
        sy, syy = (np.matmul(as_number, v[:, :, None])[:, :, 0] for v in (py, py * py))
        spread = syy - sy * sy / np.maximum(agree, 1)
        score = np.where(spread > 0, 1 - sse / np.where(spread > 0, spread, 1.0), -np.inf)
        score = np.where(agree == agree.max(axis=1, keepdims=True), np.maximum(score, -1e308), -np.inf)
        best = score.argmax(axis=1)
        inside = ok[np.arange(len(part)), best]
        out[part] = weighted_lines(px, py, np.where(inside, pw, 0.0), inside)
    return out


def weighted_lines(x: np.ndarray, y: np.ndarray, w: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """``p0, p1`` of the weighted line of the rows ``inside`` of each row of arrays; NaN without rows or where they share one ``x``."""
    count = inside.sum(axis=1)
    some = np.maximum(count, 1)
    total = lambda v: np.where(inside, v, 0.0).sum(axis=1)
    # About one of the rows, so that an equal feature deviates by exactly nothing.
    x1, y1 = (np.take_along_axis(v, inside.argmax(axis=1)[:, None], 1) for v in (x, y))
    u, v = x - x1, y - y1
    mu, mv = total(u) / some, total(v) / some
    u, v = u - mu[:, None], v - mv[:, None]
    s0 = total(w)
    with np.errstate(all="ignore"):
        du, dv = total(w * u) / s0, total(w * v) / s0
        wide = total(w * u * u) / s0 - du * du
        slope = (total(w * u * v) / s0 - du * dv) / np.where(wide == 0, np.nan, wide)
    return np.stack([y1[:, 0] + mv + dv - slope * du - slope * (x1[:, 0] + mu), slope], axis=1)


@dataclass(frozen=True)
class Decided:
    """Edge points above and below every line that may be the best, and the difference of their feature sums."""

    above: int = 0
    below: int = 0
    pull: float = 0.0


def ranked(value: np.ndarray, count: np.ndarray, rank: float) -> float:
    """The value of a rank, from 1, among values that occur ``count`` times."""
    order = np.argsort(value, kind="stable")
    total = np.cumsum(count[order])
    return float(value[order[min(int(np.searchsorted(total, rank - 0.25)), len(order) - 1)]])


def middles(low: np.ndarray, high: np.ndarray, count: np.ndarray, rest: Decided) -> tuple[float, float]:
    """The lower median of ``low`` and the upper one of ``high``, with the decided points outside."""
    half = (count.sum() + rest.above + rest.below) / 2
    return ranked(low, count, half - rest.below), ranked(high, count, half - rest.below + 1)


def margin_line(z, r, count, rest: Decided, mid: float, span: tuple[float, float]) -> tuple[float, float]:
    """``(slope, intercept)`` of the linear support vector fit on edge points with residuals ``r`` about slope ``mid``.

    The objective is convex in the slope; its derivative is followed by bisection within ``span``.  Points on the
    line balance the signs of the others.
    """

    def look(slope):
        e = r - (slope - mid) * z
        c = sum(middles(e, e, count, rest)) / 2
        d = e - c
        tied = np.abs(d) <= 1e-12 * (1 + abs(c))
        sign = np.where(tied, 0.0, np.sign(d)) * count
        on = count[tied].sum()
        free = np.clip(-(sign.sum() + rest.above - rest.below) / on, -1, 1) if on else 0.0
        pull = float(sign @ z) + rest.pull + free * float(count[tied] @ z[tied])
        return c, slope - SVR_C / 2 * pull

    low, high = span
    for _ in range(200):
        at = (low + high) / 2
        if not low < at < high:
            break
        low, high = (low, at) if look(at)[1] > 0 else (at, high)
    slope = (low + high) / 2
    return slope, look(slope)[0]


def margin_lines(z, r, count, bounds, above, below, pull, mid, low, high) -> tuple[np.ndarray, np.ndarray]:
    """``margin_line`` of many groups: ``bounds[g]`` to ``bounds[g + 1]`` are the points of group ``g``, the others have a value for each group."""
    size = np.diff(bounds)
    slope, cept = np.empty(len(size)), np.empty(len(size))
    order = np.argsort(size, kind="stable")
    # Groups of about the same size are rows of one array, filled up at the end.
    cuts = np.flatnonzero(np.diff(np.ceil(np.log(size[order]) / np.log(1.2)))) + 1
    for part in np.split(order, cuts):
        if not len(part):
            continue
        at = bounds[:-1][part][:, None] + np.arange(size[part].max())
        real = np.arange(at.shape[1]) < size[part][:, None]
        at = np.where(real, at, 0)
        one = [np.where(real, z[at], 0.0), np.where(real, r[at], np.inf), np.where(real, count[at], 0.0)]
        slope[part], cept[part] = _margin_rows(*one, *(v[part] for v in (size, above, below, pull, mid, low, high)))
    return slope, cept


def _margin_rows(z, r, count, size, above, below, pull, mid, low, high) -> tuple[np.ndarray, np.ndarray]:
    single = bool((count <= 1).all() and (count.sum(axis=1) == size).all())

    def middle(e, count, size, above, below):
        if single:  # values alone sort several times faster
            e_by, half = np.sort(e, axis=1), (size + above + below) / 2 - below
            place = lambda k: np.maximum(np.ceil(k - 0.25).astype(int) - 1, 0)
        else:
            by = np.argsort(e, axis=1)
            total = np.cumsum(np.take_along_axis(count, by, 1), axis=1)
            e_by, half = np.take_along_axis(e, by, 1), (total[:, -1] + above + below) / 2 - below
            place = lambda k: (total < (k - 0.25)[:, None]).sum(axis=1)
        return sum(np.take_along_axis(e_by, np.minimum(place(k), size - 1)[:, None], 1)[:, 0] for k in (half, half + 1)) / 2

    def look(slope, z, r, count, size, above, below, pull, mid):
        e = r - (slope - mid)[:, None] * z
        c = middle(e, count, size, above, below)
        d = e - c[:, None]
        tied = np.abs(d) <= (1e-12 * (1 + np.abs(c)))[:, None]
        sign = np.where(tied, 0.0, np.sign(d)) * count
        on = np.where(tied, count, 0.0)
        held = on.sum(axis=1)
        free = np.where(held > 0, np.clip(-(sign.sum(axis=1) + above - below) / np.where(held > 0, held, 1.0), -1, 1), 0.0)
        return c, slope - SVR_C / 2 * ((sign * z).sum(axis=1) + pull + free * (on * z).sum(axis=1))

    low, high = low.astype(float), high.astype(float)
    every = (z, r, count, size, above, below, pull, mid)
    todo, own = np.arange(len(size)), every
    for _ in range(200):
        at = (low[todo] + high[todo]) / 2
        going = (low[todo] < at) & (at < high[todo])
        if not going.any():
            break
        if 2 * going.sum() < len(going):
            todo, at, own = todo[going], at[going], tuple(v[going] for v in own)
            going = going[going]
        down = look(at, *own)[1] > 0
        high[todo] = np.where(going & down, at, high[todo])
        low[todo] = np.where(going & ~down, at, low[todo])
    slope = (low + high) / 2
    return slope, look(slope, *every)[0]


def margin_region(m, sz, sr, z0, z1, r0, r1, rest: Decided, mid: float, old: tuple[float, float, float, float]) -> tuple[float, float, float, float, int]:
    """``(low, high, c_low, c_high, open)``: where the best slope and its intercepts lie for sure, and the points that this leaves open.

    ``m, sz, sr`` are numbers and sums of the cells of open points, ``z0 .. r1`` their extents, ``r`` about slope ``mid``.
    """
    far = m * np.maximum(np.abs(z0), np.abs(z1))

    def extent(slope):
        a, b = (slope - mid) * z0, (slope - mid) * z1
        return r0 - np.maximum(a, b), r1 - np.minimum(a, b)

    def side(slope) -> int:
        """1 if the best slope is surely not above, -1 if surely not below, 0 if not known."""
        lo, hi = extent(slope)
        c_lo, c_hi = middles(lo, hi, m, rest)
        below, above = middles(hi, lo, m, rest)
        if below < above:
            # Half of the points end below where the others begin: any intercept between is a median, and none is in doubt.
            c_lo = c_hi = (below + above) / 2
        up, down = lo > c_hi, hi < c_lo
        pull, slack = rest.pull + sz[up].sum() - sz[down].sum(), far[~(up | down)].sum() * (1 + 1e-9)
        if slope - SVR_C / 2 * (pull + slack) > 0:
            return 1
        return -1 if slope - SVR_C / 2 * (pull - slack) < 0 else 0

    guess, _ = margin_line(sz / m, sr / m, m, rest, mid, old[:2])

    def bound(to: float, sign: int) -> float:
        """The nearest slope to the guess, on the way to ``to``, that is proven to be a bound."""
        step = 1e-9 * (1 + abs(guess))
        last = guess
        while abs(step) < abs(to - guess):
            at = guess + sign * step
            if side(at) == sign:
                for _ in range(12):
                    half = (last + at) / 2
                    last, at = (last, half) if side(half) == sign else (half, at)
                return at
            last, step = at, step * 2
        return to

    low, high = bound(old[0], -1), bound(old[1], 1)
    (a0, a1), (b0, b1) = extent(low), extent(high)
    c_lo, c_hi = middles(np.minimum(a0, b0), np.maximum(a1, b1), m, rest)
    c_lo, c_hi = max(c_lo, old[2]), min(c_hi, old[3])
    shut = (np.minimum(a0, b0) > c_hi) | (np.maximum(a1, b1) < c_lo)
    return low, high, c_lo, c_hi, int(m[~shut].sum())


def svr_predict(fit, x) -> np.ndarray:
    mean, sd, bias, centres, beta, gamma = fit
    z = (np.asarray(x) - mean) / sd
    out = np.empty(len(z))
    for at in range(0, len(z), 1024):
        part = z[at : at + 1024, None]
        out[at : at + 1024] = np.exp(-gamma * (part - centres[None, :]) ** 2) @ beta + bias
    return out


def boost(x, y, w):
    """Boosted regression trees on one feature, as one step function.

    Returns ``(breaks, values)``: the value left of the first break, between
    breaks, and right of the last.  On one feature a tree is a partition of the
    line, so equal feature values are first merged into weighted points.
    """
    point, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at, w)
    return boosted(point, point, np.bincount(at, w * y) / weight, weight)


def boosted(first, last, target, weight):
    """``boost`` on points in order, which reach from ``first`` to ``last``."""
    return boosted_groups(first, last, target, weight, np.array([0, len(first)]))[0]


#: Points (with what fills up the shorter groups) on which trees are grown together: as many as stay in a core's memory.
TOGETHER = 1 << 14


def boosted_groups(first, last, target, weight, bounds) -> list[tuple[np.ndarray, np.ndarray]]:
    """``boosted`` of each group of points between ``bounds``; groups of like size are grown together."""
    size = np.diff(bounds)
    out: list = [None] * len(size)
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        part = order[at : at + max(1, TOGETHER // int(size[order[at]]))]
        at += len(part)
        rows = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in part])
        ends = np.concatenate([[0], np.cumsum(size[part])])
        fitted = _grown(target[rows], weight[rows], ends)
        for k, g in enumerate(part):
            value, a = fitted[ends[k] : ends[k + 1]], bounds[g]
            change = np.flatnonzero(np.abs(np.diff(value)) > 1e-12)
            out[g] = (last[a + change] + first[a + change + 1]) / 2, value[np.append(change, len(value) - 1)]
    return out


def _grown(target, weight, ends) -> np.ndarray:
    """The trees' value at each point of groups that follow each other, the longest first."""
    size = np.diff(ends)
    # Running sums are taken by group, on rows filled up to equal length, so that no group's digits depend on another.
    slot = np.arange(len(target)) + np.repeat(np.arange(len(size)) * size[0] - ends[:-1], size)
    wide = np.zeros((len(size), int(size[0])))

    def running(v):
        wide.ravel()[slot] = v
        return np.cumsum(wide, axis=1).ravel()[slot]

    def before(sums):
        out = np.empty_like(sums)
        out[1:] = sums[:-1]
        out[ends[:-1]] = 0.0
        return out

    total = running(weight)
    total0 = before(total)
    base = [np.average(target[a:b], weights=weight[a:b]) for a, b in zip(ends, ends[1:])]
    fitted = np.repeat(base, size)
    for _ in range(TREES):
        run = running(weight * (target - fitted))
        run0 = before(run)
        start = ends[:-1]
        for _ in range(DEPTH):
            start = _cut_all(run, run0, total, total0, start)
        end = np.append(start[1:], len(target)) - 1
        leaf = (run[end] - run0[start]) / (total[end] - total0[start])
        fitted += RATE * np.repeat(leaf, end - start + 1)
    return fitted


def _cut_all(run, run0, total, total0, start) -> np.ndarray:
    """Cut every part at its best place, the first of equal ones: largest weighted gap of the two means.

    ``run`` and ``total`` are running sums of residual and weight, ``run0`` and ``total0`` those before a point."""
    count = np.diff(np.append(start, len(run)))
    end = start + count - 1
    w0, s0 = total0[start], run0[start]
    wl, sl = total0 - np.repeat(w0, count), run0 - np.repeat(s0, count)
    wr, sr = np.repeat(total[end] - w0, count) - wl, np.repeat(run[end] - s0, count) - sl
    gap = wr * sl - wl * sr
    gap *= gap
    both = wl * wr
    both[start] = 1.0
    gap /= both
    gap[start] = -1.0  # a part of one point has no other place
    best = np.flatnonzero(gap == np.repeat(np.maximum.reduceat(gap, start), count))
    part = np.searchsorted(start, best, side="right")
    best = best[np.append(True, part[1:] != part[:-1])]
    cut = np.zeros(len(run), bool)
    cut[start] = cut[best] = True
    return np.flatnonzero(cut)


def step_predict(fit, x) -> np.ndarray:
    breaks, values = fit
    return values[np.searchsorted(breaks, x, side="left")]


CELL = 0.3  # spacing of kernel centres on the scaled feature: finer adds no digits


def kernel_basis(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres around the occupied cells and the map from kernel values at them to
    orthonormal features; a Gaussian kernel on a line needs no more of them than
    its spectrum holds."""
    wide = np.unique((np.asarray(cells)[:, None] + np.arange(-3, 4)[None, :]).ravel())
    return (wide + 0.5) * CELL, kernel_map(wide - wide[0])


def kernel_map(at: np.ndarray) -> np.ndarray:
    """The map of a basis, which depends on the distances of its cells only."""
    at = at * CELL
    size, vectors = np.linalg.eigh(np.exp(-((at[:, None] - at[None, :]) ** 2)))
    keep = size > 1e-9 * size[-1]
    return vectors[:, keep] / np.sqrt(size[keep])


#: Cells between the ends of a group up to which its basis is looked up among those of the others.
SPAN = 256


def kernel_bases(cells: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``kernel_basis`` of each group; groups whose cells lie alike share the map."""
    first = bounds[:-1]
    low = np.minimum.reduceat(cells, first)
    reach = np.maximum.reduceat(cells, first) - low
    near = np.flatnonzero(reach <= SPAN)
    out = [None if r <= SPAN else kernel_basis(np.unique(cells[a:b])) for r, a, b in zip(reach, bounds, bounds[1:])]
    if not len(near):
        return out
    width = int(reach[near].max()) + 1
    place = np.full(len(first), -1)
    place[near] = np.arange(len(near))
    row = np.repeat(place, np.diff(bounds))
    held = row >= 0
    seen = np.zeros((len(near), width + 6), bool)
    at = (cells - np.repeat(low, np.diff(bounds)))[held].astype(int)
    for k in range(7):
        seen[row[held], at + k] = True
    alike, which = np.unique(np.packbits(seen, axis=1), axis=0, return_inverse=True)
    maps = []
    for bits in alike:
        cell = np.flatnonzero(np.unpackbits(bits))
        maps.append((cell, kernel_map((cell - cell[0]).astype(float))))
    for g, k in zip(near, which.ravel()):
        cell, basis = maps[k]
        out[g] = (low[g] - 3 + cell + 0.5) * CELL, basis
    return out


def kernel_features(z: np.ndarray, centres: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return np.exp(-((z[:, None] - centres[None, :]) ** 2)) @ basis


#: Gap of the two problems, relative to the objective, at which a fit is done, and beyond which it has not settled.
GAP, SETTLED = 1e-9, 1e-3


def lower_root(inner: np.ndarray) -> np.ndarray:
    """A root of a matrix whose eigenvalues are 1 and more, also where rounding beside very large ones has lost the small."""
    try:
        return np.linalg.cholesky(inner)
    except np.linalg.LinAlgError:
        size, vectors = np.linalg.eigh(inner)
        return vectors * np.sqrt(np.maximum(size, 1.0))


def lower_inverses(root: np.ndarray) -> np.ndarray:
    """The inverse of each lower triangular matrix; many small ones at once are several times faster than one by one."""
    count, size, _ = root.shape
    half = size // 2
    if size > 5 and size == 2 * half:
        both = lower_inverses(np.concatenate([root[:, :half, :half], root[:, half:, half:]]))
        out = np.zeros_like(root)
        out[:, :half, :half], out[:, half:, half:] = low, high = both[:count], both[count:]
        out[:, half:, :half] = -np.matmul(high, np.matmul(root[:, half:, :half], low))
        return out
    root = np.ascontiguousarray(root.transpose(1, 2, 0))
    out = np.zeros_like(root)
    for i in range(size):
        out[i, i] = 1 / root[i, i]
        if i:
            out[i, :i] = -(root[i, :i, None] * out[:i, :i]).sum(axis=0) * out[i, i]
    return np.ascontiguousarray(out.transpose(2, 0, 1))


def root_inverses(inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of a root of each matrix, and 1 where the root is the matrix's own, 0 where rounding broke it; see ``lower_root``."""
    failed = []
    try:
        root = np.linalg.cholesky(inner)
    except np.linalg.LinAlgError:
        root = np.empty_like(inner)
        for g, one in enumerate(inner):
            try:
                root[g] = np.linalg.cholesky(one)
            except np.linalg.LinAlgError:
                root[g] = np.eye(len(one))
                failed.append(g)
    out = lower_inverses(root)
    own = np.ones((len(inner), 1, 1))
    for g in failed:
        out[g], own[g] = np.linalg.inv(lower_root(inner[g])), 0.0
    return out, own


def margin_dual(phi: np.ndarray, t: np.ndarray, c: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, float, float]:
    """``margin_duals`` of one group."""
    weights, bias, gap = margin_duals(phi[None], t[None], c[None], np.ones((1, len(t)), bool), rounds)
    return weights[0], float(bias[0]), float(gap[0])


def margin_duals(phi: np.ndarray, t: np.ndarray, c: np.ndarray, live: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(weights, bias, gap)`` of the margin loss ``|w|^2 / 2 + C sum c max(0, |t - phi w - b| - eps)`` of many groups.

    An interior-point method on the dual: two variables a row (one for each edge) between 0 and ``C c``, whose
    signed sum is zero.  The quadratic form has the rank of the features, so a step costs rows times features
    squared.  The gap between the primal and the dual objective bounds the error; it is relative to the primal's size.

    Groups are filled up to the same number of rows and features: rows that are not ``live`` have no features, target
    or weight, and no part in any sum; features without values get no weight.  A group's steps do not depend on the others.
    """
    size, _, k = phi.shape
    best_w, best_bias, best_gap = np.zeros((size, k)), np.zeros(size), np.full(size, np.inf)
    sign = np.array([1.0, -1.0])[:, None, None]
    todo, going, bias = np.arange(size), np.ones(size, bool), np.zeros(size)
    on = live.astype(float)
    price = (SVR_EPS - sign * t) * on
    top = np.where(live, SVR_C * c, 2.0)
    a = np.stack([top / 2, top / 2])
    rest = top - a
    lower, upper = np.ones(a.shape), np.ones(a.shape)
    whole = lambda v: v.sum(axis=2).sum(axis=0)
    both = lambda v: v[0] - v[1]
    least = lambda *v: np.maximum.reduce([x.max(axis=2).max(axis=0) for x in v])
    on_rows = lambda x: np.matmul(phi, x[:, :, None])[:, :, 0]
    on_features = lambda v: np.matmul(v[:, None, :], phi)[:, 0]
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            pull = both(a)
            w = on_features(pull)
            fit = on_rows(w)
            off = np.maximum(np.abs(t - fit - bias[:, None]) - SVR_EPS, 0.0)
            half = (w * w).sum(axis=1) / 2
            primal = half + SVR_C * (c * off).sum(axis=1)
            dual = -(half + whole(price * a)) - bias * pull.sum(axis=1)
            gap = np.abs(primal - dual) / (1e-9 + np.abs(primal))
            better = going & (gap < best_gap[todo])
            at = todo[better]
            best_w[at], best_bias[at], best_gap[at] = w[better], bias[better], gap[better]
            going &= ~(gap < GAP)
            if not going.any():
                break
            if 4 * going.sum() <= 3 * len(going):
                todo, phi, t, c, on, fit, bias = (v[going] for v in (todo, phi, t, c, on, fit, bias))
                top = top[going]
                price, a, rest, lower, upper = (v[:, going] for v in (price, a, rest, lower, upper))
                going = going[going]
            stay = sign * (fit + bias[:, None]) + price - lower + upper
            number = 4 * on.sum(axis=1)
            mu = whole((a * lower + rest * upper) * on) / number
            to_a, to_rest = lower / a, upper / rest
            give = on / (to_a + to_rest)
            scaled = give[0] + give[1]
            inner = np.matmul(phi.transpose(0, 2, 1), phi * scaled[:, :, None]) + np.eye(k)
            going &= np.isfinite(inner).all(axis=(1, 2))
            if not going.any():
                break
            if not going.all():
                inner[~going] = np.eye(k)
            back, own = root_inverses(inner)

            def solved(u, inner=inner, back=back, own=own, give=give):
                """``u`` are the values over their bends."""
                across = back.transpose(0, 2, 1)
                want = on_features(both(u))[:, :, None]
                x = np.matmul(across, np.matmul(back, want))
                # Once more for what rounding left, which a product with an inverse leaves more of than a solution.
                x += own * np.matmul(across, np.matmul(back, want - np.matmul(inner, x)))
                return u - sign * give * on_rows(x[:, :, 0])

            unit = solved(sign * give)
            per_bias = both(unit).sum(axis=1)

            def move(to_low, to_high, solved=solved, unit=unit, per_bias=per_bias, stay=stay, give=give, to_a=to_a, to_rest=to_rest):
                """The step at which the products of the bounds' distances and prices become as given."""
                at_low, at_high = to_low / a - lower, to_high / rest - upper
                free = solved((at_low - at_high - stay) * give)
                step_bias = (both(free).sum(axis=1) + both(a).sum(axis=1)) / per_bias
                step = free - step_bias[:, None] * unit
                return step, step_bias, (at_low - to_a * step) * on, (at_high + to_rest * step) * on

            # First a step to the border, to see how far it goes; then one towards the centre, corrected by its products.
            s0, _, l0, u0 = move(0.0, 0.0)
            down, up = s0 / a, s0 / rest  # the prices change by as much, so that their shares follow
            most = np.maximum(least(-down, up), 1 + np.maximum(least(down), least(-up)))
            far = 1 / np.maximum(most, 1.0)[:, None]
            after = whole(((a + far * s0) * (lower + far * l0) + (rest - far * s0) * (upper + far * u0)) * on) / number
            aim = (mu * (after / mu) ** 3)[:, None]
            step, step_bias, low, high = move(aim - s0 * l0, aim + s0 * u0)
            far = np.minimum(1.0, 0.995 / np.maximum(least(-step / a, step / rest, -low / lower, -high / upper), 1.0))
            going &= np.isfinite(far) & (far >= 1e-12)
            bias = bias + far * step_bias
            far = far[:, None]
            a, lower, upper = a + far * step, lower + far * low, upper + far * high
            rest = np.maximum(top - a, 1e-14 * top)
            a = np.maximum(a, 1e-14 * top)
    return best_w, best_bias, best_gap


#: Numbers in the features of groups that are solved together: about as many as stay in a core's memory.
FEATURES = 1 << 17


def radial_groups(z: np.ndarray, t: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """``(centres, coefficients, bias, gap)`` of the radial support-vector fit of each group of scaled points; groups of like size are solved together."""
    size = np.diff(bounds)
    bases = kernel_bases(np.floor(z / CELL), bounds)
    rank = np.array([basis.shape[1] for _, basis in bases])
    out: list = [None] * len(size)
    # Filled up to one of eight sizes in each doubling, which a group's own size decides, so that none's digits depend on the others.
    step = np.maximum(1, 1 << np.maximum(np.log2(size).astype(int) - 3, 0))
    tall, wide = -(-size // step) * step, -(-rank // 4) * 4
    order = np.lexsort((wide, tall))
    kinds = np.flatnonzero((np.diff(tall[order]) != 0) | (np.diff(wide[order]) != 0)) + 1
    chunks = []
    for same in np.split(order, kinds):
        most = max(1, FEATURES // int(tall[same[0]] * wide[same[0]]))
        chunks += np.split(same, range(most, len(same), most))
    for part in chunks:
        n, k = int(tall[part[0]]), int(wide[part[0]])
        real = np.arange(n) < size[part][:, None]
        here = np.where(real, bounds[:-1][part][:, None] + np.arange(n), 0)
        phi = np.zeros((len(part), n, k))
        for row, g in zip(phi, part):
            row[: size[g], : rank[g]] = kernel_features(z[bounds[g] : bounds[g + 1]], *bases[g])
        w, bias, gap = margin_duals(phi, np.where(real, t[here], 0.0), np.where(real, c[here], 0.0), real)
        for j, g in enumerate(part):
            centres, basis = bases[g]
            out[g] = centres, basis @ w[j, : rank[g]], float(bias[j]), float(gap[j])
    return out
