"""Fits on whole arrays, for comparison with the library's fits on cells."""

import numpy as np

from pulsegrid.functions.fits import EPSILON, SVR_C, SVR_EPS, robust_step, scaling


def robust_sums(z, y, w, slope, cept, sigma) -> np.ndarray:
    r = y - slope * z - cept
    near = np.abs(r) <= EPSILON * sigma
    a, b, v = z[near], y[near], w[near]
    sign = np.sign(r[~near]) * w[~near]
    return np.array([
        v.sum(), (v * a).sum(), (v * b).sum(), (v * a * a).sum(), (v * a * b).sum(), (v * b * b).sum(),
        w[~near].sum(), (sign * z[~near]).sum(), sign.sum(), w.sum(),
    ])


def huber(x, y, w, rounds: int = 300) -> tuple[float, float]:
    """``(intercept, slope)`` of the robust line on the scaled feature."""
    mean, sd = scaling(x)
    z = (x - mean) / sd
    centre = float(y.mean())
    t = y - centre
    slope, cept, sigma = 0.0, 0.0, max(1.4826 * float(np.median(np.abs(t - np.median(t)))), 1e-6) * 10
    for k in range(rounds):
        new = robust_step(robust_sums(z, t, w, slope, cept, sigma), sigma)
        if max(abs(new[0] - slope), abs(new[1] - cept), abs(new[2] - sigma)) < 1e-10:
            break
        # plain steps settle in a few rounds; if not, halve them to end a cycle
        blend = 1.0 if k < 30 else 0.5
        slope, cept, sigma = (o + blend * (n - o) for o, n in zip((slope, cept, sigma), new))
    return centre + cept - slope * mean / sd, slope / sd


def svr(x, y, w, kernel: str, tol: float = 1e-3, rounds: int = 1_000_000):
    """Support vector regression: ``(mean, sd, bias, centres, coefficients)``.

    Sequential minimal optimisation on the dual by the most violating pair.
    Row ``i`` of the doubled problem pushes up (i < n) or down.
    """
    mean, sd = scaling(x)
    z = (x - mean) / sd
    n = len(z)
    spread = z.var()
    gamma = 1.0 / spread if spread > 0 else 1.0
    column = (lambda i: np.exp(-gamma * (z - z[i]) ** 2)) if kernel == "rbf" else (lambda i: z * z[i])
    diag = np.ones(n) if kernel == "rbf" else z * z
    sign = np.concatenate([np.ones(n), -np.ones(n)])
    top = np.concatenate([w, w]) * SVR_C
    alpha = np.zeros(2 * n)
    grad = np.concatenate([SVR_EPS - y, SVR_EPS + y])
    for _ in range(rounds):
        score = -sign * grad
        up = np.where(sign > 0, alpha < top, alpha > 0)
        down = np.where(sign > 0, alpha > 0, alpha < top)
        i = int(np.argmax(np.where(up, score, -np.inf)))
        lag = np.where(down, score[i] - score, 0.0)
        if lag.max() < tol:
            break
        # partner by the largest guaranteed decrease of the objective
        ki = column(i % n)
        bend = np.maximum(diag[i % n] + diag - 2 * ki, 1e-12)
        j = int(np.argmax(np.where(lag > 0, lag * lag / np.concatenate([bend, bend]), -1.0)))
        kj = column(j % n)
        step = (score[i] - score[j]) / bend[j % n]
        step = min(step, top[i] - alpha[i] if sign[i] > 0 else alpha[i])
        step = min(step, alpha[j] if sign[j] > 0 else top[j] - alpha[j])
        alpha[i] += sign[i] * step
        alpha[j] -= sign[j] * step
        change = step * (ki - kj)
        grad += sign * np.concatenate([change, change])
    score = -sign * grad
    free = (alpha > 0) & (alpha < top)
    if free.any():
        bias = float(score[free].mean())
    else:
        up = np.where(sign > 0, alpha < top, alpha > 0)
        down = np.where(sign > 0, alpha > 0, alpha < top)
        bias = float((score[up].max() + score[down].min()) / 2)
    beta = alpha[:n] - alpha[n:]
    used = beta != 0
    return mean, sd, bias, z[used], beta[used], gamma


def svr_line(x, y) -> tuple[float, float]:
    """``(intercept, slope)`` of the linear support vector fit; zeros without rows.

    On one feature the dual is not needed.  The margin loss is half the absolute
    deviation from each margin edge, so for a given slope the best intercept is
    the median of the edge residuals; the remaining convex problem in the slope
    is solved by bisection of its derivative.
    """
    if len(x) == 0:
        return 0.0, 0.0
    mean, sd = scaling(x)
    centre = float(y.mean())
    z = np.concatenate([x - mean, x - mean]) / sd
    edge = np.concatenate([y - centre + SVR_EPS, y - centre - SVR_EPS])

    def look(slope):
        r = edge - slope * z
        cept = float(np.median(r))
        d = r - cept
        tied = np.abs(d) <= 1e-12 * (1 + abs(cept))
        sign = np.where(tied, 0.0, np.sign(d))
        if tied.any():  # points on the line balance the signs of the others
            sign[tied] = np.clip(-sign.sum() / tied.sum(), -1, 1)
        return cept, slope - SVR_C / 2 * float(sign @ z)

    high = SVR_C / 2 * float(np.abs(z).sum()) + 1.0
    low = -high
    for _ in range(120):
        mid = (low + high) / 2
        if look(mid)[1] > 0:
            high = mid
        else:
            low = mid
    slope = (low + high) / 2
    return centre + look(slope)[0] - slope * mean / sd, slope / sd
