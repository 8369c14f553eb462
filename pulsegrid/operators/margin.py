"""Exact linear support-vector lines of groups of any size.

The fit ``min s^2 / 2 + C sum max(0, |t - s z - c| - eps)`` has, for a slope ``s``, its best intercept at the median of
the residuals of both margin edges ``t +- eps``, and its derivative follows from the signs of the residuals about
that median.  A point far from both edges has the same sign for all lines that may still be the best, so only its
sum of ``z`` matters.

Each round adds the points that are still open up in the cells of a grid around the best line so far, with the
extent of each cell.  From the extents follow bounds of the median and of the derivative for any slope, and so a
proven interval of slopes and intercepts.  It shrinks with the cells, and with it the band of open points, until they
fit in one task, where they are solved as they are.  Nothing is approximate: a cell only decides what its extent
proves.  Groups that are small from the start need no round: they go to their task as plain rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fits
from ..session import materialise
from .groups import fields, over_groups
from .segments import join_stats

#: Open points (two for each row) of a group that one task solves.
OPEN = 40_000
#: Cells of the feature for each deviation near the middle, and across the band of open points; the latter grow finer with each round.
ALONG, ACROSS, FINER = 48, 256, 4
#: Rounds after which a group whose points can't be told apart is given up (``converged`` false).
ROUNDS = 12

REGION = "n long, spread double, low double, high double, c_low double, c_high double, open long, stuck boolean"


def scaled(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(keys, z, t)`` of rows ``(keys, x, y)``, and ``(keys, n, mx, sd, my, sy)``."""
    deviation = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), deviation("x").alias("sd"), F.avg("y").alias("my"), deviation("y").alias("sy"))
    stats = materialise(stats, "margin-stats")
    z, t = (F.col("x") - F.col("mx")) / F.col("sd"), F.col("y") - F.col("my")
    return materialise(join_stats(rows.select(*keys, "x", "y"), stats, keys).select(*keys, z.alias("z"), t.alias("t")), "margin-rows"), stats


def edges(rows: DataFrame, region: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both margin edges of each row with their residual ``r`` about the region's middle slope and ``q``: beyond +-1 the region decides."""
    both = join_stats(rows, region, keys).withColumn("side", F.explode(F.array(F.lit(fits.SVR_EPS), F.lit(-fits.SVR_EPS))))
    mid, half = (F.col("low") + F.col("high")) / 2, (F.col("high") - F.col("low")) / 2
    r = F.col("t") + F.col("side") - mid * F.col("z")
    width = half * F.abs("z") + (F.col("c_high") - F.col("c_low")) / 2
    q = F.try_divide(r - (F.col("c_low") + F.col("c_high")) / 2, width)
    # A region without width decides by the sign; sums in floating point decide nothing near the border.
    q = F.coalesce(q, F.signum(r - F.col("c_low")) * 2)
    return both.select(*keys, "spread", "side", "z", r.alias("r"), q.alias("q"))


def summed(points: DataFrame, keys: Sequence[str], *cell) -> DataFrame:
    """Number, sums and extents of the open points by cell, and of the decided ones (``cls`` -1 and 1)."""
    cls = F.when(F.col("q") > 1 + 1e-9, 1).when(F.col("q") < -1 - 1e-9, -1).otherwise(0)
    at = [F.when(cls == 0, c).alias(f"c{k}") for k, c in enumerate(cell)]
    return points.groupBy(*keys, cls.alias("cls"), *at).agg(
        F.count(F.lit(1)).alias("m"), F.sum("z").alias("sz"), F.sum("r").alias("sr"),
        F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("r").alias("r0"), F.max("r").alias("r1"),
    )


def decided(g: pd.DataFrame) -> tuple[pd.DataFrame, fits.Decided]:
    up, down = g[g.cls == 1], g[g.cls == -1]
    return g[g.cls == 0].sort_values(["r0", "z0"]), fits.Decided(int(up.m.sum()), int(down.m.sum()), float(up.sz.sum() - down.sz.sum()))


def narrowed(region: DataFrame, rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The regions after round ``k``; the first has no band yet and lays its grid over all residuals."""
    across = F.col("q") * ACROSS * FINER ** (k - 1) if k else F.asinh(F.col("r") / F.col("spread")) * ALONG
    cells = summed(edges(rows, region, keys), keys, F.floor(F.asinh("z") * ALONG), F.floor(across), F.col("side"))
    cells = cells.join(region, list(keys))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        one = g.iloc[0]
        inside, rest = decided(g)
        mid, old = (one.low + one.high) / 2, (one.low, one.high, one.c_low, one.c_high)
        new = fits.margin_region(*(inside[c].to_numpy(float) for c in ("m", "sz", "sr", "z0", "z1", "r0", "r1")), rest, mid, old)
        stuck = bool(k and new[4] > 0.7 * one.open)
        got = {"n": one.n, "spread": one.spread, "low": new[0], "high": new[1], "c_low": new[2], "c_high": new[3], "open": new[4], "stuck": stuck}
        return pd.DataFrame({**{k: [one[k]] for k in keys}, **{k: [v] for k, v in got.items()}})

    return cells.groupBy(*keys).applyInPandas(run, f"{fields(region, keys)}, {REGION}")


LINE = "a double, b double, converged boolean"


def small_lines(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lines of groups whose rows fit in one task."""

    def solve(c, bounds):
        first, n = bounds[:-1], np.diff(bounds)
        group = np.repeat(np.arange(len(n)), n)
        mean = lambda v: np.add.reduceat(v, first) / n
        x, y = c["x"].astype(float), c["y"].astype(float)
        # About the group's first row, so that a constant feature deviates by exactly nothing.
        x0, y0 = x[first], y[first]
        x, y = x - x0[group], y - y0[group]
        mx, my = mean(x), mean(y)
        x -= mx[group]
        sd = np.sqrt(mean(x * x))
        sd = np.where(sd > 0, sd, 1.0)
        z, r = np.repeat(x / sd[group], 2), np.repeat(y - my[group], 2) + np.tile([fits.SVR_EPS, -fits.SVR_EPS], len(y))
        none, top = np.zeros(len(n)), fits.SVR_C * n + 1.0
        slope, cept = fits.margin_lines(z, r, np.ones(len(z)), 2 * bounds, none, none, none, none, -top, top)
        return {"a": y0 + my + cept - slope * (x0 + mx) / sd, "b": -slope / sd, "converged": np.ones(len(n), bool)}

    return over_groups(rows.select(*keys, "x", "y"), keys, [], LINE, solve)


def fit_margin_lines(rows: DataFrame, keys: Sequence[str], open_points: int = OPEN) -> DataFrame:
    """``(keys, a, b, converged)`` of the lines ``y = a - b x`` of rows ``(keys, x, y)`` without nulls."""
    keys = list(keys)
    rows = materialise(rows.select(*keys, "x", "y"), "margin-input")
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(2 * F.col("n") > open_points)
    large = materialise(large.select(*keys), "margin-large")
    if not large.head(1):
        return small_lines(rows, keys)
    small = small_lines(rows.join(large, keys, "left_anti"), keys)
    return small.unionByName(large_lines(rows.join(large, keys, "left_semi"), keys, open_points))


def large_lines(rows: DataFrame, keys: Sequence[str], open_points: int = OPEN) -> DataFrame:
    """The lines of groups of any size."""
    keys = list(keys)
    rows, stats = scaled(rows, keys)
    # At first nothing is known: slopes up to where the penalty alone outweighs all rows, intercepts within all residuals.
    top = F.lit(fits.SVR_C) * F.col("n") + 1.0  # the derivative's sum is at most C n, as |z| averages at most 1
    widest = rows.groupBy(*keys).agg(F.max(F.abs("z")).alias("_z"), F.max(F.abs("t")).alias("_t"))
    reach = F.col("_t") + fits.SVR_EPS
    start = stats.join(widest, keys).select(
        *keys, "n", F.col("sy").alias("spread"), (-top).alias("low"), top.alias("high"), (-reach - top * F.col("_z")).alias("c_low"), (reach + top * F.col("_z")).alias("c_high"),
        (2 * F.col("n")).alias("open"), F.lit(False).alias("stuck"),
    )
    region = materialise(start, "margin-region")
    for k in range(ROUNDS):
        wide = region.where(F.col("open") > open_points).where("not stuck")
        if not wide.head(1):
            break
        rest = region.where((F.col("open") <= open_points) | F.col("stuck"))
        region = materialise(rest.unionByName(narrowed(wide, rows, keys, k)), "margin-region")
    # What is still open, as distinct points with their numbers; equal points, however many, are one.
    last = materialise(summed(edges(rows, region, keys), keys, F.col("z"), F.col("r")), "margin-open")
    crowd = last.where("cls = 0").groupBy(*keys).agg((F.count(F.lit(1)) > open_points).alias("crowd"))
    last = last.join(region.select(*keys, "low", "high"), keys).join(stats.drop("n"), keys).join(crowd, keys)

    def solve(c, bounds):
        first, inside = bounds[:-1], c["cls"] == 0
        total = lambda v, of: np.add.reduceat(np.where(of, v, 0.0), first)
        up, down = c["cls"] == 1, c["cls"] == -1
        rest = total(c["m"], up), total(c["m"], down), total(c["sz"], up) - total(c["sz"], down)
        own = np.concatenate([[0], np.cumsum(total(1.0, inside))]).astype(int)
        low, high, mx, sd, my = (c[k][first] for k in ("low", "high", "mx", "sd", "my"))
        slope, cept = fits.margin_lines(*(c[k][inside].astype(float) for k in ("z0", "r0", "m")), own, *rest, (low + high) / 2, low, high)
        return {"a": my + cept - slope * mx / sd, "b": -slope / sd, "converged": ~c["crowd"][first].astype(bool)}

    # Only a group whose points can't be told apart has more of them than a task should hold; points within a ten-thousandth go together there.
    near = last.where("crowd and cls = 0").groupBy(*keys, "cls", F.round("z0", 4), F.round("r0", 4), "low", "high", "crowd", "mx", "sd", "my").agg(
        F.sum("m").alias("m"), F.avg("z0").alias("z0"), F.avg("r0").alias("r0")
    ).withColumn("sz", F.col("z0") * F.col("m"))
    need = [*keys, "cls", "m", "sz", "z0", "r0", "low", "high", "crowd", "mx", "sd", "my"]
    solved = last.where("not (crowd and cls = 0)").select(*need).unionByName(near.select(*need))
    return over_groups(solved, keys, ["r0", "z0"], LINE, solve)
