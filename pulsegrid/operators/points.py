"""Robust and support-vector fits of groups of any size, each from one aggregation.

A fit's rows are standardised and added up in the cells of a fixed grid over
(feature, target): sums and second moments of a cell, not its rows, go on.  The
grid is even near the middle and widens outwards as asinh does, so its cells are
bounded in number whatever the rows: standardised values are at most the root of
the row count.  One task per group solves on the cells.  Every group, small or
large, takes this way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fits
from ..session import materialise
from .groups import fields, over_groups
from .segments import SEGMENT_ROWS, dense_index, join_stats

#: Cells per unit: rows closer than about a hundredth of a deviation on both axes share one.
GRAIN = 96
SUMS = ("w", "wz", "wt", "wzz", "wzt", "wtt", "c", "cz", "ct")


def cell_sums(rows: DataFrame, keys: Sequence[str], grain: int = GRAIN) -> DataFrame:
    """``(keys, mx, sd, my, cell sums)`` of rows ``(keys, x, y, w)``; about the groups' means."""
    keys = list(keys)
    scale = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)

    def middle(c):
        """Scale of the grid: half the width of the middle two thirds, which an outlier does not stretch."""
        cut = F.percentile_approx(c, [1 / 6, 5 / 6], 1000)
        return F.when(cut[1] > cut[0], (cut[1] - cut[0]) / 2).otherwise(scale(c))

    stats = rows.groupBy(*keys).agg(
        F.avg("x").alias("mx"), scale("x").alias("sd"), F.avg("y").alias("my"), (scale("x") / middle("x")).alias("_fx"), middle("y").alias("_sy")
    )
    z, t, w = (F.col("x") - F.col("mx")) / F.col("sd"), F.col("y") - F.col("my"), F.col("w")
    at = lambda v: F.floor(F.asinh(v) * grain)
    terms = {"w": w, "wz": w * z, "wt": w * t, "wzz": w * z * z, "wzt": w * z * t, "wtt": w * t * t, "c": F.lit(1.0), "cz": z, "ct": t}
    return join_stats(rows.select(*keys, "x", "y", "w"), stats, keys).groupBy(
        *keys, "mx", "sd", "my", at(z * F.col("_fx")).alias("_z"), at(t / F.col("_sy")).alias("_t")
    ).agg(*[F.sum(v).alias(f"s_{n}") for n, v in terms.items()])


@dataclass(frozen=True)
class Cells:
    """Cell sums by name of groups that follow each other: ``bounds[g]`` to ``bounds[g + 1]`` is group ``g``, which has one ``mx, sd, my``."""

    sums: dict[str, np.ndarray]
    bounds: np.ndarray
    mx: np.ndarray
    sd: np.ndarray
    my: np.ndarray


def solve_cells(rows: DataFrame, keys: Sequence[str], schema: str, solve: Callable[[Cells], dict[str, Sequence]]) -> DataFrame:
    """``(keys, schema)``: what ``solve`` gives for each group, on its cells in a fixed order."""
    keys = list(keys)

    def run(c, bounds):
        sums = {n: c[f"s_{n}"].astype(float) for n in SUMS}
        return solve(Cells(sums, bounds, *(c[n][bounds[:-1]].astype(float) for n in ("mx", "sd", "my"))))

    return over_groups(cell_sums(rows, keys), keys, ["_z", "_t"], schema, run)


def cells_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, bounds: np.ndarray, grain: int = GRAIN) -> Cells:
    """``cell_sums`` of rows in memory: group ``g`` is the rows ``bounds[g]`` to ``bounds[g + 1]``, at least one."""
    first, n = bounds[:-1], np.diff(bounds)
    group = np.repeat(np.arange(len(n)), n)

    def middles(v):
        """Mean, deviation and scale of the grid; about the first row, so that a constant deviates by exactly nothing."""
        off = v - v[first][group]
        mean = np.add.reduceat(off, first) / n
        off = off - mean[group]
        sd = np.sqrt(np.add.reduceat(off * off, first) / n)
        sd = np.where(sd > 0, sd, 1.0)
        by = np.lexsort((off, group))
        low, high = (off[by[first + np.maximum(np.ceil(p * n).astype(int), 1) - 1]] for p in (1 / 6, 5 / 6))
        return v[first] + mean, off, sd, np.where(high > low, (high - low) / 2, sd)

    (mx, z, sd, sx), (my, t, _, sy) = middles(x), middles(y)
    z = z / sd[group]
    at = [np.floor(np.arcsinh(v) * grain) for v in (z * (sd / sx)[group], t / sy[group])]
    by = np.lexsort((at[1], at[0], group))
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([v[by[1:]] != v[by[:-1]] for v in (group, *at)])
    cell = np.flatnonzero(new)
    w, z, t = w[by], z[by], t[by]
    terms = {"w": w, "wz": w * z, "wt": w * t, "wzz": w * z * z, "wzt": w * z * t, "wtt": w * t * t, "c": np.ones(len(w)), "cz": z, "ct": t}
    sums = {m: np.add.reduceat(v, cell) for m, v in terms.items()}
    return Cells(sums, np.append(np.searchsorted(cell, first), len(cell)), mx, sd, my)


def huber(c: Cells, rounds: int = 500) -> dict:
    """Robust lines; a cell counts as near or far by its mean."""
    names = ("w", "wz", "wt", "wzz", "wzt", "wtt")
    s, bounds = {n: c.sums[n] for n in names}, c.bounds
    z, t = s["wz"] / s["w"], s["wt"] / s["w"]
    total = lambda v, bounds: np.add.reduceat(v, bounds[:-1])
    whole = total(s["w"], bounds)
    size = len(c.mx)
    line = np.zeros((3, size))
    line[2] = np.maximum(10 * np.sqrt(total(s["wtt"], bounds) / whole), 1e-6)
    settled = np.zeros(size, bool)
    todo = np.arange(size)
    for k in range(rounds):
        slope, cept, sigma = (np.repeat(v, np.diff(bounds)) for v in line[:, todo])
        r = t - slope * z - cept
        near = np.abs(r) <= fits.EPSILON * sigma
        far = np.where(near, 0.0, np.sign(r))
        parts = [np.where(near, s[n], 0.0) for n in names] + [np.where(near, 0.0, s["w"]), far * s["wz"], far * s["w"]]
        new = np.array(fits.robust_steps(np.array([*(total(v, bounds) for v in parts), whole]), line[2, todo]))
        moved = np.abs(new - line[:, todo])
        done = np.fmax(np.maximum(moved[0], moved[1]), moved[2]) < 1e-10
        settled[todo[done]] = True
        # plain steps settle in a few rounds; if not, shorter ones end a cycle
        blend = 1.0 if k < 30 else 0.5 if k < 100 else 0.1
        line[:, todo[~done]] += blend * (new - line[:, todo])[:, ~done]
        if done.all():
            break
        if done.any():
            mine = np.repeat(~done, np.diff(bounds))
            z, t, s = z[mine], t[mine], {n: v[mine] for n, v in s.items()}
            bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[~done])])
            todo, whole = todo[~done], whole[~done]
    slope, cept, _ = line
    return {"p0": c.my + cept - slope * c.mx / c.sd, "p1": slope / c.sd, "p2": np.zeros(size), "converged": settled}


def radial(c: Cells) -> dict:
    """Radial support vector fits in the exact basis of their kernel: ``[mean, sd, bias, gamma, centres, coefficients]``.

    ``converged``: the gap between the two problems of the fit is under a thousandth of its objective.
    """
    s = c.sums
    got = fits.radial_groups(s["cz"] / s["c"], s["ct"] / s["c"], s["w"], c.bounds)
    params = [np.concatenate([[mx, sd, my + bias, 1.0], centres, beta]) for (centres, beta, bias, _), mx, sd, my in zip(got, c.mx, c.sd, c.my)]
    return {"params": params, "converged": [gap < fits.SETTLED for *_, gap in got]}


#: Points of a group on which trees are grown: its distinct feature values, or as many runs of them by rank.
BINS = 1 << 18


def fit_steps(rows: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """``(keys, params, converged)``: boosted trees as one step function, ``[breaks, values]``.

    On one feature a tree is a partition of the line, so only sums of weight and target of equal feature values
    matter; of more than ``bins`` distinct values, neighbours by rank share a point.  An outlier so takes one point
    and moves no other.
    """
    keys = list(keys)
    w: Column = F.col("w")
    points = rows.groupBy(*keys, "x").agg(F.sum(w).alias("sw"), F.sum(w * F.col("y")).alias("sy"))
    points = materialise(points, "tree-points")
    stats = materialise(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")), "tree-sizes")
    large = stats.where(F.col("_d") > bins)
    sums = points.withColumn("x1", F.col("x")).withColumnRenamed("x", "x0")
    if large.head(1):
        # Ranks by a sketch's bounds, which part the values of a group into buckets of about equal size.
        mine = join_stats(points, large, keys)
        cuts = mine.groupBy(*keys).agg(F.percentile_approx("x", [k / 64 for k in range(1, 64)], 1000).alias("_cuts"))
        tagged = join_stats(mine, cuts, keys).withColumn("_run", F.size(F.filter("_cuts", lambda b: b <= F.col("x")))).drop("_cuts")
        ranked = dense_index(tagged, keys, "x", "_rank", bucket=F.col("_run"))
        at = F.floor(F.col("_rank") * F.lit(bins) / F.col("_d"))
        runs = ranked.groupBy(*keys, at.alias("_at")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum("sw").alias("sw"), F.sum("sy").alias("sy"))
        small = join_stats(sums, stats.where(F.col("_d") <= bins), keys).drop("_d")
        sums = small.unionByName(runs.drop("_at"))

    def solve(c, bounds):
        steps = fits.boosted_groups(c["x0"], c["x1"], c["sy"] / c["sw"], c["sw"], bounds)
        return {"params": [np.concatenate(s) for s in steps], "converged": [True] * len(steps)}

    return over_groups(sums, keys, ["x0"], "params array<double>, converged boolean", solve)


def steps_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """``fit_steps``' parameters of groups of at most ``BINS`` rows in memory."""
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    by = np.lexsort((x, group))
    x, w, wy = x[by], w[by], (w * y)[by]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(new)
    weight = np.add.reduceat(w, at)
    ends = np.append(np.searchsorted(at, bounds[:-1]), len(at))
    return [np.concatenate(s) for s in fits.boosted_groups(x[at], x[at], np.add.reduceat(wy, at) / weight, weight, ends)]


def predict_parts(test: DataFrame, params: DataFrame, keys: Sequence[str], predict: Callable[[np.ndarray, np.ndarray], np.ndarray], part_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``test`` rows with ``f = predict(params, x)``; parts of a group go separately."""
    keys, names = list(keys), test.columns
    rest = [n for n in names if n not in keys]
    sizes = test.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts"))
    salt = F.pmod(F.xxhash64(*rest), F.col("_parts"))
    rows = join_stats(test, sizes, keys).withColumn("_salt", salt).drop("_parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    spread = materialise(sizes.withColumn("_salt", every).drop("_parts").join(params, keys), "parts")
    # A part's rows become one row, so that its parameters are read once and Python sees arrays only.
    lists = rows.groupBy(*keys, "_salt").agg(F.collect_list(F.struct(*rest)).alias("_rows"))

    @F.pandas_udf("array<double>")
    def run(params: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([np.full(len(v), np.nan) if p is None else predict(p, v.astype(float)) for p, v in zip(params, x)], dtype=object)

    value = run("params", F.col("_rows.x"))
    out = lists.join(spread, [*keys, "_salt"], "left").select(*keys, F.inline(F.arrays_zip(F.col("_rows"), value.alias("f"))))
    out = out.select(*keys, *[F.col(f"_rows.{n}").alias(n) for n in rest], "f").select(*names, "f")
    return out.withColumn("f", F.when(~F.isnan("f"), F.col("f")))
