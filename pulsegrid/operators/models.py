"""Calibration models over long tables of windows: fit, validate, choose, apply.

Samples are rows ``(keys, combo, row, n, time_center, motion, x, y, w)``: ``row``
numbers the windows of a session in time order, ``n`` is their count.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fits
from ..functions.scalars import clip, pair_label, safe_ratio
from ..session import materialise
from .features import per_pair
from .groups import map_groups, together
from .margin import fit_margin_lines
from .points import cells_of, fields, fit_steps, huber, predict_parts, radial, solve_cells, steps_of
from .quantiles import exact_quantiles
from .segments import SEG, dense_index, join_segments, join_stats, with_segment

CLOSED = ("linear", "quadratic", "elasticnet")
ROBUST = ("huber", "ransac")
KERNEL = ("svr_rbf", "gbr")


@dataclass(frozen=True)
class Kind:
    """A calibration model: how it is fitted, and what its parameters give for a feature.

    ``fit(rows, keys)`` takes rows ``(keys, x, y, w)``, with ``row`` in a group's order, and gives a row
    ``(keys, params array<double>, converged boolean)`` for each group of any size.  ``predict(params, x)`` works on arrays;
    without it the parameters are a polynomial's, which needs no Python.  ``solve(x, y, w, bounds, salt)`` may give the
    parameters of the same fit for groups in memory: ``bounds[g]`` to ``bounds[g + 1]`` are the rows of group ``g`` in order,
    ``salt`` is the hash of its keys; NaN stands for parameters that are not there.
    """

    name: str
    fit: Callable[[DataFrame, Sequence[str]], DataFrame]
    predict: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    solve: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Sequence[np.ndarray]] | None = None


KINDS: dict[str, Kind] = {}


def register(kind: Kind) -> Kind:
    """Make a model known to validation, selection, training and prediction under its name."""
    KINDS[kind.name] = kind
    return kind


def known(names: Sequence[str]) -> list[Kind]:
    unknown = sorted(set(names) - set(KINDS))
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    return [KINDS[n] for n in names]


def channel_quality(channels: Column, name: Column) -> Column:
    return F.get(F.filter(channels, lambda c: c["channel"] == name), F.lit(0))["sqi"]


def quality_weight(a: Column, b: Column) -> Column:
    """Mean of the available qualities in 0..1, at least 0.05."""
    mean = F.coalesce((a + b) / 2, a, b)
    return clip(clip(mean, 0.0, 1.0), 0.05)


def samples(features: DataFrame, keys: Sequence[str], weighted: bool = True) -> DataFrame:
    """Long sample table of a feature table (see ``features.window_features``)."""
    numbered = dense_index(features, keys, "window_id", "row")
    counts = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    long = per_pair(
        join_stats(numbered, counts, keys), keys, "row", "n", "time_center", "spo2", "high_motion_window", "channels"
    )
    weight = quality_weight(channel_quality(F.col("channels"), F.col("a")), channel_quality(F.col("channels"), F.col("b")))
    return long.select(
        *keys, pair_label(F.col("a"), F.col("b")).alias("combo"), "row", "n", "time_center",
        F.col("high_motion_window").alias("motion"), F.col("r").alias("x"), F.col("spo2").alias("y"),
        (weight if weighted else F.lit(1.0)).alias("w"),
    ).where(F.col("x").isNotNull())


def standardise(rows: DataFrame, keys: Sequence[str], col: str = "x", out: str = "z") -> DataFrame:
    """``out``: the column over its group's mean and population deviation (a constant one: null)."""
    stats = rows.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    return join_stats(rows, stats, keys).withColumn(out, safe_ratio(F.col(col) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


# ---- closed forms -------------------------------------------------------------

MOMENTS = ("s0", "sx", "sy", "sxx", "sxy", "sxxx", "sxxxx", "sxxy", "c", "cx", "cxx")


def moments(rows: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Weighted power sums per group, taken about the mean of ``keys``' rows.

    The sums add up, so they serve any union of groups of the same ``keys``.
    """
    centre = rows.groupBy(*keys).agg(F.avg("x").alias("x0"), F.avg("y").alias("y0"))
    return power_sums(join_stats(rows, centre, keys), list(dict.fromkeys([*keys, *by])))


def power_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sums of rows that carry their centre ``x0, y0``."""
    return rows.groupBy(*by, "x0", "y0").agg(*[F.sum(t).alias(m) for m, t in zip(MOMENTS, power_terms())])


def power_terms() -> list[Column]:
    """What a row adds to the sums."""
    u, v, w = F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("w")
    return [w, w * u, w * v, w * u * u, w * u * v, w * u * u * u, w * u * u * u * u, w * u * u * v, F.lit(1.0), u, u * u]


def closed_forms(models: Sequence[str] = CLOSED) -> list[list[Column]]:
    """For each model ``p0, p1, p2`` as they follow from a row of sums."""
    s0 = F.col("s0")
    mu, mv = F.col("sx") / s0, F.col("sy") / s0
    m2 = F.col("sxx") / s0
    vu = m2 - mu * mu
    cuv = F.col("sxy") / s0 - mu * mv
    # weighted (co)variances of u, u^2 and v
    c12 = F.col("sxxx") / s0 - mu * m2
    c22 = F.col("sxxxx") / s0 - m2 * m2
    c2v = F.col("sxxy") / s0 - m2 * mv
    det = vu * c22 - c12 * c12
    q1 = safe_ratio(cuv * c22 - c2v * c12, det)
    q2 = safe_ratio(c2v * vu - cuv * c12, det)
    slope = safe_ratio(cuv, vu)
    # penalised slope on the unit-variance feature (unweighted scaling)
    sd2 = F.col("cxx") / F.col("c") - F.col("cx") * F.col("cx") / (F.col("c") * F.col("c"))
    sd = F.when(sd2 > 0, F.sqrt(sd2)).otherwise(1.0)
    zc, zq = cuv / sd, vu / (sd * sd)
    shrunk = F.signum(zc) * F.greatest(F.abs(zc) - 0.5, F.lit(0.0)) / (zq + 0.5) / sd

    def poly(b: Column, c: Column) -> tuple[Column, Column, Column]:
        """Coefficients in x from those in u = x - x0, v = y - y0."""
        a = mv - b * mu - c * m2
        x0, y0 = F.col("x0"), F.col("y0")
        return y0 + a - b * x0 + c * x0 * x0, b - 2 * c * x0, c

    zero = F.lit(0.0)
    forms = {"linear": poly(slope, zero), "quadratic": poly(q1, q2), "elasticnet": poly(shrunk, zero)}
    return [[e.alias(f"p{i}") for i, e in enumerate(forms[m])] for m in models]


def solve_closed(sums: DataFrame, models: Sequence[str] = CLOSED) -> DataFrame:
    """One row per group and model with ``p0 + p1 x + p2 x^2``."""
    rest = [c for c in sums.columns if c not in (*MOMENTS, "x0", "y0")]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), *p) for m, p in zip(models, closed_forms(models))])
    return sums.select(*rest, F.inline(rows))


def fit_closed(rows: DataFrame, keys: Sequence[str], models: Sequence[str] = CLOSED) -> DataFrame:
    return solve_closed(moments(rows, [], keys), models)


def poly_value(x: Column) -> Column:
    return F.col("p0") + F.col("p1") * x + F.col("p2") * x * x


# ---- robust and margin lines ---------------------------------------------------

def fit_huber(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Robust lines of all groups at once: ``(keys, model, p0, p1, p2, converged)``."""
    got = solve_cells(rows, keys, "p0 double, p1 double, p2 double, converged boolean", huber)
    return got.select(*keys, F.lit("huber").alias("model"), "p0", "p1", "p2", "converged")


def fit_svr_line(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Linear support vector calibrations ``spo2 = a - b r`` of all groups at once, exact: ``(keys, a, b, converged)``."""
    return fit_margin_lines(rows.select(*keys, "x", "y").dropna(), keys)


SEED, TRIALS = 42, 100  # of the draws


def fit_ransac(rows: DataFrame, keys: Sequence[str], order: str = "row", seed: int = SEED, trials: int = TRIALS) -> DataFrame:
    """Consensus lines of all groups at once.

    The rows of a group are numbered by ``order``; ``trials`` pairs are drawn by
    number (a join on the drawn numbers).  Each segment of a group counts which of
    its rows agree with each of the drawn lines, the counts add up, and the best
    line's agreeing rows are refitted in closed form.  A group with fewer than two
    rows has no line.
    """
    keys = list(keys)
    numbered = dense_index(rows.select(*keys, order, "x", "y", "w"), keys, order, "_row").drop(order)
    numbered = materialise(with_segment(numbered, "_row"), "ransac")
    limit = exact_quantiles(numbered, keys, {"_med": (F.col("y"), [0.5])})
    limit = exact_quantiles(join_stats(numbered, limit, keys), keys, {"limit": (F.abs(F.col("y") - F.col("_med")), [0.5])})
    size = numbered.groupBy(*keys).agg((F.max("_row") + 1).alias("_n")).where("_n >= 2")
    draws = size.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    h = [F.xxhash64(*keys, "trial", F.lit(seed * 10 + s)) for s in (0, 1)]
    first = F.pmod(h[0], F.col("_n"))
    second = F.pmod(first + 1 + F.pmod(h[1], F.col("_n") - 1), F.col("_n"))
    ends = draws.select(*keys, "trial", F.inline(F.array(
        F.struct(F.lit("i").alias("end"), first.alias("_row")), F.struct(F.lit("j").alias("end"), second.alias("_row"))
    )))
    pick = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    # The planner takes the drawn numbers for as small as the groups they are made of, and would send them to all tasks through the driver.
    drawn = ends.hint("merge").join(numbered, [*keys, "_row"]).groupBy(*keys, "trial").agg(
        pick("i", "x").alias("xi"), pick("i", "y").alias("yi"), pick("j", "x").alias("xj"), pick("j", "y").alias("yj"),
        F.avg("y").alias("ym"),
    )
    slope = F.coalesce(F.try_divide(F.col("yj") - F.col("yi"), F.col("xj") - F.col("xi")), F.lit(0.0))
    lines = drawn.select(*keys, "trial", slope.alias("b"), F.when(F.col("xi") == F.col("xj"), F.col("ym")).otherwise(F.col("yi") - slope * F.col("xi")).alias("a"))
    table = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("trial", "a", "b"))).alias("lines")).join(limit, keys)
    spread = materialise(numbered.select(*keys, SEG).distinct().join(table, keys), "lines")

    def score(g: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        names = ["trial", "a", "b", "limit", "agree", "sse", "sy", "syy"]
        if not len(g) or not len(t):
            return pd.DataFrame(columns=[*keys, *names])
        drawn = [(r["trial"], r["a"], r["b"]) for r in t.lines.iloc[0]]
        x, y, most = g.x.to_numpy(float), g.y.to_numpy(float), float(t.limit.iloc[0])
        out = []
        for trial, a, b in drawn:
            e = y - a - b * x
            ok = np.abs(e) <= most
            out.append((trial, a, b, most, int(ok.sum()), float((e[ok] ** 2).sum()), float(y[ok].sum()), float((y[ok] ** 2).sum())))
        got = pd.DataFrame(out, columns=names)
        for k in keys:
            got[k] = t[k].iloc[0]
        return got[[*keys, *names]]

    kinds = f"{fields(numbered, keys)}, trial int, a double, b double, limit double, agree long, sse double, sy double, syy double"
    sums = numbered.groupBy(*keys, SEG).cogroup(spread.groupBy(*keys, SEG)).applyInPandas(score, kinds)
    judged = sums.groupBy(*keys, "trial", "a", "b", "limit").agg(*[F.sum(c).alias(c) for c in ("agree", "sse", "sy", "syy")]).where("agree > 0")
    spread_y = F.col("syy") - F.col("sy") * F.col("sy") / F.col("agree")
    fit = F.when(spread_y > 0, 1 - F.col("sse") / spread_y).otherwise(F.lit(float("-inf")))
    best = judged.groupBy(*keys).agg(F.max_by(F.struct("a", "b", "limit"), F.struct("agree", fit.alias("s"), (-F.col("trial")).alias("t"))).alias("l"))
    inliers = join_stats(numbered, best, keys).where(F.abs(F.col("y") - F.col("l.a") - F.col("l.b") * F.col("x")) <= F.col("l.limit")).select(*keys, "x", "y", "w")
    return fit_closed(inliers, keys, ["linear"]).withColumn("model", F.lit("ransac"))


# ---- expanding-window validation ----------------------------------------------

def add_blocks(rows: DataFrame, folds: int = 5) -> DataFrame:
    """``block`` 0 only trains; block ``f`` is the test block of fold ``f`` and
    trains the later folds."""
    size = F.expr(f"n div {folds + 1}")
    first = F.col("n") - folds * size
    return rows.withColumn(
        "block",
        F.when(F.col("row") < first, 0).otherwise(1 + F.floor((F.col("row") - first) / size)).cast("int"),
    )


def cv_closed(rows: DataFrame, keys: Sequence[str], folds: int = 5, models: Sequence[str] = CLOSED) -> DataFrame:
    """Out-of-fold predictions of the closed-form models.

    Rows are aggregated once per block; the training sums of a fold are running
    totals over at most ``folds`` small rows.  Rows are not copied per fold.
    """
    by = [*keys, "combo"]
    blocked = add_blocks(rows, folds)
    upto = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = moments(blocked, ["block"], by)
    running = sums.where(F.col("block") < folds).select(
        *by, "x0", "y0", (F.col("block") + 1).alias("fold"), *[F.sum(m).over(upto).alias(m) for m in MOMENTS]
    )
    params = solve_closed(running, models)
    test = blocked.where("block > 0").withColumnRenamed("block", "fold")
    return test.join(params, [*by, "fold"]).select(
        *by, "model", "fold", "row", "time_center", "motion", F.col("y").alias("y_true"), poly_value(F.col("x")).alias("y_pred")
    )


def fold_rows(blocked: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of all folds; a block trains every later fold, so it is there at most ``folds`` times."""
    train = blocked.where(F.col("block") < folds).withColumn("fold", F.explode(F.sequence(F.col("block") + 1, F.lit(folds))))
    return train, blocked.where("block > 0").withColumnRenamed("block", "fold")


def fit_shape(rows: DataFrame, keys: Sequence[str], model: str) -> DataFrame:
    """``(keys, params, converged)`` of a model that is not a polynomial."""
    if model == "gbr":
        return fit_steps(rows, keys)
    return solve_cells(rows, keys, "params array<double>, converged boolean", radial)


def poly_params(fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    settled = F.col("converged") if "converged" in fitted.columns else F.lit(True)
    return fitted.select(*keys, F.array("p0", "p1", "p2").alias("params"), settled.alias("converged"))


def radial_value(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    half = (len(p) - 4) // 2
    return fits.svr_predict((p[0], p[1], p[2], p[4 : 4 + half], p[4 + half :], p[3]), x)


def step_value(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    half = len(p) // 2
    return fits.step_predict((p[:half], p[half:]), x)


for _name in CLOSED:
    register(Kind(_name, lambda rows, keys, m=_name: poly_params(fit_closed(rows, keys, [m]), keys)))
def solve_huber(x, y, w, bounds, salt) -> np.ndarray:
    got = huber(cells_of(x, y, w, bounds))
    return np.stack([got["p0"], got["p1"], got["p2"]], axis=1)


def solve_ransac(x, y, w, bounds, salt) -> np.ndarray:
    return np.pad(fits.consensus_lines(x, y, w, bounds, salt, SEED, TRIALS), ((0, 0), (0, 1)))


def solve_radial(x, y, w, bounds, salt) -> list[np.ndarray]:
    return radial(cells_of(x, y, w, bounds))["params"]


def solve_steps(x, y, w, bounds, salt) -> list[np.ndarray]:
    return steps_of(x, y, w, bounds)


register(Kind("huber", lambda rows, keys: poly_params(fit_huber(rows, keys), keys), solve=solve_huber))
register(Kind("ransac", lambda rows, keys: poly_params(fit_ransac(rows, keys), keys), solve=solve_ransac))
register(Kind("svr_rbf", lambda rows, keys: fit_shape(rows, keys, "svr_rbf"), radial_value, solve_radial))
register(Kind("gbr", lambda rows, keys: fit_shape(rows, keys, "gbr"), step_value, solve_steps))


def poly_of(params: Column, x: Column) -> Column:
    return F.get(params, F.lit(0)) + F.get(params, F.lit(1)) * x + F.get(params, F.lit(2)) * x * x


def predicted(rows: DataFrame, params: DataFrame, keys: Sequence[str], kind: Kind) -> DataFrame:
    """``rows`` with ``f``, the value of their group's parameters ``(keys, params)`` at ``x``; null without parameters."""
    if kind.predict:
        return predict_parts(rows, params.select(*keys, "params"), keys, kind.predict)
    return join_stats(rows, params.select(*keys, "params"), keys, "left").withColumn("f", poly_of(F.col("params"), F.col("x"))).drop("params")


def cv_kind(train: DataFrame, test: DataFrame, keys: Sequence[str], kind: Kind) -> DataFrame:
    """Out-of-fold predictions of one model, written: plans of several models together fill the driver's memory."""
    by = [*keys, "combo", "fold"]
    params = materialise(kind.fit(train.select(*by, "row", "x", "y", "w"), by), "fold-models")
    pred = predicted(test.select(*by, "x", "row", "time_center", "motion", "y"), params, by, kind)
    pred = pred.select(*keys, "combo", F.lit(kind.name).alias("model"), "fold", "row", "time_center", "motion", F.col("y").alias("y_true"), F.col("f").alias("y_pred"))
    return materialise(pred, "fold-predictions")


#: Windows of a session up to which its folds are made, fitted and predicted in one task.
HELD_ROWS = 1 << 14
#: Rows of small sessions that are fitted together.
HELD_TOGETHER = 1 << 17


def split_sessions(blocked: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of sessions that one task holds and of those that are too long or lack a number (none: None)."""
    keys = list(keys)
    number = lambda c: F.coalesce(F.abs(c) < 1e300, F.lit(False))
    plain = (F.col("n") <= HELD_ROWS) & number("x") & number("y") & number("w") & (F.col("w") > 0)
    apart = materialise(blocked.where(~plain).select(*keys).distinct(), "apart")
    if not apart.head(1):
        return blocked, None
    return blocked.join(apart, keys, "left_anti"), blocked.join(apart, keys, "left_semi")


def closed_held(blocked: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """``cv_closed`` of sessions that one task holds: rows meet the sums of the blocks before theirs without a join."""
    by = [*keys, "combo"]
    rows = blocked.select(*by, "block", "row", "time_center", "motion", "x", "y", "w").dropna(subset=[*by, "block"])
    every = Window.partitionBy(*by)
    ordered = every.orderBy("block")
    before = ordered.rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"x0": F.avg("x").over(every), "y0": F.avg("y").over(every)})
    sums = {m: F.sum(t).over(before) for m, t in zip(MOMENTS, power_terms())}
    # As in ``cv_closed``, a fold's model goes with the last block that trains it: without rows in it there is none.
    met = rows.withColumns({**sums, "_last": F.count(F.lit(1)).over(ordered.rangeBetween(-1, -1))}).where("block > 0 and _last > 0")
    forms = F.array(*[F.struct(F.lit(m).alias("model"), *p) for m, p in zip(models, closed_forms(models))])
    fitted = met.select(*by, "block", "row", "time_center", "motion", "x", "y", F.inline(forms))
    return fitted.select(
        *by, "model", F.col("block").alias("fold"), "row", "time_center", "motion", F.col("y").alias("y_true"), poly_value(F.col("x")).alias("y_pred")
    )


def cv_held(blocked: DataFrame, keys: Sequence[str], folds: int, kinds: Sequence[Kind]) -> DataFrame:
    """Out-of-fold predictions of ``kinds`` that fit rows in memory, for sessions that one task holds; written.

    The rows of a session and pair meet in one task once, for all folds and models.
    """
    by = [*keys, "combo"]
    rows = together(blocked.select(*by, "block", "row", "time_center", "motion", "x", "y", "w").dropna(subset=[*by, "block"]), by, ["block", "row"])
    made = [f"f{k}" for k in range(len(kinds))]

    def solve(c, bounds):
        block, x, y, w = c["block"], *(c[n].astype(float) for n in ("x", "y", "w"))
        size = np.diff(bounds)
        group = np.repeat(np.arange(len(size)), size)
        # Rows of a group come by block: what trains a fold is the group's start, what it tests follows.
        ends = np.stack([bounds[:-1] + np.bincount(group, block < f, len(size)).astype(int) for f in range(1, folds + 2)], axis=1)
        many = (ends[:, :-1] - bounds[:-1, None]).ravel()
        fitted = np.flatnonzero(many > 0)  # group times folds plus fold, without those that have nothing to train on
        own = np.concatenate([[0], np.cumsum(many[fitted])])
        at = np.arange(own[-1]) - np.repeat(own[:-1] - bounds[fitted // folds], many[fitted])
        salt = fits.hash_int(fitted % folds + 1, c["_salt"][bounds[fitted // folds]])
        tests = [(ends[g, f], ends[g, f + 1]) for g, f in zip(fitted // folds, fitted % folds)]
        values = {}
        for name, kind in zip(made, kinds):
            f = np.full(len(x), np.nan)
            for p, (a, b) in zip(kind.solve(x[at], y[at], w[at], own, salt), tests):
                f[a:b] = kind.predict(p, x[a:b]) if kind.predict else p[0] + p[1] * x[a:b] + p[2] * x[a:b] * x[a:b]
            values[name] = f[block > 0]
        return block > 0, values

    salted = rows.withColumn("_salt", F.xxhash64(*by))
    read = ["block", "x", "y", "w", "_salt"]
    pred = map_groups(salted, by, read, [*by, "block", "row", "time_center", "motion", "y"], made, solve, HELD_TOGETHER)
    pred = materialise(pred, "fold-predictions")
    each = F.array(*[F.struct(F.lit(k.name).alias("model"), F.col(n).alias("y_pred")) for n, k in zip(made, kinds)])
    pred = pred.select(*by, F.col("block").alias("fold"), "row", "time_center", "motion", F.col("y").alias("y_true"), F.inline(each))
    return pred.select(*by, "model", "fold", "row", "time_center", "motion", "y_true", "y_pred")


def cross_validate(rows: DataFrame, keys: Sequence[str], folds: int = 5, models: Sequence[str] = (*CLOSED, *ROBUST, *KERNEL)) -> DataFrame:
    """Out-of-fold predictions of all models, one row per window, pair and model.

    Every model has one algorithm for groups of every size.  Sessions that one task holds go there once; of
    others the training rows are added up for each fold and model.  Sessions with fewer windows than
    ``folds + 1`` have no test rows; ``plans.calibration.outcomes`` names them.
    """
    kinds = known(models)
    rows = rows.where(F.col("n") > folds)
    others = [k for k in kinds if k.name not in CLOSED]
    closed = [m for m in models if m in CLOSED]
    if not others:
        return cv_closed(rows, keys, folds, closed)
    blocked = materialise(add_blocks(rows, folds), "blocks")
    here, apart = split_sessions(blocked, keys)
    held, parts = [k for k in others if k.solve], []
    if closed:
        parts.append(closed_held(here, keys, closed))
    if closed and apart is not None:
        parts.append(cv_closed(apart.drop("block"), keys, folds, closed))
    if held:
        parts.append(cv_held(here, keys, folds, held))
    if held and apart is not None:
        parts += [cv_kind(*fold_rows(apart, folds), keys, k) for k in held]
    parts += [cv_kind(*fold_rows(blocked, folds), keys, k) for k in others if not k.solve]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- metrics --------------------------------------------------------------------

METRICS = ("RMSE", "MAE", "Bias", "SD_error", "R2", "MAPE_pct")


def metric_columns(true: Column, pred: Column, keep: Column | None = None, suffix: str = "") -> list[Column]:
    """Error metrics of a group; with ``keep`` only over the rows it selects and
    only where more than one is selected."""
    pick = (lambda c: c) if keep is None else (lambda c: F.when(keep, c))
    y, e = pick(true), pick(pred - true)
    n, sse = F.count(e), F.sum(e * e)
    total = F.var_pop(y) * F.count(y)
    r2 = F.when(n < 2, None).when(total > 0, 1 - F.try_divide(sse, total)).when(sse == 0, 1.0).otherwise(0.0)
    values = [
        F.sqrt(F.avg(e * e)), F.avg(F.abs(e)), F.avg(e), F.when(n > 1, F.stddev_samp(e)).when(n == 1, 0.0), r2,
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1e-6))) * 100,
    ]
    if keep is not None:
        values = [F.when(n > 1, v) for v in values]
    return [v.alias(f"{name}{suffix}") for name, v in zip(METRICS, values)]


def fold_metrics(pred: DataFrame, keys: Sequence[str], by_motion: bool = True) -> DataFrame:
    y, p, m = F.col("y_true"), F.col("y_pred"), F.col("motion")
    cols = metric_columns(y, p)
    if by_motion:
        cols += metric_columns(y, p, m == 0, "_lo") + metric_columns(y, p, m == 1, "_hi")
    return pred.groupBy(*keys, "combo", "model", "fold").agg(*cols)


def cv_summary(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of every metric over folds."""
    names = [c for c in metrics.columns if c.split("_lo")[0].split("_hi")[0] in METRICS]
    aggs = [f(c).alias(f"{c}_{s}") for c in names for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return metrics.groupBy(*keys, "combo", "model").agg(*aggs)


def best_models(summary: DataFrame, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    """Per key the pair and model with the lowest mean RMSE (name order on ties, which ``digits`` decimals decide if given)."""
    order = F.col("RMSE_mean") if digits is None else F.round("RMSE_mean", digits)
    rank = F.struct(order.alias("_r"), "combo", "model", "RMSE_mean")
    best = summary.where(F.col("RMSE_mean").isNotNull()).groupBy(*keys).agg(F.min(rank).alias("_b"))
    return best.select(*keys, "_b.combo", "_b.model", F.col("_b.RMSE_mean").alias("cv_rmse"))


# ---- many pairs at once ----------------------------------------------------------------

# A wide row ``(keys, row, n, y, w, ...)`` is a sample of all pairs; ``ratios`` gives the feature of each pair by name.  Only wide rows
# travel; they become a row for each pair where they meet what is known of their session, and are added up at once.

def validate_pairs(rows: DataFrame, ratios: Mapping[str, Column], keys: Sequence[str], folds: int = 5, models: Sequence[str] = CLOSED) -> DataFrame:
    """``(keys, combo, model, RMSE_mean)`` of the closed-form models of all pairs, as ``cv_summary`` has it after ``cross_validate``."""
    keys, xs = list(keys), list(ratios.values())
    blocked = add_blocks(rows.where(F.col("n") > folds), folds)
    centre = blocked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.array(*[F.avg(x) for x in xs]).alias("_x0"), F.array(*[F.avg(F.when(x.isNotNull(), F.col("y"))) for x in xs]).alias("_y0")
    )
    pairs = F.array(*[F.struct(F.lit(i).alias("_pair"), x.alias("x"), F.col("_x0")[i].alias("x0"), F.col("_y0")[i].alias("y0")) for i, x in enumerate(xs)])
    train = join_segments(blocked.where(F.col("block") < folds), centre, keys, "row", "n").select(*keys, "n", "block", "y", "w", F.inline(pairs)).where("x is not null")
    train = train.withColumn("fold", F.explode(F.sequence(F.col("block") + 1, F.lit(folds))))
    forms = F.array(*[F.struct(*p) for p in closed_forms(models)])
    solved = power_sums(train, [*keys, "n", "fold", "_pair"]).select(*keys, "n", "fold", F.struct("_pair", forms.alias("_forms")).alias("_fit"))
    fitted = solved.groupBy(*keys, "n", "fold").agg(F.collect_list("_fit").alias("_fits"))
    test = blocked.where("block > 0").withColumnRenamed("block", "fold")
    met = join_segments(test, fitted, [*keys, "fold"], "row", "n").select(*keys, "fold", "y", F.array(*xs).alias("_xs"), F.inline("_fits"))
    met = met.withColumn("x", F.get("_xs", F.col("_pair")))

    def error(k: int) -> Column:
        p, x = F.col("_forms")[k], F.col("x")
        return p["p0"] + p["p1"] * x + p["p2"] * x * x - F.col("y")

    by_fold = met.groupBy(*keys, "_pair", "fold").agg(*[F.sqrt(F.avg(error(k) * error(k))).alias(m) for k, m in enumerate(models)])
    means = by_fold.groupBy(*keys, "_pair").agg(*[F.avg(m).alias(m) for m in models])
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("RMSE_mean")) for m in models])
    return means.select(*keys, F.array(*map(F.lit, ratios))[F.col("_pair")].alias("combo"), F.inline(each))


def pick_pairs(rows: DataFrame, ratios: Mapping[str, Column], chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples ``(.., combo, x)`` of the pair that ``chosen (keys, combo)`` names for each session; without one it has none."""
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.max("n").alias("n"))
    mine = join_segments(rows, chosen.select(*keys, "combo").join(sizes, keys), keys, "row", "n")
    return mine.withColumn("x", F.coalesce(*[F.when(F.col("combo") == c, x) for c, x in ratios.items()])).where("x is not null")


# ---- training and transfer -------------------------------------------------------

@dataclass(frozen=True)
class TrainedModel:
    """A calibration ready to use: a polynomial, support vectors or steps."""

    combo: str
    model: str
    params: tuple
    train_rmse: float
    cv_rmse: float

    def predict(self, x: Column) -> Column:
        (kind,) = known([self.model])
        if not kind.predict:
            a, b, c = self.params
            return F.lit(a) + F.lit(b) * x + F.lit(c) * x * x
        value, p = kind.predict, np.array(self.params)

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(value(p, s.to_numpy(float)), index=s.index)

        return F.when(x.isNotNull(), run(x))

    def to_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.combo, self.model, [float(v) for v in self.params], self.train_rmse, self.cv_rmse)], MODEL_SCHEMA
        )

    @staticmethod
    def from_table(df: DataFrame) -> "TrainedModel":
        r = df.limit(1).first()
        return TrainedModel(r.combo, r.model, tuple(r.params), r.train_rmse, r.cv_rmse)


MODEL_SCHEMA = "combo string, model string, params array<double>, train_rmse double, cv_rmse double"


def _unpack_predict(kind: str, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return KINDS[kind].predict(p, x)


def train(rows: DataFrame, combo: str, model: str, cv_rmse: float, weighted: bool = False) -> TrainedModel:
    """Fit one model on all rows of one pair, by the algorithm that validation uses.

    The final fit ignores the quality weights unless ``weighted``.
    """
    mine = rows.where((F.col("combo") == combo) & F.col("x").isNotNull() & F.col("y").isNotNull())
    if not weighted:
        mine = mine.withColumn("w", F.lit(1.0))
    count = mine.count()
    if count < 5:
        raise RuntimeError(f"only {count} valid windows for '{combo}'")
    (kind,) = known([model])
    # Numbers for an order of all rows: any order does, a hash spreads the numbering.
    hashed = mine.drop("row").withColumn("_g", F.lit("all")).withColumn("_h", F.xxhash64("time_center", "x", "y"))
    grouped = dense_index(hashed, ["_g"], "_h", "row", bucket=F.shiftright("_h", 48)) if model == "ransac" else hashed.withColumn("row", F.col("_h"))
    params = tuple(kind.fit(grouped.select("_g", "row", "x", "y", "w"), ["_g"]).first().params)
    trained = TrainedModel(combo, model, params, 0.0, float(cv_rmse))
    err = F.col("y") - trained.predict(F.col("x"))
    rmse = mine.agg(F.sqrt(F.avg(err * err))).first()[0]
    return TrainedModel(combo, model, params, float(rmse), float(cv_rmse))


def apply_model(trained: TrainedModel, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions for other recordings: reference, estimate, residual."""
    pred = trained.predict(F.col("x"))
    return (
        rows.where(F.col("combo") == trained.combo)
        .dropna(subset=["x", "y", "time_center"])
        .select(*keys, "time_center", F.col("y").alias("spo2_reference"), pred.alias("spo2_estimated"))
        .withColumn("residual", F.col("spo2_estimated") - F.col("spo2_reference"))
    )


# ---- selection for many groups ---------------------------------------------------------

def kinds_in(table: DataFrame) -> list[Kind]:
    """The models that a table names: as many rows as there are kinds at most."""
    return known([r["model"] for r in table.select("model").where("model is not null").distinct().orderBy("model").collect()])


def fit_selected(rows: DataFrame, best: DataFrame, keys: Sequence[str], weighted: bool = False) -> DataFrame:
    """A model table ``(keys, combo, model, params, converged, train_rmse, cv_rmse)``: each group's best pair and model, fitted on all its rows.

    ``rows`` are samples, ``best`` is ``best_models``' choice; all groups of a kind are fitted in one job.  Groups
    without a choice, or without rows of its pair, have no row.  Weights count only if ``weighted``.
    """
    keys = list(keys)
    best = materialise(best.select(*keys, "combo", "model", "cv_rmse"), "best")
    chosen = best.select(*keys, F.col("combo").alias("_combo"), "model")
    mine = join_stats(rows, chosen, keys).where("combo = _combo and x is not null and y is not null")
    mine = materialise(mine.select(*keys, "combo", "model", "row", "x", "y", (F.col("w") if weighted else F.lit(1.0)).alias("w")), "chosen-rows")
    table = None
    for kind in kinds_in(best):
        one = kind.fit(mine.where(F.col("model") == kind.name).select(*keys, "row", "x", "y", "w"), keys).select(*keys, F.lit(kind.name).alias("model"), "params", "converged")
        table = one if table is None else table.unionByName(one)
    if table is None:
        table = best.limit(0).select(*keys, "model", F.array().cast("array<double>").alias("params"), F.lit(True).alias("converged"))
    table = materialise(table.join(best, [*keys, "model"]), "models")
    error = F.col("f") - F.col("y")
    fit = apply_table(table, mine, keys).groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("train_rmse"))
    return table.join(fit, keys, "left").select(*keys, "combo", "model", "params", "converged", "train_rmse", "cv_rmse")


def apply_table(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` of a pair that their group's model reads, with ``f``: its value at ``x``.

    ``keys`` name the model in both; a group of rows may use the model of another subject by carrying its name.
    """
    keys = list(keys)
    names = [c for c in rows.columns if c != "model"]
    read = table.select(*keys, F.col("combo").alias("_combo"), "model", "params")
    mine = join_stats(rows.select(*names), read, keys).where("combo = _combo").drop("_combo")
    kinds, out = kinds_in(table), None
    if plain := [k.name for k in kinds if not k.predict]:
        out = mine.where(F.col("model").isin(plain)).select(*names, "model", poly_of(F.col("params"), F.col("x")).alias("f"))
    for kind in (k for k in kinds if k.predict):
        own = table.where(F.col("model") == kind.name)
        one = predicted(mine.where(F.col("model") == kind.name).drop("params"), own, keys, kind).select(*names, "model", "f")
        out = one if out is None else out.unionByName(one)
    return rows.limit(0).select(*names, F.lit("").alias("model"), F.lit(0.0).alias("f")) if out is None else out


def transfer(table: DataFrame, rows: DataFrame, keys: Sequence[str], subject: Sequence[str]) -> DataFrame:
    """Predictions of a model table for other recordings: reference, estimate, residual, and the model's validation error.

    ``subject`` names the model in the table and, in ``rows``, whose model a recording reads.
    """
    read = rows.dropna(subset=["x", "y", "time_center"]).select(*dict.fromkeys([*keys, *subject]), "combo", "time_center", "x", "y")
    pred = join_stats(apply_table(table, read, subject), table.select(*subject, "cv_rmse"), subject)
    return pred.select(*keys, "time_center", F.col("y").alias("spo2_reference"), F.col("f").alias("spo2_estimated"), (F.col("f") - F.col("y")).alias("residual"), "cv_rmse")
