"""Exact fits, the model registry and selection for many groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import fits, spectral
from pulsegrid.operators import groups, margin, models
from pulsegrid.operators.margin import fit_margin_lines
from pulsegrid.operators.points import fit_steps

from . import reference_fits as ref

K = ["session_id"]


def law(n, seed, noise):
    g = np.random.default_rng(seed)
    x = 0.5 + g.random(n)
    return x, 110 - 25 * x + noise * g.normal(size=n), 0.05 + 0.95 * g.random(n)


def lines(pdf, got):
    for g, rows in pdf.groupby("g"):
        a, b = ref.svr_line(rows.x.to_numpy(), rows.y.to_numpy())
        assert np.isclose(got[g].a, a, atol=1e-6) and np.isclose(got[g].b, -b, atol=1e-6), g
        assert got[g].converged


@pytest.mark.parametrize("points", [40_000, 200])
def test_margin_lines_are_exact_in_any_number_of_rounds(spark, points):
    frames = []
    for k, (n, noise) in enumerate([(50, 0.05), (55, 0.05), (60, 0.3), (300, 0.6), (2000, 0.05), (1500, 2.0), (1, 1.0), (2, 1.0)]):
        x, y, _ = law(n, k, noise)
        if k == 5:  # ties: points on few places
            x, y = np.round(x, 1), np.round(y)
        if k == 3:
            x[7] = 1e4
        frames.append(pd.DataFrame({"g": k, "x": x, "y": y}))
    pdf = pd.concat(frames)
    got = {r.g: r for r in fit_margin_lines(spark.createDataFrame(pdf).repartition(3), ["g"], points).collect()}
    lines(pdf, got)


@pytest.mark.parametrize("noise", [0.05, 0.7])
def test_margin_line_of_a_large_group(spark, noise):
    x, y, _ = law(150_000, 4, noise)
    pdf = pd.DataFrame({"g": 1, "x": x, "y": y})
    lines(pdf, {r.g: r for r in fit_margin_lines(spark.createDataFrame(pdf), ["g"]).collect()})


def test_small_groups_are_solved_as_they_are(spark, monkeypatch):
    """Beside a large group, too; a constant feature has no slope."""
    large = []
    monkeypatch.setattr(margin, "scaled", lambda rows, keys, f=margin.scaled: large.append({r.g for r in rows.select("g").distinct().collect()}) or f(rows, keys))
    frames = [pd.DataFrame({"g": k, "x": law(n, k, 0.3)[0], "y": law(n, k, 0.3)[1]}) for k, n in enumerate([1, 3, 80, 100, 101, 400])]
    pdf = pd.concat([*frames, pd.DataFrame({"g": 9, "x": 0.1, "y": np.arange(7.0)})])
    df = spark.createDataFrame(pdf)
    few = {r.g: r for r in fit_margin_lines(df.where("g <> 4 and g <> 5"), ["g"], 200).collect()}
    assert not large
    every = {r.g: r for r in fit_margin_lines(df, ["g"], 200).collect()}
    assert large == [{4, 5}] and set(every) == set(pdf.g) and all(few[g] == every[g] for g in few)
    lines(pdf[pdf.g != 9], every)
    assert every[9].a == 3.0 and abs(every[9].b) < 1e-12


def test_regions_hold_the_best_line():
    for seed in range(12):
        x, y, _ = law(400, seed, (0.05, 0.5, 3.0)[seed % 3])
        mean, sd = fits.scaling(x)
        z = np.tile((x - mean) / sd, 2)
        r = np.concatenate([y - y.mean() + fits.SVR_EPS, y - y.mean() - fits.SVR_EPS])
        top, one = fits.SVR_C * len(x) + 1, np.ones(len(z))
        best, cept = fits.margin_line(z, r, one, fits.Decided(), 0.0, (-top, top))
        cell = np.unique(np.c_[np.floor(z * 5), np.floor(r * 2)], axis=0, return_inverse=True)[1].ravel()
        m = np.bincount(cell).astype(float)
        ends = [[f(v[cell == k]) for k in range(len(m))] for v in (z, r) for f in (np.min, np.max)]
        low, high, c_low, c_high, left = fits.margin_region(m, np.bincount(cell, z), np.bincount(cell, r), *map(np.array, ends), fits.Decided(), 0.0, (-top, top, -1e6, 1e6))
        assert low <= best <= high and c_low - 1e-9 <= cept <= c_high + 1e-9 and left <= len(z) and high - low < top


@pytest.mark.parametrize("n,noise", [(50, 0.05), (300, 0.05), (300, 0.6), (8, 0.05), (2, 1.0)])
def test_radial_fit_closes_its_gap(n, noise):
    x, y, w = law(n, n, noise)
    y = y + 3 * np.sin(6 * x)
    mean, sd = fits.scaling(x)
    z, centre = (x - mean) / sd, y.mean()
    centres, basis = fits.kernel_basis(np.unique(np.floor(z / fits.CELL)))
    weights, bias, gap = fits.margin_dual(fits.kernel_features(z, centres, basis), y - centre, w)
    assert gap < 1e-6
    t = np.linspace(0.5, 1.5, 21)
    mine = fits.svr_predict((mean, sd, centre + bias, centres, basis @ weights, 1.0), t)
    assert np.abs(mine - fits.svr_predict(ref.svr(x, y, w, "rbf", tol=1e-5), t)).max() < 1e-3


@pytest.mark.parametrize("outlier", [50.0, 1e3, 1e5])
def test_trees_with_an_outlier_equal_those_on_rows(spark, outlier):
    x, y, w = law(1000, 6, 0.5)
    x[17] = outlier
    df = spark.createDataFrame(pd.DataFrame({"session_id": "a", "x": x, "y": y, "w": w})).repartition(3)
    got = np.asarray(fit_steps(df, K).first().params)
    assert np.abs(models.step_value(got, x) - fits.step_predict(fits.boost(x, y, w), x)).max() < 1e-6
    # With fewer points than values neighbours by rank go together; the outlier joins its neighbours and moves no other.
    few = np.asarray(fit_steps(df, K, bins=100).first().params)
    apart = models.step_value(few, x) - fits.step_predict(fits.boost(x, y, w), x)
    assert np.sqrt(np.mean(np.delete(apart, 17) ** 2)) < 0.4


def table(spark, n=90):
    frames = []
    for s in range(4):
        for c, f in (("red_ir", 1.0), ("green_ir", 0.2)):
            g = np.random.default_rng(10 * s + len(c))
            x = 0.5 + g.random(n)
            y = (110 - 25 * x if s % 2 else 80 + 10 * x + 12 * x * x) + (0.2 if f == 1.0 else 4.0) * g.normal(size=n)
            frames.append(pd.DataFrame({"session_id": s, "combo": c, "row": np.arange(n), "n": n, "time_center": np.arange(n) / 2, "motion": 0, "x": x, "y": y, "w": 1.0}))
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf).repartition(3)


def test_selected_models_of_many_groups(spark):
    pdf, df = table(spark)
    names = ("linear", "quadratic", "huber", "svr_rbf", "gbr")
    best = spark.createDataFrame([(s, "red_ir", names[s], 1.0 + s) for s in range(4)] + [(9, "red_ir", "gbr", 2.0)], "session_id long, combo string, model string, cv_rmse double")
    got = models.fit_selected(df, best, K)
    rows = {r.session_id: r for r in got.collect()}
    assert {s: (r.combo, r.model, r.cv_rmse) for s, r in rows.items()} == {s: ("red_ir", names[s], 1.0 + s) for s in range(4)}
    out = models.apply_table(got, df, K).toPandas()
    for s in range(4):
        mine = df.where(F.col("session_id") == s)
        alone = models.train(mine, "red_ir", names[s], 1.0 + s)
        assert np.isclose(alone.train_rmse, rows[s].train_rmse, atol=1e-6)
        want = models.apply_model(alone, mine, K).toPandas().sort_values("time_center")
        assert np.allclose(out[out.session_id == s].sort_values("time_center").f, want.spo2_estimated, atol=1e-6)
    # Another recording reads the model of the subject that it names.
    new = df.where("session_id = 3").withColumn("subject", F.lit(0).cast("long"))
    pred = models.transfer(got.withColumnRenamed("session_id", "subject"), new, K, ["subject"]).toPandas()
    p, x = rows[0].params, pdf[(pdf.session_id == 3) & (pdf.combo == "red_ir")].x
    assert np.allclose(np.sort(pred.spo2_estimated), np.sort(p[0] + p[1] * x)) and set(pred.cv_rmse) == {1.0}
    assert models.fit_selected(df, best.limit(0), K).count() == 0 and models.apply_table(got.limit(0), df, K).count() == 0


def test_validation_chooses_for_each_group(spark):
    _, df = table(spark)
    summary = models.cv_summary(models.fold_metrics(models.cross_validate(df, K, 5, ("linear", "quadratic")), K, by_motion=False), K)
    best = {r.session_id: (r.combo, r.model) for r in models.best_models(summary, K).collect()}
    assert {s: c for s, (c, _) in best.items()} == dict.fromkeys(range(4), "red_ir") and best[0][1] == best[2][1] == "quadratic"


def test_a_model_from_outside(spark):
    _, df = table(spark)

    def level(rows, keys):
        return rows.groupBy(*keys).agg(F.array(F.avg("y"), F.lit(0.0), F.lit(0.0)).alias("params"), F.lit(True).alias("converged"))

    def nearest(rows, keys):
        return rows.groupBy(*keys).agg(F.array(F.avg("x"), F.avg("y")).alias("params"), F.lit(True).alias("converged"))

    models.register(models.Kind("level", level))
    models.register(models.Kind("shifted", nearest, lambda p, x: p[1] + 0 * x))
    try:
        pred = models.cross_validate(df, K, 5, ("level", "shifted", "linear")).toPandas()
        a, b = (pred[pred.model == m].sort_values(["session_id", "combo", "fold", "row"]) for m in ("level", "shifted"))
        assert len(a) == 4 * 2 * 75 and np.allclose(a.y_pred, b.y_pred)
        assert models.train(df, "red_ir", "level", 0.0).params[1] == 0.0
        with pytest.raises(ValueError):
            models.cross_validate(df, K, 5, ("level", "no such model"))
    finally:
        del models.KINDS["level"], models.KINDS["shifted"]


def test_pulse_peaks_of_many_windows():
    g = np.random.default_rng(1)

    def slow(x, gap):
        level, at = [], 0
        while at < len(x):
            end = at
            while end + 1 < len(x) and x[end + 1] == x[at]:
                end += 1
            level.append((x[at], at, end))
            at = end + 1
        open_at = [((a + b) // 2, v) for k, (v, a, b) in enumerate(level) if 0 < k < len(level) - 1 and level[k - 1][0] < v > level[k + 1][0]]
        kept = []
        while open_at:
            top = max(open_at, key=lambda p: (p[1], p[0]))
            kept.append(top[0])
            open_at = [p for p in open_at if p is not top and abs(p[0] - top[0]) >= np.ceil(gap)]
        return sorted(kept)

    for k in range(60):
        x = g.normal(size=(10, 40)) if k % 2 else g.integers(0, 4, (10, 40)).astype(float)
        mask = spectral.pulse_peaks(x, 3.5)
        assert [np.flatnonzero(m).tolist() for m in mask] == [slow(r, 3.5) for r in x]


def test_trees_of_many_groups_are_those_of_each(spark):
    g = np.random.default_rng(5)
    sizes = [*g.integers(1, 60, 70), 700]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x = np.concatenate([np.sort(g.random(n)) for n in sizes])
    y, w = g.normal(size=len(x)), g.uniform(0.05, 1, len(x))
    for (a, b), got in zip(zip(bounds, bounds[1:]), fits.boosted_groups(x, x, y, w, bounds)):
        alone = fits.boosted(x[a:b], x[a:b], y[a:b], w[a:b])
        assert np.array_equal(got[0], alone[0]) and np.array_equal(got[1], alone[1])


def test_whole_groups_over_batches(spark):
    df = spark.range(3000).selectExpr("concat('k', id * id % 37) as k", "id * 7919 % 3001 as v", "if(id % 5 = 0, null, 1) as n")
    got = groups.over_groups(
        df, ["k"], ["v"], "s double, up boolean, c long", lambda c, b: {
            "s": np.add.reduceat(c["v"], b[:-1]), "up": [bool((np.diff(c["v"][i:j]) > 0).all()) for i, j in zip(b, b[1:])], "c": np.diff(b),
        }, held=64,
    ).toPandas().set_index("k")
    want = df.toPandas().groupby("k").v.agg(["sum", "count"])
    assert len(got) == len(want)
    got = got.loc[want.index]
    assert got.up.all()
    assert (got.s == want["sum"]).all() and (got.c == want["count"]).all()


def test_radial_fit_where_rounding_breaks_the_root(monkeypatch):
    v = np.array([1.0, 1.0 + 1e-9, 3.0]) * 1e9
    inner = np.outer(v, v) + np.eye(3)
    with pytest.raises(np.linalg.LinAlgError):
        np.linalg.cholesky(inner - 1e3 * np.eye(3))
    root = fits.lower_root(inner - 1e3 * np.eye(3))
    assert np.isfinite(root).all() and np.linalg.eigvalsh(root @ root.T)[-1] > 1e18

    def refuse(_):
        raise np.linalg.LinAlgError("Matrix is not positive definite")

    g = np.random.default_rng(3)
    x = g.normal(size=60)
    centres, basis = fits.kernel_basis(np.unique(np.floor(x / fits.CELL)))
    phi, t = fits.kernel_features(x, centres, basis), np.sin(3 * x) + g.normal(size=60)
    plain = fits.margin_dual(phi, t, np.ones(60))
    monkeypatch.setattr(np.linalg, "cholesky", refuse)
    again = fits.margin_dual(phi, t, np.ones(60))
    assert again[2] < fits.GAP and np.allclose(phi @ plain[0] + plain[1], phi @ again[0] + again[1], atol=1e-5)


def test_margin_lines_of_many_groups_at_once():
    """Groups of any sizes together have the line that each has alone, with weighted, tied and decided points."""
    g = np.random.default_rng(8)
    size = np.array([2, 134, 3, 140, 134, 1000, 1, 60, 7])
    bounds = np.concatenate([[0], np.cumsum(size)])
    z, count = g.normal(size=bounds[-1]).round(1), g.integers(1, 4, bounds[-1]).astype(float)
    r = (2 * z + g.normal(size=len(z))).round(1)
    above, below, pull = g.integers(0, 5, len(size)), g.integers(0, 5, len(size)), g.normal(size=len(size))
    mid, top = g.normal(size=len(size)), 100.0 * size + 1
    slope, cept = fits.margin_lines(z, r, count, bounds, above, below, pull, mid, -top, top)
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        rest = fits.Decided(int(above[k]), int(below[k]), float(pull[k]))
        np.testing.assert_allclose((slope[k], cept[k]), fits.margin_line(z[a:b], r[a:b], count[a:b], rest, mid[k], (-top[k], top[k])), rtol=1e-9, atol=1e-9)
