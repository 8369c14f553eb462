"""Validation of sessions that one task holds, against the way that sums rows up for each fold and model."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import fits
from pulsegrid.operators import models, points

from . import reference_fits as ref

K = ["session_id"]
ALL = (*models.CLOSED, *models.ROBUST, *models.KERNEL)
ORDER = ["session_id", "combo", "model", "fold", "row", "y_true"]


def sessions(sizes, seed=1):
    g = np.random.default_rng(seed)
    frames = []
    for s, n in enumerate(sizes):
        for combo in ("red_ir", "green_blue"):
            x = 0.5 + g.random(n)
            frames.append(pd.DataFrame({
                "session_id": s, "combo": combo, "row": np.arange(n), "n": n, "time_center": np.arange(n) / 2, "motion": np.arange(n) % 3 % 2,
                "x": x, "y": 110 - 25 * x + g.normal(size=n), "w": 0.05 + 0.95 * g.random(n),
            }))
    return pd.concat(frames, ignore_index=True)


def frame(spark, pdf):
    pdf = pdf.astype({"session_id": object, "y": object})
    pdf = pdf.where(pdf.notna(), None)
    return spark.createDataFrame(pdf, "session_id long, combo string, row long, n long, time_center double, motion int, x double, y double, w double").repartition(3)


def test_held_sessions_are_predicted_as_summed_ones(spark, monkeypatch):
    pdf = sessions([60, 41, 7, 5, 33])
    pdf = pdf[~((pdf.session_id == 1) & (pdf.combo == "red_ir") & (pdf.row < 6))]  # the first block of a pair has no rows
    pdf = pd.concat([pdf, pdf[(pdf.session_id == 0) & (pdf.row < 40)]], ignore_index=True)  # rows that come twice
    lost = pdf[pdf.session_id == 2].assign(session_id=None)
    df = frame(spark, pd.concat([pdf, lost], ignore_index=True))
    monkeypatch.setattr(models, "HELD_ROWS", 50)
    calls = []
    plain = models.cv_kind
    monkeypatch.setattr(models, "cv_kind", lambda train, *a: (calls.append(train.select("session_id").distinct().toPandas().session_id.tolist()), plain(train, *a))[1])
    held = models.cross_validate(df, K, 5, ALL)
    assert calls == [[0]] * 4  # the session of 60 rows is not held
    monkeypatch.setattr(models, "HELD_ROWS", 0)
    summed = models.cross_validate(df, K, 5, ALL)
    assert held.dtypes == summed.dtypes
    a, b = (t.toPandas().sort_values(ORDER).reset_index(drop=True) for t in (held, summed))
    assert len(a) and a.drop(columns="y_pred").equals(b.drop(columns="y_pred"))
    # Two rows of training have a line through any noise; there only the models that do not divide by it agree.
    for m in ALL:
        one, other = (t[(t.model == m) & ~((t.session_id == 2) & (t.fold < 3))].y_pred for t in (a, b))
        assert one.isna().equals(other.isna()), m
        assert np.nanmax(np.abs(one - other)) < 1e-4, m


def test_sessions_that_lack_a_number_are_not_held(spark):
    pdf = sessions([8] * 5)
    for k, (c, v) in enumerate((("y", None), ("x", float("inf")), ("w", 0.0), ("n", models.HELD_ROWS + 1))):
        pdf.loc[(pdf.session_id == k) & (pdf.row == 3), c] = v
    here, apart = models.split_sessions(models.add_blocks(frame(spark, pdf)), K)
    assert {r.session_id for r in here.collect()} == {4} and apart.count() == 4 * 2 * 8


def test_held_sessions_are_not_copied_for_folds_and_draws(spark, monkeypatch):
    """What validation writes is about as many rows as it reads and predicts, not a row for each fold, part or drawn line."""
    pdf = sessions([60] * 12)
    written = {}
    plain = models.materialise

    def kept(df, label="stage"):
        out = plain(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    for module in (models, points):
        monkeypatch.setattr(module, "materialise", kept)
    assert models.cross_validate(frame(spark, pdf), K, 5, ALL).count() == 12 * 2 * 50 * len(ALL)
    assert sum(written.values()) <= 2 * len(pdf), written


def test_draws_are_those_of_the_hashes_in_spark(spark):
    df = spark.range(50).selectExpr("id", "concat('c', id % 3) as combo", "cast(id % 5 as int) as fold", "cast(id % 7 as int) as trial")
    got = df.select("fold", "trial", F.xxhash64("id", "combo").alias("s"), F.xxhash64("id", "combo", "fold", "trial", F.lit(421)).alias("h")).toPandas()
    mine = fits.hash_int(421, fits.hash_int(got.trial.to_numpy(), fits.hash_int(got.fold.to_numpy(), got.s.to_numpy())))
    assert (mine.view(np.int64) == got.h.to_numpy()).all()


def some_groups(sizes, seed=2):
    g = np.random.default_rng(seed)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x = g.normal(size=bounds[-1])
    return x, np.sin(2 * x) * 3 + g.normal(size=len(x)), g.uniform(0.05, 1, len(x)), bounds


def test_radial_fits_of_many_groups_take_steps_together(monkeypatch):
    z, t, c, bounds = some_groups(np.random.default_rng(4).integers(1, 60, 300))
    roots = []
    plain = np.linalg.cholesky
    monkeypatch.setattr(np.linalg, "cholesky", lambda m: (roots.append(1), plain(m))[1])
    cells = points.Cells({"w": c, "cz": z, "ct": t, "c": np.ones(len(z))}, bounds, np.zeros(300), np.ones(300), np.zeros(300))
    got = points.radial(cells)
    assert len(roots) < 300 * 10  # a root for each step of each group would be some 5000
    assert all(got["converged"])
    for k in range(0, 300, 20):
        a, b = bounds[k], bounds[k + 1]
        alone = fits.radial_groups(z[a:b], t[a:b], c[a:b], np.array([0, b - a]))[0]
        assert np.array_equal(np.concatenate([alone[0], alone[1]]), got["params"][k][4:]) and alone[2] == got["params"][k][2]
        if b - a > 8:
            mean, sd = fits.scaling(z[a:b])
            fit = ref.svr((z[a:b] - mean) / sd, t[a:b], c[a:b], "rbf", tol=1e-5)
            own = fits.radial_groups((z[a:b] - mean) / sd, t[a:b], c[a:b], np.array([0, b - a]))[0]
            near = np.linspace(-1, 1, 9)
            assert np.abs(fits.svr_predict((0, 1, own[2], own[0], own[1], 1.0), near) - fits.svr_predict(fit, near)).max() < 1e-2


@pytest.mark.parametrize("size", [1, 5, 30, 90])
def test_inverses_of_many_triangular_matrices(size):
    root = np.tril(np.random.default_rng(size).normal(size=(20, size, size))) + 3 * size**0.5 * np.eye(size)
    np.testing.assert_allclose(fits.lower_inverses(root) @ root, np.broadcast_to(np.eye(size), root.shape), atol=1e-9)


def test_cells_of_rows_in_memory_are_those_of_a_table(spark):
    x, y, w, bounds = some_groups([40, 1, 75, 12])
    x[:40] = 2.5  # a feature without spread
    group = np.repeat(np.arange(4), np.diff(bounds))
    df = spark.createDataFrame(pd.DataFrame({"g": group, "x": x, "y": y, "w": w}))
    table = points.cell_sums(df, ["g"]).orderBy("g", "_z", "_t").toPandas()
    got = points.cells_of(x, y, w, bounds)
    for g in range(4):
        a, b, mine = got.bounds[g], got.bounds[g + 1], table[table.g == g]
        for n in points.SUMS:
            np.testing.assert_allclose(np.sort(got.sums[n][a:b]), np.sort(mine[f"s_{n}"]), atol=1e-9)
        np.testing.assert_allclose((got.mx[g], got.sd[g], got.my[g]), mine[["mx", "sd", "my"]].iloc[0], rtol=1e-12)
