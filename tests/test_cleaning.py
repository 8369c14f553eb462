import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import cleaning, smoothing


def table(spark, series):
    pdf = pd.concat([
        pd.DataFrame({"session_id": s, "sample_idx": np.arange(len(x)), "x": np.asarray(x, float)})
        for s, x in series.items()
    ])
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(3)


def column(df, name):
    out = df.toPandas().sort_values(["session_id", "sample_idx"])
    return {s: g[name].to_numpy(float) for s, g in out.groupby("session_id")}


def jump_loop(x, lo, hi, j):
    x = np.where((x < lo) | (x > hi), np.nan, x)
    for i in range(1, len(x)):
        if abs(x[i] - x[i - 1]) > j:
            x[i] = np.nan
    return x


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    return {"hot": np.round(rng.uniform(85, 103, 400), 1), "b": np.array([95, 88, 95, 99, 93, 99, 93.0]), "c": np.array([97.0])}


@pytest.mark.parametrize("size", [16, 1000])
def test_jump_filter(spark, series, size):
    got = column(cleaning.jump_filter(table(spark, series), ["session_id"], "x", 90, 100, 3.0, size=size), "x")
    for s, x in series.items():
        assert np.array_equal(got[s], jump_loop(x, 90, 100, 3.0), equal_nan=True)


@pytest.mark.parametrize("size", [16, 1000])
def test_sanitize(spark, series, size):
    got = column(cleaning.sanitize(table(spark, series), ["session_id"], "x", 90, 100, 3.0, size=size), "x")
    for s, x in series.items():
        want = pd.Series(jump_loop(x, 90, 100, 3.0)).interpolate(limit_direction="both")
        want = want.rolling(5, center=True, min_periods=1).median()
        assert np.allclose(got[s], want, atol=1e-12)


def spikes_by_hand(x, kernel=11, z=6.0, sat=0.999):
    h = kernel // 2
    base = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, h), kernel), axis=1)
    r = x - base
    d = np.diff(x, prepend=x[0])
    rz = 0.6745 * r / (np.median(np.abs(r - np.median(r))) + 1e-12)
    dz = 0.6745 * d / (np.median(np.abs(d - np.median(d))) + 1e-12)
    m = (np.abs(rz) > z) | (np.abs(dz) > z) | (x >= np.quantile(x, sat)) | (x <= np.quantile(x, 1.0 - sat))
    wide = m.copy()
    wide[1:] |= m[:-1]
    wide[:-1] |= m[1:]
    wide[0] = wide[-1] = False
    good = ~wide
    if good.sum() < max(3, len(x) // 10):
        return base
    i = np.arange(len(x))
    return np.where(wide, np.interp(i, i[good], x[good]), x)


@pytest.mark.parametrize("size", [40, 5000])
def test_fill_spikes(spark, size):
    rng = np.random.default_rng(4)
    t = np.arange(600)
    wave = 50_000 + 300 * np.sin(t / 7) + rng.normal(size=600)
    wave[[50, 51, 300, 420]] += [9000, 8000, -7000, 6000]
    series = {"hot": wave, "b": wave[:30], "flat": np.r_[np.zeros(12), 1.0, np.zeros(12)]}
    got = column(cleaning.fill_spikes(table(spark, series), ["session_id"], ["x"], size=size), "x_raw")
    for s, x in series.items():
        assert np.allclose(got[s], spikes_by_hand(x), atol=1e-9), s


@pytest.mark.parametrize("size,passes", [(20, 1), (20, 3), (1000, 3)])
def test_box_filter(spark, size, passes):
    rng = np.random.default_rng(9)
    series = {"hot": rng.normal(size=150) + 1000, "b": rng.normal(size=9), "tiny": rng.normal(size=2)}
    got = column(smoothing.box_filter(table(spark, series), ["session_id"], {"x": "y"}, 11, passes, size=size), "y")
    for s, x in series.items():
        want = x
        for _ in range(passes):
            want = np.lib.stride_tricks.sliding_window_view(np.pad(want, 5, mode="symmetric"), 11).mean(axis=1)
        assert np.allclose(got[s], want, atol=1e-10), s
        assert np.allclose(smoothing.box_rows(x[None], 11, passes, True, True)[0], want, atol=1e-10), s
