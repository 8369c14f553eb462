import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filters
from pulsegrid.operators import alignment, filtering, motion, resample

K = ["session_id"]


def make(spark, sessions, **cols):
    frames = []
    for s, n in sessions.items():
        rng = np.random.default_rng(abs(hash(s)) % 100 + n)
        frames.append(pd.DataFrame({"session_id": s, "sample_idx": np.arange(n), **{c: f(rng, np.arange(n)) for c, f in cols.items()}}))
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf).repartition(3)


def wave(rng, i):
    return 1000 + 50 * np.sin(i / 6.0) + rng.normal(size=len(i))


@pytest.fixture(scope="module")
def data(spark):
    return make(spark, {"hot": 9000, "b": 60, "short": 20}, x=wave, y=wave, r=lambda g, i: g.normal(size=len(i)))


def by_session(df, c):
    out = df.select("session_id", "sample_idx", c).toPandas().sort_values("sample_idx")
    return {s: g[c].to_numpy(float) for s, g in out.groupby("session_id")}


def test_zero_phase_segments_equal_whole(data):
    pdf, df = data
    flt = filters.butterworth(4, 0.5, 5.0, 50.0)
    got = by_session(filtering.zero_phase(df, K, {"x": "f"}, 50.0, 0.5, 5.0, 4, size=1500), "f")
    for s, g in pdf.groupby("session_id"):
        want = filters.zero_phase(flt, g.x.to_numpy())[0]
        assert np.allclose(got[s], want, atol=1e-9, equal_nan=True)
    assert np.isnan(got["short"]).all()


def test_causal_segments_equal_whole(data):
    pdf, df = data
    flt = filters.butterworth(5, None, 0.5, 50.0)
    got = by_session(filtering.causal(df, K, {"x": "f"}, 50.0, None, 0.5, size=1500), "f")
    for s, g in pdf.groupby("session_id"):
        assert np.allclose(got[s], filters.run_filter(flt, g.x.to_numpy())[0], atol=1e-8)


@pytest.mark.parametrize("style,refs,taps", [("delayed", ["r"], 8), ("current", ["r", "y2"], 5), ("normalised", ["r"], 8)])
def test_adaptive_segments_equal_whole(data, style, refs, taps):
    pdf, df = data
    df = df.withColumn("y2", (F.col("y") - 1000) / 50)
    pdf = pdf.assign(y2=(pdf.y - 1000) / 50)
    got = filtering.adaptive_cancel(df, K, {"x": "e", "y": "e2"}, refs, taps, 0.002, style, size=2000)
    got = {c: by_session(got, c) for c in ("e", "e2")}
    for s, g in pdf.groupby("session_id"):
        n = len(g)
        x = np.concatenate([filters.tap_rows(g[r].to_numpy(), taps, style == "current") for r in refs], axis=1)
        for c, p in (("e", g.x.to_numpy()), ("e2", g.y.to_numpy())):
            w, want = np.zeros(x.shape[1]), np.zeros(n)
            for i in range(n):
                if style != "current" and i < taps:
                    want[i] = p[i] if style == "delayed" else 0.0
                    continue
                want[i] = p[i] - w @ x[i]
                step = 0.004 if style != "normalised" else 0.002 / (x[i] @ x[i] + 1e-6)
                w = w + step * want[i] * x[i]
            assert np.allclose(got[c][s], want, rtol=1e-9, atol=1e-7), (s, c)


@pytest.mark.parametrize("up,down", [(1, 2), (25, 43)])
def test_resample_poly(data, up, down):
    pdf, df = data
    got = by_session(filtering.resample_poly(df, K, ["x"], up, down, size=700), "x")
    taps = filters.kaiser_taps(up, down)
    half = len(taps) // 2
    for s, g in pdf.groupby("session_id"):
        x = g.x.to_numpy()
        spread = np.zeros(len(x) * up)
        spread[::up] = x
        full = np.convolve(spread, taps)[half : half + len(spread)]
        want = full[::down]
        want = want[: -(-len(x) * up // down)]
        assert len(got[s]) == len(want) and np.allclose(got[s], want, atol=1e-9)


def test_motion_flag_and_intervals(spark):
    pdf, df = make(spark, {"hot": 333, "b": 9}, e=lambda g, i: g.normal(size=len(i)), time=lambda g, i: i / 50)
    flagged = motion.flag_motion(df, K, "e", 0.8)
    got = by_session(flagged, "high_motion")
    runs = motion.motion_intervals(flagged, K, size=20).toPandas()
    for s, g in pdf.groupby("session_id"):
        e, t = g.e.to_numpy(), g.time.to_numpy()
        m = np.abs(e) > np.quantile(e, 0.8)
        assert np.array_equal(got[s], m)
        want, start = [], None
        for ti, mi in zip(t, m):
            if mi and start is None:
                start = ti
            elif not mi and start is not None:
                want.append((start, ti))
                start = None
        if start is not None:
            want.append((start, t[-1]))
        r = runs[runs.session_id == s].sort_values("t_start")
        assert list(zip(r.t_start, r.t_end)) == want


def lerp_extend(t, y, g):
    k = np.clip(np.searchsorted(t, g), 1, len(t) - 1)
    return y[k - 1] + (y[k] - y[k - 1]) / (t[k] - t[k - 1]) * (g - t[k - 1])


@pytest.mark.parametrize("size", [13, 5000])
def test_resample_linear_and_sparse(spark, size):
    jitter = lambda g, i: np.cumsum(g.uniform(0.005, 0.06, len(i)))
    pdf, df = make(spark, {"hot": 300, "b": 5}, time=jitter, x=wave, z=lambda g, i: np.where(g.random(len(i)) < 0.4, np.nan, i))
    df = df.withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    grid = spark.createDataFrame([("hot", -0.3, 700), ("b", 0.0, 40)], "session_id string, t0 double, n_grid long")
    got = resample.resample_linear(df, K, ["x"], grid, 50.0, size=size).toPandas()
    sparse = resample.resample_sparse(df, K, ["x", "z"], grid, 50.0, size=size).toPandas()
    for s, t0, n in (("hot", -0.3, 700), ("b", 0.0, 40)):
        g = pdf[pdf.session_id == s]
        at = t0 + np.arange(n) / 50
        out = got[got.session_id == s].sort_values("grid_idx")
        assert out.grid_idx.tolist() == list(range(n))
        assert np.allclose(out.x, lerp_extend(g.time.to_numpy(), g.x.to_numpy(), at), atol=1e-8)
        ok = g.z.notna()
        out = sparse[sparse.session_id == s].sort_values("grid_idx")
        assert len(out) == n
        assert np.allclose(out.x, lerp_extend(g.time.to_numpy(), g.x.to_numpy(), at), atol=1e-8)
        if ok.sum() > 1:
            assert np.allclose(out.z, lerp_extend(g.time[ok].to_numpy(), g.z[ok].to_numpy(), at), atol=1e-8)


def test_sparse_columns_fill_the_grid_without_dealing_its_points(spark):
    rows = [("a", 0, 0.0, 1.0, None), ("a", 1, 0.1, 2.0, 5.0), ("one", 0, 0.0, 3.0, None), ("none", 0, 0.0, None, None), ("z", 0, 0.0, None, 1.0), ("z", 1, 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "session_id string, sample_idx long, time double, x double, z double")
    grid = spark.createDataFrame([(s, 0.0, n) for s, n in (("a", 4), ("one", 2), ("none", 3), ("z", 2), ("empty", 0))], "session_id string, t0 double, n_grid long")
    out = resample.resample_sparse(df, K, ["x"], grid, 10.0)
    assert "grid_idx" not in "".join(re.findall(r"hashpartitioning\([^)]*", out._jdf.queryExecution().toString()))
    got = sorted((r.session_id, r.grid_idx, round(r.time, 6), r.x and round(r.x, 6)) for r in out.collect())
    assert got == [
        *[("a", k, k / 10, 1.0 + k) for k in range(4)], *[("none", k, k / 10, None) for k in range(3)], *[("one", k, k / 10, None) for k in range(2)],
        *[("z", k, k / 10, None) for k in range(2)],
    ]
    both = sorted((r.session_id, r.grid_idx, r.x, r.z and round(r.z, 6)) for r in resample.resample_sparse(df, K, ["x", "z"], grid, 10.0).collect() if r.session_id in ("z", "none"))
    assert both == [*[("none", k, None, None) for k in range(3)], ("z", 0, None, 1.0), ("z", 1, None, 1.1)]


@pytest.mark.parametrize("size", [50, 5000])
def test_lag_and_shift(spark, size):
    base = np.random.default_rng(0).normal(size=500)
    frames = []
    for s, d in (("p", 7), ("m", -4), ("z", 0)):
        frames.append(pd.DataFrame({"session_id": s, "sample_idx": np.arange(400), "a": base[50:450], "b": base[50 + d : 450 + d]}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).repartition(3)
    lags = alignment.estimate_lag(df, K, "a", "b", 50.0, 0.2, size=size)
    got = {r.session_id: r.lag for r in lags.collect()}
    assert got == {"p": 7, "m": -4, "z": 0}
    grid = spark.createDataFrame([(s, 1.0, 400) for s in "pmz"], "session_id string, t0 double, n_grid long")
    out = resample.shift_grid(df.withColumnRenamed("sample_idx", "grid_idx"), K, ["b"], lags, grid, 50.0).toPandas()
    for s, lag in got.items():
        o = out[out.session_id == s].sort_values("grid_idx")
        t = 1.0 + np.arange(400) / 50
        want = lerp_extend(t + lag / 50, pdf[pdf.session_id == s].b.to_numpy(), t)
        assert len(o) == 400 and np.allclose(o.b, want, atol=1e-8)


def test_sync_by_second(spark):
    r = spark.createDataFrame([("e", i, float(i)) for i in range(10)], "session_id string, sec_idx long, r double")
    sp = spark.createDataFrame([("e", i, 100.0 + i if i != 5 else None) for i in range(6)], "session_id string, sec_idx long, spo2 double")
    st = spark.sql("select 'e' session_id, timestamp'2026-01-01 10:00:00.2' ratio_start, timestamp'2026-01-01 10:00:02.9' spo2_start")
    got = sorted((x.r, x.spo2) for x in alignment.sync_by_second(r, sp, K, st).collect())
    assert got == [(2.0 + i, 100.0 + i) for i in range(5)]
