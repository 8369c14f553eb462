import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filters, spectral
from pulsegrid.operators import features, spectra, windows

K = ["session_id"]


@pytest.fixture(scope="module")
def merged(spark):
    frames = []
    for s, n in (("hot", 900), ("b", 130), ("c", 30)):
        g = np.random.default_rng(n)
        t = np.arange(n) / 50
        d = {"session_id": s, "sample_idx": np.arange(n), "time": t, "spo2": 95 + g.normal(size=n), "motion_energy": g.random(n),
             "high_motion": (g.random(n) < 0.5).astype(int), "acc_mag": g.random(n)}
        for j, c in enumerate(("red", "ir", "green")):
            d[c] = (j + 1) * np.sin(2 * np.pi * 1.2 * (t - 0.02 * j * 2)) + 0.3 * g.normal(size=n)
            d[f"{c}_raw"] = 1000.0 * (j + 1) + d[c]
            d[f"{c}_rolling_dc"] = 1000.0 * (j + 1) + g.normal(size=n)
        d["green"] = np.where(g.random(n) < 0.004, np.nan, d["green"])
        frames.append(pd.DataFrame(d))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("green", F.when(~F.isnan("green"), F.col("green")))
    return pdf, df.repartition(3)


@pytest.mark.parametrize("size,gate", [(70, 0.15), (5000, 0.9)])
def test_window_features(merged, size, gate):
    pdf, df = merged
    pairs, w, step = [("red", "ir"), ("ir", "red"), ("green", "ir")], 100, 30
    got = features.window_features(df, K, pairs, 50.0, w, step, min_sqi=gate, size=size).toPandas()
    checked = 0
    for s, g in pdf.groupby("session_id"):
        mine = got[got.session_id == s].set_index("window_id")
        expected = []
        for k in range(max(0, (len(g) - w) // step + 1) if len(g) >= w else 0):
            x = g.iloc[k * step : k * step + w]
            if x.green.isna().any():
                continue
            expected.append(k)
            row = mine.loc[k]
            assert np.isclose(row.time_center, x.time.iloc[w // 2]) and np.isclose(row.spo2, x.spo2.mean())
            assert np.isclose(row.motion_rms, np.sqrt((x.motion_energy**2).mean()))
            assert row.high_motion_window == int(x.high_motion.mean() > 0.5)
            for p, (a, b) in zip(row.combos, pairs):
                xa, xb = x[a].to_numpy(), x[b].to_numpy()
                qa, qb = (spectral.quality_index(v[None], 50.0)[0] for v in (xa, xb))
                if qa < gate or qb < gate:
                    assert p["r"] is None and p["lag_applied"] == 0
                    continue
                full = np.correlate(xa - xa.mean(), xb - xb.mean(), "full")
                lags = np.arange(-(w - 1), w)
                near = np.abs(lags) <= 8
                lag = lags[near][np.argmax(full[near])]
                moved = xb[np.clip(np.arange(w) - lag, 0, w - 1)]
                left = np.argmax(np.correlate(xa - xa.mean(), moved - moved.mean(), "full")) - (w - 1)
                dc = [max(x[f"{c}_rolling_dc"].iloc[w // 2], 1.0) for c in (a, b)]
                r = (xa.std(ddof=1) / dc[0]) / (moved.std(ddof=1) / dc[1])
                assert p["lag_applied"] == lag and p["lag_residual"] == left and np.isclose(p["r"], r)
                checked += 1
        assert sorted(mine.index) == expected
    assert checked > 10
    wide = features.wide(features.window_features(df, K, pairs, 50.0, w, step, min_sqi=0.0, size=size), K, pairs).toPandas()
    assert {"R_red_ir", "lag_green_ir", "AC_red", "DC_green", "sqi_ir"} <= set(wide.columns)


def test_sql_windows(merged):
    pdf, df = merged
    w = windows.sliding(df, K, 40, 15).groupBy(*K, "window_id").agg(F.count("*").alias("c"), F.min("sample_idx").alias("m")).toPandas()
    for s, g in pdf.groupby("session_id"):
        mine = w[w.session_id == s].sort_values("window_id")
        n = max(0, (len(g) - 40) // 15 + 1) if len(g) >= 40 else 0
        assert len(mine) == n and (mine.c == 40).all() and (mine.m == mine.window_id * 15).all()
    d = windows.double_window_mean(df, K, "spo2", 50).toPandas()
    t = windows.tumbling_mean(df, K, "spo2", 50).toPandas()
    p = windows.pair_mean(df, K, ["spo2"]).toPandas()
    for s, g in pdf.groupby("session_id"):
        x = g.spo2.to_numpy()
        assert np.allclose(d[d.session_id == s].sort_values("window_id")["mean"], [x[i - 50 : i + 50].mean() for i in range(50, len(x), 50)])
        assert np.allclose(t[t.session_id == s].sort_values("sec_idx")["mean"], [x[i * 50 : i * 50 + 50].mean() for i in range(len(x) // 50)])
        assert np.allclose(p[p.session_id == s].sort_values("pair_idx").spo2, [x[i - 2 : i].mean() for i in range(2, len(x), 2)])


def test_trailing_ratio(merged):
    pdf, df = merged
    got = windows.trailing_ratio(df, K, "red", "red_raw", "ir", "ir_raw", 60, 20).toPandas()
    for s, g in pdf.groupby("session_id"):
        want = []
        for x in range(60, len(g), 20):
            v = g.iloc[x - 60 : x]
            want.append((v.red.std(ddof=0) / v.red_raw.mean()) / (v.ir.std(ddof=0) / v.ir_raw.mean()))
        assert np.allclose(got[got.session_id == s].sort_values("window_id").r, want)


@pytest.mark.parametrize("size", [170, 9000])
def test_ratio_windows(merged, size):
    pdf, df = merged
    got = spectra.ratio_windows(df, K, "red_raw", "ir_raw", 50, 2, 0.5, 6.0, 4, size=size).toPandas()
    flt = filters.butterworth(4, 0.5, 6.0, 50.0)
    for s, g in pdf.groupby("session_id"):
        want = []
        for x in range(2, len(g) // 50 - 1):
            v = g.iloc[(x - 2) * 50 : x * 50]
            a, b = v.red_raw.to_numpy(), v.ir_raw.to_numpy()
            want.append((filters.zero_phase(flt, a)[0].std() / a.mean()) / (filters.zero_phase(flt, b)[0].std() / b.mean()))
        assert np.allclose(got[got.session_id == s].sort_values("sec_idx").r, want)


def test_quality_vector_and_gate(spark):
    t = np.arange(300) / 50
    pdf = pd.DataFrame({"raw": [(1000 + np.sin(7.5 * t)).tolist(), [5.0] * 300], "f": [np.sin(7.5 * t).tolist(), [0.0] * 300]})
    q = spark.createDataFrame(pdf).select(spectra.quality_vector(F.col("raw"), F.col("f"), 50.0).alias("q"))
    rows = q.select("q.*", spectra.passes(F.col("q")).alias("open"), spectra.passes(F.col("q"), {"snr": (1.5, None), "heart_rate": (40.0, 180.0)}).alias("strict")).collect()
    good, flat = sorted(rows, key=lambda r: r.heart_rate is None)
    assert good.open and good.strict and abs(good.heart_rate - 71.6) < 2 and good.relative_power > 0.9
    assert flat.open and not flat.strict and flat.heart_rate is None and flat.skewness is None


@pytest.mark.parametrize("size", [150, 9000])
def test_cancelled_ratio_windows(merged, size):
    pdf, df = merged
    acc = ["acc_mag", "motion_energy"]
    got = spectra.cancelled_ratio_windows(df, K, "red_raw", "ir_raw", acc, 50.0, 60, 25, 0.01, 3, size=size).toPandas()
    band, slow = filters.butterworth(5, 0.5, 5.0, 50.0), filters.butterworth(5, None, 0.5, 50.0)
    for s, g in pdf.groupby("session_id"):
        want = []
        for x in range(60, len(g), 25):
            v = g.iloc[x - 60 : x]
            refs = [v[c].to_numpy() for c in acc]
            refs.append(np.sqrt(refs[0] ** 2 + refs[1] ** 2))
            taps = np.concatenate([filters.tap_rows(r, 3, True) for r in refs], axis=1)
            p = np.stack([filters.run_filter(f, v[c].to_numpy())[0] for c in ("red_raw", "ir_raw") for f in (band, slow)])
            e, _ = filters.adaptive(p, taps, np.full(60, 0.02))
            want.append((e[0].std() / e[1].mean()) / (e[2].std() / e[3].mean()))
        assert np.allclose(got[got.session_id == s].sort_values("window_id").r, want)
