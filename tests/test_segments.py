from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import quantiles, segments


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    frames = []
    for s, n in (("hot", 230), ("b", 17), ("c", 1)):
        x = np.round(rng.normal(size=n), 2)
        x[rng.random(n) < 0.3] = np.nan
        frames.append(pd.DataFrame({"session_id": s, "sample_idx": np.arange(n), "x": x}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df.repartition(5)


def test_dense_index(spark):
    pdf = pd.DataFrame({"k": ["a"] * 50 + ["b"] * 7, "o": np.random.default_rng(1).permutation(570)[:57]})
    got = segments.dense_index(spark.createDataFrame(pdf), ["k"], "o", bucket_span=10).toPandas()
    want = pdf.assign(i=pdf.groupby("k").o.rank().astype(int) - 1)
    merged = got.merge(want, on=["k", "o"])
    assert len(merged) == 57 and (merged.sample_idx == merged.i).all()


@pytest.mark.parametrize("size", [10, 64, 1000])
def test_carry_fill(rows, size):
    pdf, df = rows
    x = F.col("x")
    got = segments.carry_fill(df, ["session_id"], {"p": x}, {"n": x}, size=size).toPandas()
    got = got.sort_values(["session_id", "sample_idx"])
    want = pdf.sort_values(["session_id", "sample_idx"])
    assert np.array_equal(got.p, want.groupby("session_id").x.ffill(), equal_nan=True)
    assert np.array_equal(got.n, want.groupby("session_id").x.bfill(), equal_nan=True)


@pytest.mark.parametrize("size", [3, 16, 1000])
def test_halo_window_sees_across_segments(rows, size):
    pdf, df = rows
    add = {"m": lambda w: F.sum("sample_idx").over(w.rowsBetween(-7, 4)), "lag": lambda w: F.lag("x", 1).over(w)}
    got = segments.over_halo(df, ["session_id"], add, left=7, right=4, size=size).toPandas()
    assert len(got) == len(pdf)
    for s, g in got.sort_values("sample_idx").groupby("session_id"):
        n = len(g)
        assert g.m.tolist() == [sum(range(max(0, i - 7), min(n, i + 5))) for i in range(n)]
        x = pdf[pdf.session_id == s].x
        assert np.array_equal(g["lag"], x.shift(1), equal_nan=True)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.concat([
        pd.DataFrame({"k": "hot", "x": rng.normal(size=30_000), "y": rng.integers(0, 3, 30_000) * 1.0}),
        pd.DataFrame({"k": "b", "x": rng.normal(size=7), "y": 5.0}),
    ])
    df = spark.createDataFrame(pdf)
    got = quantiles.exact_quantiles(
        df, ["k"], {"x": (F.col("x"), [0.001, 0.5, 0.999]), "y": (F.col("y"), [0.5])}
    ).toPandas().set_index("k")
    for k in got.index:
        g = pdf[pdf.k == k]
        assert np.allclose(got.loc[k, ["x_0", "x_1", "x_2"]].astype(float), np.quantile(g.x, [0.001, 0.5, 0.999]), atol=1e-14)
        assert got.loc[k, "y"] == np.quantile(g.y, 0.5)


def test_map_segments_drops_halo_and_keeps_columns(rows):
    pdf, df = rows

    def kernel(seg, arrays):
        return [np.cumsum(np.nan_to_num(arrays[0])) * 0 + seg.idx * 2.0]

    got = segments.map_segments(df, ["session_id"], ["x"], ["d"], kernel, left=5, right=9, size=20).toPandas()
    assert len(got) == len(pdf) and (got.d == got.sample_idx * 2).all()


def test_join_stats_deals_a_key_over_parts(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id", "id * 0.5 AS v")
    stats = df.groupBy("k").agg(F.avg("v").alias("m"))
    out = segments.join_stats(df, stats, ["k"])
    assert out.count() == 1000 and out.columns == ["k", "id", "v", "m"]
    assert out.where("k = 0").select("m").distinct().count() == 1
    assert segments.join_stats(df, stats.where("k = 1"), ["k"], "left").where("m is null").count() == 500


def test_quantiles_have_the_last_digit_of_a_fused_product(spark):
    g = np.random.default_rng(4)
    lo = np.round(g.uniform(0, 99, 4000), 2)
    pdf = pd.DataFrame({"a": lo, "z": np.where(np.arange(4000) % 2, lo, np.round(lo + g.uniform(0, 9, 4000), 2)), "d": g.integers(1, 999, 4000) / 1000})
    got = spark.createDataFrame(pdf).select("a", "z", "d", quantiles.between(F.col("a"), F.col("z"), F.col("d")).alias("v")).toPandas()

    def fused(a, z, d):
        return float(Fraction(a) * Fraction(1 - d) + Fraction(z * d))

    assert [fused(*r) for r in zip(got.a, got.z, got.d)] == got.v.tolist()
