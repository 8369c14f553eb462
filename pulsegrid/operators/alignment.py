"""Lags between signals and alignment of recordings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import SEG, SEGMENT_ROWS, join_stats, sorted_segment, to_float, with_halo


def cross_correlation(
    df: DataFrame, keys: Sequence[str], a: str, b: str, max_lag: int,
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """``corr[L] = sum a[i] * b[i - L]`` for every ``|L| <= max_lag`` of the
    z-scored signals: rows ``(keys, lag, corr)``.

    Each segment sums its own products against a halo of ``b``; the partial sums
    add up over segments, so no task sees a whole session.
    """
    stats = df.groupBy(*keys).agg(
        F.avg(a).alias("_ma"), F.stddev_pop(a).alias("_sa"), F.avg(b).alias("_mb"), F.stddev_pop(b).alias("_sb")
    )
    z = join_stats(df, stats, keys).select(
        *keys, idx,
        ((F.col(a) - F.col("_ma")) / (F.col("_sa") + 1e-12)).alias("_a"),
        ((F.col(b) - F.col("_mb")) / (F.col("_sb") + 1e-12)).alias("_b"),
    )
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("_part", T.ArrayType(T.DoubleType()))])

    def group(table: pa.Table) -> pa.Table:
        ready = sorted_segment(table, idx, size, max_lag)
        if ready is None:
            return pa.table({**{k: table.column(k).slice(0, 0) for k in keys}, "_part": pa.array([], pa.list_(pa.float64()))})
        table, seg = ready
        va, vb = to_float(table.column("_a")), to_float(table.column("_b"))
        own = seg.idx[seg.core]
        span = np.zeros(len(own) + 2 * max_lag)
        span[seg.idx - (int(own[0]) - max_lag)] = vb
        part = np.correlate(span, va[seg.core], "valid")[::-1]
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "_part": pa.array([part], pa.list_(pa.float64()))})

    parts = with_halo(z, idx, size, max_lag, max_lag).groupBy(*keys, SEG).applyInArrow(group, schema)
    return (
        parts.select(*keys, F.posexplode("_part").alias("_k", "_v"))
        .groupBy(*keys, (F.col("_k") - max_lag).alias("lag"))
        .agg(F.sum("_v").alias("corr"))
    )


def best_lag(corr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag of the highest correlation, the smallest on ties; null where undefined."""
    valid = ~F.isnan("corr") & F.col("corr").isNotNull()
    rank = F.when(valid, F.struct("corr", (-F.col("lag")).alias("_m")))
    return corr.groupBy(*keys).agg(F.max_by("lag", rank).alias("lag"))


def estimate_lag(
    df: DataFrame, keys: Sequence[str], a: str, b: str, fs: float, max_lag_sec: float = 10.0, **where
) -> DataFrame:
    """Steps (``lag``) and seconds (``shift_sec``) to add to ``b``'s time axis."""
    corr = cross_correlation(df, keys, a, b, int(max_lag_sec * fs), **where)
    return best_lag(corr, keys).withColumn("shift_sec", F.col("lag") / F.lit(float(fs)))


def trim_heads(
    a: DataFrame, b: DataFrame, keys: Sequence[str], offset: DataFrame, fs_a: float, fs_b: float,
    idx: str = "sample_idx",
) -> tuple[DataFrame, DataFrame]:
    """Drop the head of whichever recording started first.

    ``offset`` holds ``(keys, diff_sec)``: positive drops ``round(diff * fs_b)``
    rows of ``b``, otherwise ``round(-diff * fs_a)`` rows of ``a``.  Indices are
    renumbered from zero.
    """
    def cut(df, rows):
        return (
            join_stats(df, offset.select(*keys, rows.cast("bigint").alias("_cut")), keys)
            .where(F.col(idx) >= F.col("_cut"))
            .withColumn(idx, F.col(idx) - F.col("_cut"))
            .drop("_cut")
        )

    d = F.col("diff_sec")
    return (
        cut(a, F.when(d > 0, F.lit(0)).otherwise(F.bround(-d * fs_a))),
        cut(b, F.when(d > 0, F.bround(d * fs_b)).otherwise(F.lit(0))),
    )


def sync_by_second(
    ratios: DataFrame, spo2: DataFrame, keys: Sequence[str], starts: DataFrame, idx: str = "sec_idx"
) -> DataFrame:
    """Join per-second ratios and saturations of recordings with known start times.

    ``starts`` holds ``(keys, ratio_start, spo2_start)`` as timestamps.  The later
    starter defines second zero (whole seconds); rows of only one side and rows
    with a null value are dropped.  The join key carries the second, so a long
    recording spreads over tasks.
    """
    micros = F.unix_micros("ratio_start") - F.unix_micros("spo2_start")
    info = starts.select(
        *keys,
        F.expr("greatest(0L, (unix_micros(ratio_start) - unix_micros(spo2_start)) div 1000000)").alias("_cut_s"),
        F.when(micros > 0, F.lit(0)).otherwise(F.expr("(unix_micros(spo2_start) - unix_micros(ratio_start)) div 1000000")).alias("_cut_r"),
    )

    def moved(df, cut):
        j = join_stats(df, info, keys).withColumn(idx, F.col(idx) - F.col(cut)).where(F.col(idx) >= 0)
        return j.drop("_cut_s", "_cut_r")

    both = moved(ratios, "_cut_r").join(moved(spo2, "_cut_s"), [*keys, idx])
    return both.dropna(subset=["r", "spo2"])
