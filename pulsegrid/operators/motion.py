"""Acceleration: magnitude, energy, flags, flagged intervals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .filtering import Band, zero_phase
from .quantiles import exact_quantiles
from .segments import SEGMENT_ROWS, carry_fill, join_stats, shift_one


@dataclass(frozen=True)
class Movement:
    """Band of the acceleration's energy, quantile above which it is motion, and whether such windows go."""

    band: Band = Band(0.5, 10.0)
    quantile: float = 0.97
    drop: bool = True


def magnitude(*axes: Column) -> Column:
    """Length of the acceleration vector; zero without axes."""
    if not axes:
        return F.lit(0.0)
    total = axes[0] * axes[0]
    for a in axes[1:]:
        total = total + a * a
    return F.sqrt(total)


def motion_energy(
    df: DataFrame, keys: Sequence[str], col: str, fs: float, low: float = 0.5, high: float = 10.0,
    out: str = "motion_energy", **where,
) -> DataFrame:
    """Absolute band-passed acceleration magnitude."""
    passed = zero_phase(df, keys, {col: out}, fs, low, high, 4, **where)
    return passed.withColumn(out, F.abs(out))


def flag_motion(
    df: DataFrame, keys: Sequence[str], col: str = "motion_energy", share: float = 0.97, out: str = "high_motion"
) -> DataFrame:
    """1 where the energy exceeds the session's own quantile, else 0."""
    share = min(max(share, 0.0), 1.0)
    limits = exact_quantiles(df, keys, {"_limit": (F.col(col), [share])})
    # left join: a session without any energy keeps its rows, unflagged
    return (
        join_stats(df, limits, keys, "left")
        .withColumn(out, F.coalesce(F.abs(col) > F.col("_limit"), F.lit(False)).cast("int"))
        .drop("_limit")
    )


def motion_intervals(
    df: DataFrame, keys: Sequence[str], time: str = "time", flag: str = "high_motion",
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """``(t_start, t_end)`` of every flagged run; an open run ends at the last time."""
    f = F.col(flag)
    slim = df.select(*keys, idx, F.col(time).alias("_t"), f.alias("_f"))
    stepped = materialise(shift_one(slim, keys, {"_before": F.col("_f")}, idx=idx, size=size), "flags")
    closed = carry_fill(stepped, keys, next={"_close": F.when(F.col("_f") == 0, F.col("_t"))}, idx=idx, size=size)
    last = df.groupBy(*keys).agg(F.max_by(time, idx).alias("_end"))
    starts = closed.where((F.col("_f") == 1) & (F.coalesce("_before", F.lit(0)) == 0))
    return join_stats(starts, last, keys).select(
        *keys, F.col("_t").alias("t_start"), F.coalesce("_close", "_end").alias("t_end")
    )


def motion_counts(df: DataFrame, keys: Sequence[str], flag: str = "high_motion") -> DataFrame:
    """Samples, flagged samples and their percentage per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum(flag).alias("flagged"), (100 * F.avg(flag)).alias("share_pct"))
