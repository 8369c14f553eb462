"""Row-count windows over recordings and the statistics taken in them.

Windows count rows, not seconds: window ``k`` covers rows
``[start + k * step, start + k * step + width)`` of its session.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from .segments import join_stats


@dataclass(frozen=True)
class Span:
    """Seconds of a window and of what it shares with the next one."""

    seconds: float = 10.0
    shared: float = 7.5

    def rows(self, fs: float) -> int:
        return int(self.seconds * fs)

    def step(self, fs: float) -> int:
        step = int((self.seconds - self.shared) * fs)
        if step <= 0:
            raise ValueError("windows must share less than their length")
        return step


def sliding(
    df: DataFrame, keys: Sequence[str], width: int, step: int, idx: str = "sample_idx",
    start: int = 0, drop_tail: int = 0, partial: bool = False,
) -> DataFrame:
    """One copy of each row per window that covers it, with ``window_id`` and ``pos``.

    Only full windows appear; ``drop_tail`` rows at the end of a session are out
    of reach, ``partial`` keeps windows cut by the end.  Aggregate at once by
    ``(keys, window_id)``: partial aggregation folds the copies before the
    shuffle, and the window id spreads a long session over all tasks.
    """
    length = df.groupBy(*keys).agg((F.max(idx) + 1).alias("_n"))
    i = f"(`{idx}` - {start})"
    last = f"((_n - {start} - {drop_tail} - {0 if partial else width}) div {step})"
    if partial:
        last = f"((_n - {start} - {drop_tail} - 1) div {step})"
    lo = F.expr(f"greatest(0L, cast(ceil(({i} - {width} + 1) / {step}) as bigint))")
    hi = F.expr(f"cast(least({i} div {step}, {last}) as bigint)")
    room = F.expr(f"_n - {start} - {drop_tail} >= {1 if partial else width}")
    return (
        join_stats(df, length, keys)
        .where(room & (F.col(idx) >= start))
        .withColumn("_lo", lo).withColumn("_hi", hi)
        .where("_lo <= _hi")
        .withColumn("window_id", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("pos", F.expr(f"{i} - window_id * {step}"))
        .drop("_n", "_lo", "_hi")
    )


def at_middle(col: str, width: int) -> Column:
    return F.max(F.when(F.col("pos") == width // 2, F.col(col)))


def base_stats(time: str, spo2: str, width: int) -> list[Column]:
    """Bounds, centre time and mean saturation of a window."""
    return [
        F.min(time).alias("t0"), F.max(time).alias("t1"), at_middle(time, width).alias("time_center"),
        F.avg(spo2).alias("spo2"),
    ]


def motion_stats(flag: str, energy: str, mag: str) -> list[Column]:
    return [
        F.avg(flag).alias("motion_frac"),
        F.sqrt(F.avg(F.col(energy) * F.col(energy))).alias("motion_rms"),
        F.avg(mag).alias("acc_mag_mean"),
        (F.avg(flag) > 0.5).cast("int").alias("high_motion_window"),
    ]


def trailing_ratio(
    df: DataFrame, keys: Sequence[str], num_ac: str, num_dc: str, den_ac: str, den_dc: str, width: int, step: int,
    idx: str = "sample_idx", drop_tail: int = 1,
) -> DataFrame:
    """Ratio of ratios over the last ``width`` rows, every ``step`` rows.

    AC is the population deviation, DC the mean.  A window ends before the row
    that triggers it, hence ``drop_tail=1``.
    """
    return (
        sliding(df, keys, width, step, idx, drop_tail=drop_tail)
        .groupBy(*keys, "window_id")
        .agg(
            safe_ratio(
                safe_ratio(F.stddev_pop(num_ac), F.avg(num_dc)), safe_ratio(F.stddev_pop(den_ac), F.avg(den_dc))
            ).alias("r")
        )
    )


def double_window_mean(df, keys, col: str, width: int, idx: str = "sample_idx", out: str = "mean") -> DataFrame:
    """Mean over ``[x - width, x + width)`` at x = width, 2 width, ... < n."""
    two = sliding(df, keys, 2 * width, width, idx, partial=True)
    # a start is served only while the window's own middle row exists
    return (
        two.groupBy(*keys, "window_id")
        .agg(F.avg(col).alias(out), F.max("pos").alias("_top"))
        .where(F.col("_top") >= width).drop("_top")
    )


def tumbling_mean(df, keys, col: str, width: int, idx: str = "sample_idx", out: str = "mean") -> DataFrame:
    """Mean of every full run of ``width`` rows."""
    return (
        df.groupBy(*keys, F.expr(f"`{idx}` div {width}").alias("sec_idx"))
        .agg(F.avg(col).alias(out), F.count(F.lit(1)).alias("_c"))
        .where(F.col("_c") == width).drop("_c")
    )


def pair_mean(df, keys, cols: Sequence[str], idx: str = "sample_idx") -> DataFrame:
    """Halve the rate by averaging pairs; the last pair of an even length is left out."""
    length = df.groupBy(*keys).agg((F.max(idx) + 1).alias("_n"))
    return (
        join_stats(df, length, keys).where(F.expr(f"`{idx}` < 2 * ((_n - 1) div 2)"))
        .groupBy(*keys, F.expr(f"`{idx}` div 2").alias("pair_idx"))
        .agg(*[F.avg(c).alias(c) for c in cols])
    )


def stride(df, step: int, idx: str = "sample_idx", out: str = "sec_idx") -> DataFrame:
    """Every ``step``-th row."""
    return df.where(F.col(idx) % step == 0).withColumn(out, F.expr(f"`{idx}` div {step}"))


def acc_band(
    df: DataFrame, keys: Sequence[str], axes: Sequence[str], width: int, low: float | None, high: float | None,
    idx: str = "sample_idx", squared: bool = False,
) -> DataFrame:
    """Windows whose mean acceleration vector lies outside ``[low, high]``.

    One row per full window that has a successor row, with its magnitude ``acc``
    and ``rejected``; ``squared`` compares the squared length.
    """
    win = (
        sliding(df, keys, width, width, idx, drop_tail=1)
        .groupBy(*keys, "window_id")
        .agg(*[F.avg(a).alias(a) for a in axes])
    )
    total = sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))
    acc = total if squared else F.sqrt(total)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (acc < low)
    if high is not None:
        bad = bad | (acc > high)
    return win.select(*keys, "window_id", acc.alias("acc"), bad.alias("rejected"))


def discard_warmup(df: DataFrame, keys: Sequence[str], seconds: float, time: str = "time") -> DataFrame:
    """Rows from ``seconds`` after the session's first row on."""
    first = df.groupBy(*keys).agg(F.min(time).alias("_t0"))
    return join_stats(df, first, keys).where(F.col(time) >= F.col("_t0") + seconds).drop("_t0")


def head_seconds(df: DataFrame, keys: Sequence[str], seconds: float = 60.0, time: str = "time") -> DataFrame:
    first = df.groupBy(*keys).agg(F.min(time).alias("_t0"))
    return join_stats(df, first, keys).where(F.col(time) <= F.col("_t0") + seconds).drop("_t0")


def robust_amplitude(col: str) -> Column:
    """Half the distance between the 95th and the 5th percentile of a group."""
    p = F.percentile(col, F.array(F.lit(0.95), F.lit(0.05)))
    return (p[0] - p[1]) / 2


def perfusion(ac: str, dc: str) -> Column:
    """Deviation of one channel over the level of another; null for no level."""
    return safe_ratio(F.stddev_pop(ac), F.avg(dc))
