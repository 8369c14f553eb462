"""Moving averages with mirrored ends, in SQL and as a segment kernel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import SEGMENT_ROWS, SEG, join_stats, segment_window, with_halo, CORE


@dataclass(frozen=True)
class Baseline:
    """Seconds of the rolling level, and of the wander that is removed (None: none is)."""

    level: float = 2.0
    wander: float | None = 0.6


def box_size(seconds: float, fs: float) -> int:
    """Odd number of taps of a box of the given length, at least 3."""
    k = max(3, int(seconds * fs))
    return k + 1 - k % 2


def box_filter(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], kernel: int, passes: int = 1,
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Moving average over ``kernel`` samples, ``passes`` times over.

    Ends are mirrored (``d c b a | a b c d``) by adding reflected copies of the
    end rows.  A symmetric average keeps a mirrored signal mirrored, so one
    extension of ``passes * half`` rows serves all passes and all of them run
    on one shuffle.  ``cols`` maps input to output names.
    """
    half = kernel // 2
    reach = half * passes
    length = df.groupBy(*keys).agg((F.max(idx) + 1).alias("_n"))
    turns = F.ceil(F.lit(reach) / (2 * F.col("_n"))).cast("bigint")
    copies = F.flatten(
        F.transform(
            F.sequence(-turns, turns),
            lambda m: F.array(2 * m * F.col("_n") + F.col(idx), 2 * m * F.col("_n") - F.col(idx) - 1),
        )
    )
    wide = (
        join_stats(df, length, keys)
        .withColumn("_i", F.explode(copies))
        .where((F.col("_i") >= -reach) & (F.col("_i") < F.col("_n") + reach))
    )
    out = with_halo(wide, "_i", size, reach, reach)
    w = segment_window(keys, "_i").rowsBetween(-half, half)
    for c, o in cols.items():
        for p in range(passes):
            out = out.withColumn(f"_b_{o}", F.avg(c if p == 0 else f"_b_{o}").over(w))
        out = out.withColumn(o, F.col(f"_b_{o}")).drop(f"_b_{o}")
    real = F.col(CORE) & (F.col("_i") == F.col(idx)) & (F.col("_i") >= 0) & (F.col("_i") < F.col("_n"))
    return out.where(real).drop(SEG, CORE, "_i", "_n")


def rolling_dc(df, keys, cols: Mapping[str, str], fs: float, seconds: float = 2.0, **where) -> DataFrame:
    return box_filter(df, keys, cols, box_size(seconds, fs), 1, **where)


def remove_wander(df, keys, cols: Mapping[str, str], fs: float, seconds: float = 0.6, **where) -> DataFrame:
    """Signal minus its threefold moving average."""
    smooth = box_filter(df, keys, {c: f"_w_{o}" for c, o in cols.items()}, box_size(seconds, fs), 3, **where)
    for c, o in cols.items():
        smooth = smooth.withColumn(o, F.col(c) - F.col(f"_w_{o}"))
    return smooth.drop(*[f"_w_{o}" for o in cols.values()])


def box_rows(x: np.ndarray, kernel: int, passes: int, at_start: bool, at_end: bool) -> np.ndarray:
    """The same average on the rows of an array, for fused segment kernels."""
    half = kernel // 2
    reach = half * passes
    pad = (reach if at_start else 0, reach if at_end else 0)
    centre = x.mean(axis=1, keepdims=True)
    y = np.pad(x - centre, ((0, 0), pad), mode="symmetric")
    for _ in range(passes):
        y = np.pad(y, ((0, 0), (half, half)), mode="edge")
        total = np.cumsum(np.pad(y, ((0, 0), (1, 0))), axis=1)
        y = (total[:, kernel:] - total[:, :-kernel]) / kernel
    return y[:, pad[0] : pad[0] + x.shape[1]] + centre
