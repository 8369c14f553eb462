"""Column builders: conversions, times, labels.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Text to double; bad text, NaN and infinities become null."""
    v = c.try_cast("double")
    return finite(v)


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where the divisor is zero."""
    return F.try_divide(a, b)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps nulls (``greatest`` alone would skip them)."""
    v = c
    if low is not None:
        v = F.greatest(v, F.lit(low))
    if high is not None:
        v = F.least(v, F.lit(high))
    return F.when(c.isNotNull(), v)


def epoch_or_seconds(c: Column) -> Column:
    """A number of seconds, or of milliseconds where it is too large for that."""
    return F.when(c > 1e10, c / 1000.0).otherwise(c)


def wall_micros(c: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session zone."""
    return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


def parse_time(c: Column) -> Column:
    """Text time to seconds: clock notations, timestamps, plain numbers.

    ``h:m:s`` when the first part is at least 1 and the others below 60, else
    ``m:s:ms``; two parts are ``m:s``; then timestamps (UTC), then numbers.
    Unreadable text becomes null.
    """
    s = F.trim(c)
    parts = F.split(s, ":")
    a, b, d = (F.get(parts, F.lit(i)).try_cast("double") for i in range(3))
    clock3 = F.when((a >= 1) & (b < 60) & (d < 60), a * 3600 + b * 60 + d).otherwise(a * 60 + b + d / 1000.0)
    seconds = wall_micros(s.try_cast("timestamp_ntz")) / 1e6
    return (
        F.when(s == "", None)
        .when((F.size(parts) == 3) & a.isNotNull() & b.isNotNull() & d.isNotNull(), clock3)
        .when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), a * 60 + b)
        .otherwise(F.coalesce(seconds, s.try_cast("double")))
    )


def znorm(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add z-scores with the population deviation.

    The statistics come from one small aggregate joined back, not from a window
    over the whole session.
    """
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    )
    out = df.join(stats, list(keys)).withColumns(
        {f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-12) for c in cols}
    )
    return out.drop(*[f"_{p}_{c}" for c in cols for p in "ms"])


def relative_time(df: DataFrame, keys: Sequence[str], col: str, idx: str = "sample_idx", out: str = "time") -> DataFrame:
    """Seconds since the start: epoch-like times count from the first sample,
    others from the smallest value."""
    from ..operators.quantiles import exact_quantiles

    start = df.groupBy(*keys).agg(F.min_by(col, idx).alias("_first"), F.min(col).alias("_min"))
    centre = exact_quantiles(df, keys, {"_med": (F.col(col), [0.5])})
    zero = F.when(F.col("_med") > 1e8, F.col("_first")).otherwise(F.col("_min"))
    return df.join(start.join(centre, list(keys)), list(keys)).withColumn(out, F.col(col) - zero).drop("_first", "_min", "_med")


def rebase_millis(df: DataFrame, keys: Sequence[str], col: str, out: str = "time") -> DataFrame:
    """Seconds from zero; values whose typical size exceeds 1e6 are milliseconds."""
    from ..operators.quantiles import exact_quantiles

    low = df.groupBy(*keys).agg(F.min(col).alias("_min"))
    centre = exact_quantiles(df, keys, {"_med": (F.abs(F.col(col)), [0.5])})
    scale = F.when(F.col("_med") > 1e6, 1000.0).otherwise(1.0)
    return (
        df.join(low.join(centre, list(keys)), list(keys))
        .withColumn(out, F.col(col) / scale - F.col("_min") / scale)
        .drop("_min", "_med")
    )


def empirical_spo2(r: Column, a: float = 110.0, b: float = 25.0) -> Column:
    return a - b * r


def pair_label(a: Column, b: Column, sep: str = "_") -> Column:
    return F.concat_ws(sep, a, b)


# The device columns of the encounter table, in order.
DEVICES = (
    "right_ear_device", "left_ear_device", "forehead_device", "finger_l1_device", "finger_l2_device",
    "finger_l3_device", "finger_l4_device", "finger_l5_device", "finger_r1_device", "finger_r2_device",
    "finger_r3_device", "finger_r4_device", "finger_r5_device",
)


def site_of(devices: Sequence[Column]) -> Column:
    """Sensor site from which device columns are filled; null where unclear.

    The order of the cases decides: no ear device means fingers even when the
    forehead device is set, so ``chest`` needs a left-ear device only.
    """
    right, left, forehead = devices[0], devices[1], devices[2]
    return (
        F.when(F.coalesce(*devices).isNull(), None)
        .when(right.isNull() & left.isNull(), "fingers")
        .when(right.isNotNull(), "ear")
        .when(forehead.isNotNull(), "chest")
    )


def seconds_of_day(text: Column) -> Column:
    """Seconds since midnight of ``HH:MM:SS`` text, with optional hundredths."""
    return (
        F.substring(text, 1, 2).try_cast("double") * 3600
        + F.substring(text, 4, 2).try_cast("double") * 60
        + F.substring(text, 7, 2).try_cast("double")
        + F.coalesce(F.substring(text, 10, 2).try_cast("double"), F.lit(0.0)) / 100.0
    )
