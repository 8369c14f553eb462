"""Common time grid, linear resampling, shifting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import SEGMENT_ROWS, dense_index, join_stats, shift_one


def time_grid(spans: Sequence[DataFrame], keys: Sequence[str], fs: float) -> DataFrame:
    """One row per session: start ``t0`` and length ``n_grid`` of the shared grid.

    ``spans`` hold ``(keys, t_min, t_max)`` per recording.  The grid runs from the
    latest start up to, not including, the earliest end.
    """
    first, *rest = spans
    lo, hi = F.col("t_min"), F.col("t_max")
    out = first.select(*keys, lo.alias("_a"), hi.alias("_z"))
    for s in rest:
        out = out.join(s.select(*keys, lo, hi), list(keys)).select(
            *keys, F.greatest("_a", "t_min").alias("_a"), F.least("_z", "t_max").alias("_z")
        )
    count = F.greatest(F.lit(0), F.ceil((F.col("_z") - F.col("_a")) / F.lit(1.0 / fs)))
    return out.select(*keys, F.col("_a").alias("t0"), count.cast("bigint").alias("n_grid"))


def grid_points(df: DataFrame, keys: Sequence[str], low: str, high: str, spread: bool = False, run: int = SEGMENT_ROWS) -> DataFrame:
    """One row per ``grid_idx`` in ``[low, high]``, made in runs so that no row
    holds a long array; ``spread`` deals the runs of a long grid over tasks."""
    runs = df.withColumn("_run", F.explode(F.expr(f"sequence({low} div {run}, {high} div {run})")))
    if spread:
        runs = runs.repartition(*keys, "_run")
    inside = f"sequence(greatest({low}, _run * {run}), least({high}, _run * {run} + {run - 1}))"
    return runs.withColumn("grid_idx", F.explode(F.expr(inside))).drop("_run")


def time_span(df: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(time).alias("t_min"), F.max(time).alias("t_max"))


def grid_time(fs: float) -> Column:
    return F.col("t0") + F.col("grid_idx") / F.lit(fs)


def resample_linear(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], grid: DataFrame, fs: float, time: str = "time",
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Values of ``cols`` at every grid point: ``(keys, grid_idx, time, cols)``.

    Every pair of neighbouring samples emits the grid points between them, so
    there is no range join; the first and last pair also serve the points beyond
    the ends (linear extrapolation).  ``cols`` must not hold nulls - see
    ``resample_sparse``.  Samples are taken in the order of their time, whatever
    their ``idx``; of equal times the one with the least ``idx`` counts.
    """
    t, t2 = F.col("_t"), F.col("_t2")
    slim = df.select(*keys, idx, F.col(time).cast("double").alias("_t"), *[F.col(c).cast("double").alias(c) for c in cols])
    slim = slim.where(t.isNotNull()).groupBy(*keys, "_t").agg(F.min_by(F.struct(*cols), idx).alias("_s")).select(*keys, "_t", "_s.*")
    # Buckets of about a segment at the rate of the grid.
    slim = dense_index(slim, keys, "_t", "_at", bucket=F.floor(t * F.lit(fs / size)))
    pairs = shift_one(
        slim, keys, {"_t2": t, **{f"_n_{c}": F.col(c) for c in cols}}, back=False, idx="_at", size=size
    ).where(t2 > t)
    info = time_span(slim, keys, "_t").join(grid, list(keys)).where("n_grid > 0")
    placed = join_stats(pairs, info, keys)
    is_first, is_last = t == F.col("t_min"), t2 == F.col("t_max")
    top = F.col("n_grid") - 1
    low = F.when(is_first, F.lit(0)).otherwise(F.floor((t - F.col("t0")) * fs) - 1)
    high = F.when(is_last, top).otherwise(F.floor((t2 - F.col("t0")) * fs) + 1)
    low, high = F.greatest(low, F.lit(0)), F.least(high, top)
    spread = (
        placed.withColumn("_lo", low.cast("bigint")).withColumn("_hi", high.cast("bigint"))
        .where("_lo <= _hi")
    )
    spread = (
        grid_points(spread, keys, "_lo", "_hi")
        .withColumn("_g", grid_time(fs))
        .where((is_first | (F.col("_g") > t)) & (is_last | (F.col("_g") <= t2)))
    )
    share = (F.col("_g") - t) / (t2 - t)
    return spread.select(
        *keys, "grid_idx", F.col("_g").alias("time"),
        *[(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * share).alias(c) for c in cols],
    )


def resample_sparse(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], grid: DataFrame, fs: float, time: str = "time",
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """As ``resample_linear`` for columns with nulls: each column uses its own
    non-null samples; one with fewer than two stays null."""
    entries = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in cols])
    long = (
        df.select(*keys, idx, F.col(time).alias("_t"), F.explode(entries).alias("_e"))
        .select(*keys, idx, "_t", "_e.channel", "_e.v")
        .where(F.col("v").isNotNull() & F.col("_t").isNotNull())
    )
    wide_grid = grid.join(F.broadcast(df.sparkSession.createDataFrame([(c,) for c in cols], "channel string")))
    done = resample_linear(long, [*keys, "channel"], ["v"], wide_grid, fs, "_t", idx, size)
    if len(cols) == 1:
        values = done.select(*keys, "grid_idx", "time", F.col("v").alias(cols[0]))
    else:
        values = done.groupBy(*keys, "grid_idx").agg(
            F.max("time").alias("time"), *[F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in cols]
        )
    # A column with two samples or more has a value at every point, so only where none has are the points made apart.
    served = long.groupBy(*keys, "channel").agg(F.min("_t").alias("_a"), F.max("_t").alias("_z")).where("_a < _z").select(*keys).distinct()
    bare = grid_points(grid.where("n_grid > 0").join(served, list(keys), "left_anti"), keys, "0L", "(n_grid - 1)", spread=True)
    return values.unionByName(bare.select(*keys, "grid_idx", grid_time(fs).alias("time"), *[F.lit(None).cast("double").alias(c) for c in cols]))


def shift_grid(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], lags: DataFrame, grid: DataFrame, fs: float,
) -> DataFrame:
    """Move gridded signals by ``lag`` whole grid steps and resample on the grid.

    A shift by whole steps lands on grid points, so rows are only renumbered;
    the gap that opens at one end is filled by extending the end pair's line.
    """
    info = grid.join(lags.select(*keys, F.coalesce("lag", F.lit(0)).cast("bigint").alias("lag")), list(keys))
    moved = join_stats(df, info, keys).withColumn("grid_idx", F.col("grid_idx") + F.col("lag"))
    inside = moved.where("grid_idx >= 0 and grid_idx < n_grid").select(*keys, "grid_idx", *cols)

    def at(k: str, c: str) -> Column:
        return F.max(F.when(F.col("grid_idx") == F.expr(k), F.col(c)))

    # the two rows at each end decide the extension: four rows per session
    ends = (
        join_stats(df, info, keys).where("grid_idx in (0, 1, n_grid - 2, n_grid - 1)")
        .groupBy(*keys, "lag", "n_grid")
        .agg(*[F.struct(at("0", c).alias("a"), at("1", c).alias("b"), at("n_grid - 2", c).alias("y"), at("n_grid - 1", c).alias("z")).alias(c) for c in cols])
        .where("lag <> 0 and n_grid > 1")
        .withColumn("_from", F.expr("if(lag > 0, 0L, greatest(0L, n_grid + lag))"))
        .withColumn("_to", F.expr("if(lag > 0, least(lag, n_grid), n_grid) - 1"))
        .where("_from <= _to")
        .withColumn("grid_idx", F.explode(F.sequence("_from", "_to")))
    )
    step = F.col("grid_idx") - F.col("lag")
    head = lambda c: c["a"] + (c["b"] - c["a"]) * step
    tail = lambda c: c["z"] + (c["z"] - c["y"]) * (step - F.col("n_grid") + 1)
    filled = ends.select(
        *keys, "grid_idx", *[F.when(F.col("lag") > 0, head(F.col(c))).otherwise(tail(F.col(c))).alias(c) for c in cols]
    )
    return (
        join_stats(inside.unionByName(filled), grid, keys)
        .select(*keys, "grid_idx", grid_time(fs).alias("time"), *cols)
    )


def shift_time(df: DataFrame, keys: Sequence[str], lags: DataFrame, fs: float, time: str = "time") -> DataFrame:
    """Times moved by each key's ``lag`` in samples at ``fs`` (none: not moved)."""
    moved = join_stats(df, lags.select(*keys, "lag"), keys, "left")
    return moved.withColumn(time, F.col(time) + F.coalesce("lag", F.lit(0)) / F.lit(fs)).drop("lag")
