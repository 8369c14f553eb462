"""Calibration and validation over many waveform records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DEVICES, seconds_of_day, site_of
from ..operators.alignment import sync_by_second
from ..operators.models import fit_svr_line
from ..operators.segments import SEGMENT_ROWS, dense_index
from ..operators.spectra import ratio_windows
from ..operators.splits import block_shuffle
from ..operators.windows import stride
from ..session import materialise
from ..sources.readers import first_match
from .views import error_histogram

K = ("session_id",)


def encounters(files: DataFrame, table: DataFrame) -> DataFrame:
    """Patient and sensor site per record; records without a clear site drop out.

    ``files`` holds ``session_id``, ``table`` the encounter rows.
    """
    dim = first_match(table.select(F.col("encounter_id").alias("session_id"), "patient_id", *DEVICES), ["session_id"], "patient_id")
    site = site_of([F.col(d).cast("double") for d in DEVICES])
    return files.join(dim, "session_id").select("session_id", "patient_id", site.alias("site")).where("site is not null")


def paired_samples(
    waves: DataFrame, spo2: DataFrame, clocks: DataFrame, width_sec: int = 10, fs: int = 86, spo2_fs: int = 2,
    limits: dict | None = None, size: int = SEGMENT_ROWS,
) -> DataFrame:
    """``(session_id, sec_idx, r, spo2)`` of all records, one row per common second.

    ``waves`` holds red and ir, ``spo2`` the slow table, ``clocks`` the start of
    day text of both: ``(session_id, wave_clock, spo2_clock)``.  All records run
    in one job; nothing loops over files.
    """
    ratios = ratio_windows(waves, K, "red", "ir", fs, width_sec, 0.5, 6.0, 4, limits, size=size)
    seconds = stride(spo2, spo2_fs).select(*K, "sec_idx", "spo2")
    as_time = lambda c, add=0: F.timestamp_micros(((seconds_of_day(F.col(c)) + add) * 1e6).cast("bigint"))
    starts = clocks.select(*K, as_time("wave_clock", width_sec).alias("ratio_start"), as_time("spo2_clock").alias("spo2_start"))
    return materialise(sync_by_second(ratios, seconds, K, starts), "pairs")


def fit_dataset(pairs: DataFrame, block: int = 10, seed: int = 42) -> DataFrame:
    """One line ``spo2 = a - b r`` over all records: a row ``(a, b, converged)``.

    Rows are numbered over all records, dealt in shuffled blocks (the rest of an
    incomplete block is left out) and fitted together.
    """
    order = F.xxhash64("session_id")
    tagged = pairs.withColumn("_g", F.lit("all")).withColumn("_h", order)
    numbered = dense_index(
        tagged.withColumn("_o", F.struct("_h", "session_id", "sec_idx")), ["_g"], "_o", "row",
        bucket=F.struct(F.col("_h"), F.col("session_id"), F.expr("sec_idx div 65536")),
    )
    dealt = block_shuffle(numbered.select("_g", "row", "r", "spo2"), ["_g"], block, F.xxhash64("_block", F.lit(seed)))
    rows = materialise(dealt.select("_g", F.col("r").alias("x"), F.col("spo2").alias("y")), "dealt")
    return materialise(fit_svr_line(rows, ["_g"]).select("a", "b", "converged"), "line")


def validate_dataset(
    pairs: DataFrame, line: DataFrame, records: DataFrame, train_patients: DataFrame, bins: int = 30
) -> tuple[DataFrame, DataFrame]:
    """Errors of a line on records of patients it was not trained on, and their histogram.

    ``records`` maps session to patient; the exclusion is by patient.
    """
    unseen = records.join(train_patients.select("patient_id"), "patient_id", "left_anti").select("session_id")
    # the line is a single row
    errors = pairs.join(unseen, "session_id", "left_semi").join(F.broadcast(line.limit(1))).select(
        "session_id", "sec_idx", (F.col("a") - F.col("b") * F.col("r") - F.col("spo2")).alias("error")
    )
    return errors, error_histogram(errors.withColumn("_g", F.lit("all")), ["_g"], F.col("error"), bins).drop("_g")


def legacy_ratios(merged: DataFrame, keys: Sequence[str], pairs, width: int, step: int, fs: float) -> DataFrame:
    """Ratios of causally filtered channels for every pair, one row per window.

    Every channel is filtered once (band and low pass); AC is the deviation of
    the band-passed part, DC the mean of the low-passed part.
    """
    from ..functions.scalars import safe_ratio
    from ..operators.filtering import causal
    from ..operators.windows import sliding

    channels = list(dict.fromkeys(c for p in pairs for c in p))
    out = causal(merged, keys, {c: f"_b_{c}" for c in channels}, fs, 0.5, 5.0)
    out = causal(out, keys, {c: f"_l_{c}" for c in channels}, fs, None, 0.5)
    rel = {c: safe_ratio(F.stddev_pop(f"_b_{c}"), F.avg(f"_l_{c}")).alias(c) for c in channels}
    # a window ends one row before the one that triggers it
    stats = sliding(out, keys, width, step, drop_tail=1).groupBy(*keys, "window_id").agg(*rel.values())
    return stats.select(*keys, "window_id", *[safe_ratio(F.col(a), F.col(b)).alias(f"r_{a}_{b}") for a, b in pairs])
