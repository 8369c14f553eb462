"""From two recordings per session to a calibrated model, and on to new sessions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ACC, OPTICAL, PAIRS_DEFAULT, PAIRS_MAIN
from ..functions.scalars import relative_time
from ..operators import features as feats
from ..operators import models
from ..operators.alignment import estimate_lag
from ..operators.cleaning import Plausible, Spikes, fill_spikes, interpolate, sanitize
from ..operators.features import Pairing
from ..operators.filtering import Band, Canceller, adaptive_cancel, condition, resample_poly, zero_phase
from ..operators.motion import Movement, flag_motion, magnitude
from ..operators.resample import resample_linear, shift_grid, time_grid, time_span
from ..operators.segments import SEGMENT_ROWS, dense_index, join_stats
from ..operators.smoothing import Baseline
from ..operators.windows import Span, discard_warmup
from ..session import materialise
from ..sources.sinks import save_model, write_table
from . import views

K = ("session_id",)


@dataclass(frozen=True)
class Job:
    """How two recordings become window features: sampling rates (Hz) and a part for each operator.

    The defaults are the general preset (fixed values, as those of the parts).
    """

    reference_rate: float = 100.0
    prototype_rate: float = 50.0
    rate: float = 50.0
    saturation: Plausible = Plausible()
    spikes: Spikes = Spikes()
    pulse: Band = Band(0.5, 5.0)
    baseline: Baseline = Baseline()
    movement: Movement = Movement()
    cancel: Canceller | None = Canceller()
    lag: float | None = 10.0  # seconds searched for the delay between the recordings; None: not aligned
    warmup: float = 60.0  # seconds
    windows: Span = Span()
    pairing: Pairing = Pairing()

    def but(self, **parts) -> "Job":
        return replace(self, **parts)


# The settings of the pilot study runs.
PILOT = Job(
    pulse=Band(0.5, 5.0, 5), windows=Span(5.0, 4.0), saturation=Plausible(92.0, 100.0, 3.0), movement=Movement(quantile=0.95),
    cancel=None, warmup=40.0,
)


@dataclass(frozen=True)
class Validation:
    """Pairs and models that compete, over how many folds."""

    pairs: tuple = PAIRS_DEFAULT
    models: tuple = (*models.CLOSED, *models.ROBUST, *models.KERNEL)
    folds: int = 5


PILOT_VALIDATION = Validation(pairs=PAIRS_MAIN)


def clean_reference(ref: DataFrame, job: Job, keys: Sequence[str] = K, size: int = SEGMENT_ROWS) -> DataFrame:
    """Sane saturation, gap-free raw channels and their band-passed copies."""
    timed = relative_time(ref, keys, "time").select(*keys, "sample_idx", "time", "red", "ir", "spo2")
    sane = materialise(sanitize(timed, keys, "spo2", job.saturation.low, job.saturation.high, job.saturation.jump, size=size), "sane")
    whole = interpolate(sane, keys, {f"{c}_raw": F.col(c) for c in ("red", "ir")}, size=size)
    return zero_phase(
        whole, keys, {"red_raw": "red", "ir_raw": "ir"}, job.reference_rate, job.pulse.low, job.pulse.high, job.pulse.order, size=size
    )


def clean_prototype(proto: DataFrame, job: Job, keys: Sequence[str] = K, size: int = SEGMENT_ROWS) -> DataFrame:
    """Per channel: spike-free raw, rolling DC, band-passed AC; motion energy.

    Gaps are closed first: a single missing sample would otherwise void every
    statistic and filter of its recording.
    """
    optical = [c for c in OPTICAL if c in proto.columns]
    axes = [c for c in ACC if c in proto.columns]
    timed = relative_time(proto, keys, "time").select(*keys, "sample_idx", "time", *optical, *axes)
    whole = interpolate(timed, keys, [*optical, *axes], size=size)
    raw = fill_spikes(whole, keys, optical, job.spikes.window, job.spikes.limit, job.spikes.saturated, size=size).drop(*optical)
    raw = raw.withColumn("acc_mag", magnitude(*[F.col(c) for c in axes]))
    shaken = job.movement.band
    energy = ("acc_mag", shaken.low, shaken.high) if axes else None
    out = condition(
        raw, keys, optical, job.prototype_rate, job.pulse.low, job.pulse.high, job.pulse.order, job.baseline.level,
        job.baseline.wander, energy, size=size,
    )
    if not axes:
        return out.withColumn("motion_energy", F.lit(0.0))
    if job.cancel:
        out = zero_phase(out, keys, {"acc_mag": "_shake"}, job.prototype_rate, shaken.low, shaken.high, shaken.order, size=size)
        out = materialise(out, "shake")
        spread = out.groupBy(*keys).agg(F.stddev_pop("_shake").alias("_sd"))
        out = join_stats(out, spread, keys).withColumn("_shake", F.col("_shake") / (F.col("_sd") + 1e-12)).drop("_sd")
        out = adaptive_cancel(out, keys, {c: c for c in optical}, ["_shake"], job.cancel.taps, job.cancel.step, size=size).drop("_shake")
    return out


def merge_recordings(
    ref: DataFrame, proto: DataFrame, job: Job, keys: Sequence[str] = K, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Both recordings cleaned, on one time grid, aligned, flagged and trimmed.

    Rows are ``(keys, sample_idx, time, spo2, ref_*, {c}, {c}_raw,
    {c}_rolling_dc, acc*, motion_energy, high_motion)``; ``sample_idx`` is
    renumbered after trimming because windows count rows.
    """
    ref_c = materialise(clean_reference(ref, job, keys, size), "reference")
    proto_c = materialise(clean_prototype(proto, job, keys, size), "prototype")
    grid = materialise(time_grid([time_span(ref_c, keys), time_span(proto_c, keys)], keys, job.rate), "grid")
    fs = job.rate
    waves = ["red", "ir", "red_raw", "ir_raw"]
    if job.reference_rate != fs:
        slow = resample_linear(ref_c, keys, ["spo2"], grid, fs, size=size)
        start = ref_c.groupBy(*keys).agg(F.min_by("time", "sample_idx").alias("_t0"))
        fine = join_stats(resample_poly(ref_c, keys, waves, int(fs), int(job.reference_rate), size=size), start, keys)
        fine = fine.withColumn("time", F.col("_t0") + F.col("sample_idx") / F.lit(fs))
        on_grid = slow.join(resample_linear(fine, keys, waves, grid, fs, size=size).drop("time"), [*keys, "grid_idx"])
    else:
        on_grid = resample_linear(ref_c, keys, ["spo2", *waves], grid, fs, size=size)
    optical = [c for c in OPTICAL if c in proto_c.columns]
    carried = [c for c in proto_c.columns if c not in (*keys, "sample_idx", "time")]
    moved = materialise(resample_linear(proto_c, keys, carried, grid, fs, size=size), "prototype-grid")
    ref_g = materialise(on_grid.select(*keys, "grid_idx", "time", "spo2", *[F.col(c).alias(f"ref_{c}") for c in waves]), "reference-grid")
    if job.lag is not None and "red" in optical:
        both = ref_g.select(*keys, "grid_idx", "ref_red").join(moved.select(*keys, "grid_idx", "red"), [*keys, "grid_idx"])
        lags = materialise(estimate_lag(both, keys, "ref_red", "red", fs, job.lag, idx="grid_idx", size=size), "lags")
        moved = shift_grid(moved, keys, carried, lags, grid, fs)
    merged = materialise(ref_g.join(moved.drop("time"), [*keys, "grid_idx"]), "merged")
    flagged = flag_motion(merged, keys, "motion_energy", job.movement.quantile)
    required = ["time", "spo2", *[c for c in ("red", "ir", "red_raw", "ir_raw") if c in merged.columns]]
    kept = flagged.dropna(subset=required)
    if job.warmup > 0:
        kept = discard_warmup(kept, keys, job.warmup)
    return dense_index(kept, keys, "grid_idx", bucket_span=size).drop("grid_idx")


def extract_features(
    merged: DataFrame, job: Job, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = K,
    any_missing: str = "drop", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Window features, gated by ratio (``any_missing='keep'`` turns this off) and motion."""
    out = feats.window_features(
        merged, keys, pairs, job.rate, job.windows.rows(job.rate), job.windows.step(job.rate), job.pairing.shift is not None,
        job.pairing.shift or 0, job.pairing.quality, size=size
    )
    if any_missing == "drop":
        out = feats.require_all_ratios(out)
    return feats.gate_motion(out) if job.movement.drop else out


def calibrate(features: DataFrame, validation: Validation, keys: Sequence[str] = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross-validation of every session: predictions, fold metrics, summary.

    A session with too few windows has no predictions; ``outcomes`` says so.
    """
    features = materialise(features, "features")
    rows = materialise(models.samples(features, keys), "samples")
    pred = materialise(models.cross_validate(rows, keys, validation.folds, validation.models), "predictions")
    metrics = models.fold_metrics(pred, keys)
    return pred, metrics, models.cv_summary(metrics, keys)


def outcomes(sessions: DataFrame, features: DataFrame, pred: DataFrame, validation: Validation, keys: Sequence[str] = K) -> DataFrame:
    """``(keys, windows, status)``, a row for every session.

    Status: ``no windows``, ``too short`` (fewer than two for each fold), ``failed`` (no model predicts a
    window), ``partly`` (some model or fold has no prediction) or ``validated``.
    """
    n = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"))
    made = pred.groupBy(*keys).agg(F.count("y_pred").alias("_made"), F.count(F.lit(1)).alias("_asked"))
    out = sessions.select(*keys).distinct().join(n, list(keys), "left").join(made, list(keys), "left").fillna(0, ["windows", "_made", "_asked"])
    status = (
        F.when(F.col("windows") == 0, "no windows").when(F.col("windows") < 2 * validation.folds, "too short")
        .when(F.col("_made") == 0, "failed").when(F.col("_made") < F.col("_asked"), "partly").otherwise("validated")
    )
    return out.select(*keys, "windows", status.alias("status"))


def train_best(features: DataFrame, summary: DataFrame, keys: Sequence[str] = K, weighted: bool = False) -> models.TrainedModel:
    """Refit the best pair and model of the summary on all windows."""
    best = summary.where(F.col("RMSE_mean").isNotNull()).orderBy("RMSE_mean", "combo", "model").limit(1).first()
    if best is None:
        raise RuntimeError("no session could be validated; see outcomes()")
    return models.train(models.samples(features, keys), best.combo, best.model, best.RMSE_mean, weighted)


def run(
    ref: DataFrame, proto: DataFrame, job: Job, validation: Validation, out_dir: str, keys: Sequence[str] = K,
    size: int = SEGMENT_ROWS,
) -> tuple[DataFrame, DataFrame, models.TrainedModel]:
    """Train on one subject and store every table: features, summary, model."""
    spark = ref.sparkSession
    write_table(merge_recordings(ref, proto, job, keys, size), out_dir, "merged_signals")
    merged = spark.read.parquet(f"{out_dir}/merged_signals")
    write_table(views.signal_view(merged, keys, [f"ref_{c}" for c in ("red", "ir")] + list(OPTICAL)), out_dir, "signal_view")
    write_table(views.motion_view(merged, keys), out_dir, "motion_view")
    write_table(extract_features(merged, job, validation.pairs, keys, size=size), out_dir, "window_features")
    features = spark.read.parquet(f"{out_dir}/window_features")
    write_table(feats.wide(features, keys, validation.pairs), out_dir, "window_features_export", "csv")
    pred, _, summary = calibrate(features, validation, keys)
    write_table(outcomes(ref, features, pred, validation, keys), out_dir, "outcomes")
    write_table(summary, out_dir, "cv_summary")
    summary = spark.read.parquet(f"{out_dir}/cv_summary")
    best = models.best_models(summary, keys)
    write_table(views.summary_view(summary, keys), out_dir, "metrics_view")
    write_table(views.best_folds(pred, best, keys), out_dir, "best_predictions")
    write_table(views.scatter_view(pred, best, keys), out_dir, "scatter_view")
    trained = train_best(features, summary, keys)
    save_model(spark, trained, f"{out_dir}/trained_model")
    return features, summary, trained


def apply_to_subject(
    trained: models.TrainedModel, ref: DataFrame, proto: DataFrame, job: Job, validation: Validation, out_dir: str,
    subject: str, keys: Sequence[str] = K, size: int = SEGMENT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Predictions and error metrics of a trained model on other recordings."""
    spark = ref.sparkSession
    base = f"{out_dir.rstrip('/')}/subject={subject}"
    write_table(merge_recordings(ref, proto, job, keys, size), base, "merged_signals")
    merged = spark.read.parquet(f"{base}/merged_signals")
    write_table(extract_features(merged, job, validation.pairs, keys, size=size), base, "features")
    features = spark.read.parquet(f"{base}/features")
    write_table(models.apply_model(trained, models.samples(features, keys), keys), base, "predictions")
    pred = spark.read.parquet(f"{base}/predictions")
    if pred.isEmpty():
        raise RuntimeError(f"no valid windows for '{trained.combo}'")
    write_table(views.bland_altman(pred, keys), base, "bland_altman")
    write_table(views.error_summary(pred, keys, trained.cv_rmse), base, "error_summary")
    return pred, views.transfer_metrics(pred, keys)
