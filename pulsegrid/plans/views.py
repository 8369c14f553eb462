"""Tables behind the diagnostic figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pair_label, znorm
from ..operators.models import metric_columns
from ..operators.segments import join_stats
from ..operators.windows import head_seconds


def signal_view(merged: DataFrame, keys: Sequence[str], channels: Sequence[str], seconds: float = 60.0) -> DataFrame:
    """First ``seconds`` of each recording with z-scored channels."""
    names = [c for c in channels if c in merged.columns]
    return znorm(head_seconds(merged, keys, seconds), keys, names)


def motion_view(merged: DataFrame, keys: Sequence[str], seconds: float = 60.0) -> DataFrame:
    """Acceleration columns of the head with the lowest flagged energy as ``threshold``."""
    head = head_seconds(merged, keys, seconds)
    line = head.groupBy(*keys).agg(F.min(F.when(F.col("high_motion") == 1, F.col("motion_energy"))).alias("threshold"))
    return join_stats(head, line, keys)


def summary_view(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label, mean and deviation of the RMSE, best first."""
    label = pair_label(F.col("combo"), F.col("model"), " | ")
    return summary.select(*keys, label.alias("label"), "RMSE_mean", "RMSE_std").orderBy(*keys, "RMSE_mean", "label")


def top_results(summary: DataFrame, count: int = 10) -> DataFrame:
    """The best results overall (a top-k, not a full sort)."""
    return summary.orderBy("RMSE_mean", "combo", "model").limit(count)


def best_folds(pred: DataFrame, best: DataFrame, keys: Sequence[str], fold: int | None = None) -> DataFrame:
    """Out-of-fold predictions of each key's best pair and model."""
    chosen = pred if fold is None else pred.where(F.col("fold") == fold)
    return chosen.join(best.select(*keys, "combo", "model"), [*keys, "combo", "model"], "left_semi")


def scatter_view(pred: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best predictions by motion with the range of the identity line."""
    rows = best_folds(pred, best, keys)
    span = rows.groupBy(*keys).agg(
        F.least(F.min("y_true"), F.min("y_pred")).alias("low"), F.greatest(F.max("y_true"), F.max("y_pred")).alias("high")
    )
    return join_stats(rows, span, keys).select(*keys, "fold", "row", "motion", "y_true", "y_pred", "low", "high")


def bland_altman(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and difference of every pair with bias and limits of agreement."""
    d = F.col("spo2_estimated") - F.col("spo2_reference")
    stats = pred.groupBy(*keys).agg(F.avg(d).alias("bias"), F.stddev_samp(d).alias("_sd"))
    return join_stats(pred, stats, keys).select(
        *keys, "time_center", ((F.col("spo2_estimated") + F.col("spo2_reference")) / 2).alias("mean"), d.alias("diff"),
        "bias", (F.col("bias") + 1.96 * F.col("_sd")).alias("loa_high"), (F.col("bias") - 1.96 * F.col("_sd")).alias("loa_low"),
    )


def transfer_metrics(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pred.groupBy(*keys).agg(*metric_columns(F.col("spo2_reference"), F.col("spo2_estimated")))


def error_summary(pred: DataFrame, keys: Sequence[str], cv_rmse: float | DataFrame) -> DataFrame:
    """RMSE, MAE, absolute bias and deviation, one row each, beside the training RMSE: one for all, or a table ``(keys, cv_rmse)``."""
    m = transfer_metrics(pred, keys)
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("measure"), v.alias("value"))
        for i, (n, v) in enumerate([("RMSE", F.col("RMSE")), ("MAE", F.col("MAE")), ("abs_Bias", F.abs("Bias")), ("SD_error", F.col("SD_error"))])
    ])
    out = m.select(*keys, F.inline(rows))
    return out.join(cv_rmse, list(keys), "left") if isinstance(cv_rmse, DataFrame) else out.withColumn("cv_rmse", F.lit(float(cv_rmse)))


def error_histogram(errors: DataFrame, keys: Sequence[str], error: Column, bins: int = 30) -> DataFrame:
    """Counts in equal bins from the smallest to the largest error, and their spread.

    The largest value falls in the last bin; a constant error fills one bin.
    """
    e = errors.select(*keys, error.alias("_e")).where(F.col("_e").isNotNull())
    span = e.groupBy(*keys).agg(F.min("_e").alias("_a"), F.max("_e").alias("_z"), F.stddev_pop("_e").alias("spread"))
    width = (F.col("_z") - F.col("_a")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("_e") - F.col("_a"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        join_stats(e, span, keys).groupBy(*keys, at.alias("bin"), "_a", "_z", "spread").agg(F.count(F.lit(1)).alias("count"))
        .select(*keys, "bin", (F.col("_a") + F.col("bin") * width).alias("low"), "count", "spread")
    )
