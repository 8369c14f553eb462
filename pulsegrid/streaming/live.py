"""A trained calibration on a stream of window features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models import TrainedModel


def score_stream(windows: DataFrame, trained: TrainedModel) -> DataFrame:
    """Estimates for arriving windows ``(session_id, time_center, combo, x)``.

    Stateless, so it serves ``readStream`` and batch input alike.
    """
    return (
        windows.where(F.col("combo") == trained.combo)
        .select("session_id", "time_center", trained.predict(F.col("x")).alias("spo2_estimated"))
    )
