"""Where results go: parquet tables, or CSV for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import TrainedModel


def write_table(df: DataFrame, out_dir: str, name: str, fmt: str = "parquet", by: list[str] | None = None) -> str:
    """Write ``out_dir/name``; nested columns are JSON text in CSV."""
    path = f"{out_dir.rstrip('/')}/{name}"
    if fmt == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        for c in nested:
            df = df.withColumn(c, F.to_json(c))
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)
    return path


def save_model(spark: SparkSession, trained: TrainedModel, path: str) -> None:
    """Parameters as a one-row table, readable anywhere (no pickles)."""
    trained.to_table(spark).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    return TrainedModel.from_table(spark.read.parquet(path))
