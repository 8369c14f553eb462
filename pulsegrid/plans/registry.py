"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import wall_micros
from ..operators.segments import dense_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = ["session_id"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six decimals, no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double"), 6) + F.lit(0.0)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[r6(c, c) if c in cols else F.col(c) for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# One user's events are one recording; channels are simple functions of an event.
# The texts below mean the same in Spark SQL and in the check's SQL.
CHANNELS = {
    "red": "value",
    "ir": "60e0 + 5e-1 * value + ((event_id * 7919) % 101) / 10e0",
    "green": "80e0 + 3e-1 * value + ((event_id * 31) % 97) / 10e0",
    "blue": "120e0 - 1e-1 * value + ((event_id * 17) % 53) / 10e0",
    "accx": "((event_id * 37) % 101) - 50e0",
    "accy": "((event_id * 53) % 103) - 51e0",
    "accz": "100e0 + ((event_id * 71) % 107) / 10e0",
    "spo2": "98e0 - value * 2.718281e-2 + ((event_id * 13) % 29) / 10e0",
}


def recording(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """``(session_id, sample_idx, event_id, cols)`` of all events; ``n`` is the session's number of them."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id",
        *(["ts"] if "ts" in cols else []),
        *[F.expr(CHANNELS[c]).alias(c) for c in cols if c in CHANNELS],
    )
    out = dense_index(ev, K, "event_id", total="n" if "n" in cols else None)
    if "time" in cols:
        out = out.withColumn("time", F.col("sample_idx") / F.lit(50.0))
    if "clock" in cols:
        # event time in hours since the start of the month
        out = out.withColumn("clock", (wall_micros(F.col("ts")) - F.lit(1704067200000000)) / F.lit(3.6e9))
    return out


SIG = """sig AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_id, ts,
    (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 50e0 AS time,
    (epoch_us(ts) - 1704067200000000) / 3.6e9 AS clock,
    %s
  FROM events),
cnt AS (SELECT session_id, count(*) AS n FROM sig GROUP BY 1)""" % ",\n    ".join(f"{e} AS {c}" for c, e in CHANNELS.items())


def sql_windows(width: int, step: int, tail: int = 0) -> str:
    """CTE ``win``: rows of ``sig`` with the window ``k`` and position ``pos``."""
    return f"""win AS (
  SELECT s.*, w.k, s.i - w.k * {step} AS pos
  FROM sig s JOIN (SELECT session_id, unnest(range(0, (n - {tail} - {width}) // {step} + 1)) AS k FROM cnt WHERE n - {tail} >= {width}) w
  ON s.session_id = w.session_id AND s.i >= w.k * {step} AND s.i < w.k * {step} + {width})"""


def sq(x: str, name: str | None = None) -> str:
    """SQL text of ``r6``."""
    return f"round(({x})::DOUBLE, 6) + 0" + (f" AS {name}" if name else "")
