"""What the text operators share: Arrow scans, byte-exact words, hashing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Characters of text that one step of a scan holds as Python objects at a time; a longer text is a step of its own.
STEP_CHARS = 2 << 20


def slices(batch: pa.RecordBatch, text: str, step: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of about ``step`` bytes of text, and their texts (null: empty)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + step, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [x or "" for x in part.column(text).to_pylist()]
        start = stop


def bounded_batches(spark, limit: str = "8m") -> None:
    """Arrow batches of at most ``limit`` bytes for this session, unless it has a limit of its own.

    By default a batch is bounded by its rows alone; ten thousand long texts take hundreds of megabytes, in the JVM and again in the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, limit)


def tidy(*caches: dict) -> None:
    """Give memory back at the end of a task: workers live on and would hold it beside the next stage's."""
    for c in caches:
        c.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def scan(df: DataFrame, cols: list[str], text: str, schema: str, fn: Callable[[], Callable]) -> DataFrame:
    """``fn()`` runs once in each task and gives a function ``(rows, texts) -> RecordBatch or None``."""

    def run(batches):
        one = fn()
        for batch in batches:
            for part, texts in slices(batch, text):
                out = one(part, texts)
                if out is not None:
                    yield out
        del one
        tidy()

    bounded_batches(df.sparkSession)
    return df.select(*cols).mapInArrow(run, schema)


def table(**columns) -> pa.RecordBatch:
    """A batch of the named columns; numpy arrays and lists are converted."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


#: One byte for each kind: A-Z lower-cased, all else as it is (UTF-8 continuation bytes are above 0x7F).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
