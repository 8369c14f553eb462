"""Array functions over many groups at once.

A grouped map in Python costs some milliseconds a group before it does anything, which is most of the time where
groups are small and many.  Here a task reads its groups in order, as many whole ones at a time as a bounded number
of rows holds (or one larger group), and hands them over as plain arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are handed over together, unless one group has more.
HELD = 1 << 16


def fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def first_rows(batch: pa.RecordBatch, keys: Sequence[str], last: tuple | None) -> np.ndarray:
    """Rows at which a group begins; ``last`` is the key of the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    new[0] = last is None or tuple(batch.column(k)[0].as_py() for k in keys) != last
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], held: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """``(rows, bounds)`` of whole groups, from batches in which the rows of a group follow each other."""
    parts, starts, size, last = [], [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = first_rows(batch, keys, last)
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        if size >= held and len(at):
            # What is held ends where the first group of this batch begins.
            yield pa.Table.from_batches([*parts, batch.slice(0, at[0])]), np.array([*starts, size + at[0]])
            batch, at, parts, starts, size = batch.slice(at[0]), at - at[0], [], [], 0
        starts += (at + size).tolist()
        parts.append(batch)
        size += batch.num_rows
    if size:
        yield pa.Table.from_batches(parts), np.array([*starts, size])


def over_groups(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str,
    solve: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, Sequence]], held: int = HELD,
) -> DataFrame:
    """``(keys, schema)``, a row for each group: ``solve(columns, bounds)`` gives the values of the groups by name.

    Group ``g`` is the rows ``bounds[g]`` to ``bounds[g + 1]`` of the columns, in ``order``.
    """
    keys = list(keys)
    kind = T.StructType.fromDDL(f"{fields(rows, keys)}, {schema}")
    made = [f.name for f in kind if f.name not in keys]
    target = to_arrow_schema(kind)

    def run(batches):
        for table, bounds in whole_groups(batches, keys, held):
            columns = {n: table.column(n).to_numpy() for n in table.column_names if n not in keys}
            got = solve(columns, bounds)
            heads = table.select(keys).take(pa.array(bounds[:-1]))
            cols = [heads.column(k).combine_chunks().cast(target.field(k).type) for k in keys]
            cols += [pa.array(got[n], target.field(n).type) for n in made]
            yield from pa.Table.from_arrays(cols, schema=target).to_batches(max_chunksize=4096)

    return together(rows, keys, order).mapInArrow(run, kind)


def together(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of a group in one task, one after the other in ``order``."""
    # As many tasks as the session has for a shuffle: their work is in the rows' arithmetic, not in their bytes.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)


def map_groups(
    rows: DataFrame, keys: Sequence[str], read: Sequence[str], passed: Sequence[str], made: Sequence[str],
    solve: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], held: int = HELD,
) -> DataFrame:
    """``(passed, made)`` of the rows that ``solve(columns, bounds)`` keeps, with the doubles it gives them by name; NaN becomes null.

    ``rows`` are ``together`` by ``keys``; ``read`` names the columns, as in ``over_groups``.
    """
    kind = T.StructType([*(rows.schema[n] for n in passed), *(T.StructField(n, T.DoubleType()) for n in made)])
    target = to_arrow_schema(kind)
    keys, passed = list(keys), list(passed)

    def run(batches):
        for table, bounds in whole_groups(batches, keys, held):
            keep, values = solve({n: table.column(n).to_numpy() for n in read}, bounds)
            cols = [c.combine_chunks() for c in table.select(passed).filter(pa.array(keep)).columns]
            cols = [c.cast(target.field(n).type) for n, c in zip(passed, cols)]
            cols += [pa.array(values[n], pa.float64(), from_pandas=True) for n in made]
            yield from pa.Table.from_arrays(cols, schema=target).to_batches(max_chunksize=4096)

    return rows.mapInArrow(run, kind)
