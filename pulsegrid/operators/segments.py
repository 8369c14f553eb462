"""Ordered operators over sessions of any length.

``Window.partitionBy(session)`` would put a whole session in one task.  One
session may hold a large share of all rows, so every ordered operator here
partitions by ``(session, segment)``: a segment is ``segment_rows`` consecutive
samples.  Two ways to see beyond a segment's edge:

* a *halo*: copies of a fixed number of neighbouring rows (moving windows);
* a *carry*: one summary row per segment, scanned in order, for reaches that
  have no bound (last valid sample, run starts).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_ROWS = 65_536
SEG, CORE = "_seg", "_core"


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str = "sample_idx",
    bucket: Column | None = None,
    bucket_span: int = 1 << 20,
    total: str | None = None,
) -> DataFrame:
    """Number rows 0, 1, 2, ... per key by ``order`` without a per-key window.

    Rows are counted per (key, bucket of ``order``); the running total of those
    counts is the offset of the bucket, and ``row_number`` runs inside a bucket.
    ``bucket`` must not decrease along ``order``; the default suits integers.
    ``total`` names a column for the number of the key's rows.
    """
    b = F.expr(f"`{order}` div {bucket_span}") if bucket is None else bucket
    tagged = df.withColumn("_bucket", b)
    part = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({
            "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)), **({total: F.sum("_n").over(Window.partitionBy(*keys))} if total else {}),
        })
        .drop("_n")
    )
    inside = Window.partitionBy(*part).orderBy(order)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, part)
        .withColumn(out, (F.col("_offset") + F.col("_rn") - 1).cast("bigint"))
        .drop("_bucket", "_rn", "_offset")
    )


#: Parts over which the rows of one key are dealt when they meet its statistics.
STAT_PARTS = 16


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner", parts: int = STAT_PARTS) -> DataFrame:
    """``df`` with the columns of ``stats``, which has one row per key.

    The statistics are spread to one row per (key, part) and both take part in the
    join, so that a key with a large share of all rows is not one task, and what
    is grouped by the key afterwards is dealt anew.
    """
    plain = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, T.AtomicType)]
    spread = stats.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(parts)).cast("int"))
    return dealt.join(spread, [*keys, "_part"], how).drop("_part")


def with_segment(df: DataFrame, idx: str = "sample_idx", size: int = SEGMENT_ROWS) -> DataFrame:
    return df.withColumn(SEG, F.expr(f"cast(`{idx}` div {size} as bigint)"))


def join_segments(df: DataFrame, stats: DataFrame, keys: Sequence[str], idx: str, count: str, size: int = SEGMENT_ROWS) -> DataFrame:
    """``df`` with the columns of ``stats``, which has one row per key and the key's number of rows as ``count``.

    ``df`` is numbered by ``idx``.  Each segment of it meets one copy of its key's row: a small key has one copy, where
    ``join_stats`` makes the same number for all.
    """
    spread = stats.withColumn(SEG, F.explode(F.expr(f"sequence(0L, cast((`{count}` - 1) div {size} as bigint))"))).drop(count)
    return with_segment(df, idx, size).join(spread, [*keys, SEG]).drop(SEG)


def with_halo(
    df: DataFrame, idx: str = "sample_idx", size: int = SEGMENT_ROWS, left: int = 0, right: int = 0
) -> DataFrame:
    """Tag rows with their segment and copy the rows that neighbours need.

    ``_core`` is true for the row's own segment; operators drop other copies.
    The copy rate is ``(left + right) / size``.
    """
    lo = F.expr(f"greatest(0L, cast((`{idx}` - {right}) div {size} as bigint))")
    hi = F.expr(f"cast((`{idx}` + {left}) div {size} as bigint)")
    return df.withColumn(SEG, F.explode(F.sequence(lo, hi))).withColumn(
        CORE, F.expr(f"{SEG} = `{idx}` div {size}")
    )


def segment_window(keys: Sequence[str], idx: str = "sample_idx"):
    return Window.partitionBy(*keys, SEG).orderBy(idx)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORE)).drop(SEG, CORE)


def over_halo(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, Callable],
    idx: str = "sample_idx",
    left: int = 0,
    right: int = 0,
    size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add columns computed by ``fn(window)`` on segments with a halo."""
    w = segment_window(keys, idx)
    out = with_halo(df, idx, size, left, right)
    return drop_halo(out.withColumns({name: fn(w) for name, fn in columns.items()}))


def carry_fill(
    df: DataFrame,
    keys: Sequence[str],
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    idx: str = "sample_idx",
    size: int = SEGMENT_ROWS,
    positions: bool = False,
) -> DataFrame:
    """Nearest non-null value at or before (``prev``) / at or after (``next``) a row.

    The reach is unbounded: each segment hands on one summary row.  ``df`` is read
    twice (summary and fill), so stage it first where it is costly to compute.
    With ``positions`` the index of each value comes along as ``{name}_at``.
    Values should be plain numbers or text: structs would force a sort before
    the summary's aggregation.
    """
    sides = [(n, e, True) for n, e in (prev or {}).items()] + [(n, e, False) for n, e in (next or {}).items()]
    pos = F.col(idx)
    tagged = with_segment(df, idx, size).withColumns({f"_v_{n}": e for n, e, _ in sides})
    at = {n: F.when(F.col(f"_v_{n}").isNotNull(), pos) for n, _, _ in sides}
    aggs = []
    for n, _, back in sides:
        aggs.append((F.max_by if back else F.min_by)(F.col(f"_v_{n}"), at[n]).alias(f"_e_{n}"))
        if positions:
            aggs.append((F.max if back else F.min)(at[n]).alias(f"_a_{n}"))
    edges = tagged.groupBy(*keys, SEG).agg(*aggs)
    up = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc(SEG)).rowsBetween(Window.unboundedPreceding, -1)
    # The "next" side runs as a running window over descending order: a frame
    # that ends at UNBOUNDED FOLLOWING would restart for every row.
    here = Window.partitionBy(*keys, SEG).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    back_w = Window.partitionBy(*keys, SEG).orderBy(F.desc(idx)).rowsBetween(Window.unboundedPreceding, 0)
    carried, local, result = [], {}, []
    for n, _, back in sides:
        over, within = (up, here) if back else (down, back_w)
        carried.append(F.last(f"_e_{n}", ignorenulls=True).over(over).alias(f"_c_{n}"))
        local[f"_l_{n}"] = F.last(f"_v_{n}", ignorenulls=True).over(within)
        result.append(F.coalesce(f"_l_{n}", f"_c_{n}").alias(n))
        if positions:
            carried.append(F.last(f"_a_{n}", ignorenulls=True).over(over).alias(f"_ca_{n}"))
            local[f"_la_{n}"] = F.last(at[n], ignorenulls=True).over(within)
            result.append(F.coalesce(f"_la_{n}", f"_ca_{n}").alias(f"{n}_at"))
    names = {n for n, _, _ in sides}
    out = tagged.withColumns(local).join(edges.select(*keys, SEG, *carried), [*keys, SEG])
    return out.select(*[c for c in df.columns if c not in names], *result)


def shift_one(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column], back: bool = True,
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """``lag`` (or ``lead``) by one row per key, across segment edges."""
    fn = F.lag if back else F.lead
    return over_halo(
        df, keys, {n: (lambda w, e=e: fn(e, 1).over(w)) for n, e in columns.items()},
        idx, left=1 if back else 0, right=0 if back else 1, size=size,
    )


class Segment:
    """What a segment kernel sees: sorted positions and float arrays."""

    __slots__ = ("seg", "idx", "core", "starts", "ends", "extra")

    def __init__(self, seg, idx, core, starts, ends, extra=None):
        self.seg, self.idx, self.core = seg, idx, core
        self.starts, self.ends, self.extra = starts, ends, extra


def to_float(col: pa.ChunkedArray) -> np.ndarray:
    """Doubles with nulls as NaN."""
    return pc.fill_null(col.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) if col.null_count else (
        col.cast(pa.float64()).to_numpy()
    )


def to_null(values: np.ndarray) -> pa.Array:
    """Doubles back to Arrow; NaN and infinities become null."""
    v = np.asarray(values, dtype=np.float64)
    return pa.array(v, mask=~np.isfinite(v))


def sorted_segment(table: pa.Table, idx: str, size: int, right: int) -> tuple[pa.Table, Segment] | None:
    """Sort one group and work out which session edges it touches."""
    core = table.column(CORE)
    if not pc.any(core).as_py():
        return None
    pos = table.column(idx).to_numpy()
    if np.any(pos[1:] < pos[:-1]):
        order = np.argsort(pos, kind="stable")
        table = table.take(pa.array(order))
        pos = pos[order]
    seg = table.column(SEG)[0].as_py()
    # a right halo shorter than asked for means the session ends here
    ends = int(pos[-1]) < (seg + 1) * size + right - 1
    mask = table.column(CORE).to_numpy(zero_copy_only=False).astype(bool)
    return table, Segment(seg, pos, mask, int(pos[0]) == 0, ends)


def map_segments(
    df: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    outputs: Sequence[str],
    kernel: Callable[[Segment, list[np.ndarray]], list[np.ndarray]],
    idx: str = "sample_idx",
    left: int = 0,
    right: int = 0,
    size: int = SEGMENT_ROWS,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Run a numpy kernel per (keys, segment) and keep the core rows.

    The kernel gets ``inputs`` as float arrays in sample order (halo included)
    and returns arrays of the same length for ``outputs``.  ``carry`` optionally
    brings one row per (keys, segment) with an array column ``state``.
    """
    halo = with_halo(df, idx, size, left, right)
    kept = [c for c in df.columns if c not in outputs]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [T.StructField(o, T.DoubleType()) for o in outputs]
    )

    def run(table: pa.Table, state) -> pa.Table | None:
        ready = sorted_segment(table, idx, size, right)
        if ready is None:
            return None
        table, seg = ready
        seg.extra = state
        made = kernel(seg, [to_float(table.column(c)) for c in inputs])
        mask = pa.array(seg.core)
        result = table.select(kept).filter(mask)
        for name, values in zip(outputs, made):
            result = result.append_column(name, to_null(values[seg.core]))
        return result

    def empty(table: pa.Table) -> pa.Table:
        base = table.select(kept).slice(0, 0)
        for name in outputs:
            base = base.append_column(name, pa.array([], pa.float64()))
        return base

    if carry is None:

        def group(table: pa.Table) -> pa.Table:
            done = run(table, None)
            return empty(table) if done is None else done

        return halo.groupBy(*keys, SEG).applyInArrow(group, schema)

    def cogroup(table: pa.Table, states: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.table({f.name: pa.array([], _arrow_type(f.dataType)) for f in schema})
        state = np.array(states.column("state")[0].as_py()) if states.num_rows else None
        done = run(table, state)
        return empty(table) if done is None else done

    return halo.groupBy(*keys, SEG).cogroup(carry.groupBy(*keys, SEG)).applyInArrow(cogroup, schema)


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)
