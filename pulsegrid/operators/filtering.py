"""Recursive filters and adaptive noise cancellation on segments."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters
from .segments import SEG, SEGMENT_ROWS, join_stats, map_segments, sorted_segment, to_float, with_halo
from .smoothing import box_rows, box_size


@dataclass(frozen=True)
class Band:
    """Pass band in Hz and the order of the filter on each side."""

    low: float
    high: float
    order: int = 4

    def __post_init__(self):
        if not 0 < self.low < self.high:
            raise ValueError("a pass band needs 0 < low < high")


@dataclass(frozen=True)
class Canceller:
    """Adaptive noise cancelling: length of the weight vector and its step."""

    taps: int = 32
    step: float = 0.005


def zero_phase(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], fs: float, low: float | None, high: float | None,
    order: int, idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Forward-backward Butterworth filter (band, low or high pass).

    Exact on segments: the halo is long enough for the filter's memory to fade
    far below double precision, so no state has to travel between tasks.
    """
    flt = filters.butterworth(order, low, high, fs)
    reach = filters.settle_samples(flt)

    def kernel(seg, arrays):
        return list(filters.zero_phase(flt, np.stack(arrays), seg.starts, seg.ends))

    return map_segments(df, keys, list(cols), list(cols.values()), kernel, idx, reach, reach, size)


def causal(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], fs: float, low: float | None, high: float | None,
    order: int = 5, idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """One-way filter that starts from rest at the first sample."""
    flt = filters.butterworth(order, low, high, fs)

    def kernel(seg, arrays):
        x = np.stack(arrays)
        start = None if seg.starts else filters.steady_state(flt)[None, :] * x[:, :1]
        return list(filters.run_filter(flt, x, start))

    return map_segments(
        df, keys, list(cols), list(cols.values()), kernel, idx, filters.settle_samples(flt), 0, size
    )


def condition(
    df: DataFrame, keys: Sequence[str], channels: Sequence[str], fs: float, low: float, high: float, order: int,
    dc_sec: float, wander_sec: float | None, energy: tuple[str, float, float] | None = None,
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Rolling DC, wander removal and band-pass of all channels in one pass.

    Reads ``{c}_raw`` and writes ``{c}_rolling_dc`` and ``{c}``; ``energy`` is
    ``(column, low, high)`` of the acceleration magnitude, which adds
    ``motion_energy``.  One shuffle and one trip through Arrow for the lot.
    """
    band = filters.butterworth(order, low, high, fs)
    shake = filters.butterworth(4, energy[1], energy[2], fs) if energy else None
    dc_box, wander_box = box_size(dc_sec, fs), box_size(wander_sec or 0.0, fs)
    smooth_reach = max(dc_box // 2, 3 * (wander_box // 2))
    reach = max(filters.settle_samples(f) for f in (band, shake) if f) + smooth_reach
    names = list(channels)

    def kernel(seg, arrays):
        raw = np.stack(arrays[: len(names)])
        slow = box_rows(raw, dc_box, 1, seg.starts, seg.ends)
        ac = raw - box_rows(raw, wander_box, 3, seg.starts, seg.ends) if wander_sec else raw
        out = [*filters.zero_phase(band, ac, seg.starts, seg.ends), *slow]
        if shake:
            out.append(np.abs(filters.zero_phase(shake, arrays[-1], seg.starts, seg.ends))[0])
        return out

    inputs = [f"{c}_raw" for c in names] + ([energy[0]] if energy else [])
    outputs = names + [f"{c}_rolling_dc" for c in names] + (["motion_energy"] if energy else [])
    return map_segments(df, keys, inputs, outputs, kernel, idx, reach, reach, size)


def adaptive_cancel(
    df: DataFrame, keys: Sequence[str], primaries: Mapping[str, str], references: Sequence[str], taps: int, mu: float,
    style: str = "delayed", idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """LMS noise cancellation of ``primaries`` (input to output names).

    * ``delayed``: one reference, taps end before the current sample, the first
      ``taps`` outputs are the input;
    * ``current``: any number of references, zero-padded, current sample included;
    * ``normalised``: as ``delayed`` with the step divided by the tap power, the
      first ``taps`` outputs are zero.

    The weights depend on everything before, but each run of samples maps start
    weights to end weights affinely.  Three steps therefore suffice: every
    segment computes its map from rest, the maps are chained per session (one
    small row per segment, streamed), and every segment runs again from its true
    start weights.  Sessions of one segment skip the first two.
    """
    names, refs = list(primaries), list(references)
    width = taps * len(refs)

    def prepare(seg, arrays):
        rows = [filters.tap_rows(r, taps, style == "current") for r in arrays[len(names):]]
        x = np.concatenate(rows, axis=1)
        gain = np.full(len(seg.idx), 2.0 * mu)
        if style == "normalised":
            gain = mu / ((x * x).sum(axis=1) + 1e-6)
        if style != "current":
            gain[seg.idx < taps] = 0.0
        return np.stack(arrays[: len(names)]), x, gain

    inputs = names + refs
    inner = join_stats(
        df, df.groupBy(*keys).agg(F.max(idx).alias("_last")), keys
    ).where(F.expr(f"`{idx}` div {size} < _last div {size}")).select(*keys, idx, *dict.fromkeys(inputs))
    key_fields = [df.schema[k] for k in keys]
    array = T.ArrayType(T.DoubleType())
    map_schema = T.StructType([*key_fields, T.StructField(SEG, T.LongType()), T.StructField("map", array), T.StructField("push", array)])

    def summarise(table: pa.Table) -> pa.Table:
        ready = sorted_segment(table, idx, size, 0)
        shape = {k: table.column(k).slice(0, 1 if ready else 0) for k in (*keys, SEG)}
        m, v = [], []
        if ready:
            table, seg = ready
            p, x, gain = prepare(seg, [to_float(table.column(c)) for c in inputs])
            c = seg.core
            _, w = filters.adaptive(p[:, c], x[c], gain[c])
            m, v = [filters.adaptive_map(x[c], gain[c]).ravel()], [w.ravel()]
        return pa.table({**shape, "map": pa.array(m, pa.list_(pa.float64())), "push": pa.array(v, pa.list_(pa.float64()))})

    maps = with_halo(inner, idx, size, taps, 0).groupBy(*keys, SEG).applyInArrow(summarise, map_schema)
    state_schema = T.StructType([*key_fields, T.StructField(SEG, T.LongType()), T.StructField("state", array)])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, w = None, None
        for batch in batches:
            states = []
            for row in batch.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != last:
                    last, w = key, np.zeros((len(names), width))
                w = w @ np.asarray(row[-2]).reshape(width, width).T + np.asarray(row[-1]).reshape(len(names), width)
                states.append(w.ravel())
            out = batch[[*keys, SEG]].copy()
            out[SEG] += 1
            out["state"] = states
            yield out

    carry = (
        maps.repartition(*keys).sortWithinPartitions(*keys, SEG).mapInPandas(chain, state_schema)
    )

    def kernel(seg, arrays):
        p, x, gain = prepare(seg, arrays)
        c = seg.core
        start = None if seg.extra is None else np.asarray(seg.extra).reshape(len(names), width)
        out = np.full_like(p, np.nan)
        out[:, c], _ = filters.adaptive(p[:, c], x[c], gain[c], start)
        if style == "normalised":
            out[:, seg.idx < taps] = 0.0
        return list(out)

    return map_segments(
        df, keys, inputs, list(primaries.values()), kernel, idx, taps, 0, size, carry=carry
    )


def resample_poly(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], up: int, down: int,
    idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Change the rate by ``up / down`` with an anti-alias filter.

    Gives rows ``(keys, idx, cols)`` on the new rate, ``ceil(n * up / down)`` per
    session; samples beyond the ends count as zero.
    """
    from math import gcd

    g = gcd(up, down)
    up, down = up // g, down // g
    taps = filters.kaiser_taps(up, down)
    half = len(taps) // 2
    reach = half // up + 1
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(idx, T.LongType())] + [T.StructField(c, T.DoubleType()) for c in cols])

    def group(table: pa.Table) -> pa.Table:
        ready = sorted_segment(table, idx, size, reach)
        if ready is None:
            m = np.zeros(0, np.int64)
            made = [np.zeros(0) for _ in cols]
        else:
            table, seg = ready
            own = seg.idx[seg.core]
            m = np.arange(-(-int(own[0]) * up // down), -(-(int(own[-1]) + 1) * up // down))
            first = -(-(m * down - half) // up)
            j = first[:, None] + np.arange(2 * half // up + 1)[None, :]
            k = m[:, None] * down + half - j * up
            weight = np.where((k >= 0) & (k < len(taps)), taps[np.clip(k, 0, len(taps) - 1)], 0.0)
            at = j - int(seg.idx[0])
            weight[(at < 0) | (at >= len(seg.idx))] = 0.0
            at = np.clip(at, 0, len(seg.idx) - 1)
            made = [(to_float(table.column(c))[at] * weight).sum(axis=1) for c in cols]
        data = {k: pa.array([table.column(k)[0].as_py()] * len(m), table.schema.field(k).type) for k in keys}
        data[idx] = pa.array(m, pa.int64())
        for c, v in zip(cols, made):
            data[c] = pa.array(v, mask=~np.isfinite(v))
        return pa.table(data)

    needed = df.select(*keys, idx, *cols)
    return with_halo(needed, idx, size, reach, reach).groupBy(*keys, SEG).applyInArrow(group, schema)
