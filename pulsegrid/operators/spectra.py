"""Quality metrics of window arrays as Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from .features import shape_stats

QUALITY = (
    "perfusion", "skewness", "kurtosis", "snr", "entropy", "relative_power", "heart_rate", "consistency", "sqi"
)


def _by_length(series: pd.Series, fn) -> np.ndarray:
    """Apply a (windows, samples) function to a series of arrays of any lengths."""
    out = np.full(len(series), np.nan)
    lengths = series.map(lambda v: -1 if v is None else len(v)).to_numpy()
    values = series.to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        x = np.concatenate(values[at]).astype(float).reshape(len(at), n)
        whole = np.isfinite(x).all(axis=1)
        if whole.any():
            out[at[whole]] = fn(x[whole])
    return out


def metric(name: str, col: Column, fs: float) -> Column:
    """``sqi, snr, entropy, relative_power, magnitude_share, heart_rate`` or
    ``consistency`` of an array column; undefined values are null."""
    table = {
        "sqi": spectral.quality_index, "snr": spectral.snr, "entropy": spectral.entropy,
        "relative_power": spectral.relative_power, "magnitude_share": spectral.magnitude_share,
        "heart_rate": spectral.heart_rate, "consistency": spectral.pulse_consistency,
    }
    fn = table[name]

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        v = _by_length(s, lambda x: fn(x, fs))
        return pd.Series(np.where(np.isfinite(v), v, np.nan)).astype("Float64").where(np.isfinite(v), None)

    return run(col)


def quality_vector(raw: Column, filtered: Column, fs: float) -> Column:
    """All pulse-quality metrics of a window as one struct."""
    schema = ", ".join(f"{n} double" for n in QUALITY)

    @F.pandas_udf(schema)
    def run(r: pd.Series, f: pd.Series) -> pd.DataFrame:
        got = {
            "skewness": _by_length(f, lambda x: shape_stats(x)[0]),
            "kurtosis": _by_length(f, lambda x: shape_stats(x)[1]),
            "snr": _by_length(f, lambda x: spectral.snr(x, fs)),
            "entropy": _by_length(f, lambda x: spectral.entropy(x, fs)),
            "relative_power": _by_length(f, lambda x: spectral.relative_power(x, fs)),
            "heart_rate": _by_length(f, lambda x: spectral.heart_rate(x, fs)),
            "consistency": _by_length(f, lambda x: spectral.pulse_consistency(x, fs)),
            "sqi": _by_length(f, lambda x: spectral.magnitude_share(x, fs)),
        }
        ac, dc = _by_length(f, lambda x: x.std(axis=1)), _by_length(r, lambda x: x.mean(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            got["perfusion"] = ac / dc
        return pd.DataFrame({n: pd.Series(got[n], dtype="Float64").where(np.isfinite(got[n]), None) for n in QUALITY})

    return run(raw, filtered)


# The optional acceptance limits (low, high) of the quality gate.
LIMITS = {
    "perfusion": (0.01, None), "skewness": (0.0, 6.0), "kurtosis": (-1.5, 10.0), "snr": (1.5, None),
    "relative_power": (0.5, None), "entropy": (None, 5.0), "sqi": (0.4, None), "heart_rate": (40.0, 180.0),
}


def passes(quality: Column, limits: dict | None = None) -> Column:
    """True where every metric is within its limits; without limits always true.

    A missing metric fails only for the heart rate."""
    ok = F.lit(True)
    for name, (low, high) in (limits or {}).items():
        v = quality[name]
        inside = F.lit(True)
        if low is not None:
            inside = inside & (v >= low)
        if high is not None:
            inside = inside & (v <= high)
        ok = ok & F.coalesce(inside, F.lit(name != "heart_rate"))
    return ok


def ratio_windows(
    df: DataFrame, keys, red: str, ir: str, fs: int, width_sec: int, low: float, high: float, order: int,
    limits: dict | None = None, idx: str = "sample_idx", size: int | None = None,
) -> DataFrame:
    """Per-second ratio of windows that are band-passed one by one.

    The window of second ``x`` covers the ``width_sec`` seconds before it, for
    ``x`` from ``width_sec`` to two seconds before the end: rows
    ``(keys, sec_idx, r)`` with ``sec_idx`` from zero.  Windows that fail
    ``limits`` have a null ratio.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..functions import filters
    from .segments import SEG, SEGMENT_ROWS, sorted_segment, to_float, with_halo

    size = size or SEGMENT_ROWS
    width = width_sec * fs
    flt = filters.butterworth(order, low, high, float(fs))
    # a window needs one more full second after it than it reads
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("sec_idx", T.LongType()), T.StructField("r", T.DoubleType())])
    reach = width + 2 * fs

    def accept(raw, ac):
        ok = np.ones(len(raw), bool)
        values = {
            "perfusion": lambda: ac.std(axis=1) / raw.mean(axis=1), "skewness": lambda: shape_stats(ac)[0],
            "kurtosis": lambda: shape_stats(ac)[1], "snr": lambda: spectral.snr(ac, fs),
            "entropy": lambda: spectral.entropy(ac, fs), "relative_power": lambda: spectral.relative_power(ac, fs),
            "heart_rate": lambda: spectral.heart_rate(ac, fs), "sqi": lambda: spectral.magnitude_share(ac, fs),
        }
        for name, (lo, hi) in (limits or {}).items():
            v = values[name]()
            with np.errstate(invalid="ignore"):
                bad = (v < (-np.inf if lo is None else lo)) | (v > (np.inf if hi is None else hi))
            ok &= ~(bad | (np.isnan(v) & (name == "heart_rate")))
        return ok

    def group(table: pa.Table) -> pa.Table:
        ready = sorted_segment(table, idx, size, reach)
        k, r = np.zeros(0, np.int64), np.zeros(0)
        if ready is not None:
            sorted_table, seg = ready
            a, b = to_float(sorted_table.column(red)), to_float(sorted_table.column(ir))
            own, base = seg.idx[seg.core], int(seg.idx[0])
            k = np.arange(-(-int(own[0]) // fs), int(own[-1]) // fs + 1)
            n = int(seg.idx[-1]) + 1
            k = k[k + width_sec < n // fs - 1] if seg.ends else k
            at = (k * fs - base)[:, None] + np.arange(width)[None, :]
            xa, xb = a[at], b[at]
            fa, fb = filters.zero_phase(flt, xa), filters.zero_phase(flt, xb)
            with np.errstate(invalid="ignore", divide="ignore"):
                r = (fa.std(axis=1) / xa.mean(axis=1)) / (fb.std(axis=1) / xb.mean(axis=1))
                if limits:
                    r = np.where(accept(xa, fa) & accept(xb, fb), r, np.nan)
        data = {c: pa.array([table.column(c)[0].as_py()] * len(k), table.schema.field(c).type) for c in keys}
        return pa.table({**data, "sec_idx": pa.array(k, pa.int64()), "r": pa.array(r, mask=~np.isfinite(r))})

    return with_halo(df.select(*keys, idx, red, ir), idx, size, 0, reach).groupBy(*keys, SEG).applyInArrow(group, schema)


def cancelled_ratio_windows(
    df: DataFrame, keys, red: str, ir: str, acc, fs: float, width: int, step: int, mu: float = 0.001, taps: int = 5,
    low: float = 0.5, high: float = 5.0, cutoff: float = 0.5, order: int = 5, idx: str = "sample_idx", size: int | None = None,
) -> DataFrame:
    """Trailing ratios of windows that are filtered and motion-cancelled one by one.

    Each window of ``width`` rows (every ``step`` rows, with one row after it)
    starts its causal band and low pass and its canceller from rest; references
    are the axes and their magnitude within the window.  AC is the deviation of
    the cancelled band, DC the mean of the cancelled low pass.  Windows of a
    segment run side by side, so only the samples of one window are sequential.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..functions import filters
    from .segments import SEG, SEGMENT_ROWS, sorted_segment, to_float, with_halo

    size = size or SEGMENT_ROWS
    band = filters.butterworth(order, low, high, float(fs))
    slow = filters.butterworth(order, None, cutoff, float(fs))
    acc = list(acc)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("window_id", T.LongType()), T.StructField("r", T.DoubleType())])

    def cancel(signals: np.ndarray, refs: np.ndarray) -> np.ndarray:
        """(windows, signals, n) against (windows, refs, n), current sample included."""
        count, kinds, n = signals.shape
        padded = np.concatenate([np.zeros((count, refs.shape[1], taps - 1)), refs], axis=2)
        w = np.zeros((count, kinds, refs.shape[1] * taps))
        out = np.empty_like(signals)
        for i in range(n):
            x = padded[:, :, i : i + taps][:, :, ::-1].reshape(count, 1, refs.shape[1] * taps)
            out[:, :, i] = signals[:, :, i] - (w * x).sum(axis=2)
            w += 2 * mu * out[:, :, i, None] * x
        return out

    def group(table: pa.Table) -> pa.Table:
        ready = sorted_segment(table, idx, size, width)
        k, r = np.zeros(0, np.int64), np.zeros(0)
        if ready is not None:
            sorted_table, seg = ready
            cols = {c: to_float(sorted_table.column(c)) for c in (red, ir, *acc)}
            own, base = seg.idx[seg.core], int(seg.idx[0])
            k = np.arange(-(-int(own[0]) // step), int(own[-1]) // step + 1)
            k = k[k * step + width <= int(seg.idx[-1])]
            at = (k * step - base)[:, None] + np.arange(width)[None, :]
            win = {c: v[at] for c, v in cols.items()}
            refs = np.stack([*(win[c] for c in acc), np.sqrt(sum(win[c] ** 2 for c in acc))], axis=1)
            parts = np.stack([filters.run_filter(f, win[c]) for c in (red, ir) for f in (band, slow)], axis=1)
            clean = cancel(parts, refs)
            with np.errstate(all="ignore"):
                r = (clean[:, 0].std(axis=1) / clean[:, 1].mean(axis=1)) / (clean[:, 2].std(axis=1) / clean[:, 3].mean(axis=1))
        data = {c: pa.array([table.column(c)[0].as_py()] * len(k), table.schema.field(c).type) for c in keys}
        return pa.table({**data, "window_id": pa.array(k, pa.int64()), "r": pa.array(r, mask=~np.isfinite(r))})

    slim = df.select(*keys, idx, red, ir, *acc)
    return with_halo(slim, idx, size, 0, width).groupBy(*keys, SEG).applyInArrow(group, schema)
