"""Window features of merged recordings: quality, shape, ratio of ratios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import spectral
from .segments import SEG, SEGMENT_ROWS, sorted_segment, to_float, with_halo

D = T.DoubleType()
CHANNEL = T.StructType(
    [T.StructField("channel", T.StringType())] + [T.StructField(c, D) for c in ("sqi", "skewness", "kurtosis")]
)
PAIR = T.StructType(
    [T.StructField("combo_ord", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]
    + [T.StructField(c, D) for c in ("r", "ac_a", "dc_a", "ac_b", "dc_b")]
    + [T.StructField("lag_applied", T.IntegerType()), T.StructField("lag_residual", T.IntegerType())]
)
BASE = ("t0", "t1", "time_center", "spo2", "motion_frac", "motion_rms", "acc_mag_mean")
EPS = 1e-12
BATCH = 512


@dataclass(frozen=True)
class Pairing:
    """Samples by which a pair's channels may be shifted (None: not at all), and the least quality of both."""

    shift: int | None = 8
    quality: float = 0.15


def shape_stats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population skewness and excess kurtosis of each row."""
    d = x - x.mean(axis=1, keepdims=True)
    m2 = (d**2).mean(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (d**3).mean(axis=1) / m2**1.5, (d**4).mean(axis=1) / m2**2 - 3.0


def pair_lag(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Per row the shift of ``b`` within ``reach`` that correlates best with ``a``."""
    w = a.shape[1]
    a = a - a.mean(axis=1, keepdims=True)
    b = b - b.mean(axis=1, keepdims=True)
    score = np.full((len(a), 2 * reach + 1), -np.inf)
    for k, lag in enumerate(range(-reach, reach + 1)):
        if abs(lag) < w:
            lead = a[:, max(lag, 0) : w + min(lag, 0)]
            score[:, k] = np.einsum("ij,ij->i", lead, b[:, max(-lag, 0) : w - max(lag, 0)])
    return score.argmax(axis=1) - reach


def free_lag(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``pair_lag`` over all lags, by Fourier transform."""
    w = a.shape[1]
    size = 1 << (2 * w - 1).bit_length()
    fa = np.fft.rfft(a - a.mean(axis=1, keepdims=True), size, axis=1)
    fb = np.fft.rfft(b - b.mean(axis=1, keepdims=True), size, axis=1)
    corr = np.fft.irfft(fa * np.conj(fb), size, axis=1)
    ordered = np.concatenate([corr[:, size - w + 1 :], corr[:, :w]], axis=1)
    # equal scores differ by rounding only; take the first within that noise
    top = ordered.max(axis=1, keepdims=True)
    return (ordered >= top - 1e-12 * np.abs(top)).argmax(axis=1) - (w - 1)


def shifted(b: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Rows of ``b`` moved right by ``lag``; the ends repeat the edge value."""
    w = b.shape[1]
    at = np.clip(np.arange(w)[None, :] - lag[:, None], 0, w - 1)
    return np.take_along_axis(b, at, axis=1)


def window_features(
    df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], fs: float, width: int, step: int,
    align: bool = True, reach: int = 8, min_sqi: float = 0.15, idx: str = "sample_idx", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """One row per full window: base statistics, ``channels`` and ``combos`` arrays.

    Needs ``time, spo2``, and per channel ``{c}`` (AC) and ``{c}_raw``;
    ``{c}_rolling_dc``, ``motion_energy``, ``high_motion``, ``acc_mag`` are used
    where present.  A window belongs to the segment its first row lies in and
    reads the rest from the halo, so samples cross the network about once
    instead of once per covering window.  Windows with a missing sample or mean
    saturation are left out; a pair whose channel quality is under ``min_sqi``
    has null values and zero lags.
    """
    channels = list(dict.fromkeys(c for p in pairs for c in p))
    for c in channels:
        for need in (c, f"{c}_raw"):
            if need not in df.columns:
                raise KeyError(f"column '{need}' is needed; there are {df.columns}")
    dc = {c: f"{c}_rolling_dc" if f"{c}_rolling_dc" in df.columns else f"{c}_raw" for c in channels}
    optional = [c for c in ("motion_energy", "high_motion", "acc_mag") if c in df.columns]
    needed = list(dict.fromkeys(["time", "spo2", *channels, *[f"{c}_raw" for c in channels], *dc.values(), *optional]))
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("window_id", T.LongType())] + [T.StructField(c, D) for c in BASE]
        + [T.StructField("high_motion_window", T.IntegerType()),
           T.StructField("channels", T.ArrayType(CHANNEL)), T.StructField("combos", T.ArrayType(PAIR))]
    )
    arrow_schema = to_arrow_schema(schema)

    def batch_rows(cols, first):
        view = {c: cols[c][first[:, None] + np.arange(width)[None, :]] for c in needed}
        out = {
            "t0": view["time"][:, 0], "t1": view["time"][:, -1], "time_center": view["time"][:, width // 2],
            "spo2": view["spo2"].mean(axis=1),
        }
        zero = np.zeros(len(first))
        out["motion_frac"] = view["high_motion"].mean(axis=1) if "high_motion" in view else zero
        out["motion_rms"] = np.sqrt((view["motion_energy"] ** 2).mean(axis=1)) if "motion_energy" in view else zero
        out["acc_mag_mean"] = view["acc_mag"].mean(axis=1) if "acc_mag" in view else zero
        whole = np.isfinite(out["spo2"])
        stats = {}
        for c in channels:
            whole &= np.isfinite(view[c]).all(axis=1) & np.isfinite(view[f"{c}_raw"]).all(axis=1)
        for c in channels:
            x = np.where(whole[:, None], view[c], 0.0)
            stats[c] = (x, spectral.quality_index(x, fs), *shape_stats(x), x.std(axis=1, ddof=1), np.maximum(view[dc[c]][:, width // 2], 1.0))
        combos = []
        for a, b in pairs:
            xa, qa, _, _, ac_a, dc_a = stats[a]
            xb, qb, _, _, ac_b, dc_b = stats[b]
            lag = residual = np.zeros(len(first), int)
            if align:
                lag = pair_lag(xa, xb, reach)
                moved = shifted(xb, lag)
                residual = free_lag(xa, moved)
                ac_b = moved.std(axis=1, ddof=1)
            r = (ac_a / (dc_a + EPS)) / (ac_b / (dc_b + EPS) + EPS)
            gate = (qa < min_sqi) | (qb < min_sqi)
            values = [np.where(gate, np.nan, v) for v in (r, ac_a, dc_a, ac_b, dc_b)]
            combos.append((a, b, values, np.where(gate, 0, lag), np.where(gate, 0, residual)))
        return out, whole, stats, combos

    def structs(fields: T.StructType, parts: list[dict], keep: np.ndarray) -> pa.Array:
        """One list per kept window, holding one struct per part."""
        kind = to_arrow_schema(fields)
        count = int(keep.sum())
        made = []
        for f in kind:
            cols = [np.broadcast_to(np.asarray(p[f.name], dtype=object if f.type == pa.string() else None), len(keep))[keep] for p in parts]
            flat = np.stack(cols, axis=1).ravel() if count else np.zeros(0)
            if f.type == pa.float64():
                flat = flat.astype(float)
                made.append(pa.array(flat, mask=~np.isfinite(flat)))
            else:
                made.append(pa.array(flat.tolist(), f.type))
        offsets = np.arange(count + 1, dtype=np.int32) * len(parts)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(made, fields=list(kind)))

    def batch_table(key, ids, out, whole, stats, combos) -> pa.Table:
        count = int(whole.sum())
        cols = [pa.array([v] * count, arrow_schema.field(c).type) for c, v in zip(keys, key)]
        cols.append(pa.array(ids[whole], pa.int64()))
        for c in BASE:
            v = out[c][whole]
            cols.append(pa.array(v, mask=~np.isfinite(v)))
        cols.append(pa.array((out["motion_frac"][whole] > 0.5).astype(np.int32)))
        cols.append(structs(CHANNEL, [{"channel": c, "sqi": s[1], "skewness": s[2], "kurtosis": s[3]} for c, s in stats.items()], whole))
        cols.append(structs(PAIR, [
            {"combo_ord": o, "a": a, "b": b, **dict(zip(("r", "ac_a", "dc_a", "ac_b", "dc_b"), values)), "lag_applied": lag, "lag_residual": res}
            for o, (a, b, values, lag, res) in enumerate(combos)
        ], whole))
        return pa.table(cols, names=arrow_schema.names).cast(arrow_schema)

    def group(table: pa.Table) -> pa.Table:
        ready = sorted_segment(table, idx, size, width - 1)
        parts = [arrow_schema.empty_table()]
        if ready is not None:
            sorted_table, seg = ready
            cols = {c: to_float(sorted_table.column(c)) for c in needed}
            own = seg.idx[seg.core]
            k = np.arange(-(-int(own[0]) // step), int(own[-1]) // step + 1)
            k = k[k * step + width - 1 <= int(seg.idx[-1])]
            key = [table.column(c)[0].as_py() for c in keys]
            for at in range(0, len(k), BATCH):
                ids = k[at : at + BATCH]
                parts.append(batch_table(key, ids, *batch_rows(cols, ids * step - int(seg.idx[0]))))
        return pa.concat_tables(parts)

    slim = df.select(*keys, idx, *needed)
    return with_halo(slim, idx, size, 0, width - 1).groupBy(*keys, SEG).applyInArrow(group, schema)


def require_all_ratios(features: DataFrame) -> DataFrame:
    """Windows in which every pair has a ratio."""
    return features.where(~F.exists("combos", lambda c: c["r"].isNull()))


def gate_motion(features: DataFrame) -> DataFrame:
    return features.where("high_motion_window = 0")


def per_channel(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return features.select(*keys, "window_id", F.inline("channels"))


def per_pair(features: DataFrame, keys: Sequence[str], *carry: str) -> DataFrame:
    return features.select(*keys, "window_id", *carry, F.inline("combos"))


def wide(features: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The export layout: one column per channel and pair statistic.

    ``AC_``/``DC_`` of a channel come from the last pair that holds it.
    """
    channels = list(dict.fromkeys(c for p in pairs for c in p))
    cols: list[Column] = [F.col(c) for c in (*keys, "window_id", *BASE, "high_motion_window")]
    for i, c in enumerate(channels):
        s = F.col("channels")[i]
        cols += [s["sqi"].alias(f"sqi_{c}"), s["skewness"].alias(f"skewness_{c}"), s["kurtosis"].alias(f"kurtosis_{c}")]
    for i, (a, b) in enumerate(pairs):
        p = F.col("combos")[i]
        cols += [p["r"].alias(f"R_{a}_{b}"), p["lag_residual"].alias(f"lag_{a}_{b}")]
    for c in channels:
        last = max(i for i, p in enumerate(pairs) if c in p)
        side = "b" if pairs[last][1] == c else "a"
        p = F.col("combos")[last]
        cols += [p[f"ac_{side}"].alias(f"AC_{c}"), p[f"dc_{side}"].alias(f"DC_{c}")]
    return features.select(*cols)
