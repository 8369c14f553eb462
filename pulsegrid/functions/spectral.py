"""Spectra and pulse shape of window arrays; every function takes (windows, samples)."""

from __future__ import annotations

import numpy as np

BAND = (0.5, 4.0)


def welch_psd(x: np.ndarray, fs: float, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Averaged periodogram: periodic Hann, half overlap, mean removed, one-sided."""
    n = x.shape[1]
    size = min(n, nperseg)
    hop = size - size // 2
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = (parts - parts.mean(axis=2, keepdims=True)) * taper
    power = np.abs(np.fft.rfft(parts, axis=2)) ** 2 / (fs * np.sum(taper**2))
    inner = slice(1, -1) if size % 2 == 0 else slice(1, None)
    power[:, :, inner] *= 2
    return np.fft.rfftfreq(size, 1 / fs), power.mean(axis=1)


def quality_index(x: np.ndarray, fs: float, band=BAND) -> np.ndarray:
    """Share of spectral power inside the band by the trapezoid rule, 0..1."""
    if x.shape[1] < 32:
        return np.zeros(len(x))
    f, p = welch_psd(x, fs)
    total = np.trapezoid(p, f, axis=1)
    inside = (f >= band[0]) & (f <= band[1])
    part = np.trapezoid(p[:, inside], f[inside], axis=1)
    flat = np.all(x == x[:, :1], axis=1) | (total < 1e-20)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(flat, 0.0, np.clip(part / total, 0.0, 1.0))


def band_sums(x: np.ndarray, fs: float, band=BAND, nperseg: int = 256):
    f, p = welch_psd(x, fs, nperseg)
    inside = (f >= band[0]) & (f <= band[1])
    return p[:, inside].sum(axis=1), p[:, ~inside].sum(axis=1), p


def snr(x, fs):
    signal, noise, _ = band_sums(x, fs)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(noise != 0, signal / noise, np.nan)


def relative_power(x, fs):
    signal, noise, _ = band_sums(x, fs)
    with np.errstate(invalid="ignore", divide="ignore"):
        return signal / (signal + noise)


def entropy(x, fs):
    _, _, p = band_sums(x, fs)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = p / p.sum(axis=1, keepdims=True)
        return -(share * np.log2(share + 1e-12)).sum(axis=1)


def magnitude_share(x, fs):
    """Magnitude share strictly inside the band (no taper, mean kept)."""
    mag = np.abs(np.fft.rfft(x, axis=1))
    f = np.fft.rfftfreq(x.shape[1], 1 / fs)
    inside = (f > BAND[0]) & (f < BAND[1])
    with np.errstate(invalid="ignore", divide="ignore"):
        return mag[:, inside].sum(axis=1) / mag.sum(axis=1)


def pulse_peaks(x: np.ndarray, min_gap: float) -> np.ndarray:
    """Mask of the peaks of all windows at once: local maxima (plateau middles); where two are closer than
    ``min_gap`` samples the higher survives, the later one on equal height.

    In each round every window accepts its highest open peak and closes what is near it, so there are as many rounds
    as a window has peaks at most.
    """
    rows, n = x.shape
    open_at = np.zeros(x.shape, bool)
    if n > 2:
        rise = np.diff(x, axis=1)
        # The sign of the last change before each place, and of the next one after it, reach over plateaus.
        at = np.arange(n - 1)
        last = np.maximum.accumulate(np.where(rise != 0, at, -1), axis=1)
        first = np.minimum.accumulate(np.where(rise != 0, at, n)[:, ::-1], axis=1)[:, ::-1]
        row = np.arange(rows)[:, None]
        start, stop = last[:, :-1] + 1, first[:, 1:]  # of the plateau that holds places 1 .. n - 2
        inner = np.arange(1, n - 1)[None, :]
        up = (last[:, :-1] >= 0) & (rise[row, np.maximum(last[:, :-1], 0)] > 0)
        down = (stop < n) & (rise[row, np.minimum(stop, n - 2)] < 0)
        open_at[:, 1:-1] = up & down & (inner == (start + np.minimum(stop, n - 1)) // 2)
    kept = np.zeros(x.shape, bool)
    place, gap = np.arange(n), np.ceil(min_gap)
    todo = np.flatnonzero(open_at.any(axis=1))
    while len(todo):
        high = np.where(open_at[todo], x[todo], -np.inf)
        top = n - 1 - np.argmax(high[:, ::-1], axis=1)
        kept[todo, top] = True
        open_at[todo] &= np.abs(place[None, :] - top[:, None]) >= gap
        open_at[todo, top] = False
        todo = todo[open_at[todo].any(axis=1)]
    return kept


def find_pulse_peaks(x: np.ndarray, min_gap: float) -> np.ndarray:
    """Places of the peaks of one window."""
    return np.flatnonzero(pulse_peaks(np.asarray(x, float)[None, :], min_gap)[0])


def heart_rate(x: np.ndarray, fs: float) -> np.ndarray:
    kept = pulse_peaks(x, fs * 0.4)
    count = kept.sum(axis=1)
    first, last = kept.argmax(axis=1), x.shape[1] - 1 - kept[:, ::-1].argmax(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count >= 2, 60.0 * fs * (count - 1) / (last - first), np.nan)


def pulse_consistency(x: np.ndarray, fs: float) -> np.ndarray:
    """Mean correlation of inner pulses with their mean shape; 0 with under 3 peaks.

    A pulse cut by the window edge has no full shape and is left out."""
    kept = pulse_peaks(x, fs * 0.4)
    half, enough = int(0.6 * fs) // 2, kept.sum(axis=1) >= 3
    order = np.cumsum(kept, axis=1)
    inner = kept & (order > 1) & (order < order[:, -1:]) & enough[:, None]
    row, at = np.nonzero(inner)
    whole = (at >= half) & (at + half <= x.shape[1])
    row, at = row[whole], at[whole]
    out = np.where(enough, np.nan, 0.0)
    if not len(row):
        return out
    shapes = x[row[:, None], at[:, None] + np.arange(-half, half)[None, :]]
    edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[edge, len(row)])
    mean = np.add.reduceat(shapes, edge, axis=0) / count[:, None]
    mean -= mean.mean(axis=1, keepdims=True)
    own = np.repeat(mean, count, axis=0)
    dev = shapes - shapes.mean(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = (dev * own).sum(axis=1) / np.sqrt((dev**2).sum(axis=1) * (own**2).sum(axis=1))
    out[row[edge]] = np.add.reduceat(corr, edge) / count
    return out
