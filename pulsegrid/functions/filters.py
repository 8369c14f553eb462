"""Recursive-filter arithmetic used inside segment kernels (numpy only).

Textbook forms: Butterworth prototype poles, bilinear transform, direct form II
transposed state space, odd extension for zero-phase filtering.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np


class Filter(NamedTuple):
    """A digital filter by its zeros, poles and gain."""

    zeros: tuple
    poles: tuple
    gain: float


@lru_cache(maxsize=64)
def butterworth(order: int, low: float | None, high: float | None, fs: float) -> Filter:
    """A digital Butterworth filter.

    Both edges give a band-pass (degree ``2 * order``), only ``high`` a low-pass
    with that cutoff, only ``low`` a high-pass.
    """
    m = np.arange(order)
    proto = np.exp(1j * np.pi * (2 * m + order + 1) / (2 * order))
    warp = lambda f: 2.0 * fs * math.tan(math.pi * f / fs)
    if low is not None and high is not None:
        w1, w2 = warp(low), warp(high)
        width, centre2 = w2 - w1, w1 * w2
        half = proto * width / 2
        root = np.sqrt(half * half - centre2)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), width**order
    elif high is not None:
        cut = warp(high)
        poles, zeros, gain = proto * cut, np.zeros(0, complex), cut**order
    else:
        cut = warp(low)
        poles, zeros, gain = cut / proto, np.zeros(order, complex), float(np.real(1.0 / np.prod(-proto)))
    c = 2.0 * fs
    gain *= float(np.real(np.prod(c - zeros) / np.prod(c - poles)))
    zd = np.concatenate([(c + zeros) / (c - zeros), -np.ones(len(poles) - len(zeros))])
    return Filter(tuple(zd), tuple((c + poles) / (c - poles)), gain)


def settle_samples(flt: Filter, digits: float = 24.0) -> int:
    """Samples after which the memory of a start state has shrunk by 10**-digits.

    A halo of this length makes a segment independent of what lies before it,
    to well below double precision.
    """
    radius = float(np.max(np.abs(flt.poles)))
    return int(math.ceil(digits * math.log(10.0) / -math.log(radius)))


@lru_cache(maxsize=64)
def _block_form(flt: Filter, block: int):
    """Partial-fraction form: one complex state per pole, ``s' = p s + x``.

    The poles are distinct, so powers are elementwise and never grow; expanded
    polynomial coefficients would lose most digits here.
    """
    p, z = np.array(flt.poles), np.array(flt.zeros)
    apart = p[:, None] - p[None, :] + np.eye(len(p))
    share = flt.gain * np.prod(p[:, None] - z[None, :], axis=1) / np.prod(apart, axis=1)
    powers = p[None, :] ** np.arange(block)[:, None]
    look = powers * share
    load = powers[::-1]
    impulse = np.concatenate([[flt.gain], look[: block - 1].sum(axis=1).real])
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    toeplitz = np.where(lag >= 0, impulse[np.clip(lag, 0, None)], 0.0)
    return toeplitz, look, load, p**block, 1.0 / (1.0 - p)


def run_filter(flt: Filter, x: np.ndarray, state: np.ndarray | None = None, block: int = 64) -> np.ndarray:
    """Causal filter along the last axis of ``x`` (rows are signals).

    Works block by block: the response to the samples of a block is one matrix
    product for all blocks, only the state hops from block to block.
    """
    toeplitz, look, load, hop, _ = _block_form(flt, block)
    x = np.atleast_2d(x)
    rows, n = x.shape
    count = -(-n // block)
    padded = np.zeros((rows, count * block))
    padded[:, :n] = x
    blocks = padded.reshape(rows, count, block)
    feed = blocks @ load
    states = np.empty((rows, count, len(hop)), complex)
    s = np.zeros((rows, len(hop)), complex) if state is None else state
    for i in range(count):
        states[:, i] = s
        s = s * hop + feed[:, i]
    y = blocks @ toeplitz.T + (states @ look.T).real
    return y.reshape(rows, count * block)[:, :n]


def steady_state(flt: Filter) -> np.ndarray:
    """Filter state after an endless run of ones."""
    return _block_form(flt, 64)[4]


def zero_phase(flt: Filter, x: np.ndarray, at_start: bool = True, at_end: bool = True) -> np.ndarray:
    """Forward-backward filter of the rows of ``x``.

    At a true end of the recording the signal is extended by point reflection;
    at an inner cut (``False``) the halo plays that part.  A recording not
    longer than the extension cannot be filtered and gives NaN.
    """
    x = np.atleast_2d(x)
    n = x.shape[1]
    pad = 3 * (len(flt.poles) + 1)
    if at_start and at_end and n <= pad:
        return np.full_like(x, np.nan)
    parts = [x]
    if at_start:
        parts.insert(0, 2 * x[:, :1] - x[:, pad:0:-1])
    if at_end:
        parts.append(2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1])
    ext = np.concatenate(parts, axis=1)
    zi = steady_state(flt)
    forward = run_filter(flt, ext, zi[None, :] * ext[:, :1])
    turned = forward[:, ::-1]
    back = run_filter(flt, turned, zi[None, :] * turned[:, :1])[:, ::-1]
    first = pad if at_start else 0
    return back[:, first : first + n]


def kaiser_taps(up: int, down: int) -> np.ndarray:
    """Anti-alias taps for rational resampling: windowed sinc, Kaiser beta 5."""
    rate = max(up, down)
    half = 10 * rate
    m = np.arange(-half, half + 1)
    taps = np.sinc(m / rate) / rate * np.kaiser(2 * half + 1, 5.0)
    return taps / taps.sum() * up


def adaptive(primary: np.ndarray, refs: np.ndarray, gain: np.ndarray, weights: np.ndarray | None = None):
    """Adaptive canceller: ``e = p - w.x``, then ``w += gain * e * x``.

    ``primary`` is (signals, n), ``refs`` (n, taps), ``gain`` (n,).  Returns the
    errors and final weights (signals, taps).
    """
    w = np.zeros((primary.shape[0], refs.shape[1])) if weights is None else weights.copy()
    errors = np.empty_like(primary)
    for i in range(primary.shape[1]):
        x = refs[i]
        e = primary[:, i] - w @ x
        errors[:, i] = e
        w += (gain[i] * e)[:, None] * x
    return errors, w


def adaptive_map(refs: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The matrix by which a run over ``refs`` maps start weights to end weights.

    The weight update is affine in the weights, so runs compose like affine
    maps and segments can be solved independently, then joined exactly.
    """
    m = np.eye(refs.shape[1])
    for x, g in zip(refs, gain):
        m -= np.outer(g * x, x @ m)
    return m


def tap_rows(reference: np.ndarray, taps: int, include_now: bool) -> np.ndarray:
    """Row i holds the last ``taps`` reference samples, newest first, zero padded."""
    lead = taps - 1 if include_now else taps
    padded = np.concatenate([np.zeros(lead), reference])
    rows = np.lib.stride_tricks.sliding_window_view(padded, taps)[: len(reference)]
    return rows[:, ::-1]
