import numpy as np
import pytest

from pulsegrid.functions import filters, spectral


def slow_filter(b, a, x, z):
    y = np.empty_like(x)
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * y[i]
        z[-1] = b[-1] * v - a[-1] * y[i]
    return y


@pytest.mark.parametrize("spec", [(5, 0.5, 5.0), (4, 0.5, 10.0), (5, None, 0.5), (5, 5.0, None)])
def test_block_filter_equals_sample_loop(spec):
    flt = filters.butterworth(*spec, 50.0)
    x = np.random.default_rng(1).normal(size=700).astype(np.longdouble) + 100
    # the plain recursion needs the extra digits: its own double error is 1e-6
    b = flt.gain * np.real(np.poly(np.array(flt.zeros))).astype(np.longdouble)
    p = np.array(flt.poles, dtype=np.clongdouble)
    a = np.ones(1, dtype=np.clongdouble)
    for pole in p:
        a = np.concatenate([a, [0]]) - pole * np.concatenate([[0], a])
    a = a.real
    want = slow_filter(b, a, x, np.zeros(len(a) - 1, dtype=np.longdouble))
    got = filters.run_filter(flt, x.astype(float))[0]
    assert np.max(np.abs(got - want)) < 1e-8
    # a constant input with the steady start state stays constant
    level = filters.run_filter(flt, np.full(300, 7.0), filters.steady_state(flt)[None] * 7.0)[0]
    assert np.ptp(level) < 1e-8


def test_band_edges_and_gain():
    flt = filters.butterworth(4, 0.5, 5.0, 50.0)
    for f, gain in [(0.5, 2**-0.5), (5.0, 2**-0.5), (1.6, 1.0)]:
        z = np.exp(1j * 2 * np.pi * f / 50)
        h = flt.gain * np.prod(z - np.array(flt.zeros)) / np.prod(z - np.array(flt.poles))
        assert abs(abs(h) - gain) < 1e-3


def test_zero_phase_keeps_band_and_blocks_rest():
    t = np.arange(1000) / 50
    flt = filters.butterworth(4, 0.5, 5.0, 50.0)
    inside, outside = np.sin(2 * np.pi * 1.2 * t), np.sin(2 * np.pi * 12 * t)
    y = filters.zero_phase(flt, np.stack([inside, outside]))
    mid = slice(200, 800)
    assert np.max(np.abs(y[0, mid] - inside[mid])) < 0.02
    assert np.max(np.abs(y[1, mid])) < 0.01
    assert np.isnan(filters.zero_phase(flt, np.ones((1, 20)))).all()


def test_adaptive_zero_reference_is_identity_and_map_composes():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(2, 300))
    refs = filters.tap_rows(rng.normal(size=300), 4, False)
    gain = np.full(300, 0.02)
    e, w = filters.adaptive(p, np.zeros((300, 4)), gain)
    assert np.array_equal(e, p)
    _, full = filters.adaptive(p, refs, gain)
    _, first = filters.adaptive(p[:, :150], refs[:150], gain[:150])
    _, second = filters.adaptive(p[:, 150:], refs[150:], gain[150:])
    joined = first @ filters.adaptive_map(refs[150:], gain[150:]).T + second
    assert np.max(np.abs(joined - full)) < 1e-12


def test_tap_rows():
    assert filters.tap_rows(np.array([1.0, 2, 3]), 2, True).tolist() == [[1, 0], [2, 1], [3, 2]]
    assert filters.tap_rows(np.array([1.0, 2, 3]), 2, False).tolist() == [[0, 0], [1, 0], [2, 1]]


def test_psd_sums_to_variance():
    x = np.random.default_rng(3).normal(size=(3, 256))
    f, p = spectral.welch_psd(x, 50.0)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    y = (x - x.mean(axis=1, keepdims=True)) * taper
    assert np.allclose(p.sum(axis=1) * f[1], (y**2).sum(axis=1) / (taper**2).sum())


def test_quality_and_rate_of_a_pure_pulse():
    t = np.arange(500) / 50
    x = np.sin(2 * np.pi * 1.2 * t)[None]
    assert spectral.quality_index(x, 50.0)[0] > 0.98
    assert abs(spectral.heart_rate(x, 50.0)[0] - 72) < 1.0
    assert spectral.pulse_consistency(x, 50.0)[0] > 0.99
    assert spectral.quality_index(np.ones((1, 100)), 50.0)[0] == 0
    assert spectral.quality_index(x[:, :31], 50.0)[0] == 0
    assert np.isnan(spectral.heart_rate(np.ones((1, 100)), 50.0)[0])


def test_peaks_keep_the_higher_of_close_pairs():
    x = np.array([0, 1, 0, 3, 0, 0, 0, 2, 2, 0.0])
    assert spectral.find_pulse_peaks(x, 3).tolist() == [3, 7]
    assert spectral.find_pulse_peaks(x, 1).tolist() == [1, 3, 7]
