"""Kernels against properties of signals and direct recurrences."""

import numpy as np
import pytest

from voltaflow.functions import kernels as K

FS = 1000.0
T = np.arange(4000) / FS


def direct(b, a, x):
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = (sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)) / a[0]
    return y


def test_lfilter_is_the_recurrence():
    x = np.random.default_rng(0).normal(size=500)
    b, a = K.to_ba(*K.design(4, (60, 140), FS, "bandpass"))
    assert np.allclose(K.lfilter(b, a, x)[0], direct(b, a, x))
    sos = K.to_sos(*K.design(4, (60, 140), FS, "bandpass"))
    assert np.allclose(K.sosfilt(sos, x), direct(b, a, x), atol=1e-8)


@pytest.mark.parametrize("kind", ["butter", "cheby2"])
def test_gains(kind):
    for order in (3, 4, 6):
        z, p, k = K.design(order, 100, FS, "lowpass", kind, 40)
        b, a = K.to_ba(z, p, k)
        assert np.all(np.abs(p) < 1)
        assert abs(abs(K.response(b, a, 0.0, FS)) - 1) < 1e-6
        assert abs(K.response(b, a, 300.0, FS)) < 0.02
        edge = abs(K.response(b, a, 100.0, FS))
        assert abs(edge - (2**-0.5 if kind == "butter" else 0.01)) < 1e-6
        hb, ha = K.to_ba(*K.design(order, 100, FS, "highpass", kind, 40))
        assert abs(K.response(hb, ha, 0.0, FS)) < 0.011 and abs(abs(K.response(hb, ha, 499.0, FS)) - 1) < 1e-3


def test_zero_phase_and_passband():
    x = np.zeros(2001)
    x[1000] = 1
    b, a = K.to_ba(*K.design(4, (60, 140), FS, "bandpass"))
    y = K.filtfilt(b, a, x)
    assert np.allclose(y, y[::-1], atol=1e-9)
    tone = np.sin(2 * np.pi * 100 * T)
    assert np.allclose(K.filtfilt(b, a, tone)[500:-500], tone[500:-500], atol=2e-3)
    sos = K.to_sos(*K.design(4, (60, 140), FS, "bandpass"))
    assert np.allclose(K.sosfiltfilt(sos, tone)[500:-500], tone[500:-500], atol=2e-3)


def test_notch_and_hum():
    b, a = K.notch(50, FS)
    assert abs(K.response(b, a, 50.0, FS)) < 1e-9 and abs(abs(K.response(b, a, 10.0, FS)) - 1) < 1e-3
    b, a = K.hum_filter(60, FS)
    assert abs(K.response(b, a, 60.0, FS)) < 1e-9 and abs(abs(K.response(b, a, 0.0, FS)) - 1) < 1e-9


def test_envelope_of_a_modulated_tone():
    slow = 1 + 0.5 * np.sin(2 * np.pi * 2 * T)
    e = K.envelope(slow * np.sin(2 * np.pi * 100 * T))
    assert np.allclose(e[100:-100], slow[100:-100], atol=1e-2)


def test_resample_keeps_a_sine():
    x = np.sin(2 * np.pi * 20 * T)
    y = K.resample_to(x, FS, 400.0)
    t = np.arange(len(y)) / 400
    assert len(y) == 1600 and np.allclose(y[100:-100], np.sin(2 * np.pi * 20 * t)[100:-100], atol=5e-3)
    assert np.allclose(K.resample(x, 3, 3), x)


def test_spectra_find_tones():
    x = np.sin(2 * np.pi * 125 * T)
    f, p = K.welch(x, FS, 512)
    assert f[p.argmax()] == 125
    f, t, s = K.stft_power(x, FS, 256)
    assert abs(f[s.mean(1).argmax()] - 125) < 4
    assert abs(s.mean(1).sum() * (f[1] - f[0]) - 0.5) < 0.02  # power of a unit sine
    freqs = 100 / 2 ** (np.arange(70) / 40)
    m = np.abs(K.morse(np.sin(2 * np.pi * freqs[30] * T), FS, freqs)).mean(1)
    assert m.argmax() == 30


def test_peaks_and_prominences():
    x = np.array([0, 2, 1, 3, 3, 3, 0, 1, 0.5])
    assert K.find_peaks(x).tolist() == [1, 4, 7]
    assert K.prominences(x, K.find_peaks(x)).tolist() == [1, 3, 0.5]


@pytest.mark.parametrize("n", [4, 7, 600])
def test_spline_reproduces_cubics(n):
    x = np.sort(np.random.default_rng(1).uniform(0, 10, n))
    y = x**3 - 2 * x**2 + x - 3
    at = np.linspace(x[0], x[-1], 300)
    assert np.allclose(K.spline(x, y, at), at**3 - 2 * at**2 + at - 3, atol=1e-5)
    assert K.spline(x, y, np.array([-5.0]))[0] == pytest.approx(y[0])


def test_detectors_find_a_burst():
    rng = np.random.default_rng(2)
    x = rng.normal(size=20000)
    x[9000:9060] += 12 * np.sin(2 * np.pi * 150 * np.arange(60) / FS) * np.hanning(60)
    y = K.sosfiltfilt(K.band_sos(80, 300, FS), x)
    for find in (K.short_term_energy, K.hilbert_detector):
        found = find(y, FS)
        assert any(a < 9060 and b > 9000 for a, b in found), find
    spike = rng.normal(size=30000)
    spike[15000:15030] += 60 * np.hanning(30)
    at = K.spike_detector(spike, FS)
    assert np.abs(at - 15015).min() < 30


def test_morse_is_its_definition():
    """By sums over all frequencies, with powers instead of logarithms."""
    fs, n = 500.0, 400
    x = np.random.default_rng(0).normal(size=n)
    k = np.arange(n)
    omega = 2 * np.pi * np.where(k < n / 2, k, k - n) / n
    for f in (30.5, 47.0, 100.0):
        scale = (20 / 3) ** (1 / 3) * fs / (2 * np.pi * f)
        w = np.where(omega > 0, np.abs(scale * omega) ** 20 * np.exp(-np.abs(scale * omega) ** 3), 0)
        w *= np.sqrt(scale) * f * K.MORSE_GAIN * np.sqrt(K.MORSE_RATE / fs) / np.sqrt((w**2).sum())
        spectrum = np.array([(x * np.exp(-2j * np.pi * j * k / n)).sum() for j in range(n)])
        want = np.array([(spectrum * w * np.exp(2j * np.pi * k * t / n)).sum() / n for t in range(0, n, 37)])
        assert np.allclose(K.morse(x, fs, np.array([f]))[0][::37], want)


def shaped(fs=1000.0, n=1000, at=500, height=100.0):
    """A spike of that height at `at`, troughs 20 ms before and 25 ms behind it, a slow wave's top 60 ms behind it."""
    x = np.zeros(n)
    t = np.arange(n)
    points = [(0, 0), (at - 60, 5), (at - 20, -30), (at, 100), (at + 25, -40), (at + 60, 30), (at + 120, -5), (n - 1, 0)]
    return np.interp(t, *zip(*points)) * height / 100 + x


def test_spike_boundary_by_hand():
    x = shaped()
    # troughs at 480 and 525 are 45 ms apart: P1 = 480. Behind P2 the next top is at 560, 35 samples behind P2, so N2 = 500 + 35.
    assert K.spike_boundary(x, 1000.0, 503) == (480, 500, 535)
    assert K.spike_boundary(-x, 1000.0, 503) == (480, 500, 535)
    assert K.spike_boundary(np.zeros(1000), 1000.0, 500) is None
    assert K.spike_boundary(np.arange(300.0), 1000.0, 150) is None
    near = x.copy()
    near[492:494] = -20  # a trough 7 ms before the peak of 20 and more in prominence: levels jump until it is too shallow
    assert K.spike_boundary(near, 1000.0, 500)[0] in (480, 492)


def test_gamma_measure_by_hand():
    fs, n = 500.0, 1000
    t = np.arange(n) / fs
    rng = np.random.default_rng(3)
    x = 0.2 * rng.normal(size=n)
    x[380:460] += 5 * np.sin(2 * np.pi * 60 * t[380:460])
    power, freq, ms = K.gamma_measure(x, fs, 480, 520)
    assert 50 < freq < 70 and power > 0 and 50 < ms < 400
    # the same by plain loops
    freqs = [100 / 2 ** (k / 40) for k in range(70)]
    mag = np.abs(K.morse(x[:-1], fs, np.array(freqs)))
    base = [i for i in range(n - 1) if 480 - 249 <= i < 480 or 520 < i <= 770]
    best = (0.0, 0.0, 0.0)
    for k, f in enumerate(freqs):
        limit = np.mean(mag[k, base]) + 2 * np.std(mag[k, base], ddof=1)
        i = 480 - 249
        while i < 480:
            j = i
            while j < 480 and mag[k, j] > limit:
                j += 1
            if j - i >= 3 * np.ceil(fs / f) and 480 - j <= 0.19 * fs:
                value = np.mean([mag[k, m + 1] for m in range(i, j)])
                if value > best[0]:
                    best = (value, f, 1000 * (j - i) / fs)
            i = max(j, i + 1)
    assert np.allclose((power, freq, ms), best)
    assert np.isnan(K.gamma_measure(x[:100], fs, 20, 40)).all()


def test_detector_chain():
    # published orders of these edges: analogue ratios 1.426 and 1.955
    assert K.cheby2_order(0.6, 0.7) == int(np.ceil(np.arccosh(np.sqrt((1e6 - 1) / (10**0.6 - 1))) / np.arccosh(np.tan(0.35 * np.pi) / np.tan(0.3 * np.pi))))
    fs, n = 200.0, 4000
    t = np.arange(n) / fs
    for f, keep in ((30, True), (2, False), (90, False)):
        y = K.detector_band(np.sin(2 * np.pi * f * t), fs)[500:-500]
        assert (np.abs(y).max() > 0.7) if keep else (np.abs(y).max() < 0.01)
        f = 130 if f == 90 else f
        y = K.detector_band(np.sin(2 * np.pi * f * np.arange(8000) / 1000), 1000.0, chebyshev=False)[2000:-2000]
        assert (np.abs(y).max() > 0.7) if keep else (np.abs(y).max() < 0.05)
    assert np.abs(K.hum_free(np.sin(2 * np.pi * 50 * t), fs))[500:-500].max() < 0.02
    x = np.sin(2 * np.pi * 20 * np.arange(20_000) / 2500.0)
    y = K.detector_rate(x, 2500.0)
    assert len(y) == 1600 and np.abs(y - np.sin(2 * np.pi * 20 * np.arange(1600) / 200.0))[200:-200].max() < 0.01
    sos = K.prefilter(80, 200, 1000.0)
    z = np.exp(-2j * np.pi * np.array([70, 79.4, 100, 150, 199, 201, 250]) / 1000)
    gain = np.abs(np.prod([np.polynomial.polynomial.polyval(z, r[:3]) / np.polynomial.polynomial.polyval(z, r[3:]) for r in sos], 0))
    assert (gain[[0, 1, 5, 6]] < 10**-4.5).all() and (gain[2:5] > 0.9).all()


def test_peaks_of_runs_on_arrays():
    x = np.array([5, 4, 3, 2, 1, 0, 1, 3, 3, 1, 0, 2, 7, 7, 0.0])
    assert K.run_maxima(x, x > 0).tolist() == [0, 7, 8, 12]
    v = np.zeros(40)
    v[[0, 2, 4, 6, 8, 30]] = 5, 7, 6, 8, 8, 1
    assert K.polyspikes(v, np.array([0, 2, 4, 6, 8, 30]), 3).tolist() == [2, 8, 30]
