"""Signal kernels in NumPy: filters, envelopes, resampling, spectra, wavelets, peaks, splines (DSP01-DSP24)."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import ceil, floor, gcd, log10, pi

import numpy as np

# ---- filter design -------------------------------------------------------------------------------


def _prototype(kind: str, order: int, attenuation: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Analogue low-pass with edge 1: zeros, poles, gain."""
    m = np.arange(-order + 1, order, 2)
    if kind == "butter":
        return np.empty(0, complex), -np.exp(1j * pi * m / (2 * order)), 1.0
    d = 1 / np.sqrt(10 ** (0.1 * attenuation) - 1)
    mu = np.arcsinh(1 / d) / order
    zeros = -np.conj(1j / np.sin(np.concatenate([m[m < 0], m[m > 0]]) * pi / (2 * order)))
    poles = -np.exp(1j * pi * m / (2 * order))
    poles = 1 / (np.sinh(mu) * poles.real + 1j * np.cosh(mu) * poles.imag)
    return zeros, poles, float((np.prod(-poles) / np.prod(-zeros)).real)


def design(order: int, edges, fs: float, btype: str = "lowpass", kind: str = "butter", attenuation: float = 40.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Digital zeros, poles, gain by the bilinear transform with prewarped edges."""
    z, p, k = _prototype(kind, order, attenuation)
    warped = 4 * np.tan(pi * np.atleast_1d(np.asarray(edges, float)) / fs)
    degree = len(p) - len(z)
    if btype == "lowpass":
        w = warped[0]
        z, p, k = z * w, p * w, k * w**degree
    elif btype == "highpass":
        w = warped[0]
        k = k * float((np.prod(-z) / np.prod(-p)).real)
        z, p = np.concatenate([w / z, np.zeros(degree)]), w / p
    else:
        w0, bw = np.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
        k = k * bw**degree

        def split(r):
            half = r * bw / 2
            root = np.sqrt(half.astype(complex) ** 2 - w0**2)
            return np.concatenate([half + root, half - root])

        z, p = np.concatenate([split(z), np.zeros(degree)]), split(p)
    fs2 = 4.0
    k = k * float((np.prod(fs2 - z) / np.prod(fs2 - p)).real)
    zd = np.concatenate([(fs2 + z) / (fs2 - z), -np.ones(len(p) - len(z))])
    return zd, (fs2 + p) / (fs2 - p), k


def to_ba(z, p, k) -> tuple[np.ndarray, np.ndarray]:
    return np.real(k * np.poly(z)), np.real(np.poly(p))


def to_sos(z, p, k) -> np.ndarray:
    """Second-order sections: conjugate poles together, each with the nearest zeros, the slowest pair last."""
    z, p = list(np.asarray(z, complex)), list(np.asarray(p, complex))
    if len(p) % 2:
        p.append(0j)
    z += [0j] * (len(p) - len(z))
    out = []

    def pull(pool, target):
        i = min(range(len(pool)), key=lambda j: abs(pool[j] - target))
        return pool.pop(i)

    while p:
        i = min(range(len(p)), key=lambda j: 1 - abs(p[j]))
        a = p.pop(i)
        real = [j for j, v in enumerate(p) if abs(v.imag) < 1e-12]
        b = pull(p, a.conjugate()) if abs(a.imag) > 1e-12 else p.pop(min(real, key=lambda j: 1 - abs(p[j])))
        za = pull(z, a)
        if abs(za.imag) > 1e-12:
            zb = pull(z, za.conjugate())
        else:
            reals = [v for v in z if abs(v.imag) <= 1e-12]
            zb = min(reals, key=lambda v: abs(v - b)) if reals else z[0]
            z.remove(zb)
        out.append(np.concatenate([np.real(np.poly([za, zb])), np.real(np.poly([a, b]))]))
    sos = np.array(out[::-1])
    sos[0, :3] *= k
    return sos


def notch(f0: float, fs: float, quality: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    w0 = 2 * pi * f0 / fs
    gain = 1 / (1 + np.tan(w0 / quality / 2))
    b = gain * np.array([1, -2 * np.cos(w0), 1])
    return b, np.array([1, -2 * gain * np.cos(w0), 2 * gain - 1])


def hum_filter(hz: float, fs: float, radius: float = 0.985) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * pi * hz / fs
    b, a = np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * radius * np.cos(w), radius**2])
    return b * (a.sum() / b.sum()), a


def response(b, a, freq, fs: float) -> np.ndarray:
    z = np.exp(-2j * pi * np.asarray(freq) / fs)
    return np.polynomial.polynomial.polyval(z, b) / np.polynomial.polynomial.polyval(z, a)


# ---- filtering -----------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _blocks(b: tuple, a: tuple, size: int):
    """Matrices that take a block of input and the state to a block of output and the next state."""
    n = max(len(a), len(b))
    b, a = np.pad(np.array(b), (0, n - len(b))) / a[0], np.pad(np.array(a), (0, n - len(a))) / a[0]
    m = n - 1
    step, drive = np.zeros((m, m)), b[1:] - a[1:] * b[0]
    step[:, 0] = -a[1:]
    step[np.arange(m - 1), np.arange(1, m)] = 1
    free, power, impulse, pushes = np.zeros((size, m)), np.eye(m), np.zeros(size), []
    for i in range(size):
        free[i] = power[0]
        impulse[i] = b[0] if i == 0 else pushes[i - 1][0]
        pushes.append(power @ drive)
        power = step @ power
    i = np.arange(size)
    forced = np.where(i[:, None] >= i, impulse[np.abs(i[:, None] - i)], 0)
    return free, forced, power, np.array(pushes[::-1]).T


def lfilter(b, a, x: np.ndarray, zi: np.ndarray | None = None, size: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Direct form II transposed along the last axis, a block of samples at a time."""
    x = np.asarray(x, float)
    m = max(len(a), len(b)) - 1
    flat, out = x.reshape(-1, x.shape[-1]), np.empty((int(np.prod(x.shape[:-1])), x.shape[-1]))
    state = np.zeros((len(flat), m)) if zi is None else np.broadcast_to(zi, (len(flat), m)).copy()
    if m == 0:
        return x * (b[0] / a[0]), state
    key = (tuple(map(float, b)), tuple(map(float, a)))
    for lo in range(0, x.shape[-1], size):
        part = flat[:, lo : lo + size]
        free, forced, power, push = _blocks(*key, part.shape[1])
        out[:, lo : lo + size] = part @ forced.T + state @ free.T
        state = state @ power.T + part @ push.T
    return out.reshape(x.shape), state


def steady_state(b, a) -> np.ndarray:
    """State of a filter that has seen a constant 1 for ever."""
    n = max(len(a), len(b))
    b, a = np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]
    step = np.zeros((n - 1, n - 1))
    step[:, 0] = -a[1:]
    step[np.arange(n - 2), np.arange(1, n - 1)] = 1
    return np.linalg.solve(np.eye(n - 1) - step, b[1:] - a[1:] * b[0])


def _odd_pad(x: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return x
    return np.concatenate([2 * x[..., :1] - x[..., n:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -n - 2 : -1]], -1)


def filtfilt(b, a, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Zero-phase filtering with odd extension of 3 * max(len) samples by default."""
    pad = 3 * max(len(a), len(b)) if pad is None else pad
    pad = min(pad, x.shape[-1] - 1)
    wide, zi = _odd_pad(np.asarray(x, float), pad), steady_state(b, a)
    y, _ = lfilter(b, a, wide, zi * wide.reshape(-1, wide.shape[-1])[:, :1])
    y = y[..., ::-1]
    y, _ = lfilter(b, a, y, zi * y.reshape(-1, y.shape[-1])[:, :1])
    return y[..., ::-1][..., pad : wide.shape[-1] - pad]


def sosfilt(sos: np.ndarray, x: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Sections one after the other; with scale, each starts in the steady state of that input level."""
    y, level = np.asarray(x, float), scale
    for s in sos:
        zi = None if level is None else steady_state(s[:3], s[3:]) * level
        y, _ = lfilter(s[:3], s[3:], y, zi)
        level = None if level is None else level * s[:3].sum() / s[3:].sum()
    return y


def sosfiltfilt(sos: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = min(3 * taps if pad is None else pad, x.shape[-1] - 1)
    y = _odd_pad(np.asarray(x, float), pad)
    for _ in range(2):
        y = sosfilt(sos, y, y.reshape(-1, y.shape[-1])[:, :1])[..., ::-1]
    return y[..., pad : y.shape[-1] - pad]


def forward_reverse(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward, then reverse filtering from rest, without padding (DSP12)."""
    return sosfilt(sos, sosfilt(sos, x)[..., ::-1])[..., ::-1]


def reach(denominators, digits: float = 26.0) -> int:
    """Samples after which nothing is left of a recursive filter's start, in so many decimal digits, forward and in reverse."""
    radius = max(np.abs(np.roots(a)).max(initial=0.0) for a in denominators)
    return 64 + (ceil(digits * np.log(10) / -np.log(radius)) if radius > 0 else 0)


# ---- envelope, resampling, spectra ---------------------------------------------------------------


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(x))


#: Places of a block at which what comes from afar is known; 20 give all digits of a double.
NODES = 20


@lru_cache(maxsize=4)
def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev places in a block, and at each of its samples the polynomials that are 1 at one of them."""
    at, k = pi * (2 * np.arange(NODES) + 1) / (2 * NODES), np.arange(NODES)
    angle = np.arccos((2 * np.arange(size) + 1) / size - 1)
    return (np.cos(at) + 1) / 2 * size - 0.5, (np.cos(np.outer(angle, k)) * np.where(k, 2, 1) / NODES) @ np.cos(np.outer(k, at))


def _hilbert(d: np.ndarray, odd: bool, n: int) -> np.ndarray:
    """Share of a sample in the imaginary part of `analytic` d samples later, of n samples; d has the parity told, or lies between such ones."""
    if n % 2 == 0:
        return 2 / (n * np.tan(pi * d / n)) if odd else np.zeros(d.shape)
    return 1 / (n * np.tan(pi * d / (2 * n))) if odd else -np.tan(pi * d / (2 * n)) / n


def block_sums(x: np.ndarray, size: int) -> np.ndarray:
    """A block's samples as weights of its places, those of even samples first; block sizes are even."""
    base = _places(size)[1][: len(x)]
    return np.concatenate([x[p::2] @ base[p::2] for p in (0, 1)])


def is_near(i: int, j: int, count: int) -> bool:
    """Blocks that touch, or have at most one between them over the ends of the channel (the last block may be short)."""
    return abs(i - j) <= 1 or count - abs(i - j) <= 2


def far_field(sums: np.ndarray, n: int, size: int) -> np.ndarray:
    """What all blocks that aren't near add to the imaginary part at each block's places, for even samples, then for odd ones.

    Between blocks that lie apart the kernel is smooth, so their places stand for all samples (anterpolation, interpolation).
    """
    at, count, out = _places(size)[0], len(sums), np.zeros(sums.shape)
    gap, halves = at[:, None] - at, (slice(0, NODES), slice(NODES, 2 * NODES))
    for step in range(1 - count, count):
        if is_near(step, 0, count):
            continue
        source, target = sums[max(0, -step) : count - max(0, step)], out[max(0, step) : count + min(0, step)]
        odd, even = (_hilbert(step * size + gap, o, n).T for o in (True, False))
        for own, other in (halves, halves[::-1]):
            target[:, own] += source[:, other] @ odd
            if n % 2:
                target[:, own] += source[:, own] @ even
    return out


def from_far(field: np.ndarray, length: int, size: int) -> np.ndarray:
    """A block's samples of what is known at its places."""
    base, out = _places(size)[1][:length], np.empty(length)
    for p in (0, 1):
        out[p::2] = base[p::2] @ field[p * NODES : (p + 1) * NODES]
    return out


def near_field(blocks: dict[int, np.ndarray], i: int, n: int, size: int) -> np.ndarray:
    """What the blocks given, itself among them, add to the imaginary part of block i."""
    total = np.zeros(size + 1, complex)
    for j, x in blocks.items():
        d = (i - j) * size + np.arange(1 - size, size)
        odd, kernel = d % 2 != 0, np.zeros(len(d))
        kernel[odd] = _hilbert(d[odd], True, n)
        if n % 2:
            kernel[~odd] = _hilbert(d[~odd], False, n)
        total += np.fft.rfft(kernel, 2 * size) * np.fft.rfft(x, 2 * size)
    return np.fft.irfft(total, 2 * size)[size - 1 :][: len(blocks[i])]


def firwin(taps: int, cutoff: float, beta: float = 5.0) -> np.ndarray:
    """Low-pass FIR by a Kaiser window; cutoff as a share of the Nyquist rate."""
    m = np.arange(taps) - (taps - 1) / 2
    h = cutoff * np.sinc(cutoff * m) * np.kaiser(taps, beta)
    return h / h.sum()


def resample(x: np.ndarray, up: int, down: int, half: int = 10) -> np.ndarray:
    """Polyphase resampling by up / down with a Kaiser low-pass; output n is at time n * down / up."""
    g = gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return np.array(x, float)
    reach = half * max(up, down)
    h = up * firwin(2 * reach + 1, 1 / max(up, down))
    n = x.shape[-1]
    size, count = -(-n * up // down), -(-len(h) // up)
    wide = np.concatenate([np.zeros(count - 1), x, np.zeros(reach // up + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(wide, count)  # the last sample of window i is sample i
    out = np.zeros(size)
    for k in range(min(up, size)):  # outputs k, k + up, ... meet the same taps, windows of `down` samples apart
        at = k * down + reach
        taps = np.pad(h[at % up :: up], (0, count))[count - 1 :: -1]
        out[k::up] = windows[at // up :: down][: len(out[k::up])] @ taps
    return out


def resample_to(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    ratio = Fraction(target / fs).limit_denominator(1000)
    return resample(x, ratio.numerator, ratio.denominator)


def welch(x: np.ndarray, fs: float, nperseg: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Mean periodogram: half overlap, symmetric Hann, mean removed, one-sided bins not doubled (DSP13)."""
    n = min(nperseg, len(x))
    w = np.hanning(n) if n > 1 else np.ones(1)
    starts = range(0, len(x) - n + 1, max(1, n - n // 2))
    power = [np.abs(np.fft.rfft((x[s : s + n] - x[s : s + n].mean()) * w)) ** 2 for s in starts]
    return np.fft.rfftfreq(n, 1 / fs), np.mean(power, 0) / (fs * (w**2).sum())


def stft_power(x: np.ndarray, fs: float, nperseg: int | None = None, hop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Density spectrogram: periodic Hann, mean removed, bins doubled but for the ends (DSP14)."""
    n = nperseg or min(max(64, len(x) // 8), 1024, len(x))
    hop = hop or max(1, n - n // 2)
    w = 0.5 - 0.5 * np.cos(2 * pi * np.arange(n) / n)
    starts = np.arange(0, len(x) - n + 1, hop)
    frames = np.stack([x[s : s + n] for s in starts])
    p = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w**2).sum())
    p[:, 1 : (-1 if n % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(n, 1 / fs), (starts + n / 2) / fs, p.T


#: Gain of the wavelets for each Hz of their frequency at the reference sampling rate.
MORSE_GAIN, MORSE_RATE = 0.055219397200513345, 2000.0


def _morse_gain(n: int, fs: float, f: float, gamma: float, bandwidth: float) -> np.ndarray:
    """A wavelet's gains at the positive frequencies of n samples."""
    omega = 2 * pi * np.fft.fftfreq(n)[1 : (n + 1) // 2]
    beta = bandwidth / gamma
    scale = (beta / gamma) ** (1 / gamma) * fs / (2 * pi * f)
    shape = np.exp(beta * np.log(scale * omega) - (scale * omega) ** gamma)
    energy = np.sqrt((shape**2).sum())
    return shape * (np.sqrt(scale * MORSE_RATE / fs) * f * MORSE_GAIN / (energy or 1.0))


def morse(x: np.ndarray, fs: float, freqs: np.ndarray, gamma: float = 3.0, bandwidth: float = 60.0) -> np.ndarray:
    """Generalised Morse wavelet transform by FFT (DSP21): unit-energy spectra, times sqrt(scale), frequency and a fixed gain."""
    n = len(x)
    spectrum = np.fft.fft(x)[1 : (n + 1) // 2]
    out = np.empty((len(freqs), n), complex)
    for i, f in enumerate(freqs):
        h = np.zeros(n, complex)
        h[1 : (n + 1) // 2] = spectrum * _morse_gain(n, fs, f, gamma, bandwidth)
        out[i] = np.fft.ifft(h)
    return out


def morse_power(x: np.ndarray, fs: float, freqs: np.ndarray, gamma: float = 3.0, bandwidth: float = 60.0) -> np.ndarray:
    """Mean squared magnitude of the transform at each frequency, by Parseval's theorem: the spectrum's energy, without going back."""
    n = len(x)
    energy = np.abs(np.fft.rfft(x)[1 : (n + 1) // 2]) ** 2
    return np.array([(energy * _morse_gain(n, fs, f, gamma, bandwidth) ** 2).sum() for f in freqs]) / n**2


# ---- peaks and splines ---------------------------------------------------------------------------


def find_peaks(x: np.ndarray) -> np.ndarray:
    """Strict local maxima; the middle of flat tops (rounded down)."""
    first, last = tops(np.asarray(x))
    return (first + last) // 2


def tops(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last samples of the strict local maxima."""
    starts = np.flatnonzero(x[1:] != x[:-1]) + 1  # of the stretches of equal values behind the first
    first, behind = starts[:-1], starts[1:]
    top = (x[first - 1] < x[first]) & (x[behind] < x[first])
    return first[top], behind[top] - 1


def prominences(x: np.ndarray, peaks: np.ndarray, size: int = 1 << 16) -> np.ndarray:
    """Height of peaks over the higher of the two lowest points towards higher ground; compared in blocks of about `size` values."""
    out, at = np.empty(len(peaks)), np.arange(len(x))
    step = max(1, size // max(1, len(x)))
    for k in range(0, len(peaks), step):
        p = peaks[k : k + step, None]
        higher = x > x[p]
        a = np.where(higher & (at < p), at, -1).max(1, keepdims=True)
        b = np.where(higher & (at > p), at, len(x)).min(1, keepdims=True)
        left = np.where((at > a) & (at <= p), x, np.inf).min(1)
        right = np.where((at >= p) & (at < b), x, np.inf).min(1)
        out[k : k + step] = x[p[:, 0]] - np.where(right > left, right, left)
    return out


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic, not-a-knot, from four points on, else linear; held outside."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    inside = np.clip(at, x[0], x[-1])
    n = len(x)
    if n < 4:
        return np.interp(inside, x, y) if n > 1 else np.full(len(at), y[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m, r = np.zeros((n, n)) if n < 512 else None, np.zeros(n)
    r[1:-1] = 6 * np.diff(d)
    if m is not None:
        i = np.arange(1, n - 1)
        m[i, i - 1], m[i, i], m[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
        m[0, :3] = h[1], -(h[0] + h[1]), h[0]
        m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        c = np.linalg.solve(m, r)
    else:  # eliminate the end values, then one tridiagonal sweep
        lo, di, up, rr = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), r[1:-1].copy()
        di[0] += h[0] * (h[0] + h[1]) / h[1]
        up[0] -= h[0] ** 2 / h[1]
        di[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
        lo[-1] -= h[-1] ** 2 / h[-2]
        for k in range(1, n - 2):
            f = lo[k] / di[k - 1]
            di[k] -= f * up[k - 1]
            rr[k] -= f * rr[k - 1]
        c = np.zeros(n)
        for k in range(n - 3, -1, -1):
            c[k + 1] = (rr[k] - (up[k] * c[k + 2] if k < n - 3 else 0)) / di[k]
        c[0] = ((h[0] + h[1]) * c[1] - h[0] * c[2]) / h[1]
        c[-1] = ((h[-1] + h[-2]) * c[-2] - h[-1] * c[-3]) / h[-2]
    k = np.clip(np.searchsorted(x, inside, "right") - 1, 0, n - 2)
    t = inside - x[k]
    b = d[k] - h[k] * (2 * c[k] + c[k + 1]) / 6
    return y[k] + t * (b + t * (c[k] / 2 + t * (c[k + 1] - c[k]) / (6 * h[k])))


def runs(mask: np.ndarray) -> np.ndarray:
    """Start and stop (exclusive) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.r_[0, np.asarray(mask, int), 0]))
    return edge.reshape(-1, 2)


# ---- detectors -----------------------------------------------------------------------------------


def band_sos(low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    return to_sos(*design(order, (low, min(high, 0.95 * fs / 2)), fs, "bandpass"))


def merge_runs(found: np.ndarray, gap: int) -> np.ndarray:
    out: list[list[int]] = []
    for a, b in found.tolist():
        if out and a - out[-1][1] < gap:
            out[-1][1] = b
        else:
            out.append([a, b])
    return np.array(out, int).reshape(-1, 2)


def moving_rms(x: np.ndarray, fs: float, rms_s: float = 0.003, least: int = 1) -> np.ndarray:
    """Root mean square of a window around each sample; beyond the ends there are zeros (windows of two or more begin there at the first sample)."""
    w = max(least, round(rms_s * fs))
    total = np.cumsum(np.r_[0, x**2])
    lo = np.arange(len(x)) - w // 2
    hi = np.clip((lo if least == 1 else np.clip(lo, 0, None)) + w, None, len(x))
    return np.sqrt((total[hi] - total[np.clip(lo, 0, None)]) / w)


def quiet_windows(fs: float, base_s: float = 0.125) -> tuple[int, int]:
    """Length and step of the windows in which a baseline is looked for."""
    size = max(16, round(base_s * fs))
    return size, max(1, size // 2)


def quiet(x: np.ndarray, fs: float, base_s: float = 0.125, base_share: float = 0.67) -> np.ndarray:
    """Whether each sample is in a window of high wavelet entropy."""
    size, step = quiet_windows(fs, base_s)
    out = np.zeros(len(x), bool)
    for s in range(0, len(x) - size + 1, step):
        part = x[s : s + size]
        power = np.abs(np.fft.rfft(np.correlate(part, part, "full"))) ** 2
        p = power / power.sum() if power.sum() > 0 else np.full(len(power), 1 / len(power))
        entropy = -(p[p > 0] * np.log(p[p > 0])).sum() / np.log(len(p))
        if entropy > base_share * 0.9:
            out[s : s + size] = True
    return out


def short_term_energy(x: np.ndarray, fs: float, rms_s: float = 0.003, min_s: float = 0.006, gap_s: float = 0.010, oscillations: int = 6, rms_sd: float = 5.0, peak_sd: float = 3.0) -> np.ndarray:
    """Staba 2002: runs of moving RMS above mean + rms_sd sd, joined over short gaps, with enough rectified peaks above mean + peak_sd sd."""
    rms = moving_rms(x, fs, rms_s)
    found = runs(rms > rms.mean() + rms_sd * rms.std(ddof=1))
    found = found[found[:, 1] - found[:, 0] >= min_s * fs]
    found = merge_runs(found, round(gap_s * fs))
    rect = np.abs(x)
    limit = rect.mean() + peak_sd * rect.std(ddof=1)
    keep = [(rect[a:b][find_peaks(rect[a:b])] > limit).sum() >= oscillations for a, b in found]
    return found[np.array(keep, bool)] if len(found) else found


def hilbert_detector(x: np.ndarray, fs: float, sd: float = 5.0, min_s: float = 0.010) -> np.ndarray:
    """Crepon 2010: runs of the envelope above mean + sd deviations of at least min_s."""
    e = envelope(x)
    found = runs(e > e.mean() + sd * e.std(ddof=1))
    return found[found[:, 1] - found[:, 0] >= min_s * fs]


def mni_detector(x: np.ndarray, fs: float, percentile: float = 0.999999, base_s: float = 0.125, base_share: float = 0.67, base_min: float = 5.0, chf: float = 0.95, min_s: float = 0.010, gap_s: float = 0.010) -> np.ndarray:
    """Zelmann 2010: baseline segments of high wavelet entropy set the threshold of the RMS; without enough of them, a percentile of all."""
    rms, calm = moving_rms(x, fs, 0.002, 2), quiet(x, fs, base_s, base_share)
    enough = calm.sum() >= base_min / 60 * len(x)
    limit = np.quantile(rms[calm], percentile) if enough else np.quantile(rms, chf)
    found = merge_runs(runs(rms > limit), round(gap_s * fs))
    return found[found[:, 1] - found[:, 0] >= min_s * fs] if len(found) else found


def cheby2_order(passed: float, stopped: float, ripple: float = 6.0, attenuation: float = 60.0) -> int:
    """Least order of a Chebyshev II filter that loses at most `ripple` dB at one edge and `attenuation` dB at the other (shares of Nyquist)."""
    ratio = np.tan(pi * max(passed, stopped) / 2) / np.tan(pi * min(passed, stopped) / 2)
    return ceil(np.arccosh(np.sqrt((10 ** (attenuation / 10) - 1) / (10 ** (ripple / 10) - 1))) / np.arccosh(ratio))


def butter_order(passed: float, stopped: float, ripple: float = 6.0, attenuation: float = 60.0) -> tuple[int, float]:
    """The same for a Butterworth filter, and the -3 dB edge (share of Nyquist) that meets the ripple at the passed edge."""
    w = np.tan(pi * np.array([passed, stopped]) / 2)
    lose, stop = 10 ** (ripple / 10) - 1, 10 ** (attenuation / 10) - 1
    order = ceil(np.log10(stop / lose) / (2 * np.log10(max(w) / min(w))))
    shift = lose ** (-1 / (2 * order))
    edge = w[0] * shift if passed < stopped else w[0] / shift
    return order, float(2 * np.arctan(edge) / pi)


def prefilter(low: float, high: float, fs: float, transition: float = 0.5) -> np.ndarray:
    """DSP12: sections of a Chebyshev II band-pass, 0.5 dB at the band's edges and 93 dB a transition outside of them."""
    top = fs / 2 - 2 * transition
    passed = np.tan(pi * np.array([low, min(high, top)]) / fs)
    stopped = np.tan(pi * np.array([max(low - transition, 1e-3), min(high, top) + transition]) / fs)
    ratio = np.abs((stopped**2 - passed[0] * passed[1]) / (stopped * (passed[0] - passed[1]))).min()
    need = np.arccosh(np.sqrt((10**9.3 - 1) / (10**0.05 - 1)))
    order = ceil(need / np.arccosh(ratio))
    # the stop edges at which this order loses 0.5 dB exactly at the band's edges
    spread = np.cosh(need / order) * (passed[1] - passed[0]) / 2
    low_edge = np.sqrt(spread**2 + passed[0] * passed[1]) - spread
    edges = np.arctan([low_edge, passed[0] * passed[1] / low_edge]) * fs / pi
    return to_sos(*design(order, tuple(edges), fs, "bandpass", "cheby2", 93.0))


def detector_band(x: np.ndarray, fs: float, low: float = 10.0, high: float = 60.0, chebyshev: bool = True) -> np.ndarray:
    """DSP08: high-pass, then low-pass (none at Nyquist), zero phase, orders from 6 dB and 60 dB at edges 0.05 and 0.1 of Nyquist apart."""
    for b, a in detector_filters(fs, low, high, chebyshev):
        x = filtfilt(b, a, x, 3 * (max(len(a), len(b)) - 1))
    return x


@lru_cache(maxsize=16)
def detector_filters(fs: float, low: float, high: float, chebyshev: bool) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Coefficients of the filters of `detector_band`."""
    out = []
    for edge, wide, kind in ((2 * low / fs, -0.05, "highpass"), (2 * high / fs, 0.1, "lowpass")):
        if kind == "lowpass" and high >= fs / 2:
            continue
        if chebyshev:
            stopped = min(1 - 1e-9, edge + wide) if wide > 0 else max(1e-5, edge + wide)
            order, at = cheby2_order(edge, stopped), stopped
            out.append(to_ba(*design(order, at * fs / 2, fs, kind, "cheby2", 60.0)))
        else:
            order, at = butter_order(edge, min(1 - 1e-9, edge + wide) if wide > 0 else max(0.1, edge + wide))
            out.append(to_ba(*design(order, at * fs / 2, fs, kind)))
    return tuple(out)


def hum_free(x: np.ndarray, fs: float, hum: float = 50.0, high: float = 60.0) -> np.ndarray:
    """DSP07: all harmonics of the hum up to 1.1 times the band's upper edge and Nyquist."""
    for b, a in hum_filters(fs, hum, high):
        x = filtfilt(b, a, x, 3 * (len(a) - 1))
    return x


def hum_filters(fs: float, hum: float, high: float) -> list[tuple[np.ndarray, np.ndarray]]:
    return [hum_filter(k * hum, fs) for k in range(1, int((min(fs / 2, 1.1 * high) + 1e-9) // hum) + 1)]


def detector_rate(x: np.ndarray, fs: float, rate: float = 200.0) -> np.ndarray:
    """DSP09: to the detector's rate, in one stage for each decade of the ratio, by long Kaiser filters."""
    for exact in rate_stages(fs, rate):
        x = resample(x, exact.numerator, exact.denominator, half=STAGE_TAPS)
    return x


#: Half of a stage's taps, in samples of the lower rate.
STAGE_TAPS = 100


def rate_stages(fs: float, rate: float) -> list[Fraction]:
    """Ratios of the stages of `detector_rate`."""
    stages, out = max(1, ceil(np.log10(fs / rate))), []
    share = (fs / rate) ** (1 / stages)
    for i in range(stages if fs != rate else 0):
        to = rate if i == stages - 1 else float(round(fs / share))
        out.append(Fraction(to).limit_denominator(10**6) / Fraction(fs).limit_denominator(10**6))
        fs = to
    return out


def lognormal_windows(e: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, mean and deviation of the logarithms of their positive values (zeros where there are none)."""
    starts = np.arange(0, max(1, len(e) - size + 1), step)
    out = np.array([lognormal(e[s : s + size]) for s in starts])
    return starts, *smoothed(out.T, size, len(starts), len(e))


def lognormal(v: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of the logarithms of positive values (zeros where there are none)."""
    v = np.log(v[v > 0])
    return (v.mean(), v.std(ddof=1) if len(v) > 1 else 0.0) if len(v) else (0.0, 0.0)


def smoothed(v: np.ndarray, size: int, windows: int, n: int) -> np.ndarray:
    """Rows of values of windows, averaged forward and in reverse over the windows that share a sample, of all windows of n samples."""
    smooth = round(size * windows / max(1, n))
    return filtfilt(np.full(smooth, 1 / smooth), [1.0], v) if smooth > 1 and windows > 3 * smooth else v


def run_maxima(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """WIN07 on arrays: the greatest sample of runs of up to three, else where the slope's sign gets less (0 in front)."""
    out = []
    for a, b in runs(mask).tolist():
        if b - a > 3:
            slope = np.sign(np.diff(x[a:b]))
            out += (a + np.flatnonzero(slope < np.r_[0, slope[:-1]])).tolist()
        else:
            out.append(a + int(np.argmax(x[a:b])))
    return np.array(out, int)


def polyspikes(x: np.ndarray, peaks: np.ndarray, reach: int) -> np.ndarray:
    """WIN08 on arrays: of peaks in a chain of gaps up to reach, those no lower than the one before and higher than the one behind."""
    out: list[int] = []
    for group in np.split(peaks, np.flatnonzero(np.diff(peaks) > reach) + 1):
        v = np.r_[0, x[group], 0]
        out += (group if len(group) == 1 else group[(v[1:-1] >= v[:-2]) & (v[2:] < v[1:-1])]).tolist()
    return np.array(out, int)


def spike_times(x: np.ndarray, fs: float, low: float = 10.0, high: float = 60.0, hum: float = 50.0, k1: float = 3.65, win_s: float = 5.0, step_s: float = 1.0, union_s: float = 0.12, rate: float = 200.0) -> np.ndarray:
    """DSP19: seconds of the spikes of one channel (the first sample is one sample's length after 0).

    Resampled, freed of hum and band-passed; envelope; thresholds from lognormal windows, joined by a spline; maxima of
    the runs above them, polyspikes reduced, neighbours united, edges of a second and the recording's two seconds cleared.
    """
    y = detector_rate(np.asarray(x, float), fs, rate)
    if len(y) < 40 or not np.any(y):
        return np.empty(0)
    e = envelope(detector_band(hum_free(y, rate, hum, high), rate, low, high, rate == 200.0))
    size, step = round(win_s * rate), round(step_s * rate)
    starts, mu, sigma = lognormal_windows(e, min(size, len(e)), step)
    united = near_spikes(e, np.arange(len(e)), starts + round(size / 2), mu, sigma, k1, ceil(union_s * rate))
    found = np.array([a + int(np.argmax(e[a:b])) for a, b in runs(united)], int)
    edge = round(rate) if len(e) > 2 * round(rate) else 0
    found = found[(found >= edge) & (found < len(e) - max(edge, ceil(0.005 * rate + 1)))]
    seconds = (found + 1) / rate
    return seconds[(seconds > 2) & (seconds < len(x) / fs - 2)]


def near_spikes(e: np.ndarray, at: np.ndarray, knots: np.ndarray, mu: np.ndarray, sigma: np.ndarray, k1: float, union: int) -> np.ndarray:
    """Which samples of an envelope (at places `at`) are in a stretch of spikes: over the limit that goes through the knots."""
    mu, sigma = (spline(knots, v, at) if len(knots) > 1 else np.full(len(e), v[0]) for v in (mu, sigma))
    sigma = np.maximum(sigma, np.finfo(float).eps)
    limit = k1 * (np.exp(mu - sigma**2) + np.exp(mu))
    mark, reach = np.zeros(len(e)), np.ones(union | 1)
    mark[polyspikes(e, run_maxima(e, e > limit), union)] = 1
    return np.convolve(np.convolve(mark, reach, "same") < 0.5, reach, "same") < 0.5


def spike_detector(x: np.ndarray, fs: float, **settings) -> np.ndarray:
    """Samples of x nearest to the detector's spikes."""
    return np.clip(np.round(spike_times(x, fs, **settings) * fs).astype(int) - 1, 0, max(0, len(x) - 1))


#: Levels of prominence, 0 to 50 by 2.
LEVELS = np.arange(0, 52, 2)


def boundary_reach(fs: float) -> int:
    """How far from a spike the samples may be that its boundary is read from."""
    return round(0.3 * fs) + 2 * floor(fs / 200 + 0.5) + 1


def spike_boundary(x: np.ndarray, fs: float, at: int) -> tuple[int, int, int] | None:
    """DSP20: P1 (onset), N1 (peak) and N2 (end) of the spike near sample `at`, or None.

    A stretch of 0.3 s begins a quarter before the spike. The peak is its greatest magnitude near there. P1 and P2 are the
    nearest extrema of the other sign whose prominence reaches a level: 20, then less by 2 down to 0, until they are 20 to
    70 ms apart and 10 ms from the peak each; levels jump to 30, 40 and 50 the first three times that one is too near.
    N2 is an extremum of the opposite kind behind P2, counted from the peak, 10 ms behind P2 and within 150 ms of P1, at
    levels 4 to 50; if the last level gives none, it is 150 ms behind P1.
    """
    lo = at - floor(0.3 * fs / 4 + 0.5)
    hi, lo = min(len(x), lo + round(0.3 * fs)), max(0, lo)
    part, reach = x[lo:hi], 2 * floor(fs / 200 + 0.5)
    first = max(0, at - lo - reach)
    if not len(part[first : at - lo + reach]):
        return None
    peak = first + int(np.argmax(np.abs(part[first : at - lo + reach])))
    value = part[peak]
    kinds = {}
    for sign in (1, -1):
        found = find_peaks(sign * part)
        kinds[sign] = found, prominences(sign * part, found)
    found, depth = kinds[-1 if value > 0 else 1]
    strong = depth >= LEVELS[:, None]
    before, behind = found < peak, found > peak
    nearest = [
        (int(found[i]) if i >= 0 else None, int(found[j]) if j < len(found) else None)
        for i, j in zip(np.where(strong & before, np.arange(len(found)), -1).max(1, initial=-1).tolist(), np.where(strong & behind, np.arange(len(found)), len(found)).min(1, initial=len(found)).tolist())
    ]
    left = right = None
    level, jumps = 20, [50, 40, 30]
    while True:
        left, right = nearest[level // 2]
        close = False
        if left is not None and right is not None:
            close = min(right - peak, peak - left) / fs < 0.01
            if not close and 0.02 <= (right - left) / fs <= 0.07:
                break
        if close and jumps:
            level = jumps.pop()
        elif level == 0:
            break
        else:
            level -= 2
    if left is None or right is None:
        return None
    found, depth = kinds[-1 if value < 0 else 1]
    ends = np.where((depth >= LEVELS[2:, None]) & (found > right), np.arange(len(found)), len(found)).min(1, initial=len(found)).tolist()
    end = None
    for j in ends:
        end = peak + int(found[j]) - right if j < len(found) else None
        if end is not None and (end - right) / fs >= 0.01 and (end - left) / fs <= 0.15:
            break
    return lo + left, lo + peak, lo + (end if end is not None else left + round(0.15 * fs))


class Extrema:
    """Strict maxima of sign * x, and their prominences in stretches of at most `width` samples."""

    def __init__(self, x: np.ndarray, sign: int, width: int):
        y = sign * x
        self.first, self.last = tops(y)
        self.at = (self.first + self.last) // 2
        self.y, self.higher, self.least = y, [], [y]
        for step in (-1, 1):  # the nearest higher sample on each side
            found, pending = np.full(len(self.at), -width - len(y) if step < 0 else width + 2 * len(y)), np.arange(len(self.at))
            for d in range(1, width + 1):
                place = self.at[pending] + step * d
                inside = (place >= 0) & (place < len(y))
                pending, place = pending[inside], place[inside]
                hit = y[place] > y[self.at[pending]]
                found[pending[hit]] = place[hit]
                pending = pending[~hit]
                if not len(pending):
                    break
            self.higher.append(found)
        while 2 ** len(self.least) <= width:  # least values of 1, 2, 4, ... samples from each on
            half, t = 2 ** (len(self.least) - 1), self.least[-1]
            self.least.append(np.r_[np.minimum(t[:-half], t[half:]), t[max(0, len(t) - half) :]] if len(t) > half else t)
        self.least = np.array(self.least)

    def minimum(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least values of the stretches from a to b, both included."""
        k = np.frexp(b - a + 1)[1] - 1
        return np.minimum(self.least[k, a], self.least[k, b - (1 << k) + 1])

    def depths(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and prominences of the maxima in each stretch [lo, hi), a row each; -1 behind a row's last one."""
        begin = np.searchsorted(self.first, lo, "right")
        count = np.maximum(np.searchsorted(self.last, hi - 1, "left") - begin, 0)
        column = np.arange(count.max(initial=0))
        row, i = np.nonzero(column < count[:, None])
        k = begin[row] + i
        p = self.at[k]
        left = self.minimum(np.maximum(self.higher[0][k] + 1, lo[row]), p)
        right = self.minimum(p, np.minimum(self.higher[1][k], hi[row]) - 1)
        place, depth = np.full((len(lo), len(column)), -1), np.full((len(lo), len(column)), np.nan)
        place[row, i], depth[row, i] = p, self.y[p] - np.where(right > left, right, left)
        return place, depth


def spike_boundaries(x: np.ndarray, fs: float, at: np.ndarray, size: int = 512) -> np.ndarray:
    """`spike_boundary` of many spikes at once: rows of P1, N1 and N2, or of -1."""
    at, width, reach = np.asarray(at, int), round(0.3 * fs), 2 * floor(fs / 200 + 0.5)
    out = np.full((len(at), 3), -1)
    if not len(at) or width < 1:
        return out
    kinds = {sign: Extrema(x, sign, width) for sign in (1, -1)}
    for k in range(0, len(at), size):
        own = at[k : k + size]
        lo = own - floor(0.3 * fs / 4 + 0.5)
        lo, hi = np.maximum(0, lo), np.minimum(len(x), lo + width)
        near = np.maximum(lo, own - reach)[:, None] + np.arange(2 * reach)
        inside = near < np.minimum(hi, own + reach)[:, None]
        some = inside.any(1)
        high = np.where(inside, np.abs(x[np.minimum(near, len(x) - 1)]), -np.inf)
        peak = near[np.arange(len(own)), high.argmax(1)] if reach else own
        value = x[np.minimum(peak, len(x) - 1)]
        for sign, other, chosen in ((-1, 1, value > 0), (1, -1, value < 0), (1, 1, ~((value > 0) | (value < 0)))):
            which = np.flatnonzero(chosen & some)
            if len(which):
                out[k + which] = _boundaries(fs, peak[which], *kinds[sign].depths(lo[which], hi[which]), *kinds[other].depths(lo[which], hi[which]))
    return out


def _boundaries(fs: float, peak: np.ndarray, found: np.ndarray, depth: np.ndarray, others: np.ndarray, other_depth: np.ndarray) -> np.ndarray:
    n, rows = len(peak), np.arange(len(peak))
    sides = np.full((2, len(LEVELS), n), -1)  # of each level, the nearest extremum on each side
    before, behind = (found >= 0) & (found < peak[:, None]), found > peak[:, None]
    for i, level in enumerate(LEVELS.tolist()):
        strong = depth >= level
        sides[0, i] = np.where(before & strong, found, -1).max(1, initial=-1)
        least = np.where(behind & strong, found, np.iinfo(int).max).min(1, initial=np.iinfo(int).max)
        sides[1, i] = np.where(least == np.iinfo(int).max, -1, least)
    level, used, active = np.full(n, 20), np.zeros(n, int), rows
    while len(active):
        left, right = sides[:, level[active] // 2, active]
        both, mid = (left >= 0) & (right >= 0), peak[active]
        close = both & (np.minimum(right - mid, mid - left) / fs < 0.01)
        fits = both & ~close & (0.02 <= (right - left) / fs) & ((right - left) / fs <= 0.07)
        jump = close & (used[active] < 3)
        stop = fits | (~jump & (level[active] == 0))
        level[active] = np.where(stop, level[active], np.where(jump, 30 + 10 * used[active], level[active] - 2))
        used[active] += jump & ~stop
        active = active[~stop]
    left, right = sides[:, level // 2, rows]
    end, open_, last = np.full(n, -1), np.ones(n, bool), np.full(n, -1)
    for least in LEVELS[2:].tolist():
        first = np.where((other_depth >= least) & (others > right[:, None]), others, np.iinfo(int).max).min(1, initial=np.iinfo(int).max)
        known = first < np.iinfo(int).max
        last = np.where(known, peak + np.where(known, first, 0) - right, -1)
        fits = open_ & known & ((last - right) / fs >= 0.01) & ((last - left) / fs <= 0.15)
        end[fits], open_ = last[fits], open_ & ~fits
    end = np.where(open_, np.where(last >= 0, last, left + round(0.15 * fs)), end)
    return np.where(((left >= 0) & (right >= 0))[:, None], np.stack([left, peak, end], 1), -1)


#: Frequencies at which pre-spike gamma is looked for.
GAMMA_HZ = 100 / 2 ** (np.arange(70) / 40)


@lru_cache(maxsize=16)
def _gamma_bank(n: int, fs: float) -> np.ndarray:
    """Gains of all the wavelets, with a turn by one sample: the transform then begins at its lowest positive frequency."""
    return np.array([_morse_gain(n, fs, f, 3.0, 60.0) for f in GAMMA_HZ])


def gamma_measure(x: np.ndarray, fs: float, p1: int, n2: int) -> tuple[float, float, float]:
    """DSP22: power, frequency and duration (ms) of pre-spike gamma: zeros if there is none, NaN if it can't be measured.

    The half seconds before P1 and behind N2 are the baseline; runs above its mean by two deviations are looked for before
    P1. A run's power is the mean magnitude over its stretch one sample later, as published results have it.
    """
    x = x[:-1]
    if len(x) < 2:
        return 0.0, 0.0, 0.0
    n, half = np.arange(len(x)), fs / 2
    search = (n < p1) & (n >= ceil(p1 + 1 - half))
    base = search | ((n > n2) & (n < floor(n2 + 1 + half)))
    if 1000 * base.sum() / fs < 250 or not search.any():
        return (float("nan"),) * 3
    cut = min(len(x), p1 + 1)  # what is read: the stretch before P1, P1 itself, the baseline behind N2
    first = int(np.argmax(search))
    found = np.fft.ifft(np.fft.fft(x)[1 : (len(x) + 1) // 2] * _gamma_bank(len(x), fs), len(x))
    before, behind = np.abs(found[:, first:cut]), np.abs(found[:, base & ~search])
    level = np.concatenate([before[:, : int(search.sum())], behind], 1)
    limit = level.mean(1) + 2 * level.std(1, ddof=1)
    over = np.zeros((len(GAMMA_HZ), int(search.sum()) + 2), np.int8)
    over[:, 1:-1] = before[:, : over.shape[1] - 2] > limit[:, None]
    edge = np.diff(over, axis=1)
    (row, start), (_, stop) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    long = (stop - start >= 3 * np.ceil(fs / GAMMA_HZ)[row]) & (p1 - first - stop <= 0.19 * fs)
    best = (0.0, 0.0, 0.0)
    for i, a, b in zip(row[long].tolist(), start[long].tolist(), stop[long].tolist()):
        if (power := float(before[i, a + 1 : b + 1].mean())) > best[0]:
            best = (power, float(GAMMA_HZ[i]), 1000.0 * (b - a) / fs)
    return best


def decibel(p: np.ndarray, floor: float = 1e-20) -> np.ndarray:
    return 10 * np.log10(np.maximum(p, floor))


def decade(x: float) -> int:
    return int(np.floor(log10(x)))
