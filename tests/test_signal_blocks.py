"""Kernels that read their surroundings only are run by block: the same as on whole channels, in bounded tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaflow.functions import kernels as K
from voltaflow.operators import dsp as S
from voltaflow.operators import windows as W


def frame(spark, channels):
    return spark.createDataFrame([(c, i, float(v)) for c, x in channels.items() for i, v in enumerate(x)], "channel string, sample long, x double")


def peaks_by_definition(x):
    out, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def test_peaks_by_block(spark):
    """Flat tops longer than blocks, steps up and down, values that aren't numbers, channels of one sample."""
    rng = np.random.default_rng(1)
    x = {"a": np.repeat(rng.integers(0, 4, 60), rng.integers(1, 40, 60)).astype(float), "b": rng.integers(0, 3, 300).astype(float), "c": np.ones(1), "d": np.r_[0, np.ones(100), 0, np.nan, 2, np.nan, 1, 3, 1, 1]}
    for c, v in x.items():
        assert K.find_peaks(v).tolist() == peaks_by_definition(v)
    got = W.local_maxima(frame(spark, x), block=16).collect()
    assert sorted((r.channel, r.sample) for r in got) == sorted((c, p) for c, v in x.items() for p in peaks_by_definition(v))


def test_prominences_in_any_block_size():
    x = np.random.default_rng(2).normal(size=500)
    p = K.find_peaks(x)
    want = [x[i] - max(x[: i + 1][(np.r_[-1, np.flatnonzero(x[:i] > x[i])][-1] + 1) :].min(), x[i : (np.r_[np.flatnonzero(x[i:] > x[i]), 500 - i][0] + i)].min()) for i in p]
    for size in (1, 3000, 1 << 20):
        assert np.array_equal(K.prominences(x, p, size), want)


def test_measurements_by_block(spark, monkeypatch):
    """A channel of several blocks gives the rows of the whole channel, by more tasks than there are channels."""
    fs, rng = 500.0, np.random.default_rng(6)
    x = np.convolve(rng.normal(size=9500) * 60, np.hanning(9), "same")
    got = S.gamma_events(frame(spark, {"a": x}), fs, K.find_peaks)
    assert got.rdd.getNumPartitions() >= 4
    rows = {r.sample: r for r in got.collect()}
    assert sorted(rows) == K.find_peaks(x).tolist()
    measured = 0
    for p in [p for p in rows if p % 4096 < 600 or p % 4096 > 3500]:
        edges, r = K.spike_boundary(x, fs, p), rows[p]
        assert (None if edges is None else edges) == (None if r.p1 is None else (r.p1, r.n1, r.n2))
        if edges is not None:
            lo = max(0, edges[1] - 500)
            want = K.gamma_measure(x[lo : edges[1] + 500], fs, edges[0] - lo, edges[2] - lo)
            assert np.allclose([np.nan if v is None else v for v in (r.power, r.freq, r.duration_ms)], want, equal_nan=True)
            measured += 1
    assert measured > 100


@pytest.mark.parametrize("shape", [(), (64, 16), (64, 6), (16, 40)])
def test_spectrograms_by_block(spark, shape):
    """Blocks of a few frames, frames that overlap, touch or lie apart: bit by bit those of the whole channel, in more tasks than channels."""
    rng = np.random.default_rng(7)
    x = {"a": rng.normal(size=2003), "b": rng.normal(size=70), "c": rng.normal(size=64)}
    got = S.spectrogram(frame(spark, x), 100.0, *shape, values=3000)
    assert got.rdd.getNumPartitions() >= 4
    rows = got.collect()
    for c, v in x.items():
        f, t, p = K.stft_power(v, 100.0, *shape)
        own = {(r.frame, r.bin): (r.t, r.freq, r.power) for r in rows if r.channel == c}
        assert own == {(j, i): (t[j], f[i], p[i, j]) for j in range(len(t)) for i in range(len(f))}
    assert len(rows) == sum(K.stft_power(v, 100.0, *shape)[2].size for v in x.values())


def test_wavelet_power_needs_no_memory_a_scale():
    """A prime number of samples; the arrays that live at once are few."""
    import tracemalloc

    x, freqs = np.random.default_rng(8).normal(size=20011), 100 / 2 ** (np.arange(70) / 40)
    assert np.allclose(K.morse_power(x, 500.0, freqs), (np.abs(K.morse(x, 500.0, freqs)) ** 2).mean(1), rtol=1e-9)
    tracemalloc.start()
    K.morse_power(x, 500.0, freqs)
    assert tracemalloc.get_traced_memory()[1] < 60 * len(x)
    tracemalloc.stop()


def test_ranges_of_files_stay_few(tmp_path):
    """Short ranges of a large file are made longer, up to the longest; they still cover each file once."""
    from voltaflow.sources import edf_source

    for name, size in (("a.edf", 3 << 20), ("b.edf", 5000), ("c.txt", 9)):
        (tmp_path / name).write_bytes(bytes(size))
    got = edf_source.EdfReader(str(tmp_path), 4096).partitions()
    assert len(got) <= edf_source.TASKS + 2
    for path, size in (("a.edf", 3 << 20), ("b.edf", 5000)):
        own = [(r.lo, r.hi) for r in got if r.path.endswith(path)]
        assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert len(edf_source.EdfReader(str(tmp_path / "b.edf"), 1000).partitions()) == 5
