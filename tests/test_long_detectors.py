"""Detectors take a channel block by block and give what the kernels give for the whole channel."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaflow.functions import kernels as K
from voltaflow.operators import blocks as B
from voltaflow.operators import detectors as D
from voltaflow.operators import dsp as S
from voltaflow.operators import pipelines as R


def frame(spark, channels):
    return spark.createDataFrame([(c, i, float(v)) for c, x in channels.items() for i, v in enumerate(x)], "channel string, sample long, x double")


def oscillating(n, seed, stretches):
    """Noise with stretches of 150 Hz at 1000 Hz."""
    x = np.random.default_rng(seed).normal(size=n)
    for a, b in stretches:
        x[a:b] += 30 * np.sin(0.3 * np.pi * np.arange(a, b))
    return x


def grouping(df):
    """Keys of the groups that Python gets whole."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "FlatMapGroupsInArrow" in line]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 130, 1000, 1023, 1025])
def test_envelopes_from_neighbours_and_sums(n):
    """Blocks that begin or end anywhere on the circle, short last blocks, even and odd lengths."""
    x = np.cumsum(np.random.default_rng(n).normal(size=n))
    for size in (16, 64):
        count = -(-n // size)
        blocks = {i: x[i * size : (i + 1) * size] for i in range(count)}
        far = K.far_field(np.array([K.block_sums(b, size) for b in blocks.values()]), n, size)
        got = [K.near_field({j: b for j, b in blocks.items() if K.is_near(i, j, count)}, i, n, size) + K.from_far(far[i], len(blocks[i]), size) for i in blocks]
        assert np.allclose(np.concatenate(got), K.analytic(x).imag, rtol=0, atol=1e-11 * np.abs(x).max())


CHANNELS = {
    "a": oscillating(6001, 1, [(300, 360), (1000, 1040), (2030, 2110), (4000, 4900)]),  # over edges of blocks, and longer than one
    "b": oscillating(3000, 2, [(0, 60), (2950, 3000)]),
    "c": np.zeros(700),
    "d": oscillating(100, 3, []),
    "e": oscillating(12000, 4, [(500, 540), (1010, 1050), (4080, 4125), (4133, 4165), (9000, 9060)]),
}


def whole(find, fs, sos):
    return sorted((c, *r) for c, x in CHANNELS.items() for r in find(K.sosfiltfilt(sos, x), fs).tolist())


def test_hilbert_by_block(spark):
    fs, sos = 1000.0, K.band_sos(80, 300, 1000.0)
    want = whole(K.hilbert_detector, fs, sos)
    assert len(want) > 3
    assert sorted(map(tuple, D.hilbert(frame(spark, CHANNELS), sos, fs, block=512).collect())) == want
    got = S.candidates(frame(spark, CHANNELS), fs, "HIL", 80, 300)
    assert sorted((r.channel, r.start, r.end) for r in got.collect()) == want
    assert all("block_id" in keys for keys in grouping(got))


def test_short_term_energy_by_block(spark):
    fs, sos = 1000.0, K.band_sos(80, 300, 1000.0)
    want = whole(K.short_term_energy, fs, sos)
    assert len(want) > 3
    for block in (512, 64):
        assert sorted(map(tuple, D.short_term_energy(frame(spark, CHANNELS), sos, fs, block=block).collect())) == want
    got = S.candidates(frame(spark, CHANNELS), fs, "STE", 80, 300)
    assert all("block_id" in keys for keys in grouping(got))


@pytest.mark.parametrize("least", [5.0, 60.0])
def test_mni_by_block(spark, least):
    """Limits from the baseline and, where that is asked to be longer than the channel, from all values."""
    fs, sos = 1000.0, K.band_sos(80, 300, 1000.0)
    want = whole(lambda x, fs: K.mni_detector(x, fs, base_min=least), fs, sos)
    assert len(want) > 2
    assert sorted(map(tuple, D.mni(frame(spark, CHANNELS), sos, fs, base_min=least, block=512).collect())) == want
    got = S.candidates(frame(spark, CHANNELS), fs, "MNI", 80, 300)
    assert all("block_id" in keys for keys in grouping(got))


def test_quantiles_by_bins(spark):
    """Values that differ in their last digits, equal ones, a rank between two bins, one value."""
    rng = np.random.default_rng(4)
    x = {"a": rng.exponential(size=5000), "b": 1 + 1e-12 * rng.integers(0, 50, 3000), "c": np.zeros(700), "d": np.r_[np.zeros(50), np.full(50, 8.0)], "e": np.array([3.5])}
    rows = [(c, i, v[k : k + 512].tolist()) for c, v in x.items() for i, k in enumerate(range(0, len(v), 512))]
    for q in (0.95, 0.5, 0.999999):
        ranks = spark.createDataFrame([(c, q, len(v)) for c, v in x.items()], "channel string, q double, n long")
        got = D.quantiles(spark.createDataFrame(rows, "channel string, block_id long, v array<double>"), "v", ranks).collect()
        assert {r.channel: r.limit for r in got} == {c: np.quantile(v, q) for c, v in x.items()}


@pytest.mark.parametrize("fs", [100.0, 500.0, 200.0])
def test_spikes_by_block(spark, fs):
    """Heavy-tailed noise, slow changes of its size, silence, channels of one window and of fewer than 40 samples."""
    rng = np.random.default_rng(9)
    x = {"a": rng.standard_cauchy(round(130.7 * fs)), "b": rng.standard_t(3, round(61 * fs)) * np.repeat([1, 9], [round(30 * fs), round(31 * fs)])}
    x |= {"c": rng.standard_cauchy(round(4.9 * fs)), "d": np.zeros(round(20 * fs)), "e": np.ones(10), "f": rng.standard_cauchy(round(9 * fs) + 1)}
    want = sorted((c, min(len(v), max(1, round(t * fs))) - 1, t) for c, v in x.items() for t in K.spike_times(v, fs).tolist())
    assert len(want) > 50
    assert sorted(map(tuple, D.spikes(frame(spark, x), fs, block=1024).collect())) == want
    got = S.spikes(frame(spark, x), fs)
    assert sorted(map(tuple, got.collect())) == want
    assert all("block_id" in keys for keys in grouping(got))


@pytest.mark.parametrize("fs", [100.0, 333.0, 500.0])
def test_boundaries_of_many_spikes(fs):
    """The same as one at a time: noise, smooth noise, flat tops, values that aren't numbers, both ends; and in a fraction of the time."""
    rng = np.random.default_rng(10)
    smooth, flat, holes = np.convolve(rng.normal(size=900) * 60, np.hanning(9), "same"), np.repeat(np.round(rng.normal(size=200) * 9), 5), rng.normal(size=700) * 40
    holes[[0, 50, 51, 600]] = np.nan
    found = 0
    for x in (rng.normal(size=900) * 50, smooth, flat, holes, np.ones(1), np.arange(40.0)):
        want = [K.spike_boundary(x, fs, p) for p in range(len(x))]
        assert K.spike_boundaries(x, fs, np.arange(len(x)), size=100).tolist() == [list(w or (-1, -1, -1)) for w in want]
        found += sum(w is not None for w in want)
    assert found > 100


def test_many_boundaries_take_little_time():
    x = np.random.default_rng(11).normal(size=8192) * 500
    at = K.find_peaks(x)
    start = time.perf_counter()
    K.spike_boundaries(x, 500.0, at)
    many = time.perf_counter() - start
    start = time.perf_counter()
    for p in at[:400].tolist():
        K.spike_boundary(x, 500.0, p)
    assert many / len(at) < (time.perf_counter() - start) / 400 / 3


def test_gamma_run_detects_once(spark):
    """What follows the detection reads its spikes, so no chunk is searched again for each of its uses."""
    x = {c: np.random.default_rng(i).standard_cauchy(3000) for i, c in enumerate("abcdef")}
    got = R.gamma_spikes(frame(spark, x), 100.0, 1000, 500)
    assert got.count() > 0 and "pos_s" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_numbering_shuffles_rows_once(spark):
    """Places of rows with null keys, spans and order values; no join, by which rows were broadcast or shuffled a second time."""
    rows = [(k, d, i * 7919 % 1009) for i, (k, d) in enumerate((k, d) for k in ("a", "b", None) for d in (3, None, 1, 2) for _ in range(5 if d else 2))] + [("a", 2, None)]
    got = B.numbered(spark.createDataFrame(rows, "k string, d int, v int").withColumn("d2", F.col("d")), "k", F.col("d"), ["d2", "v"], "place")
    assert got.columns == ["k", "d", "v", "d2", "place"] and dict(got.dtypes)["place"] == "bigint"
    nulls_first = lambda r: [(v is not None, v or 0) for v in r[1:]]
    want = [(*r, i) for k in ("a", "b", None) for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=nulls_first))]
    assert sorted(((r.k, r.d, r.v, r.place) for r in got.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_gamma_events_number_samples_once(spark):
    """Samples are numbered for the detection only, and are read again, in blocks of its size, around its spikes; as on the whole channel."""
    fs, x = 500.0, np.random.default_rng(12).standard_cauchy(D.BLOCK + 9000)
    rows = spark.createDataFrame([(int(i % 2), i // 2, float(v)) for i, v in enumerate(np.r_[x, x[::-1]].reshape(2, -1).T.ravel())], "channel long, t long, x double")
    got = S.gamma_events(B.numbered(rows, "channel", F.floor(F.col("t") / 10000), ["t"]).select("channel", "sample", "x"), fs)
    assert "_span" not in got._jdf.queryExecution().optimizedPlan().toString()
    want, found = {}, 0
    for c, y in enumerate((x, x[::-1])):
        at = [min(len(y), max(1, round(t * fs))) - 1 for t in K.spike_times(y, fs).tolist()]
        for p, (p1, n1, n2) in zip(at, K.spike_boundaries(y, fs, at).tolist()):
            lo = max(0, n1 - round(fs))
            want[c, p] = (p1, n1, n2, *K.gamma_measure(y[lo : n1 + round(fs)], fs, p1 - lo, n2 - lo)) if p1 >= 0 else None
    for r in got.collect():
        edges = want.pop((r.channel, r.sample))
        assert (r.p1, r.n1, r.n2) == (edges[:3] if edges else (None,) * 3)
        assert r.error or np.allclose((r.power, r.freq, r.duration_ms), edges[3:], rtol=1e-9)
        found += r.error is None
    assert not want and found > 50
