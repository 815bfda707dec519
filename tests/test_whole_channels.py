"""Queries read whole channels: on channels of more than 2000 samples no sample is missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaflow.functions import kernels as K
from voltaflow.operators import dsp as S
from voltaflow.operators import sorting as O
from voltaflow.plans import adapters as A
from voltaflow.plans import registry

SF = "/root/testdata/sf0.01"
FILTERS = ["dsp01_rei_bandpass", "dsp02_notch", "dsp03_display_filter", "dsp05_gamma_notch", "dsp06_boundary_band", "dsp06_gamma_band", "dsp07_hum_filter", "dsp08_detector_band", "dsp11_envelope", "dsp12_prefilter", "dsp17_review_filter", "dsp18_threshold_spline"]


@pytest.fixture(scope="module")
def channels(spark):
    rows = A.signal(spark, SF).orderBy("channel", "sample").collect()
    found = {c: np.array([r.x for r in rows if r.channel == c]) for c in {r.channel for r in rows}}
    assert max(map(len, found.values())) > 2000
    return found


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_every_sample(spark, channels, name):
    got = registry.queries()[name](spark, SF).groupBy("channel").agg(F.count("*").alias("n"), F.max("sample").alias("last")).collect()
    assert {r.channel: (r.n, r.last) for r in got} == {c: (len(x), len(x) - 1) for c, x in channels.items()}


@pytest.mark.parametrize("name, fs, target", [("dsp09_detector_resample", 500.0, 200.0), ("dsp10_resample", A.FS, 80.0)])
def test_resampling_covers_the_channel(spark, channels, name, fs, target):
    got = registry.queries()[name](spark, SF).groupBy("channel").count().collect()
    assert {r.channel: r["count"] for r in got} == {c: len(K.resample_to(x, fs, target)) for c, x in channels.items()}


@pytest.mark.parametrize("name, shape", [("dsp14_spectrogram", ()), ("dsp15_tf_panel", (64, 16)), ("dsp16_gamma_tf_panel", (64, 6))])
def test_spectrograms_are_of_the_whole_channel(spark, channels, name, shape):
    got = registry.queries()[name](spark, SF).groupBy("channel").agg(F.count("*").alias("n"), F.max("t").alias("t"), F.sum("power").alias("power")).collect()
    for r in got:
        _, t, p = K.stft_power(channels[r.channel], A.FS, *shape)
        assert r.n == p.size and r.t == round(t[-1], 6) and np.isclose(r.power, p.sum(), rtol=1e-6)
    assert len(got) == len(channels)


def test_spectra_are_of_the_whole_channel(spark, channels):
    welch = registry.queries()["dsp13_welch"](spark, SF).collect()
    morse = registry.queries()["dsp21_morse_power"](spark, SF).collect()
    freqs = 100 / 2 ** (np.arange(70) / 40)
    for c, x in channels.items():
        got = [r.power for r in sorted(welch, key=lambda r: r.bin) if r.channel == c]
        assert np.allclose(got, K.welch(x, A.FS, 256)[1], atol=1e-6)
        got = [r.power for r in sorted(morse, key=lambda r: r.k) if r.channel == c]
        assert np.allclose(got, (np.abs(K.morse(x, 500.0, freqs)) ** 2).mean(1), atol=1e-6)


def test_long_splines_go_through_their_points():
    """From 512 points on, which whole channels have, the sweep gives the same as the dense solution."""
    rng = np.random.default_rng(3)
    cubic = lambda t: 2 - t + 0.3 * t**2 - 0.01 * t**3
    x = np.cumsum(rng.uniform(0.01, 0.03, 700))
    at = np.linspace(x[0], x[-1], 3001)
    assert np.allclose(K.spline(x, cubic(x), at), cubic(at))
    y = rng.normal(size=700)
    assert np.allclose(K.spline(x, y, x), y)


def test_every_peak_has_a_row(spark, channels):
    peaks = {(c, p) for c, x in channels.items() for p in K.find_peaks(x).tolist()}
    for name in ("dsp20_spike_boundary", "dsp22_gamma_measure"):
        got = registry.queries()[name](spark, SF).collect()
        assert len(got) == len(peaks) and {(r.channel, r.sample) for r in got} == peaks


def test_every_peak_has_its_boundary_and_measurement(spark):
    """On smooth noise, where most peaks have a boundary."""
    fs, rng = 500.0, np.random.default_rng(5)
    x = {c: np.convolve(rng.normal(size=2500), np.hanning(15), "same") for c in "ab"}
    df = spark.createDataFrame([(c, i, float(v)) for c in x for i, v in enumerate(x[c])], "channel string, sample long, x double")
    edges = {(c, p): K.spike_boundary(x[c], fs, p) for c in x for p in K.find_peaks(x[c]).tolist()}
    assert sum(e is not None for e in edges.values()) > 100
    got = S.spike_boundaries(df, fs, K.find_peaks).collect()
    assert len(got) == len(edges) and {(r.channel, r.sample): None if r.p1 is None else (r.p1, r.n1, r.n2) for r in got} == edges
    got = S.gamma_events(df, fs, K.find_peaks).collect()
    assert len(got) == len(edges) and {(r.channel, r.sample) for r in got} == set(edges)
    for r in got:
        at = edges[r.channel, r.sample]
        if at is None:
            assert r.error == "no boundary" and r.power is None
            continue
        lo = max(0, at[1] - 500)
        want = K.gamma_measure(x[r.channel][lo : at[1] + 500], fs, at[0] - lo, at[2] - lo)
        assert np.allclose([np.nan if v is None else v for v in (r.power, r.freq, r.duration_ms)], want, equal_nan=True)


def test_whole_queries_have_no_row_filter(spark):
    """Counted on tables where a filter by sample or by start would drop rows."""
    run = registry.queries()
    s = A.signal(spark, SF)
    assert run["src14_hfo_import_export"](spark, SF).agg(F.sum("n")).first()[0] == A.oscillations(spark, SF).count()
    assert run["src17_heatmap"](spark, SF).count() == s.count()
    assert run["jon08_candidate_waveform"](spark, SF).count() == s.where("x > 400").count() > 0
    assert run["win22_best_prespike_z"](spark, SF).count() == s.where("x > 200 and sample > 0").count() > 0
    assert run["win23_gamma_masks"](spark, SF).count() == s.where("x > 200").count()


def test_orders_place_every_row(spark):
    """The places of a whole order are 0 to n - 1, nulls first, whatever the spans."""
    rows = spark.createDataFrame([(2.5, 1), (None, 7), (0.5, 3), (2.5, 0), (-1.5, 2), (None, 4)], "power double, event_id long")
    got = O.placed(rows, [F.col("power").asc_nulls_first(), F.col("event_id")], F.floor("power")).orderBy("place").collect()
    assert [(r.place, r.event_id) for r in got] == [(0, 4), (1, 7), (2, 2), (3, 3), (4, 0), (5, 1)]
    assert O.placed(rows.limit(0), [F.col("event_id")], F.col("event_id")).count() == 0
    for name, table in {"srt02_candidate_order": A.oscillations, "srt03_detector_order": A.detections, "srt04_summary_sort": A.spikes, "srt07_review_order": A.detections, "srt10_timeline_order": A.oscillations}.items():
        assert registry.queries()[name](spark, SF).count() == table(spark, SF).count()
