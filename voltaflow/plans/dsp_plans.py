"""Queries of the kernels; results that SQL can't express are held against signal properties in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import blocks as B
from ..operators import dsp as S
from ..operators import pipelines as R
from . import adapters as A


def heavy(spark, sf):
    """Heavy-tailed noise, by a hash of channel and sample, so that detectors have something to find."""
    u = (F.crc32(F.concat_ws(":", "channel", "sample").cast("binary")) + 0.5) / 4294967296.0
    return A.long_signal(spark, sf).withColumn("x", F.tan(3.141592653589793 * (u - 0.5)))


def bursts(spark, sf):
    """Noise with bursts of 150 Hz (at 1000 Hz) in some stretches of 64 samples."""
    u = F.crc32(F.concat_ws(":", "channel", "sample").cast("binary")) / 4294967296.0 - 0.5
    on = F.crc32(F.concat_ws("#", "channel", F.floor(F.col("sample") / 64)).cast("binary")) % 40 == 0
    return A.long_signal(spark, sf).withColumn("x", u + F.when(on, 30 * F.sin(2 * 3.141592653589793 * 0.15 * F.col("sample"))).otherwise(0.0))


def q(fn):
    def run(spark, sf):
        out = fn(A.signal(spark, sf))
        return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

    return run


def dft(spark, sf):
    """Periodogram of every embedding by the definition, in array functions (the SQL-checkable form of DSP13 and DSP15)."""
    e = A.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    e = e.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k"))

    def part(f):
        return F.aggregate(F.transform("x", lambda x, i: x * f(2 * 3.141592653589793 * F.col("k") * i / F.size("x"))), F.lit(0.0), lambda a, v: a + v)

    return e.select("vec_id", F.col("k").cast("long").alias("k"), F.round((part(F.cos) ** 2 + part(F.sin) ** 2) / F.size("x"), 4).alias("power"))


DFT = """WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS i, len(embedding) AS n FROM embeddings),
p AS (SELECT vec_id, k, sum(x * cos(2 * 3.141592653589793 * k * i / n)) AS re, sum(x * sin(2 * 3.141592653589793 * k * i / n)) AS im, any_value(n) AS n FROM v, range(0, 33) r(k) GROUP BY vec_id, k)
SELECT vec_id, k, round((re * re + im * im) / n, 4) AS power FROM p"""


def stm01(spark, sf):
    """Envelope of chunks with context: every chunk is one group, its centre is kept."""
    s = A.signal(spark, sf)
    near = B.with_halo(s, 64, 64, 512)
    chunked = near.select("channel", "block_id", "sample", "x")
    first = chunked.groupBy("channel", "block_id").agg(F.min("sample").alias("s0"))
    out = S.per_channel(chunked, lambda x: S._rows(S.K.envelope(x)), *S.SAMPLES, keys=("channel", "block_id"))
    out = out.join(first, ["channel", "block_id"]).withColumn("sample", F.col("sample") + F.col("s0"))
    return out.where(F.floor(F.col("sample") / 512) == F.col("block_id")).select("channel", "sample", F.round("y", 6).alias("y"))


def hfo_run(spark, sf):
    found = R.hfo_events(bursts(spark, sf), 1000.0, max_ms=200.0, pad=10)
    k = F.crc32(F.col("event_id").cast("binary")) / 4294967296.0
    scores = found.select("event_id", k.alias("keep"), ((k * 7) % 1).alias("spike"), ((k * 13) % 1).alias("ehfo"))
    channels = A.long_signal(spark, sf).select("channel").distinct()
    out = R.hfo_summary(channels, R.label_hfo(found, scores), 1.0)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def spline(spark, sf):
    def run(x):
        at = list(range(0, len(x), 10))
        return S._rows(K.spline(at, x[at], range(len(x))))

    return S.per_channel(A.signal(spark, sf), run, *S.SAMPLES).withColumn("y", F.round("y", 6))


def prepared(spark, sf):
    bad = spark.createDataFrame([(3,)], "channel long")
    out = R.prepared(A.long_signal(spark, sf), 50, 900, bad, "mean")
    return out.withColumn("x", F.round("x", 0))


PREPARED = f"""WITH {A.LONG_SIGNAL}, s AS (SELECT channel, sample - 50 AS sample, x * 1e6 AS x FROM long_signal WHERE sample >= 50 AND sample < 900 AND channel <> 3) SELECT channel, sample, round(x - avg(x) OVER (PARTITION BY sample), 0) AS x FROM s"""

QUERIES = {
    "dsp05_gamma_notch": (q(lambda s: S.per_channel(s, lambda x: S._rows(K.filtfilt(*K.notch(20.0, A.FS), x)), *S.SAMPLES)), None),
    "dsp06_boundary_band": (q(lambda s: S.bandpass(s, 500.0, 10.0, 60.0)), None),
    "dsp06_gamma_band": (q(lambda s: S.bandpass(s, 500.0, 30.0, 100.0)), None),
    "dsp07_hum_filter": (q(lambda s: S.hum_free(s, 200.0)), None),
    "dsp08_detector_band": (q(lambda s: S.detector_band(s, 200.0)), None),
    "dsp09_detector_resample": (q(lambda s: S.detector_rate(s, 500.0)), None),
    "dsp17_review_filter": (q(lambda s: S.display_filter(s, A.FS, 5.0, 45.0)), None),
    "dsp18_threshold_spline": (spline, None),
    "dsp20_spike_boundary": (q(lambda s: S.spike_boundaries(s, A.FS * 5, K.find_peaks)), None),
    "dsp22_gamma_measure": (q(lambda s: S.gamma_events(s, 500.0, K.find_peaks).withColumnRenamed("duration_ms", "ms")), None),
    "dsp29_hfo_run": (hfo_run, None),
    "dsp30_prepared_input": (prepared, PREPARED),
    "gamma_spike_run": (lambda spark, sf: R.gamma_spikes(heavy(spark, sf), A.FS, 4000, 1000), None),
    "dsp01_rei_bandpass": (q(lambda s: S.bandpass(s, A.FS, 10.0, 40.0)), None),
    "dsp02_notch": (q(lambda s: S.notched(s, A.FS, 20.0)), None),
    "dsp03_display_filter": (q(lambda s: S.display_filter(s, A.FS, 1.0, 30.0)), None),
    "dsp10_resample": (q(lambda s: S.resampled(s, A.FS, 80.0)), None),
    "dsp11_envelope": (q(S.envelope), None),
    "dsp12_prefilter": (q(lambda s: S.prefiltered(s, A.FS, 10.0, 40.0)), None),
    "dsp13_welch": (q(lambda s: S.welch(s, A.FS, 256)), None),
    "dsp13_periodogram": (dft, DFT),
    "dsp14_spectrogram": (q(lambda s: S.spectrogram(s, A.FS)), None),
    "dsp15_tf_panel": (q(lambda s: S.spectrogram(s, A.FS, 64, 16)), None),
    "dsp16_gamma_tf_panel": (q(lambda s: S.spectrogram(s, A.FS, 64, 6)), None),
    "dsp19_spike_detector": (lambda spark, sf: S.spikes(heavy(spark, sf), A.FS), None),
    "dsp21_morse_power": (q(lambda s: S.wavelet_power(s, 500.0)), None),
    "dsp23_gamma_events": (lambda spark, sf: S.gamma_events(heavy(spark, sf), 500.0), None),
    "dsp24_ste": (lambda spark, sf: S.candidates(bursts(spark, sf), 1000.0, "STE", 80, 300), None),
    "dsp24_mni": (lambda spark, sf: S.candidates(bursts(spark, sf), 1000.0, "MNI", 80, 300), None),
    "dsp24_hilbert": (lambda spark, sf: S.candidates(bursts(spark, sf), 1000.0, "HIL", 80, 300), None),
    "stm01_chunked_envelope": (stm01, None),
}
