"""The beta mask against a whole pass in NumPy, and the hook for models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaflow.functions import kernels as K
from voltaflow.operators import inference, spectra


def plain_beta(x, fs, beta, window_s, ratio):
    size = int(round(window_s * fs))
    step = size - int(round(0.5 * size))
    starts = list(range(0, len(x) - size + 1, step))
    if not starts:
        return np.zeros(len(x), bool), []
    b, a = K.to_ba(*K.design(4, 30.0, fs, "lowpass"))
    flags = []
    for s in starts:
        y = K.filtfilt(b, a, x[s : s + size], 12)
        n = min(512, len(y))
        w = np.hanning(n + 1)[:-1]
        p = np.mean([np.abs(np.fft.rfft((q - q.mean()) * w)) ** 2 for i in range(0, len(y) - n + 1, n - n // 2) for q in [y[i : i + n]]], 0)
        p[1:-1] *= 2
        f = np.fft.rfftfreq(n, 1 / fs)
        flags.append(p[(f > beta) & (f < 25)].max() > np.median(p) * ratio)
    points = np.array([*starts, len(x) - 1])
    values = np.array([*flags, flags[-1]])
    return np.array([values[np.argmin(np.abs(points - s))] for s in range(len(x))]), flags


@pytest.mark.parametrize("window_s", [2.0, 5.0])
def test_beta_mask(spark, window_s):
    fs, rng = 200.0, np.random.default_rng(2)
    t = np.arange(6000) / fs
    x = {"a": rng.normal(size=6000) + np.where((t > 8) & (t < 18), 4 * np.sin(2 * np.pi * 18 * t), 0), "b": rng.normal(size=700), "c": rng.normal(size=300)}
    df = spark.createDataFrame([(c, i, float(v)) for c, xs in x.items() for i, v in enumerate(xs)], "channel string, sample long, x double").repartition(6)
    got = spectra.beta_mask(df, fs, 15.0, window_s, 40.0)
    assert got.columns == ["channel", "sample", "x", "beta"]
    rows = {(r.channel, r.sample): r.beta for r in got.collect()}
    assert len(rows) == 7000
    for c, xs in x.items():
        mask, _ = plain_beta(xs, fs, 15.0, window_s, 40.0)
        assert [rows[c, i] for i in range(len(xs))] == mask.tolist(), c
    assert rows["a", 2600] and not all(rows.values()) and not any(v for (c, _), v in rows.items() if c == "c" and window_s > 1.5)
    assert spectra.beta_mask(df, fs).where("beta").count() == 0


def test_models_are_given_batches(spark):
    rows = [(f"e{i}", [float(i)] * (3 if i % 4 else 5)) for i in range(300)] + [("none", None), ("empty", [])]
    events = spark.createDataFrame(rows, "event_id string, waveform array<double>").repartition(2)

    def make():
        def model(x):
            assert 0 < len(x) <= 64
            if (x[:, 0] == 8).any():
                raise ValueError("eight")
            return {"keep": x[:, 0] / 300, "spike": np.where(x[:, 0] == 7, np.nan, 0.5), "ehfo": x.sum(1)}

        return model

    got = {r.event_id: r for r in inference.complete(events.unionByName(spark.createDataFrame([("late", [1.0])], events.schema)), inference.scored(events, make, batch=64)).collect()}
    assert len(got) == 303 and got["none"].status == got["empty"].status == "no features" and got["late"].status == "not scored"
    failed = [k for k, r in got.items() if r.status == "model error: ValueError: eight"]
    assert "e8" in failed and len(failed) <= 64 and all(int(k[1:]) % 4 == 0 for k in failed)
    assert got["e7"].keep == 7 / 300 and got["e7"].spike is None and got["e7"].ehfo == 21.0 and got["e7"].status == "ok"

    short = inference.scored(events, lambda: lambda x: {"keep": x[:, 0]}, batch=1000)
    assert {r.status for r in short.where(F.col("event_id").startswith("e1")).collect()} == {"scores missing: spike, ehfo"}
