"""Operators on hand-made cases: quirks, edges, round trips, chunk invariance, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaflow.operators import blocks as B
from voltaflow.operators import dsp, rei
from voltaflow.operators import events as E
from voltaflow.operators import windows as W
from voltaflow.sources import recordings, results
from voltaflow.sources.settings import parsed_settings
from voltaflow.streaming import streams


def signal(spark, channels):
    return spark.createDataFrame([(c, i, float(v)) for c, x in channels.items() for i, v in enumerate(x)], "channel string, sample long, x double")


def test_anchored_clusters_are_not_chained(spark):
    rows = [(t / 1000, i) for i, t in enumerate((0, 6, 12, 13, 30))]
    df = spark.createDataFrame([("r", "c", t, i) for t, i in rows], "recording string, channel string, t double, ord long")
    got = {r.ord: r.anchor for r in E.anchored_clusters(df, 0.010).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.012, 3: 0.012, 4: 0.030}


def test_two_channels_are_always_common_mode(spark):
    df = spark.createDataFrame([("r", "a", 0.0, 0), ("r", "b", 5.0, 1)], "recording string, channel string, t double, ord long")
    assert all(r.common for r in E.common_mode(E.anchored_clusters(df, 0.010), 2).collect())


def test_burst_gap_is_strict(spark):
    df = spark.createDataFrame([("a", 0.0, 0), ("a", 0.3, 1), ("a", 0.5, 2)], "channel string, t double, ord long")
    assert [r.burst for r in E.burst_members(df, 0.3).orderBy("ord").collect()] == [False, True, True]
    assert [r.burst for r in E.burst_members(df.where("ord < 2"), 0.3).collect()] == [False, False]


def test_envelope_of_nan_bins(spark):
    x = [float("nan")] * 4 + [1.0, 5.0, 2.0, float("nan")]
    rows = {r.bin: r for r in W.envelope(signal(spark, {"a": x}), 2).collect()}
    assert np.isnan(rows[0].first_x) and (rows[1].first_x, rows[1].second_x) == (1.0, 5.0)


def test_energy_does_not_depend_on_blocks(spark):
    s = signal(spark, {"a": np.sin(np.arange(300)), "b": np.cos(np.arange(150))}).select("channel", F.lit("ictal").alias("segment"), F.col("sample").alias("n"), "x")
    one, many = (W.moving_energy(s, 25, block=b).select("channel", "n", F.round("energy", 9).alias("e")) for b in (1 << 20, 16))
    assert one.exceptAll(many).isEmpty() and one.count() == many.count() == 450


def test_scores_find_the_early_channel_and_ignore_scale(spark):
    rng = np.random.default_rng(0)

    def make(scale):
        rows = []
        for c in "abc":
            x = rng.normal(size=800) * scale
            if c == "b":
                x[500:] *= 20
            rows += [(c, "baseline" if i < 400 else "ictal", i % 400, float(v)) for i, v in enumerate(x)]
        return spark.createDataFrame(rows, "channel string, segment string, n long, x double")

    rng = np.random.default_rng(0)
    a = rei.scores(make(1.0), 100.0).orderBy("final_rank").collect()
    rng = np.random.default_rng(0)
    b = rei.scores(make(1e-6), 100.0).orderBy("final_rank").collect()
    assert a[0].channel == "b" and a[0].score == 1.0 and 75 < a[0].onset < 110
    assert [(r.channel, r.onset) for r in a] == [(r.channel, r.onset) for r in b]
    assert all(r.onset == 400 for r in a if r.channel != "b")


def test_blocks_round_trip(spark):
    s = signal(spark, {"a": range(100), "b": range(37)})
    blocks = B.to_blocks(s, block=16)
    assert B.from_blocks(blocks).exceptAll(s).isEmpty()
    assert B.read_range(blocks, 10, 40, 16).count() == 57


def test_waveforms_shift_and_pad(spark):
    s = signal(spark, {"a": range(20)})
    e = spark.createDataFrame([("a", 1, 20), ("a", 19, 20)], "channel string, event long, n long")
    lo, hi = E.fixed_window(F.col("event"), 9, F.col("n"))
    got = {r.event: r.waveform for r in E.waveforms(e.select("channel", "event", lo.alias("lo"), hi.alias("hi")), s, 4).collect()}
    assert got[1] == list(map(float, range(9))) and got[19] == list(map(float, range(11, 20)))
    padded = spark.range(1).select(E.padded(F.array(F.lit(1.0)), 3).alias("w")).collect()[0].w
    assert padded == [1.0, 0.0, 0.0]


def test_edf_round_trip(spark, tmp_path):
    x = 50 * np.sin(np.arange(300) / 7)
    (tmp_path / "a.edf").write_bytes(recordings.encode_edf([("C1", x), ("C2", -x)], 100))
    rows = B.from_blocks(recordings.read_edf(spark, str(tmp_path), 64), ("channel",)).where("channel = 'C2'").orderBy("sample").collect()
    assert np.allclose([r.x for r in rows], -x, atol=0.01)
    assert recordings.suffix_reader("x/y.BDF") == "edf"
    with pytest.raises(ValueError):
        recordings.suffix_reader("x.cnt")


def test_gamma_export_shifts_time_by_one_sample(spark):
    df = spark.createDataFrame([("a", 99, 1.5, None)], "channel string, sample0 long, power double, duration double")
    out = results.export_gamma(df, 100.0).collect()[0]
    assert (out.sample, out.time_s, out.is_gamma) == (100, 1.0, False)


def test_projects():
    text = results.project_document("p", "a.edf", {}, {"filters": {"highpass_hz": 1.0}}, {"sort_mode": "mean"})
    d = results.load_project(text)
    assert d["preprocessing"]["filters"]["micro"] == {"highpass_hz": 1.0} and d["computation"]["sort_mode"] == "time"
    for bad in ("[]", "{}", text.replace('"version": 8', '"version": 9'), text.replace('"raw_file": "a.edf"', '"raw_file": ""')):
        with pytest.raises(ValueError):
            results.load_project(bad)
    assert results.result_kind(["gamma_spike_events.csv", "x"]) == "gamma" and results.same_source("/a/B.edf", "c/b.EDF")
    assert results.metadata_json({"a": float("nan"), "b": 2, "c": 3}, {"a": "x", "b": "y"}) == '{"x": null, "y": 2}'


def test_settings_last_value_counts(spark):
    m = spark.range(1).select(parsed_settings(F.lit("-k1 4.5 -fl 12 -bl 15 -zz 3")).alias("m")).collect()[0].m
    assert (m["k1"], m["k2"], m["bandwidth_low"]) == ("4.5", "3.65", "15") and "zz" not in m


def test_kernels_by_channel(spark):
    t = np.arange(500) / 100
    out = dsp.envelope(signal(spark, {"a": np.sin(2 * np.pi * 10 * t), "b": 2 * np.sin(2 * np.pi * 10 * t)}))
    got = {r.channel: r.m for r in out.where("sample between 100 and 400").groupBy("channel").agg(F.avg("y").alias("m")).collect()}
    assert abs(got["a"] - 1) < 0.01 and abs(got["b"] - 2) < 0.01


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, "click", 1.0 * i) for i in range(0, 40, 4)]
    df = spark.createDataFrame(rows, "event_id long, s string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    src = streams.event_stream(spark, str(tmp_path / "in"), schema)
    out = streams.run_to_table(streams.windowed_counts(src, "0 seconds", "20 minutes", "20 minutes"), "w1", "complete", str(tmp_path / "c1"))
    assert sorted(r.n for r in out.collect()) == [5, 5]
    s = streams.run_to_table(streams.sessions(src, "0 seconds", "5 minutes"), "s1", "append", str(tmp_path / "c2"))
    assert s.count() >= 0


def test_bursts_in_a_stream(spark, tmp_path):
    """Files out of order, a late row, and a channel that is told by another's watermark."""
    batches = [
        [("a", 1, 100.0), ("a", 3, 300.0), ("b", 1, 120.0)], [("a", 2, 100.2), ("a", 4, 301.0), ("a", 5, 320.0)], [("b", 2, 900.0)], [("a", 6, 50.0), ("a", 7, 320.5), ("b", 3, 1000.0)], [("b", 4, 5000.0)], [("b", 5, 9000.0)],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "channel string, ord long, t double").select("channel", "ord", F.timestamp_micros((F.col("t") * 1000000).cast("long")).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), "channel string, ord long, ts timestamp")
    out = streams.run_to_table(streams.without_bursts(stream, 1.0, "1000 seconds"), "bursts", "append", str(tmp_path / "c"))
    got = {(r.channel, r.ord, r.t) for r in out.collect()}
    # 1 and 2 of channel a are 0.2 s apart, 5 and 7 half a second; 3 and 4 are just the gap apart
    assert {("a", 3, 300.0), ("a", 4, 301.0), ("b", 1, 120.0)} <= got and not {o for c, o, _ in got if c == "a"} & {1, 2, 5, 7}
    assert len(got) == out.count()
