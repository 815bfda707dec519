"""Saved states, batch output and the EDF source: crashes, broken rows, resume, ranges and pushed filters."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaflow.functions import kernels as K
from voltaflow.operators import batch
from voltaflow.sources import edf_source, states, storage


def test_state_versions_and_crash(spark, tmp_path):
    store = states.StateStore(spark, f"{tmp_path}/s")
    with pytest.raises(LookupError):
        store.restore()
    events = spark.createDataFrame([(1, "a", "c1", [1.0, 2.0]), (2, None, "c2", None)], "ord long, event_id string, channel string, waveform array<double>")
    saved = states.saved_oscillations(events)
    assert "waveform" not in saved.columns
    assert store.save({"events": saved}, {"algorithm": "hfo", "hfo": {"params": {"low": 80}}}) == 1

    class Broken(RuntimeError):
        pass

    def fail(it):
        raise Broken("the job dies between tables")

    with pytest.raises(Exception, match="dies between"):
        store.save({"events": saved.limit(1), "more": saved.mapInPandas(fail, saved.schema)}, {"algorithm": "ei"})
    assert store.versions() == [1]
    back = store.restore(verify=True)
    assert back.version == 1 and back.parameters["hfo"]["params"] == {"low": 80}
    assert sorted(map(tuple, back.tables["events"].collect())) == sorted(map(tuple, saved.collect()))
    assert store.save({"events": saved.limit(0)}) == 3  # the crashed number isn't given again
    assert store.restore(verify=True).tables["events"].count() == 0 and store.restore(1).tables["events"].count() == 2
    with pytest.raises(LookupError):
        store.restore(2)
    assert store.vacuum(1) == [1] and store.versions() == [3]
    assert storage.names(spark, f"{tmp_path}/s/data") == ["version=000003"]


def test_damaged_state_is_told(spark, tmp_path):
    store = states.StateStore(spark, f"{tmp_path}/s")
    df = spark.range(5).withColumn("x", F.col("id") / 2)
    store.save({"t": df})
    path = store.manifests().collect()[0].tables[0].path
    df.limit(4).write.mode("overwrite").parquet(path)
    assert store.restore().tables["t"].count() == 4
    with pytest.raises(states.DamagedState):
        store.restore(verify=True)


def test_restored_defaults(spark):
    rows = [(1, None, "c", None, None, None, None, None, None, None), (2, "x", "", 1.0, 2.0, None, None, None, None, None), (3, "y", "b", 1.0, 0.5, float("nan"), float("inf"), " ", "spike-HFO", "reviewed"), (4, "", "c", 2.0, 2.5, 2.1, 7.0, "m", None, "")]
    df = spark.createDataFrame(rows, "ord long, event_id string, channel string, start_time_s double, end_time_s double, peak_time_s double, artifact_score double, final_model_class string, manual_class string, manual_review_status string")
    got = {r.ord: r for r in states.read_oscillations(df).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].event_id == "hfo_000001" and got[4].event_id == "hfo_000004" and (got[1].start_time_s, got[1].peak_time_s, got[1].duration_ms, got[1].low_freq_hz, got[1].high_freq_hz) == (0, 0, 0, 80, 300)
    assert (got[3].peak_time_s, got[3].duration_ms, got[3].artifact_score, got[3].final_model_class, got[3].manual_review_status) == (1.0, 0.0, None, None, "reviewed")
    assert (got[4].peak_time_s, got[4].duration_ms, got[4].artifact_score, got[4].manual_review_status) == (2.1, 500.0, 7.0, "unreviewed")
    listed = spark.createDataFrame([("b", 1), ("zz", 0)], "channel string, ordinal long")
    assert [tuple(r) for r in states.restored_channels(states.read_oscillations(df), listed).orderBy("place").collect()] == [("b", 1, 1), ("c", 2, 2)]


def test_parameters_of_older_states():
    assert states.read_parameters({})["algorithm"] == "ei" and states.read_parameters({"algorithm": "mean"})["algorithm"] == "ei"
    got = states.read_parameters({"algorithm": "hfo", "mean": {"t0": "3", "window_s": 0.2}, "selected_abs": [1, "2", "x", None], "ei": {"seizure_onset_s": "no"}, "hfo": {"analysis_end_s": 9}}, duration_s=60.0)
    assert got["time"] == {"t0": 3.0, "window_s": 1.0, "link_time": False} and got["selected_abs"] == [1, 2]
    assert got["ei"]["seizure_onset_s"] is None and got["hfo"]["analysis_end_s"] == 9.0 and got["gamma_spike"]["analysis_end_s"] == 60.0


def batch_case(spark):
    rng = np.random.default_rng(0)
    rows = []
    for path in ("data/sub-1/a.edf", "data/sub-2/b.edf"):
        for c in range(4):
            x = rng.normal(size=400)
            x[250 + 10 * c :] *= 30
            rows += [(path, f"c{c}", i, float(v)) for i, v in enumerate(x)]
    signal = spark.createDataFrame(rows, "path string, channel string, sample long, x double")
    recordings = spark.createDataFrame([(p, 50.0, 50.0, 400) for p in ("data/sub-1/a.edf", "data/sub-2/b.edf")], "path string, native_fs double, fs double, n_samples long")
    fields = "row long, edf_full_path string, edf_relative_path string, baseline_start_sec string, baseline_end_sec string, ictal_start_sec string, ictal_end_sec string, segment_status string, qc_note string, seizure_onset_relative_sec string, seizure_offset_relative_sec string"
    ok = ("0", "4", "4", "8", "ok", None, None, None)
    raw = [
        (0, None, "data/sub-1/a.edf", *ok), (1, "/none.edf", "data/sub-2/b.edf", *ok), (2, None, "data/sub-9/c.edf", *ok), (3, None, None, *ok), (4, None, "data/sub-2/b.edf", "0", "4", "x", "8", "OK ", None, None, None),
        (5, None, "data/sub-2/b.edf", "4", "4", "4", "8", "ok", None, None, None), (6, None, "data/sub-3/b.edf", *ok), (7, None, "data/sub-2/b.edf", "0", "4", "4", "8", "poor", "noise", None, None),
        (8, None, "data/sub-2/b.edf", "0", "4", "4", "8", None, None, None, None), (9, None, "data/sub-2/b.edf", "0", "4", "4", "8", "ok", None, "5", "5"), (10, None, "data/sub-1/a.edf", "0", "4", "7.9", "99", "ok", None, None, None),
    ]
    return spark.createDataFrame(raw, fields), spark.createDataFrame([("sub-3", "left")], "patient_id string, reason string"), recordings, signal


def test_batch_with_broken_rows_and_resume(spark, tmp_path):
    folder = f"{tmp_path}/out"
    case = batch_case(spark)
    got = batch.run_batch(spark, folder, *case, exclude_channels="^c3$")
    assert got == {"ok": 3, "skipped": 4, "error": 4, "done_before": 0}
    log = {r.row: r for r in batch.last_status(batch.read_log(spark, folder)).collect()}
    assert {k: r.status for k, r in log.items()} == {0: "ok", 1: "ok", 2: "error", 3: "error", 4: "error", 5: "error", 6: "skipped", 7: "skipped", 8: "skipped", 9: "skipped", 10: "ok"}
    assert log[2].reason == "missing recording: data/sub-9/c.edf" and log[5].reason == "invalid baseline window: (200, 200)" and log[6].reason == "patient excluded from the index | left"
    assert log[7].reason == "segment_status is poor | noise" and log[9].reason == "offset isn't after onset" and (log[0].n_channels, log[0].excluded_channel_count) == (3, 1)
    out = spark.read.parquet(f"{folder}/results")
    first = {r.channel: r for r in out.where("row = 0").collect()}
    assert set(first) == {"c0", "c1", "c2"} and first["c0"].EI_rank_desc == 1 and 40 <= first["c0"].channel_onset_sample_in_ictal_window <= 60
    assert {r.status: (r.n_rows, r.excluded_channels) for r in batch.tally(batch.read_log(spark, folder)).collect()}["ok"] == (3, 3)
    files = {(r.path, r.bytes) for r in storage.listing(spark, f"{folder}/results", "*.parquet").collect()}
    assert batch.run_batch(spark, folder, *case, exclude_channels="^c3$") == {"ok": 0, "skipped": 4, "error": 4, "done_before": 3}
    assert {(r.path, r.bytes) for r in storage.listing(spark, f"{folder}/results", "*.parquet").collect()} == files
    assert batch.read_log(spark, folder).count() == 11  # nothing has changed, so nothing is logged


def test_batch_resumes_and_mends(spark, tmp_path):
    """A run over some rows, a run that is stopped before its log, a recording that comes later."""
    raw, excluded, recordings, signal = batch_case(spark)
    folder = f"{tmp_path}/out"
    assert batch.run_batch(spark, folder, raw, excluded, recordings, signal, first=0, last=0)["ok"] == 1

    def stopped(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        batch.run_batch(spark, folder, raw, excluded, recordings, signal, prepare=stopped)
    assert batch.read_log(spark, folder).count() == 1
    assert batch.run_batch(spark, folder, raw, excluded, recordings, signal)["ok"] == 2
    more = recordings.unionByName(spark.createDataFrame([("data/sub-9/c.edf", 50.0, 50.0, 400)], recordings.schema))
    late = signal.unionByName(signal.where("path = 'data/sub-1/a.edf'").withColumn("path", F.lit("data/sub-9/c.edf")))
    assert batch.run_batch(spark, folder, raw, excluded, more, late) == {"ok": 1, "skipped": 4, "error": 3, "done_before": 3}
    rows = {r.row: r.n for r in spark.read.parquet(f"{folder}/results").groupBy("row").agg(F.count("*").alias("n")).collect()}
    assert rows == {0: 4, 1: 4, 2: 4, 10: 4}


def edf_signal(spark, seconds=40, fs=100):
    rng = np.random.default_rng(3)
    data = {(r, c): np.round(rng.normal(size=seconds * fs - 7 * i) * 50, 2) for i, (r, c) in enumerate([("a", "X1"), ("a", "X2"), ("b", "EEG Y")])}
    rows = [(r, c, i, float(v)) for (r, c), x in data.items() for i, v in enumerate(x)]
    return data, spark.createDataFrame(rows, "recording string, channel string, sample long, x double").repartition(5)


def test_edf_round_trip_in_ranges(spark, tmp_path):
    data, signal = edf_signal(spark)
    path = f"{tmp_path}/edf"
    edf_source.write_recordings(signal, path, 100)
    assert sorted(r.path for r in storage.listing(spark, path).collect()) == ["a.edf", "b.edf"]
    back = edf_source.read_recordings(spark, path, task_bytes=1500)
    assert back.rdd.getNumPartitions() >= 10  # a file is many tasks
    rows = back.collect()
    for (r, c), x in data.items():
        mine = sorted((b for b in rows if (b.recording, b.channel) == (r, c)), key=lambda b: b.record)
        assert [b.record for b in mine] == list(range(40)) and {b.fs for b in mine} == {100.0} and [b.start_sample for b in mine] == list(range(0, 4000, 100))
        y = np.concatenate([b.x for b in mine])
        assert np.abs(y[: len(x)] - x).max() <= np.abs(x).max() / 65000 and not y[len(x) :].any()
    # the whole-file reader sees the same samples
    from voltaflow.sources import recordings

    whole = [r for r in recordings.read_edf(spark, path, 4000).collect() if r.recording.endswith("a.edf") and r.channel == "X1"]
    assert np.allclose(np.concatenate([b.x for b in sorted((b for b in rows if (b.recording, b.channel) == ("a", "X1")), key=lambda b: b.record)]), whole[0].x)


def test_edf_filters_reach_the_reader(spark, tmp_path):
    _, signal = edf_signal(spark)
    path = f"{tmp_path}/edf"
    edf_source.write_recordings(signal, path, 100)
    part = edf_source.read_recordings(spark, path).where("recording = 'a' and channel in ('X2', 'none') and record >= 5 and record < 9")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull" in plan and "X2" not in plan and ">=" not in plan  # what is left for Spark is that keys aren't null
    assert sorted((r.channel, r.record) for r in part.collect()) == [("X2", k) for k in range(5, 9)]
    assert edf_source.read_recordings(spark, path).where("record = 39 and fs > 1").count() == 3
    assert edf_source.read_recordings(spark, path).where("channel = 'nobody'").count() == 0


def test_a_slice_reads_only_its_bytes(spark, tmp_path):
    _, signal = edf_signal(spark)
    path = f"{tmp_path}/edf"
    edf_source.write_recordings(signal, path, 100)

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n):
            self.n += n
            return self.f.read(n)

        def seek(self, at):
            self.f.seek(at)

    file = Counted(open(f"{path}/a.edf", "rb"))
    size = len(open(f"{path}/a.edf", "rb").read())
    got = list(edf_source.read_range(file, edf_source.FileRange("a.edf", size, 0, size), {"X1"}, 10, 12))
    assert [(h["label"][i], r) for h, i, r, _ in got] == [("X1", 10), ("X1", 11)] and file.n == 256 * 3 + 2 * 400
    # ranges of bytes share out the records without loss or overlap
    seen = [r for lo in range(0, size, 777) for _, _, r, _ in edf_source.read_range(Counted(open(f"{path}/a.edf", "rb")), edf_source.FileRange("a.edf", size, lo, min(lo + 777, size)), {"X1"})]
    assert seen == list(range(40))


@pytest.mark.parametrize("target", [50.0, 64.0, 250.0, 0.0, 100.0])
def test_resampled_in_stretches(spark, tmp_path, target):
    data, signal = edf_signal(spark)
    path = f"{tmp_path}/edf"
    edf_source.write_recordings(signal, path, 100)
    blocks = edf_source.read_recordings(spark, path, task_bytes=1500)
    rows = edf_source.resampled(blocks, target, length=500).collect()
    source = blocks.collect()
    for r, c in data:
        x = np.concatenate([b.x for b in sorted((b for b in source if (b.recording, b.channel) == (r, c)), key=lambda b: b.record)])
        mine = sorted((b for b in rows if (b.recording, b.channel) == (r, c)), key=lambda b: b.start_sample)
        want = x if target in (0.0, 100.0) else K.resample_to(x, 100.0, target)
        y = np.concatenate([b.x for b in mine])
        assert len(y) == len(want) and np.allclose(y, want, atol=1e-9)
        assert {(b.fs, b.native_fs) for b in mine} == {(target if target not in (0.0, 100.0) else 100.0, 100.0)}
        assert [b.start_sample for b in mine] == list(np.cumsum([0, *[len(b.x) for b in mine]])[:-1])


def test_batch_writes_files_by_task_and_computes_windows_once(spark, tmp_path, monkeypatch):
    """Forty rows with the same windows: no folder a row, one computation, and a stopped run's output isn't counted twice."""
    raw, excluded, recordings, signal = batch_case(spark)
    many = raw.where("row = 0").crossJoin(spark.range(40)).withColumn("row", F.col("id")).drop("id")
    seen, cut = [], batch.cut

    def counted(ready, *rest):
        seen.append(ready.count())
        return cut(ready, *rest)

    monkeypatch.setattr(batch, "cut", counted)
    folder = f"{tmp_path}/out"
    spark.range(1).write.parquet(f"{folder}/results/attempt=1")  # as a run leaves it that is stopped before its log
    assert batch.run_batch(spark, folder, many, excluded, recordings, signal, last=19)["ok"] == 20
    assert batch.run_batch(spark, folder, many, excluded, recordings, signal) == {"ok": 20, "skipped": 0, "error": 0, "done_before": 20}
    assert seen == [1, 1] and len(storage.names(spark, f"{folder}/results")) == 2
    out = spark.read.parquet(f"{folder}/results")
    assert out.count() == 160 and out.select("row", "channel").distinct().count() == 160
    assert out.select("channel", F.round("EI", 9), "EI_rank_desc", "channel_onset_sample_in_ictal_window").distinct().count() == 4


def joins_since(spark, known=()):
    """Ids of the executions that aren't known, and of each the kinds and left keys of its joins."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = {ran.apply(i).executionId(): ran.apply(i).physicalPlanDescription() for i in range(ran.size())}
    found = {k: re.findall(r"\) (\w+Join)\b.*\nLeft keys \[\d+\]: \[(.*)\]", p) for k, p in plans.items() if k not in known}
    return {k: {(kind, re.sub(r"#\d+L?", "", keys)) for kind, keys in v} for k, v in found.items()}


def test_batch_broadcasts_no_table_of_its_rows(spark, tmp_path):
    """Tables that grow with the batch's rows are joined by shuffles, in a first run and in one that resumes it, though these are small enough to be broadcast."""
    raw, excluded, recordings, signal = batch_case(spark)
    known, folder = joins_since(spark), f"{tmp_path}/out"
    assert batch.run_batch(spark, folder, raw, excluded, recordings, signal, last=5) == {"ok": 2, "skipped": 0, "error": 4, "done_before": 0}
    assert batch.run_batch(spark, folder, raw, excluded, recordings, signal) == {"ok": 1, "skipped": 4, "error": 4, "done_before": 2}
    assert batch.read_log(spark, folder).count() == 11  # rows 2 to 5 are as before
    ran = joins_since(spark, known).values()
    scored = [j for j in ran if any(keys == "once" for _, keys in j)]  # the index itself has joins by row too, of the windows that it computes
    rows = {"row", "once", "edf, b0, b1, i0, i1"}
    kinds = {j for one in ran for j in one if j[1] in (rows - {"row"} if one in scored else rows)}
    assert kinds == {("SortMergeJoin", keys) for keys in rows}
