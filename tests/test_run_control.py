"""Progress, cancel, the performance log, and the bounded cache; moments, covers and spectra against brute force; paths and projects by hand."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaflow import runs
from voltaflow.operators import covers, moments, spectra
from voltaflow.sources import paths, projects, states


def slow(spark, n=40, s=0.5):
    def wait(it):
        for batch in it:
            time.sleep(s)
            yield batch

    return spark.range(n).repartition(n).mapInArrow(wait, "id long")


def test_cancel_leaves_nothing(spark, tmp_path):
    store = states.StateStore(spark, f"{tmp_path}/s")
    store.save({"t": spark.range(3)}, {"run": 1})

    def work(run):
        run.step("write")
        store.save({"t": slow(spark)}, {"run": 2})
        run.step("never")

    run = runs.Run(spark, work, "slow").start()
    until = time.monotonic() + 30
    while not (p := run.progress()).tasks and time.monotonic() < until:
        time.sleep(0.1)
    assert p.state == "running" and p.step == "write" and 0 < p.tasks and p.tasks_done < 40
    other = spark.range(1000).count()  # jobs outside of the run go on
    start = time.monotonic()
    run.cancel()
    with pytest.raises(runs.Cancelled):
        run.result(30)
    assert time.monotonic() - start < 15 and other == 1000 and run.progress().state == "cancelled"
    assert store.versions() == [1] and store.restore().parameters == {"run": 1}
    from voltaflow.sources import storage

    assert storage.names(spark, f"{tmp_path}/s/data") == ["version=000001"]


def test_runs_finish_fail_and_stop_between_steps(spark):
    seen = []
    run = runs.Run(spark, lambda r: (r.step("a"), spark.range(10).count(), r.step("b"))[1], on_step=seen.append).start()
    assert run.result(60) == 10 and seen == ["a", "b"] and run.progress().state == "finished" and run.progress().steps_done == 2

    def broken(r):
        r.step("a")
        raise ValueError("no")

    run = runs.Run(spark, broken).start()
    with pytest.raises(ValueError, match="no"):
        run.result(60)
    assert run.progress().state == "failed"

    def patient(r):
        while True:
            r.step("again")
            time.sleep(0.05)

    run = runs.Run(spark, patient).start()
    with pytest.raises(TimeoutError):
        run.result(0.2)
    run.cancel()
    with pytest.raises(runs.Cancelled):
        run.result(10)


def test_log_has_a_row_a_step(spark, tmp_path):
    log = runs.PerformanceLog(spark, f"{tmp_path}/log", file_path="a.edf", sfreq=100, n_channels=3)
    assert log.read().count() == 0
    assert log.write("numbers", spark.range(7), f"{tmp_path}/n") == 7
    assert log.write("none", spark.range(7).where("id > 9"), f"{tmp_path}/none") == 0
    with log.step("sleep"):
        time.sleep(0.05)
    with pytest.raises(ValueError), log.step("broken"):
        raise ValueError
    rows = {r.step: r for r in log.read().collect()}
    assert log.read().columns == runs.LOG_COLUMNS and set(rows) == {"numbers", "none", "sleep", "broken"}
    assert (rows["numbers"].notes, rows["none"].notes, rows["broken"].notes) == ("rows=7", "rows=0", "failed: ValueError")
    assert float(rows["sleep"].elapsed_s) >= 0.05 and rows["sleep"].file_path == "a.edf" and rows["sleep"].sfreq == "100" and float(rows["sleep"].private_mb) > 0
    with pytest.raises(ValueError):
        runs.PerformanceLog(spark, "x", colour="red")


def test_cache_hits_evictions_and_bound(spark):
    made = []

    def make(df):
        made.append(1)
        return df.withColumn("y", F.col("x") * 2)

    def source(k, n=20000):
        return spark.range(n).select((F.col("id") + k).cast("double").alias("x"))

    one = runs.SegmentCache(1 << 30)
    one.get(source(0), runs.filter_signature(1.0, None), make)
    size = one.bytes
    assert 20000 * 8 <= size <= 20000 * 40
    cache = runs.SegmentCache(int(2.5 * size))
    a = cache.get(source(0), runs.filter_signature(1.0, 0.0), make)
    assert cache.get(source(0), runs.filter_signature(1, None), make) is a and cache.hits == 1 and a.storageLevel.useMemory
    cache.get(source(0), runs.filter_signature(2.0, None), make)  # other settings
    assert (cache.hits, cache.misses, len(cache)) == (1, 2, 2)
    cache.get(source(0), runs.filter_signature(1.0, None), make)  # used again, so the other one is the oldest
    third = cache.get(source(5), runs.filter_signature(1.0, None), make)
    assert cache.evictions == 1 and len(cache) == 2 and cache.bytes <= cache.limit and third.count() == 20000
    assert cache.get(source(0), runs.filter_signature(1.0, None), make) is a and cache.hits == 3
    big = cache.get(source(1, 200000), ("big",), make)
    assert len(cache) == 2 and big.count() == 200000 and not big.storageLevel.useMemory
    cache.clear()
    assert len(cache) == 0 and cache.bytes == 0 and not a.storageLevel.useMemory
    one.clear()


@pytest.mark.parametrize("bucket", [0.5, 3.0, 1000.0])
def test_covers_against_brute_force(spark, bucket):
    rng = np.random.default_rng(4)
    held = [("ab"[i % 2], i, float(t), float(t + d)) for i, (t, d) in enumerate(zip(np.round(rng.uniform(-5, 30, 200), 1), np.round(rng.exponential(1.0, 200), 1)))]
    held += [("a", 900, 2.0, 25.0), ("a", 901, 2.0, 25.0), ("b", 902, None, 9.0), ("b", 903, 5.0, float("nan")), ("b", 904, 8.0, 1.0)]
    asked = [("abc"[i % 3], i, float(t), float(t + d)) for i, (t, d) in enumerate(zip(np.round(rng.uniform(-5, 30, 300), 1), np.round(rng.exponential(0.5, 300), 1)))]
    asked += [("a", 1000, None, 1.0), ("a", 1001, 2.0 - 5e-10, 25.0 + 5e-10), ("a", 1002, 2.0, 25.1)]
    df = lambda rows: spark.createDataFrame(rows, "channel string, id long, t0 double, t1 double")
    got = {r.id: r.cover_id for r in covers.covered(df(asked), df(held), bucket=bucket).collect()}
    want = {}
    for c, i, t0, t1 in asked:
        ok = [(-h[3], h[1]) for h in held if t0 is not None and h[0] == c and h[2] is not None and h[2] <= h[3] and h[2] <= t0 + 1e-9]
        want[i] = min(ok)[1] if ok and -min(ok)[0] >= t1 - 1e-9 else None
    assert got == want and sum(v is not None for v in want.values()) > 50


def test_moments_of_any_ranges(spark):
    rng = np.random.default_rng(5)
    x = {(c, k): 1e6 + rng.normal(size=300 + 0 * k) for c in (0, 1) for k in (0, 1, 2)}
    series = spark.createDataFrame([(c, k, i, float(v)) for (c, k), xs in x.items() for i, v in enumerate(xs)], "channel long, k long, sample long, x double")
    ranges = [(1, 0, 0, 10), (1, 0, 50, 170), (2, 1, 250, 900), (3, 1, -20, 1), (4, 0, 40, 40), (5, 0, 400, 500), (6, 1, 63, 64), (6, 1, 64, 65)]
    got = {(r.event_id, r.k): r for r in moments.range_moments(moments.prefix_sums(series, block=64), spark.createDataFrame(ranges, "event_id long, channel long, lo long, hi long")).collect()}
    for e in (1, 2, 3, 6):
        for k in (0, 1, 2):
            v = np.concatenate([x[c, k][max(lo, 0) : hi] for i, c, lo, hi in ranges if i == e])
            r = got.pop((e, k))
            assert r.n == len(v) and abs(r["mean"] - v.mean()) < 1e-7 and (r.sd is None if len(v) == 1 else abs(r.sd - v.std(ddof=1)) < 1e-7)
    assert not got


def test_spectra_of_long_and_short_channels(spark):
    rng = np.random.default_rng(6)
    x = {"a": rng.normal(size=1000), "b": rng.normal(size=70), "c": rng.normal(size=7), "d": rng.normal(size=129)}
    signal = spark.createDataFrame([(c, i, float(v)) for c, xs in x.items() for i, v in enumerate(xs)], "channel string, sample long, x double").repartition(7)
    got = {}
    for r in spectra.mean_periodogram(signal, 50.0, 128).collect():
        got.setdefault(r.channel, {})[r.bin] = (r.freq, r.power)
    assert set(got) == {"a", "b", "d"}
    for c in got:
        size = min(128, len(x[c]))
        w = np.hanning(size)
        p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 / (50.0 * (w**2).sum()) for at in range(0, len(x[c]) - size + 1, size - size // 2) for s in [x[c][at : at + size]]], axis=0)
        assert np.allclose([got[c][b][1] for b in sorted(got[c])], p) and np.allclose([got[c][b][0] for b in sorted(got[c])], np.fft.rfftfreq(size, 1 / 50.0))


def test_paths_by_hand(spark):
    texts = ["/a//b/./c/../d", "a/../../b", "", "/", "..", "C:\\x\\y", None, "/../a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, p string")
    assert [r.n for r in df.select("i", paths.normal(F.col("p")).alias("n")).orderBy("i").collect()] == ["/a/b/d", "../b", "", "/", "..", "C:/x/y", None, "/../a"]
    stems = spark.createDataFrame([("/a/b.c.set",), ("x",), (".hidden",)], "p string").select(paths.stem_of(F.col("p"))).collect()
    assert [r[0] for r in stems] == ["b.c", "x", ".hidden"]
    rel = spark.createDataFrame([("/a/b/c.edf", "/a/b"), ("/a/x/c.edf", "/a/b/d"), ("/c.edf", "/a"), ("/a/b", "/a/b")], "p string, f string").select(projects.relative_path(F.col("p"), F.col("f"))).collect()
    assert [r[0] for r in rel] == ["c.edf", "../../x/c.edf", "../c.edf", ""]


def test_project_documents_that_cannot_be_read(spark):
    good = '{"format": "voltaflow-project", "version": 2, "source": {"raw_file_relative": "a.edf"}}'
    texts = [good, None, "", "[1]", '"x"', good.replace("2", "true"), good.replace("2", "2.5"), good.replace("2", "0"), good.replace("voltaflow-project", "other"), good.replace('"format"', '"f"'), good.replace('{"raw_file_relative": "a.edf"}', "null"), good.replace('"a.edf"', "3")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i long, document string, version string")
    rows = projects.read_projects(df).orderBy("i").collect()
    assert [r.problem for r in rows] == [None, *["not a project document"] * 4, *["the version isn't a whole number"] * 2, "a version that isn't known", "another format", "another format", "no source", "no recording is named"]
    assert rows[0].raw_file is None and rows[0].raw_file_relative == "a.edf" and rows[0].macro.notch_mode == "Off" and rows[0].algorithm == "ei" and rows[0].annotations == []
