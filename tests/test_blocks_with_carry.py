"""Runs, peaks, groups, closing, bursts and clusters over block borders: small blocks against one pass over the whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaflow.functions import kernels as K
from voltaflow.operators import events as E
from voltaflow.operators import windows as W


def flagged(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows, state = [], False
    for c in ("a", "b"):
        for i in range(n):
            if rng.random() < (0.25 if c == "a" else 0.03):
                state = not state
            rows.append((c, i, float(rng.choice([0, 1, 2, 3, 3, 4])), state))
    return rows, spark.createDataFrame(rows, "channel string, sample long, x double, flag boolean")


def by_channel(rows):
    for c in ("a", "b"):
        mine = [r for r in rows if r[0] == c]
        yield c, np.array([r[2] for r in mine]), np.array([r[3] for r in mine])


@pytest.mark.parametrize("block", [1, 4, 7, 64, 1000])
def test_runs_and_peaks(spark, block):
    rows, df = flagged(spark)
    runs = {(c, int(a), int(b)) for c, x, f in by_channel(rows) for a, b in K.runs(f)}
    ends = {(r.channel, r.start, r.stop) for r in W.true_runs(df, block=block).collect()}
    # the kernel's stops are inclusive or not: lengths decide
    if runs != ends:
        runs = {(c, a, b - 1) for c, a, b in runs}
    assert ends == runs and all(r.length == r.stop - r.start + 1 for r in W.true_runs(df, block=block).collect())
    peaks = {(c, int(p)) for c, x, f in by_channel(rows) for p in K.run_maxima(x, f)}
    assert {(r.channel, r.sample) for r in W.run_peaks(df, block=block).collect()} == peaks
    best = {(c, a + int(np.argmax(x[a : b + 1]))) for c, x, f in by_channel(rows) for cc, a, b in runs if cc == c}
    assert {(r.channel, r.sample) for r in W.local_maximum_of_runs(df, flag="flag", block=block).collect()} == best


@pytest.mark.parametrize("block", [1, 5, 16, 1000])
@pytest.mark.parametrize("reach", [2, 6])
def test_groups_of_peaks(spark, block, reach):
    rng = random.Random(3)
    at = sorted(rng.sample(range(400), 120))
    peaks = [("a", s, float(rng.choice([1, 2, 2, 3]))) for s in at]
    groups, want = [[peaks[0]]], {}
    for p in peaks[1:]:
        groups.append([p]) if p[1] - groups[-1][-1][1] > reach else groups[-1].append(p)
    for g in groups:
        v = [0, *[p[2] for p in g], 0]
        for i, p in enumerate(g):
            if len(g) == 1 or (v[i + 1] >= v[i] and v[i + 2] < v[i + 1]):
                want[p[1]] = len(g)
    df = spark.createDataFrame(peaks, "channel string, sample long, x double")
    assert {r.sample: r.n for r in W.poly_groups(df, reach, block=block).collect()} == want


@pytest.mark.parametrize("block", [1, 8, 33])
def test_closing(spark, block):
    rows, df = flagged(spark, 300, 5)
    want = set()
    for c, _, f in by_channel(rows):
        wide = [any(f[max(0, i - 2) : i + 3]) for i in range(len(f))]
        want |= {(c, i) for i in range(len(f)) if all(wide[max(0, i - 2) : i + 3])}
    out = W.closing(df, 5, block=block)
    assert out.columns == [*df.columns, "closed"] and {(r.channel, r.sample) for r in out.where("closed").collect()} == want and out.count() == len(rows)


@pytest.mark.parametrize("span", [0.5, 2.0, 3600.0])
def test_bursts_and_clusters(spark, span):
    rng = random.Random(6)
    rows = []
    for rec in ("r", "s"):
        t = -3.0
        for i in range(300):
            t = round(t + rng.choice([0.0, 0.01, 0.02, 0.05, 0.2, 1.0, 4.0]), 2)
            rows.append((rec, rng.choice("xyz"), t, i, "clash"))
    df = spark.createDataFrame(rows, "recording string, channel string, t double, ord long, _gap string")
    df = df.drop("_gap").withColumn("note", F.lit("kept"))
    burst = {}
    for rec, c, t, o, _ in rows:
        mine = sorted((r[2], r[3]) for r in rows if r[1] == c and r[0] == rec)
        i = mine.index((t, o))
        burst[rec, o] = (i > 0 and t - mine[i - 1][0] < 0.3) or (i + 1 < len(mine) and mine[i + 1][0] - t < 0.3)
    one = df.where("recording = 'r'")
    assert {r.ord: r.burst for r in E.burst_members(one, 0.3, span=span).collect()} == {o: b for (rec, o), b in burst.items() if rec == "r"}
    want = {}
    for rec in ("r", "s"):
        anchor = None
        for _, _, t, o, _ in sorted((r for r in rows if r[0] == rec), key=lambda r: (r[2], r[3])):
            anchor = t if anchor is None or t - anchor > 0.05 else anchor
            want[rec, o] = anchor
    out = E.anchored_clusters(df, 0.05, span=span)
    assert out.columns == [*df.columns, "anchor"]
    assert {(r.recording, r.ord): r.anchor for r in out.collect()} == want and E.anchored_clusters(df.limit(0), 0.05).count() == 0


def test_one_channel_is_many_tasks(spark):
    """The windows that see all samples are partitioned by block too."""
    _, df = flagged(spark, 50)
    for out in (W.true_runs(df, block=8), W.run_peaks(df, block=8), W.closing(df, 5, block=8)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert any("block" in line for line in windows)


def test_no_task_scans_a_recording_without_gaps(spark):
    """Events without a wide gap from end to end: anchors by definition, and no task sorts more than a share of them."""
    rng = random.Random(7)
    times = sorted({round(rng.uniform(0, 40.0), 4) for _ in range(6000)})
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(times)], "recording string, ord long, t double")
    out = E.anchored_clusters(df, 0.05, span=0.5)
    want, anchor = {}, None
    for i, t in enumerate(times):
        anchor = t if anchor is None or t - anchor > 0.05 else anchor
        want[i] = anchor
    assert {r.ord: r.anchor for r in out.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged
    try:
        sizes = [n for n in E.anchored_clusters(df, 0.05, span=0.5).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.6 * len(times)
