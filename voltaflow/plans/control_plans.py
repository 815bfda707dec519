"""Queries of runs, logs, caches and parameter checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import runs
from ..operators import inference, spectra, validation
from ..operators import windows as W
from ..sources import states, storage
from . import adapters as A


def stm03(spark, sf):
    """Label counts of oscillations made by a run under a tag, published as a saved state, which is read back."""
    store = states.StateStore(spark, storage.shared_path(spark, "run"))

    def work(run):
        run.step("count")
        counts = A.oscillations(spark, sf).groupBy("channel", "detector").agg(F.count("*").alias("n"))
        run.step("publish")
        return store.save({"counts": counts}, {"algorithm": "hfo"})

    run = runs.Run(spark, work, "counts").start()
    version = run.result()
    return store.restore(version).tables["counts"].withColumn("steps", F.lit(run.progress().steps_done))


def snk12(spark, sf):
    """Three tables written as steps of a log: what the log says of them."""
    log = runs.PerformanceLog(spark, storage.shared_path(spark, "perf"), file_path="tables", sfreq=A.FS)
    for name in ("orders", "lineitem", "events"):
        log.write(name, A.table(spark, sf, name), storage.shared_path(spark, f"perf-{name}"))
    return log.read().select("file_path", "sfreq", "step", "notes", (F.col("elapsed_s").cast("double") > 0).alias("timed"))


CACHE = runs.SegmentCache()


def stm04(spark, sf):
    """Two views of one signal, centred and by envelope, each asked for twice: the second time comes from the cache."""
    source = A.long_signal(spark, sf)
    for _ in range(2):
        centred = CACHE.get(source, ("centred",), W.centred)
        envelope = CACHE.get(source, ("envelope", 50), lambda s: W.envelope(s, 50))
    tops = centred.groupBy("channel").agg(F.round(F.max("x"), 6).alias("top"), F.count("*").alias("n"))
    return tops.join(envelope.groupBy("channel").agg(F.count("*").alias("bins")), "channel")


STM04 = f"""WITH {A.LONG_SIGNAL}, m AS (SELECT channel, median(x) AS mid, count(*) AS n, max(x) AS top, greatest(1, ceil(count(*) / 50.0)) AS width FROM long_signal GROUP BY channel)
SELECT channel, round(top - mid, 6) AS top, n, CAST(ceil(n / width) AS BIGINT) AS bins FROM m"""


def fil21(spark, sf):
    """A parameter set for each part: the first thing that is wrong with it."""
    k, p = F.col("p_partkey"), A.table(spark, sf, "part")
    number = lambda v: v.cast("double")
    entries = lambda pairs: F.map_from_arrays(F.array(*(F.lit(n) for n, _ in pairs)), F.array(*(number(v) for _, v in pairs)))
    one = F.lit(1.0)
    sets = p.select(
        k, F.when(k % 3 == 0, validation.NATIVE_ROUTE).otherwise("ehfo").alias("route"), number(500 + 500 * (k % 4)).alias("fs"), number(F.col("p_size") * 12).alias("low"), (F.col("p_retailprice") / 3).alias("high"), number(k % 29).alias("sigma"),
        number(k % 31).alias("min_ms"), number(k % 37 + 20).alias("max_ms"), number(k % 41 - 1).alias("padding_s"), F.lit(0.0).alias("gap_ms"), number(k % 43).alias("cycles"),
        F.when(k % 47 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("STE"), F.lit("MNI"))).otherwise(F.array(F.lit("Hilbert"))).alias("detectors"),
        entries([(n, number(k % 23) if n == "min_osc" else one) for n in validation.DETECTOR_RULES["ste"]]).alias("ste"),
        entries([(n, (k % 21) / 20.0 if n in ("per_chf", "threshold_percentile") else one) for n in validation.DETECTOR_RULES["mni"] if n != "base_min"] + [("base_min", number(k % 53 - 1))]).alias("mni"),
        entries([("sd_threshold", F.when(k % 11 == 0, float("nan")).otherwise(one)), ("min_window_s", number(k % 60)), ("epoch_len_s", one)]).alias("hilbert"), F.when(k % 5 != 0, number(k % 100)).alias("analysis_s"),
    )
    return sets.select("p_partkey", validation.hfo_problem().alias("problem"))


FIL21 = """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS native, 500.0 + 500 * (p_partkey % 4) AS fs, p_size * 12.0 AS low, p_retailprice / 3 AS high, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 100 END AS a,
  p_partkey % 47 <> 0 AND p_partkey % 2 = 0 AS two, p_partkey % 47 <> 0 AND p_partkey % 2 = 1 AS hil FROM part)
SELECT k AS p_partkey, CASE WHEN low <= 0 OR high <= low THEN 'band edges must rise from above zero' WHEN native AND high > 500 THEN 'the band ends above 500 Hz' WHEN native AND low >= least(high, 0.95 * fs / 2) THEN 'the band starts above what the native rate allows'
  WHEN NOT native AND fs < 1000 THEN 'the recording is sampled below 1000 Hz' WHEN NOT native AND high >= 500 THEN 'the band doesn''t end below 500 Hz' WHEN k % 29 <= 0 THEN 'the threshold must be positive' WHEN k % 31 < 1 THEN 'the least duration is under 1 ms'
  WHEN k % 37 + 20 <= k % 31 THEN 'the greatest duration isn''t above the least' WHEN k % 41 - 1 < 0 THEN 'the padding is negative' WHEN k % 43 < 1 THEN 'less than one cycle' WHEN k % 47 = 0 THEN 'no detector is chosen'
  WHEN two AND k % 23 = 0 THEN 'ste min_osc must be positive' WHEN two AND k % 21 = 0 THEN 'mni per_chf must be share' WHEN two AND k % 21 = 20 THEN 'mni threshold_percentile must be share below 1' WHEN two AND k % 53 - 1 < 0 THEN 'mni base_min must be not negative'
  WHEN hil AND k % 11 = 0 THEN 'hilbert sd_threshold must be positive' WHEN hil AND k % 60 = 0 THEN 'hilbert min_window_s must be positive' WHEN a <= 0 THEN 'the interval must be positive' WHEN k % 31 / 1000.0 >= a THEN 'the least duration isn''t shorter than the interval'
  WHEN (k % 37 + 20) / 1000.0 >= a THEN 'the greatest duration isn''t shorter than the interval' WHEN 2 * (k % 41 - 1) >= a THEN 'the padding leaves nothing of the interval' WHEN two AND 1.0 >= a THEN 'ste min_window_s isn''t shorter than the interval' WHEN hil AND k % 60 >= a THEN 'hilbert min_window_s isn''t shorter than the interval' END AS problem FROM p"""

def fil27(spark, sf):
    """Where the power between 12 and 25 Hz stands out, in windows of two seconds."""
    return spectra.beta_mask(A.long_signal(spark, sf), A.FS, 12.0, 2.0, 3.0).select("channel", "sample", "beta")


def order_model():
    """A model for a test of the hook: mean, greatest value and length of an order's quantities."""
    return lambda x: {"keep": x.mean(1) / 50, "spike": x.max(1) / 50, "ehfo": np.full(len(x), x.shape[1] / 7)}


def dsp26(spark, sf):
    """Orders with their quantities as features; orders without lines aren't scored, but told."""
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_sort(F.collect_list("l_quantity")).alias("waveform"))
    found = inference.scored(li, order_model)
    out = inference.complete(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id")), found)
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in inference.SCORES), "status")


DSP26 = """SELECT o_orderkey AS event_id, round(avg(l_quantity) / 50, 6) AS keep, round(max(l_quantity) / 50, 6) AS spike, round(nullif(count(l_quantity), 0) / 7, 6) AS ehfo, CASE WHEN count(l_quantity) > 0 THEN 'ok' ELSE 'not scored' END AS status
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""

COUNTED = " UNION ALL ".join(f"SELECT 'tables' AS file_path, '{A.FS}' AS sfreq, '{t}' AS step, 'rows=' || count(*) AS notes, true AS timed FROM {t}" for t in ("orders", "lineitem", "events"))

QUERIES = {
    "stm03_tagged_run": (stm03, f"WITH {A.OSCILLATIONS} SELECT channel, detector, count(*) AS n, 2 AS steps FROM oscillations GROUP BY channel, detector"),
    "snk12_performance_log": (snk12, COUNTED),
    "stm04_cached_views": (stm04, STM04),
    "fil21_hfo_validation": (fil21, FIL21),
    "fil27_beta_mask": (fil27, None),
    "dsp26_model_scores": (dsp26, DSP26),
}
