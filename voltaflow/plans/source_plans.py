"""Queries of sources and sinks: written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..functions import classes as C
from ..operators import summaries as S
from ..sources import folders, recordings, results
from . import adapters as A


def scratch(spark, name):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors share no local folder")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/voltaflow-io/{name}-{uuid.uuid4().hex}"


def src05(spark, sf):
    """Write blocks, read a range of samples back."""
    path = scratch(spark, "blocks")
    B.to_blocks(A.long_signal(spark, sf), block=256).write.partitionBy("channel").parquet(path)
    return B.read_range(spark.read.parquet(path), 300, 900, 256).select(F.col("channel").cast("long").alias("channel"), "sample", "x")


def src07(spark, sf):
    raw = A.table(spark, sf, "orders").select(
        F.concat(F.lit("data/sub-"), F.col("o_custkey").cast("string"), F.lit("/run1.edf")).alias("edf_relative_path"), F.lit("0").alias("baseline_start_sec"), F.lit("60").alias("baseline_end_sec"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("string")).otherwise("nan").alias("ictal_start_sec"), (F.col("o_orderkey") + 25).cast("string").alias("ictal_end_sec"),
        F.when(F.col("o_orderkey") % 3 == 0, "yes").otherwise(" ").alias("usable_for_EI"), F.when(F.col("o_orderkey") % 2 == 0, "OK").otherwise("bad").alias("segment_status"),
    )
    path = scratch(spark, "segments")
    results.write_csv(raw, path)
    rows = results.segments(results.read_csv(spark, path))
    drop = results.exclusions(A.table(spark, sf, "nation").select(F.concat(F.lit("sub-"), F.col("n_nationkey").cast("string")).alias("patient_id"), F.col("n_name").alias("reason"), "n_nationkey"), F.col("n_nationkey"))
    return results.batch_status(rows, drop).groupBy("status", "subject").agg(F.count("*").alias("n"))


SRC07 = """WITH r AS (SELECT 'sub-' || o_custkey AS subject, o_custkey, o_orderkey % 5 = 0 AS broken, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AS valid FROM orders)
SELECT CASE WHEN n_nationkey IS NOT NULL THEN 'skipped' WHEN NOT valid THEN 'invalid' WHEN broken THEN 'error' ELSE 'ready' END AS status, subject, count(*) AS n FROM r LEFT JOIN nation ON n_nationkey = o_custkey GROUP BY ALL"""


def src08(spark, sf):
    """Several reasons for a patient, some rows without an id: the last reason by order key counts."""
    patient = F.when(F.col("o_orderkey") % 10 == 0, " ").otherwise(F.concat(F.lit("sub-"), F.col("o_custkey").cast("string")))
    raw = A.table(spark, sf, "orders").select(patient.alias("patient_id"), F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").cast("string").alias("line"))
    path = scratch(spark, "exclusions")
    results.write_csv(raw, path)
    return results.exclusions(results.read_csv(spark, path), F.col("line").cast("long"))


def src14(spark, sf):
    o = A.oscillations(spark, sf)
    raw = o.select(F.when(F.col("start") % 2 == 0, F.col("event_id")).alias("event_id"), "channel", (F.col("start") / 1000.0).alias("start_time_s"), (F.col("end") / 1000.0).alias("end_time_s"), F.col("low_hz").alias("low_freq_hz"), "manual_class", F.col("model_class").alias("final_model_class"))
    path = scratch(spark, "hfo")
    results.write_csv(raw, path)
    out = results.export_hfo(results.hfo_events(results.read_csv(spark, path)))
    return out.groupBy("channel", "official_class", "manual_review_status").agg(F.count("*").alias("n"), F.sum("start_sample").alias("starts"), F.round(F.sum("duration_ms"), 3).alias("ms"), F.sum("low_freq_hz").alias("low"))


def src15(spark, sf):
    s = A.spikes(spark, sf).select("channel", F.col("event_id").alias("sample0"), "power", "duration")
    path = scratch(spark, "gamma")
    results.write_csv(results.export_gamma(s, A.FS), path)
    return results.gamma_events(results.read_csv(spark, path)).select(F.col("channel").cast("long").alias("channel"), "sample0", F.round("time_s", 6).alias("time_s"), "power", "duration")


def src17(spark, sf, width=20):
    """Whole channels in stretches of `width` samples, one row of the wide table each, so that the columns stay few."""
    s = A.signal(spark, sf)
    part, start = F.floor(F.col("sample") / width), F.split_part("channel", F.lit("@"), F.lit(-1)).cast("long") * width
    rows = s.select(F.concat_ws("@", "channel", part.cast("string")).alias("channel"), ((F.col("sample") % width) / A.FS).alias("t_s"), F.col("x").alias("hfer"))
    path = scratch(spark, "heat")
    results.write_csv(results.heatmap_wide(rows, [i / A.FS for i in range(width)]), path)
    back = results.heatmap_long(results.read_csv(spark, path)).withColumn("sample", start + F.round(F.col("t_s") * A.FS).cast("long"))
    back = back.select(F.regexp_replace("channel", "@[0-9]+$", "").alias("channel"), "sample", (F.col("sample") / A.FS).alias("t_s"), "hfer")
    n = s.groupBy("channel").agg(F.count("*").alias("n"))  # the last stretch of a channel has empty cells
    back = back.join(n, "channel").where(F.col("sample") < F.col("n"))
    return results.heatmap_display(back, -5.0, 0.0).select("channel", F.round("t", 6).alias("t"), F.round("level", 6).alias("level"))


def src01(spark, sf):
    """Write a small EDF file with Spark-readable bytes, read it back, and summarise its channels."""
    n = A.table(spark, sf, "nation").count()  # the file's channels: one a nation
    chans = [(f"CH{i}", 100.0 * np.sin(2 * np.pi * (i + 1) * np.arange(500) / 100)) for i in range(min(n, 25))]
    path = scratch(spark, "edf")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/a.edf")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(recordings.encode_edf(chans, 100)))
    stream.close()
    out = B.from_blocks(recordings.read_edf(spark, path, 128), ("channel", "ch_idx", "fs"))
    return out.groupBy("channel", "ch_idx", "fs").agg(F.count("*").alias("n"), F.round(F.max("x"), 0).alias("top"))


def src06(spark, sf):
    p = A.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 10.0).alias("n_samps"), F.lit(2.0).alias("record_s"), F.lit(512.0).alias("file_fs"))
    return recordings.native_rates(p).select("p_partkey", "native_fs")


def scores(spark, sf):
    """Suppliers as channels with a score, a rank and an onset (NaN for some), lineitem as their heatmap of 7 columns."""
    s = A.table(spark, sf, "supplier")
    onset = F.when(F.col("s_suppkey") % 4 == 0, float("nan")).otherwise(F.col("s_suppkey") / 8.0)
    rows = s.select(F.col("s_name").alias("channel"), F.when(F.col("s_nationkey") % 3 != 0, F.concat(F.lit("g"), F.col("s_nationkey").cast("string"))).alias("grp"), F.col("s_acctbal").alias("ei"), F.col("s_suppkey").cast("long").alias("rank"), onset.alias("onset"))
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("v"))
    value = F.when((F.col("s_suppkey") + F.col("k")) % 5 == 0, float("nan")).otherwise(F.col("v"))
    return rows, li.join(s.select("s_suppkey", "s_name"), "s_suppkey").select(F.col("s_name").alias("channel"), (F.col("k") / 4.0).alias("t_s"), value.alias("hfer"))


def rei_folder(spark, sf):
    rows, heat = scores(spark, sf)
    path = scratch(spark, "rei")
    folders.export_rei(spark, path, rows, heat, [k / 4 for k in range(1, 8)], {"sampling_frequency_hz": 100.0, "threshold_sigma": float("nan")})
    return folders.open_folder(spark, path)


def snk01(spark, sf):
    return folders.rei_summary(*scores(spark, sf))


def src16(spark, sf):
    """Written to a folder and read back: the summary with its heatmap's sum and number of finite cells."""
    kind, tables, meta = rei_folder(spark, sf)
    cells = tables["heatmap"].where("not isnan(hfer)").groupBy("channel").agg(F.count("hfer").alias("cells"), F.round(F.sum("hfer"), 3).alias("total"))
    return tables["summary"].join(cells, "channel", "left").withColumns({"kind": F.lit(kind), "sigma": F.lit(meta["threshold_sigma"]).cast("double")})


SCORES = """scores AS (SELECT s_suppkey, s_name AS channel, CASE WHEN s_nationkey % 3 <> 0 THEN 'g' || s_nationkey ELSE '' END AS grp, s_acctbal AS ei, CAST(s_suppkey AS BIGINT) AS rank, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey / 8.0::DOUBLE END AS onset FROM supplier),
heat AS (SELECT l_suppkey AS s_suppkey, l_linenumber AS k, CASE WHEN (l_suppkey + l_linenumber) % 5 <> 0 THEN sum(l_quantity) END AS v FROM lineitem GROUP BY 1, 2)"""
SNK01 = f"""WITH {SCORES} SELECT channel, any_value(grp) AS "group", any_value(ei) AS ei_score, any_value(rank) AS rank, any_value(onset) AS onset_sec_from_seizure_onset, max(v) AS peak_hfer_activity FROM scores LEFT JOIN heat USING (s_suppkey) GROUP BY channel"""
SRC16 = f"""WITH {SCORES}, c AS (SELECT s_suppkey, count(v) AS cells, round(sum(v), 3) AS total FROM heat WHERE v IS NOT NULL GROUP BY s_suppkey)
SELECT channel, grp, ei, rank, CAST(round_even(coalesce(onset, 0) * 100, 0) AS BIGINT) AS onset_sample, coalesce(onset, 0) AS onset, cells, total, 'rei' AS kind, NULL::DOUBLE AS sigma FROM scores LEFT JOIN c USING (s_suppkey)"""


def spike_rows(spark, sf):
    s = A.spikes(spark, sf)
    at = F.col("event_id")
    return s.select(
        F.concat(F.lit("c"), F.col("channel").cast("string")).alias("channel"), at.alias("sample0"), F.when(at % 3 != 0, at - 20).alias("p1"), F.when(at % 3 != 0, at).alias("n1"), F.when(at % 3 == 1, at + 40).alias("n2"),
        "power", (at % 70 + 30.0).alias("freq"), "duration", "manual_class", F.lit(None).cast("string").alias("status"), F.when(at % 3 == 0, "no boundary").alias("error"),
    )


def snk04(spark, sf):
    out = folders.gamma_export(spike_rows(spark, sf), A.FS, 2.0)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


SNK04 = f"""WITH {A.SPIKES}, e AS (SELECT 'c' || channel AS channel, event_id AS s, CASE WHEN event_id % 3 <> 0 THEN event_id - 20 END AS p1, CASE WHEN event_id % 3 <> 0 THEN event_id END AS n1, CASE WHEN event_id % 3 = 1 THEN event_id + 40 END AS n2,
  CASE WHEN NOT isnan(power) THEN power END AS power, duration, manual_class, event_id % 70 + 30.0::DOUBLE AS freq FROM spikes),
g AS (SELECT *, coalesce(power IS NOT NULL AND duration IS NOT NULL AND (power > 0 OR duration > 0), false) AS is_gamma FROM e)
SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY s) AS event_number, s + 1 AS sample, round(2.0 + (s + 1) / 100.0, 6)::DOUBLE AS time_s, is_gamma, CASE WHEN is_gamma THEN 'gamma' ELSE 'non-gamma' END AS model_class,
  coalesce(nullif(trim(manual_class), ''), CASE WHEN is_gamma THEN 'gamma' ELSE 'non-gamma' END) AS official_class, p1 + 1 AS boundary_p1_sample, n1 + 1 AS boundary_n1_sample, n2 + 1 AS boundary_n2_sample,
  round(2.0 + (p1 + 1) / 100.0, 6)::DOUBLE AS boundary_p1_time_s, round(2.0 + (n1 + 1) / 100.0, 6)::DOUBLE AS boundary_n1_time_s, round(2.0 + (n2 + 1) / 100.0, 6)::DOUBLE AS boundary_n2_time_s,
  round(power, 6) AS gamma_power, freq AS gamma_frequency_hz, round(duration, 6) AS gamma_duration_ms, manual_class, 'unreviewed' AS manual_review_status, CASE WHEN s % 3 = 0 THEN 'no boundary' END AS error FROM g"""


def src15_summary(spark, sf):
    """Spikes and a summary of some channels written to a folder and read back: counts from the summary where it has the channel."""
    rows = spike_rows(spark, sf)
    path = scratch(spark, "gamma-folder")
    results.write_csv(folders.gamma_export(rows, A.FS, 2.0), f"{path}/{folders.FILES['gamma'][0]}")
    official = rows.withColumn("official", C.gamma_class(C.official_class(F.col("manual_class"), F.when(C.is_gamma(F.col("power"), F.col("duration")), "gamma").otherwise("non-gamma"))))
    channels = rows.groupBy("channel").agg((F.count("*") + 3).alias("spike_count")).where("spike_count % 2 = 0").unionByName(spark.createDataFrame([("silent", 0)], "channel string, spike_count long"))
    results.write_csv(folders.gamma_summary_export(S.gamma_summary(channels, official)), f"{path}/{folders.FILES['gamma'][1]}")
    folders.write_metadata(spark, path, "gamma", {"fs": A.FS, "data_start_s": 2.0})
    _, tables, _ = folders.open_folder(spark, path)
    ends = tables["events"].groupBy("channel").agg(F.sum("sample0").cast("long").alias("samples"), F.round(F.sum("time_s"), 3).alias("seconds"), F.sum("n2").cast("long").alias("n2"))
    return tables["channels"].join(ends, "channel", "left")


SRC15 = f"""WITH {A.SPIKES}, c AS (SELECT 'c' || channel AS channel, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS samples, round(sum(2.0 + (event_id + 1) / 100.0), 3)::DOUBLE AS seconds, CAST(sum(CASE WHEN event_id % 3 = 1 THEN event_id + 40 END) AS BIGINT) AS n2 FROM spikes GROUP BY channel)
SELECT channel, CASE WHEN (n + 3) % 2 = 0 THEN n + 3 ELSE n END AS spike_count, n AS n_events, samples, seconds, n2 FROM c UNION ALL SELECT 'silent', 0, 0, NULL, NULL, NULL"""

QUERIES = {
    "src15_gamma_folder": (src15_summary, SRC15),
    "src16_rei_folder": (src16, SRC16),
    "snk01_rei_summary": (snk01, SNK01),
    "snk04_gamma_events": (snk04, SNK04),
    "src01_edf": (src01, None),
    "src05_block_range": (src05, f"WITH {A.LONG_SIGNAL} SELECT channel, sample, x FROM long_signal WHERE sample >= 300 AND sample < 900"),
    "src06_native_rate": (src06, "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size * 5.0 ELSE 512.0 END::DOUBLE AS native_fs FROM part"),
    "src07_segments_batch": (src07, SRC07),
    "src08_exclusions": (src08, "SELECT 'sub-' || o_custkey AS patient_id, arg_max(o_orderpriority, o_orderkey) AS reason FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1"),
    "src14_hfo_import_export": (src14, f"WITH {A.OSCILLATIONS}, o AS (SELECT *, coalesce(nullif(trim(manual_class), ''), nullif(model_class, '')) AS c, CASE WHEN manual_class IS NULL THEN 'unreviewed' WHEN manual_class = 'deleted' THEN 'deleted' ELSE 'reviewed' END AS manual_review_status FROM oscillations), k AS (SELECT *, replace(lower(coalesce(c, '')), '_', '-') AS k FROM o) SELECT channel, CASE WHEN k IN ('hfo', 'real-hfo', 'non-spike hfo') THEN 'HFO' WHEN k IN ('spike-hfo', 'spkhfo') THEN 'spike-HFO' WHEN k = 'ehfo' THEN 'eHFO' WHEN k = 'spike-ehfo' THEN 'spike-eHFO' WHEN contains(k, 'artifact') THEN 'artifact' WHEN k IN ('deleted', 'excluded') THEN 'deleted' ELSE 'candidate' END AS official_class, manual_review_status, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, round(sum(\"end\" - start), 3)::DOUBLE AS ms, sum(coalesce(low_hz, 80.0)) AS low FROM k GROUP BY ALL"),
    "src15_gamma_round_trip": (src15, f"WITH {A.SPIKES} SELECT channel, event_id AS sample0, round((event_id + 1) / 100.0, 6)::DOUBLE AS time_s, CASE WHEN NOT isnan(power) THEN power END AS power, CASE WHEN NOT isnan(duration) THEN duration END AS duration FROM spikes"),
    "src17_heatmap": (src17, f"WITH {A.SIGNAL} SELECT channel, round(sample / 100.0 - 5.0, 6)::DOUBLE AS t, round(log10(greatest(x, 1e-6)), 6) AS level FROM signal"),
}
