"""Queries of saved states, batch output and recordings as a data source: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch
from ..operators import blocks as B
from ..sources import edf_source, states, storage
from . import adapters as A


def run_state(spark, sf, reviewed):
    """Oscillations as a run's result: some without id, channel, end, band or peak, some with numbers that aren't finite."""
    o, k = A.oscillations(spark, sf), F.col("start")
    return o.select(
        k.alias("ord"), F.when(k % 3 != 0, F.col("event_id")).alias("event_id"), F.when(k % 17 != 0, F.col("channel")).otherwise("").alias("channel"), "detector", k.alias("start_sample"), F.col("end").alias("end_sample"),
        (k / 1000.0).alias("start_time_s"), F.when(k % 5 != 0, F.col("end") / 1000.0).alias("end_time_s"), F.when(k % 4 == 0, k / 1000.0).alias("peak_time_s"), F.col("low_hz").alias("low_freq_hz"),
        F.when(k % 7 == 0, float("nan")).otherwise(F.col("p_artifact")).alias("artifact_probability"), F.when(k % 2 == 0, F.col("model_class")).alias("final_model_class"),
        (F.col("manual_class") if reviewed else F.lit(None).cast("string")).alias("manual_class"), F.when(F.col("manual_class").isNotNull() & F.lit(reviewed), "reviewed").alias("manual_review_status"),
    )


def saved_states(spark, sf):
    """A store with two versions: a run, and the same run reviewed."""
    store = states.StateStore(spark, storage.shared_path(spark, "states"))
    listed = A.table(spark, sf, "nation").select(F.concat(F.lit("ch"), F.col("n_nationkey").cast("string")).alias("channel"), (100 - F.col("n_nationkey")).alias("ordinal"))
    for reviewed in (False, True):
        store.save({"oscillations": states.saved_oscillations(run_state(spark, sf, reviewed)), "channels": listed}, {"algorithm": "hfo", "hfo": {"params": {"reviewed": reviewed}}})
    return store


def snk10(version):
    def run(spark, sf):
        snapshot = saved_states(spark, sf).restore(version, verify=True)
        out = states.read_oscillations(snapshot.tables["oscillations"])
        kept = ["ord", "event_id", "channel", "detector", "start_sample", "end_sample", "start_time_s", "end_time_s", "peak_time_s", "low_freq_hz", "high_freq_hz", "artifact_probability", "final_model_class", "manual_class", "manual_review_status"]
        rounded = [F.round(c, 6).alias(c) if c.endswith("_s") else F.col(c) for c in kept]
        return out.select(*rounded, F.round("duration_ms", 3).alias("duration_ms"), F.lit(snapshot.version).alias("version"), F.lit(snapshot.parameters["hfo"]["params"]["reviewed"]).alias("reviewed"))

    return run


def snk10_sql(version, reviewed):
    return f"""WITH {A.OSCILLATIONS}, r AS (
  SELECT *, start AS ord, start / 1000.0::DOUBLE AS t0, CASE WHEN start % 5 <> 0 THEN "end" ELSE start END / 1000.0::DOUBLE AS t1, {"manual_class" if reviewed else "NULL::VARCHAR"} AS manual FROM oscillations WHERE start % 17 <> 0)
SELECT ord, CASE WHEN ord % 3 <> 0 THEN event_id ELSE format('hfo_{{:06d}}', ord) END AS event_id, channel, detector, ord AS start_sample, "end" AS end_sample, round(t0, 6) AS start_time_s, round(t1, 6) AS end_time_s,
  round(CASE WHEN ord % 4 = 0 THEN t0 ELSE t0 + greatest(0, t1 - t0) / 2 END, 6) AS peak_time_s, coalesce(low_hz, 80.0) AS low_freq_hz, 300.0::DOUBLE AS high_freq_hz, CASE WHEN ord % 7 <> 0 THEN p_artifact END AS artifact_probability,
  CASE WHEN ord % 2 = 0 THEN nullif(trim(model_class), '') END AS final_model_class, manual AS manual_class, CASE WHEN manual IS NULL THEN 'unreviewed' ELSE 'reviewed' END AS manual_review_status,
  round(greatest(0, t1 - t0) * 1000, 3) AS duration_ms, {version} AS version, {str(reviewed).lower()} AS reviewed FROM r"""


def snk10_channels(spark, sf):
    snapshot = saved_states(spark, sf).restore()
    return states.restored_channels(states.read_oscillations(snapshot.tables["oscillations"]), snapshot.tables["channels"])


SNK10_CHANNELS = f"""WITH {A.OSCILLATIONS}, c AS (SELECT channel, count(*) AS event_count, min(start) AS first FROM oscillations WHERE start % 17 <> 0 GROUP BY channel)
SELECT channel, row_number() OVER (ORDER BY 100 - n_nationkey NULLS LAST, first, channel) AS place, event_count FROM c LEFT JOIN nation ON channel = 'ch' || n_nationkey"""

#: Samples a second of the batch's recordings.
RATE = 4.0


def batch_inputs(spark, sf):
    """Orders as segments, suppliers as recordings (some orders name none that is there), lineitem as their channels."""
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("data/sub-"), (F.col("o_custkey") % 130).cast("string"), F.lit("/run1.edf"))
    at = lambda v: v.cast("string")
    raw = o.select(
        k.cast("long").alias("row"), F.when(k % 19 != 0, path).alias("edf_relative_path"), F.when(k % 4 == 0, F.concat(F.lit("/elsewhere/"), path)).alias("edf_full_path"),
        F.lit("0").alias("baseline_start_sec"), F.when(k % 23 == 0, "none").otherwise(at(F.lit(8.0) - 9 * (k % 29 == 0).cast("int"))).alias("baseline_end_sec"), at(6.0 + k % 5).alias("ictal_start_sec"), at(12.0 + k % 7).alias("ictal_end_sec"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("no").alias("usable_for_EI"), F.col("o_orderpriority").alias("qc_note"), F.lit("30").alias("duration_sec"), at(k % 33).alias("seizure_onset_relative_sec"), at(k % 33 + k % 11 - 1).alias("seizure_offset_relative_sec"),
    )
    excluded = A.table(spark, sf, "nation").select(F.concat(F.lit("sub-"), (F.col("n_nationkey") * 5).cast("string")).alias("patient_id"), F.col("n_name").alias("reason"))
    order = ["l_shipdate", "l_orderkey", "l_partkey"]
    li = A.table(spark, sf, "lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("key"), F.concat(F.lit("data/sub-"), F.col("l_suppkey").cast("string"), F.lit("/run1.edf")).alias("path"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("channel"), F.col("l_quantity").alias("x"), *order)
    signal = B.numbered(li, "key", F.trunc("l_shipdate", "month"), order).select("path", "channel", "sample", "x")
    sizes = li.groupBy("path", "key").agg(F.count("*").alias("n"))
    recordings = sizes.groupBy("path").agg(F.max("n").alias("n_samples")).withColumns({"native_fs": F.lit(RATE), "fs": F.lit(RATE)})
    return raw, excluded, recordings, signal


def batch_folder(spark, sf):
    folder = storage.shared_path(spark, "rei-batch")
    batch.run_batch(spark, folder, *batch_inputs(spark, sf), exclude_channels="^c7$")
    return folder


def snk11(spark, sf):
    out = spark.read.parquet(f"{batch_folder(spark, sf)}/results")
    kept = ["channel", "EI_rank_desc", "channel_onset_sample_in_ictal_window", "channel_onset_sec_in_ictal_window", "subject", "run", "edf_file", "ictal_start_sec", "ictal_end_sec", "excluded_channel_count"]
    return out.select(F.col("row").cast("long").alias("row"), F.round("EI", 6).alias("EI"), *kept)


def snk11_log(spark, sf):
    log = batch.last_status(batch.read_log(spark, batch_folder(spark, sf)))
    return log.select("row", "status", F.coalesce("reason", F.lit("")).alias("reason"), "edf", F.coalesce("subject", F.lit("")).alias("subject"), "n_channels")


BATCH = """o AS (
  SELECT o_orderkey AS row, CASE WHEN o_orderkey % 19 <> 0 THEN 'data/sub-' || (o_custkey % 130) || '/run1.edf' END AS rel, CASE WHEN o_orderkey % 4 = 0 THEN '/elsewhere/data/sub-' || (o_custkey % 130) || '/run1.edf' END AS ful, o_custkey % 130 AS sub,
    CASE WHEN o_orderkey % 29 = 0 THEN -1.0 ELSE 8.0 END AS be, o_orderkey % 23 = 0 AS broken, 6.0 + o_orderkey % 5 AS i_s, 12.0 + o_orderkey % 7 AS i_e, o_orderpriority AS note, o_orderkey % 33 AS onset, o_orderkey % 33 + o_orderkey % 11 - 1 AS offs FROM orders),
sig AS (SELECT l_suppkey AS sub, l_linenumber AS ch, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY {order}) - 1 AS sample, l_quantity AS x FROM lineitem),
rec AS (SELECT sub, max(sample) + 1 AS n, count(DISTINCT ch) FILTER (ch = 7) AS dropped FROM sig GROUP BY sub),
a AS (
  SELECT o.*, coalesce('sub-' || CASE WHEN rel IS NOT NULL OR ful IS NOT NULL THEN o.sub END, '') AS subject, n_name, rec.n, dropped, least(n, CAST(greatest(0, be * 4) AS BIGINT)) AS b1, least(n, CAST(i_s * 4 AS BIGINT)) AS i0, least(n, CAST(i_e * 4 AS BIGINT)) AS i1
  FROM o LEFT JOIN nation ON n_nationkey * 5 = o.sub AND (rel IS NOT NULL OR ful IS NOT NULL) LEFT JOIN rec ON rec.sub = o.sub AND rel IS NOT NULL),
problems AS (SELECT row, array_to_string(list_filter([CASE WHEN onset > 30 THEN 'onset exceeds recording duration' END, CASE WHEN offs > 30 THEN 'offset exceeds recording duration' END, CASE WHEN offs <= onset THEN 'offset isn''t after onset' END], lambda t: t IS NOT NULL), '; ') AS p FROM o),
judged AS (
  SELECT a.*, CASE WHEN n_name IS NOT NULL THEN 'patient excluded from the index | ' || n_name WHEN note <> '1-URGENT' THEN 'usable_for_EI is false | ' || note WHEN p <> '' THEN p END AS skip,
    CASE WHEN rel IS NULL AND ful IS NULL THEN 'no recording is named' WHEN n IS NULL AND rel IS NULL THEN 'no recording is named' WHEN n IS NULL THEN 'missing recording: ' || rel WHEN broken THEN 'a window''s edge isn''t a number'
      WHEN b1 <= 0 THEN 'invalid baseline window: (0, ' || b1 || ')' WHEN i1 <= i0 THEN 'invalid ictal window: (' || i0 || ', ' || i1 || ')' END AS err FROM a JOIN problems USING (row)),
ready AS (SELECT * FROM judged WHERE skip IS NULL AND err IS NULL),
seg AS (SELECT row, ch, 'baseline' AS segment, sample AS n, x FROM ready JOIN sig USING (sub) WHERE ch <> 7 AND sample < b1 UNION ALL SELECT row, ch, 'ictal', sample - i0, x FROM ready JOIN sig USING (sub) WHERE ch <> 7 AND sample >= i0 AND sample < i1),
energy AS (SELECT row, ch, segment, n, sum(x * x) OVER (PARTITION BY row, ch, segment ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS e FROM seg),
base AS (SELECT row, ch, avg(e) AS m, max(e) AS top, stddev_samp(e) AS sd FROM energy WHERE segment = 'baseline' GROUP BY row, ch),
hfer AS (SELECT row, ch, n, e / m AS h, top / m + 10.0 * (sd / m) AS thr FROM energy JOIN base USING (row, ch) WHERE segment = 'ictal'),
onset AS (SELECT row, ch, coalesce(min(n) FILTER (h > thr), max(n) + 1) AS onset, max(n) + 1 AS len FROM hfer GROUP BY row, ch),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY onset, ch) AS k, min(onset) OVER (PARTITION BY row) AS first FROM onset),
mag AS (SELECT row, ch, avg(h) AS mag, any_value(k) AS k, any_value(ranked.onset) AS onset FROM ranked JOIN hfer USING (row, ch) WHERE n >= least(first, len - 1) AND n < least(len, least(first, len - 1) + 1) GROUP BY row, ch),
raw AS (SELECT *, sqrt(mag * CAST(CAST(1 AS FLOAT) / CAST(k AS FLOAT) AS DOUBLE)) AS raw FROM mag),
scored AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY row) > 0 THEN raw / max(raw) OVER (PARTITION BY row) ELSE raw END AS ei FROM raw)"""
BATCH = BATCH.format(order="l_shipdate, l_orderkey, l_partkey")
SNK11 = f"""WITH {BATCH} SELECT row, round(ei, 6) AS "EI", 'c' || ch AS channel, rank() OVER (PARTITION BY row ORDER BY ei DESC) AS "EI_rank_desc", scored.onset AS channel_onset_sample_in_ictal_window, scored.onset / 4.0::DOUBLE AS channel_onset_sec_in_ictal_window,
  subject, CAST(row + 1 AS VARCHAR) AS run, rel AS edf_file, i_s::DOUBLE AS ictal_start_sec, i_e::DOUBLE AS ictal_end_sec, dropped AS excluded_channel_count FROM scored JOIN ready USING (row)"""
SNK11_LOG = f"""WITH {BATCH} SELECT row, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN err IS NOT NULL OR k IS NULL THEN 'error' ELSE 'ok' END AS status, coalesce(skip, err, CASE WHEN k IS NULL THEN 'no channel has samples in both windows' ELSE '' END) AS reason,
  CASE WHEN n IS NULL AND rel IS NULL THEN NULL ELSE rel END AS edf, subject, k AS n_channels FROM judged LEFT JOIN (SELECT row, count(*) AS k FROM scored GROUP BY row) USING (row)"""


def edf_folder(spark, sf):
    """Lineitem as EDF files: a recording a line number, eight channels each, 100 samples a second."""
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey"]
    li = A.table(spark, sf, "lineitem").select((F.col("l_linenumber") * 10 + F.col("l_suppkey") % 8).alias("key"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("recording"), F.concat(F.lit("CH"), (F.col("l_suppkey") % 8).cast("string")).alias("channel"), F.col("l_quantity").alias("x"), *order)
    signal = B.numbered(li, "key", F.trunc("l_shipdate", "month"), order).select("recording", "channel", "sample", "x")
    path = storage.shared_path(spark, "edf")
    edf_source.write_recordings(signal, path, 100)
    return path, signal


def samples(blocks):
    return blocks.select("recording", "channel", "start_sample", F.posexplode("x").alias("i", "x")).select("recording", "channel", (F.col("start_sample") + F.col("i")).alias("sample"), "x")


def src01_source(spark, sf):
    """Written as EDF files and read back in ranges; what fills a channel's last record up is 0 and goes."""
    path, signal = edf_folder(spark, sf)
    ends = signal.groupBy("recording", "channel").agg(F.max("sample").alias("end"))
    back = samples(edf_source.read_recordings(spark, path, task_bytes=4096)).join(ends, ["recording", "channel"]).where("sample <= end")
    return back.select("recording", "channel", "sample", F.round("x").alias("x"))


SRC01 = """SELECT 'r' || l_linenumber AS recording, 'CH' || (l_suppkey % 8) AS channel, row_number() OVER (PARTITION BY l_linenumber, l_suppkey % 8 ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey) - 1 AS sample, l_quantity::DOUBLE AS x FROM lineitem"""


def src04(spark, sf):
    """The files at half their rate."""
    path, _ = edf_folder(spark, sf)
    out = samples(edf_source.resampled(edf_source.read_recordings(spark, path, task_bytes=4096), 50.0, length=200))
    return out.select("recording", "channel", "sample", F.round("x", 6).alias("x"))


QUERIES = {
    "snk10_state_newest": (snk10(None), snk10_sql(2, True)),
    "snk10_state_version": (snk10(1), snk10_sql(1, False)),
    "snk10_state_channels": (snk10_channels, SNK10_CHANNELS),
    "snk11_batch_results": (snk11, SNK11),
    "snk11_batch_log": (snk11_log, SNK11_LOG),
    "src01_edf_source": (src01_source, SRC01),
    "src04_edf_resampled": (src04, None),
}
