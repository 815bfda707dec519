"""Queries of written oscillations, metadata documents, route facts and review lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..operators import reviews
from ..sources import folders, metadata, results, storage
from . import adapters as A
from .run_plans import run_state

DOCUMENT = '{"detector_version": " eHFO ", "analysis_window_s": [30, 630.0], "input_fs": 2000, "effective_high_freq_hz": 300.0, "detection_fs": NaN, "band_label": "a \\"NaN\\", b"}'


def hfo_folder(spark, sf):
    path = storage.shared_path(spark, "hfo-folder")
    events = run_state(spark, sf, True).withColumn("boundary_warning", F.col("start_sample") % 9 == 0)
    channels = events.select("channel").unionByName(A.table(spark, sf, "nation").select(F.concat(F.lit("silent"), F.col("n_nationkey").cast("string")).alias("channel")))
    folders.export_hfo_folder(spark, path, channels, events, DOCUMENT)
    return path


def snk05_events(spark, sf):
    raw = results.read_csv(spark, f"{hfo_folder(spark, sf)}/hfo_events.csv")
    assert raw.columns == folders.HFO_EVENTS
    return raw.select(
        "event_id", F.coalesce("channel", F.lit("")).alias("channel"), F.round(F.col("start_time_s").cast("double"), 6).alias("start_time_s"), "detector", F.col("boundary_warning").cast("boolean").alias("boundary_warning"), F.col("artifact_probability").cast("double").alias("artifact_probability"),
        F.coalesce("final_model_class", F.lit("")).alias("final_model_class"), "official_class", "manual_review_status", F.col("effective_high_freq_hz").cast("double").alias("effective_high_freq_hz"), F.col("input_sampling_frequency_hz").cast("double").alias("input_sampling_frequency_hz"), "detection_sampling_frequency_hz",
    )


EVENTS = f"""{A.OSCILLATIONS}, e AS (SELECT *, replace(lower(coalesce(nullif(trim(manual_class), ''), CASE WHEN start % 2 = 0 THEN model_class END, '')), '_', '-') AS k FROM oscillations),
w AS (SELECT *, CASE WHEN k IN ('hfo', 'real-hfo', 'non-spike hfo') THEN 'HFO' WHEN k IN ('spike-hfo', 'spkhfo') THEN 'spike-HFO' WHEN k = 'ehfo' THEN 'eHFO' WHEN k = 'spike-ehfo' THEN 'spike-eHFO' WHEN contains(k, 'artifact') THEN 'artifact' WHEN k IN ('deleted', 'excluded') THEN 'deleted' ELSE 'candidate' END AS official,
  CASE WHEN start % 17 <> 0 THEN channel ELSE '' END AS ch, start % 9 = 0 AS edge FROM e)"""
SNK05_EVENTS = f"""WITH {EVENTS} SELECT CASE WHEN start % 3 <> 0 THEN event_id ELSE format('hfo_{{:06d}}', start) END AS event_id, ch AS channel, round(start / 1000.0, 6)::DOUBLE AS start_time_s, detector, edge AS boundary_warning, CASE WHEN start % 7 <> 0 THEN p_artifact END AS artifact_probability,
  coalesce(CASE WHEN start % 2 = 0 THEN model_class END, '') AS final_model_class, official AS official_class, CASE WHEN manual_class IS NULL THEN 'unreviewed' ELSE 'reviewed' END AS manual_review_status, 300.0::DOUBLE AS effective_high_freq_hz, 2000.0::DOUBLE AS input_sampling_frequency_hz, NULL::VARCHAR AS detection_sampling_frequency_hz FROM w"""


def snk05_summary(spark, sf):
    raw = results.read_csv(spark, f"{hfo_folder(spark, sf)}/hfo_channel_summary.csv")
    assert raw.columns == folders.HFO_SUMMARY
    return raw.select(*(F.coalesce("channel", F.lit("")).alias("channel") if c == "channel" else F.col(c).cast("long").alias(c) if c.endswith("_count") else F.round(F.col(c).cast("double"), 6).alias(c) for c in raw.columns))


SNK05_SUMMARY = f"""WITH {EVENTS}, c AS (SELECT DISTINCT ch AS channel FROM w UNION SELECT 'silent' || n_nationkey FROM nation),
n AS (SELECT c.channel, count(*) FILTER (official <> 'deleted') AS candidate_count, count(*) FILTER (official IN ('HFO', 'spike-HFO', 'eHFO', 'spike-eHFO')) AS accepted_hfo_count, count(*) FILTER (official = 'HFO') AS non_spike_hfo_count, count(*) FILTER (official = 'spike-HFO') AS spike_hfo_count,
  count(*) FILTER (official = 'eHFO') AS ehfo_count, count(*) FILTER (official = 'spike-eHFO') AS spike_ehfo_count, count(*) FILTER (official = 'artifact') AS artifact_count, count(*) FILTER (official = 'deleted') AS deleted_event_count, count(*) FILTER (official <> 'deleted' AND edge) AS boundary_event_count FROM c LEFT JOIN w ON w.ch = c.channel GROUP BY c.channel)
SELECT *, round(candidate_count / 10.0, 6)::DOUBLE AS candidate_rate_per_min, round(accepted_hfo_count / 10.0, 6)::DOUBLE AS accepted_hfo_rate_per_min, round(non_spike_hfo_count / 10.0, 6)::DOUBLE AS non_spike_hfo_rate_per_min, round(spike_hfo_count / 10.0, 6)::DOUBLE AS spike_hfo_rate_per_min,
  round(ehfo_count / 10.0, 6)::DOUBLE AS ehfo_rate_per_min, round(spike_ehfo_count / 10.0, 6)::DOUBLE AS spike_ehfo_rate_per_min, round(CASE WHEN candidate_count > 0 THEN 100.0::DOUBLE * artifact_count / candidate_count ELSE 0 END, 6) AS artifact_percentage FROM n"""


def snk06(spark, sf):
    """Metadata documents of parts: what is written of them, and how many keys."""
    p, k = A.spread(A.table(spark, sf, "part").select("p_partkey")), F.col("p_partkey").cast("string")
    n = F.col("p_partkey")
    doc = F.concat(
        F.lit('{"fs": '), F.when(n % 3 == 0, "NaN").when(n % 3 == 1, "-Infinity").otherwise(k), F.lit(', "input_fs": '), k, F.lit(', "notch_modes": '), F.when(n % 2 == 0, '["50 Hz", NaN]').otherwise("[]"), F.lit(', "total_events": '), F.when(n % 5 == 0, "null").otherwise(k),
        F.lit(', "notch_filter": '), F.when(n % 7 == 0, "true").otherwise("false"), F.lit(', "unknown": 1, "band_label": "NaN, '), k, F.lit('"'), F.when(n % 4 == 0, ', "algorithm": "other"').otherwise(""), F.lit(', "analysis_window_s": [1, '), k, F.lit("]}"),
    )
    rows = p.select("p_partkey", doc.alias("d")).select("p_partkey", metadata.compacted(F.col("d"), "hfo").alias("hfo"), metadata.compacted(F.col("d"), "rei").alias("rei"), metadata.imported(F.col("d"), F.lit("/in")).alias("back"), metadata.analysis_minutes(F.col("d")).alias("minutes"))
    at = F.get_json_object
    return rows.select(
        "p_partkey", at("hfo", "$.algorithm").alias("algorithm"), at("hfo", "$.input_sampling_frequency_hz").cast("double").alias("input_fs"), at("rei", "$.sampling_frequency_hz").cast("double").alias("fs"), at("hfo", "$.notch_modes").alias("modes"), at("hfo", "$.total_events").cast("long").alias("events"),
        at("hfo", "$.notch_filter").cast("boolean").alias("notch"), at("hfo", "$.band_label").alias("band"), F.json_object_keys("hfo").getItem(0).alias("first"), F.size(F.json_object_keys("hfo")).alias("n_hfo"), F.size(F.json_object_keys("rei")).alias("n_rei"), at("back", "$.imported_from").alias("came_from"), F.size(F.json_object_keys("back")).alias("n_back"), "minutes",
    )


SNK06 = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE 'HFO' END AS algorithm, p_partkey::DOUBLE AS input_fs, CASE WHEN p_partkey % 3 = 2 THEN p_partkey::DOUBLE END AS fs, CASE WHEN p_partkey % 2 = 0 THEN '["50 Hz",null]' ELSE '[]' END AS modes,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey END AS events, p_partkey % 7 = 0 AS notch, 'NaN, ' || p_partkey AS band, 'algorithm' AS "first", 48 AS n_hfo, 24 AS n_rei, '/in' AS came_from, CASE WHEN p_partkey % 4 = 0 THEN 12 ELSE 11 END AS n_back,
  CASE WHEN p_partkey > 1 THEN (p_partkey - 1) / 60.0 ELSE 0 END::DOUBLE AS minutes FROM part"""


def hlp02(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*(F.lit(v) for v in ("pyhfo_pybrain", "PYHFO_OMNI_LEGACY", "ehfo", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("detector_version"))
    return metadata.provenance(o).select("o_orderkey", "known_route", "band_high_hz", "needs_fs", F.size("model_classes").alias("n_classes"))


HLP02 = "SELECT o_orderkey, o_orderkey % 4 < 3 AS known_route, CASE o_orderkey % 4 WHEN 0 THEN 500.0 WHEN 3 THEN NULL ELSE 300.0 END::DOUBLE AS band_high_hz, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 1000.0 END::DOUBLE AS needs_fs, CASE o_orderkey % 4 WHEN 2 THEN 5 WHEN 3 THEN 0 ELSE 3 END AS n_classes FROM orders"


def hlp09(spark, sf):
    """The channels to choose from, and each channel's counts in words, by reviewed class."""
    o = A.oscillations(spark, sf).withColumn("label", C.manual_class(F.coalesce("manual_class", "model_class")))
    return reviews.choices(o, "channel", "All channels").select("place", F.col("choice").alias("channel")).join(reviews.count_texts(o, "channel", "label"), "channel", "left")


HLP09 = f"""WITH {A.OSCILLATIONS}, k AS (SELECT channel, replace(lower(coalesce(manual_class, model_class)), '_', '-') AS k FROM oscillations),
l AS (SELECT channel, CASE WHEN contains(k, 'artifact') THEN 'artifact' WHEN k IN ('hfo', 'real-hfo') THEN 'HFO' WHEN k = 'non-spike hfo' THEN 'non-spike HFO' WHEN k IN ('spike-hfo', 'spkhfo') THEN 'spike-HFO' WHEN k = 'ehfo' THEN 'eHFO' WHEN k = 'spike-ehfo' THEN 'spike-eHFO' WHEN k IN ('deleted', 'excluded') THEN 'deleted' ELSE 'unclassified' END AS label FROM k),
n AS (SELECT channel, label, count(*) AS n, list_position(['artifact', 'HFO', 'non-spike HFO', 'spike-HFO', 'eHFO', 'spike-eHFO', 'unclassified', 'deleted'], label) AS p FROM l GROUP BY ALL),
t AS (SELECT channel, string_agg(label || ': ' || n, ', ' ORDER BY p) AS counts FROM n GROUP BY channel)
SELECT 0 AS place, 'All channels' AS channel, NULL AS counts UNION ALL SELECT row_number() OVER (ORDER BY channel), channel, counts FROM t"""


def hlp11(spark, sf):
    """Detector settings of recordings (customers of a nation) from their channels' notch modes."""
    c = A.table(spark, sf, "customer").where("c_custkey % 5 < 3").select(F.col("c_nationkey").alias("recording"), F.element_at(F.array(F.lit("Off"), F.lit("50 Hz + harmonics"), F.lit("60 Hz + harmonics")), F.when(F.col("c_nationkey") % 3 == 0, 1).when((F.col("c_nationkey") % 3 == 1) & (F.col("c_custkey") % 2 == 0), 3).otherwise(2)).alias("mode"))
    return reviews.detector_settings(c, "recording")


HLP11 = """WITH c AS (SELECT c_nationkey AS recording, CASE WHEN c_nationkey % 3 = 0 THEN 'off' WHEN c_nationkey % 3 = 1 AND c_custkey % 2 = 0 THEN '60' ELSE '50' END AS m FROM customer WHERE c_custkey % 5 < 3)
SELECT recording, '-bl 10 -bh 60 -h ' || CASE WHEN bool_or(m = '60') THEN '60' WHEN bool_or(m = '50') THEN '50' ELSE '1000000000' END || ' -k1 3.65 -dec 200' AS settings FROM c GROUP BY recording"""

QUERIES = {
    "snk05_hfo_events": (snk05_events, SNK05_EVENTS),
    "snk05_hfo_summary": (snk05_summary, SNK05_SUMMARY),
    "snk06_metadata": (snk06, SNK06),
    "hlp02_provenance": (hlp02, HLP02),
    "hlp09_review_lists": (hlp09, HLP09),
    "hlp11_detector_settings": (hlp11, HLP11),
}
