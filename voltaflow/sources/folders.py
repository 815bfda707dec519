"""Result folders as a whole: summaries, events, heatmaps and metadata, written and read back (SRC13, SRC15-16, SNK01, SNK04-05)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classes as C
from ..functions import mathx as X
from . import metadata, results

#: Columns of the written tables, in order (fixed values of the file formats).
REI_SUMMARY = "channel group ei_score rank onset_sec_from_seizure_onset peak_hfer_activity".split()
GAMMA_SUMMARY = "channel total_spikes gamma_spikes non_gamma_spikes spike_gamma_rate mean_gamma_power mean_gamma_duration_ms".split()
GAMMA_EVENTS = "channel event_number sample time_s is_gamma model_class official_class boundary_p1_sample boundary_n1_sample boundary_n2_sample boundary_p1_time_s boundary_n1_time_s boundary_n2_time_s gamma_power gamma_frequency_hz gamma_duration_ms manual_class manual_review_status error".split()
HFO_EVENTS = "event_id channel start_time_s end_time_s duration_ms detector boundary_warning real_hfo_probability artifact_probability spike_hfo_probability final_model_class manual_class official_class manual_review_status start_sample end_sample peak_time_s band_label low_freq_hz high_freq_hz effective_high_freq_hz input_sampling_frequency_hz detection_sampling_frequency_hz legacy_artifact_score legacy_spike_score legacy_hfo_score legacy_classification_label error".split()
HFO_SUMMARY = "channel candidate_count accepted_hfo_count non_spike_hfo_count spike_hfo_count ehfo_count spike_ehfo_count artifact_count candidate_rate_per_min accepted_hfo_rate_per_min non_spike_hfo_rate_per_min spike_hfo_rate_per_min ehfo_rate_per_min spike_ehfo_rate_per_min artifact_percentage deleted_event_count boundary_event_count".split()
#: Files of each kind of folder, the first of which names the kind.
FILES = {"hfo": ("hfo_events.csv", "hfo_channel_summary.csv"), "gamma": ("gamma_spike_events.csv", "gamma_channel_summary.csv"), "rei": ("rei_summary.csv", "rei_heatmap.csv")}
METADATA = {"hfo": "hfo_metadata.json", "gamma": "gamma_metadata.json", "rei": "rei_metadata.json"}


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, folder: str) -> list[str]:
    system, target = _filesystem(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def write_metadata(spark: SparkSession, folder: str, kind: str, values: dict) -> None:
    """A small document beside the tables; numbers that JSON has no word for become null."""
    keep = {k: k for k in values}
    spark.createDataFrame([(results.metadata_json(values, keep),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{METADATA[kind]}")


def read_metadata(spark: SparkSession, folder: str, kind: str) -> dict:
    """The document, or an empty one where there is none."""
    if METADATA[kind] not in names(spark, folder):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/{METADATA[kind]}").collect()) or "{}")


def open_folder(spark: SparkSession, folder: str) -> tuple[str, dict[str, DataFrame], dict]:
    """Kind, tables (events, summary or heatmap, where written) and metadata of a result folder (SRC13)."""
    found = names(spark, folder)
    kind = results.result_kind(found)
    if kind is None:
        raise ValueError(f"no results in {folder}: {', '.join(found) or 'empty'}")
    tables = {name: results.read_csv(spark, f"{folder}/{name}") for name in FILES[kind] if name in found}
    meta = read_metadata(spark, folder, kind)
    first, second = (tables.get(n) for n in FILES[kind])
    if kind == "rei":
        fs = meta.get("sampling_frequency_hz") or meta.get("fs") or 1.0
        out = {"summary": import_rei(first, float(fs))} | ({"heatmap": results.heatmap_long(second)} if second is not None else {})
    elif kind == "gamma":
        fs = float(meta.get("fs") or meta.get("sampling_frequency_hz") or 1.0)
        out = {"events": import_gamma(first, fs, float(meta.get("data_start_s") or 0.0))}
        out["channels"] = gamma_channels(out["events"], second)
    else:
        out = {"events": results.hfo_events(first)} | ({"summary": second} if second is not None else {})
    return kind, out, meta


# ---- recruitment index


def rei_summary(scores: DataFrame, heat: DataFrame) -> DataFrame:
    """Rows of the written summary from scores (channel, grp, ei, rank, onset) and a heatmap (channel, hfer) (SNK01).

    The peak is the greatest finite value of the channel's row; an onset that isn't finite is empty.
    """
    peaks = heat.groupBy("channel").agg(F.max(C.finite(F.col("hfer"))).alias("peak_hfer_activity"))
    return scores.join(peaks, "channel", "left").select(
        "channel", F.coalesce("grp", F.lit("")).alias("group"), F.col("ei").cast("double").alias("ei_score"), F.col("rank").cast("long").alias("rank"),
        C.finite(F.col("onset")).alias("onset_sec_from_seizure_onset"), "peak_hfer_activity",
    )


def export_rei(spark: SparkSession, folder: str, scores: DataFrame, heat: DataFrame, times: list[float], metadata: dict) -> None:
    results.write_csv(rei_summary(scores, heat), f"{folder}/rei_summary.csv")
    results.write_csv(results.heatmap_wide(heat, times), f"{folder}/rei_heatmap.csv")
    write_metadata(spark, folder, "rei", metadata)


def import_rei(raw: DataFrame, fs: float) -> DataFrame:
    """channel, grp, ei, rank, onset_sample, onset: what can't be read is 0, and for the rank the row's number in channel order (SRC16)."""
    onset = F.coalesce(X.to_float(F.col("onset_sec_from_seizure_onset")), F.lit(0.0))
    place = F.row_number().over(Window.orderBy("channel"))  # one row a channel: as many as a recording has
    return raw.select(
        "channel", F.coalesce("group", F.lit("")).alias("grp"), F.coalesce(X.to_float(F.col("ei_score")), F.lit(0.0)).alias("ei"),
        F.coalesce(X.to_float(F.col("rank")).cast("long"), place.cast("long")).alias("rank"), X.round_half_even(onset * fs).cast("long").alias("onset_sample"), onset.alias("onset"),
    )


# ---- gamma spikes


def gamma_export(events: DataFrame, fs: float, start_s: float = 0.0) -> DataFrame:
    """All written columns of spikes (channel, sample0, p1, n1, n2, power, freq, duration, manual_class, status, error) (SNK04).

    Samples count from 1; a time is that sample over the rate, from the recording's start. Numbers count a channel's events by sample.
    """
    gamma = C.is_gamma(F.col("power"), F.col("duration"))
    model = F.when(gamma, "gamma").otherwise("non-gamma")
    one = lambda c: F.col(c) + 1
    time = lambda c: F.lit(start_s) + one(c) / fs
    number = F.row_number().over(Window.partitionBy("channel").orderBy("sample0"))
    cols: dict[str, Column] = {
        "channel": F.col("channel"), "event_number": number.cast("long"), "sample": one("sample0"), "time_s": time("sample0"), "is_gamma": gamma, "model_class": model,
        "official_class": C.gamma_class(C.official_class(F.col("manual_class"), model)),
        **{f"boundary_{c}_sample": one(c) for c in ("p1", "n1", "n2")}, **{f"boundary_{c}_time_s": time(c) for c in ("p1", "n1", "n2")},
        "gamma_power": C.finite(F.col("power")), "gamma_frequency_hz": C.finite(F.col("freq")), "gamma_duration_ms": C.finite(F.col("duration")),
        "manual_class": F.col("manual_class"), "manual_review_status": F.coalesce("status", F.lit("unreviewed")), "error": F.col("error"),
    }
    return events.select(*(cols[c].alias(c) for c in GAMMA_EVENTS))


def gamma_summary_export(summary: DataFrame) -> DataFrame:
    """A channel summary (operators.summaries.gamma_summary) under the written names."""
    return summary.toDF(*GAMMA_SUMMARY)


def import_gamma(raw: DataFrame, fs: float, start_s: float = 0.0) -> DataFrame:
    """channel, sample0, time_s, boundaries and measurements; of sample and time, one that is missing follows from the other."""
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    zero = lambda c: X.to_float(have(c)) - 1
    time = X.to_float(have("time_s"))
    sample = F.coalesce(F.greatest(zero("sample"), F.lit(0.0)), F.greatest((F.coalesce(time, F.lit(start_s)) - start_s) * fs, F.lit(0.0)))
    return raw.select(
        "channel", sample.alias("sample0"), F.coalesce(time, start_s + sample / fs).alias("time_s"), *(zero(f"boundary_{c}_sample").alias(c) for c in ("p1", "n1", "n2")),
        X.to_float(have("gamma_power")).alias("power"), X.to_float(have("gamma_frequency_hz")).alias("freq"), X.to_float(have("gamma_duration_ms")).alias("duration"),
        X.blank_to_null(have("manual_class")).alias("manual_class"), F.coalesce(X.blank_to_null(have("manual_review_status")), F.lit("unreviewed")).alias("status"), X.blank_to_null(have("error")).alias("error"),
    )


def gamma_channels(events: DataFrame, summary: DataFrame | None) -> DataFrame:
    """channel, spike_count, n_events: the summary's count where the channel has one, else that of its events (SRC15)."""
    counted = events.groupBy("channel").agg(F.count("*").alias("n_events"))
    if summary is None:
        return counted.select("channel", F.col("n_events").alias("spike_count"), "n_events")
    given = summary.where("channel <> ''").groupBy("channel").agg(F.max(F.coalesce(X.to_float(F.col("total_spikes")).cast("long"), F.lit(0))).alias("total"))
    out = given.join(counted, "channel", "full")
    return out.select("channel", F.coalesce("total", "n_events").alias("spike_count"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


# ---- oscillations


def hfo_event_table(events: DataFrame, with_ehfo: bool, effective_high_hz: float | None = None, input_fs: float | None = None, detection_fs: float | None = None) -> DataFrame:
    """All written columns of oscillations, of those that a saved state has (SNK05, SNK07).

    An event without an id gets one from its place (ord, from 1); scores stand in for probabilities, and the older label
    for the model's class, where these are missing.
    """
    have = lambda c, t="double": F.col(c) if c in events.columns else F.lit(None).cast(t)
    number = lambda *cs: F.coalesce(*(C.finite(have(c)) for c in cs))
    text = lambda c: have(c, "string")
    model = F.coalesce(F.when(text("final_model_class") != "", text("final_model_class")), text("classification_label"))
    known = lambda v: F.lit(v).cast("double")
    cols = {
        "event_id": F.coalesce(F.when(text("event_id") != "", text("event_id")), F.format_string("hfo_%06d", "ord")), "channel": F.col("channel"), "start_time_s": number("start_time_s"), "end_time_s": number("end_time_s"),
        "duration_ms": number("duration_ms"), "detector": text("detector"), "boundary_warning": F.coalesce(have("boundary_warning", "boolean"), have("is_boundary", "boolean"), F.lit(False)),
        "real_hfo_probability": number("real_hfo_probability"), "artifact_probability": number("artifact_probability", "artifact_score"), "spike_hfo_probability": number("spike_hfo_probability", "spike_score"),
        "final_model_class": model, "manual_class": text("manual_class"), "official_class": C.export_class(C.official_class(text("manual_class"), text("final_model_class"), text("classification_label")), with_ehfo),
        "manual_review_status": F.coalesce(text("manual_review_status"), F.lit("unreviewed")), "start_sample": have("start_sample", "long"), "end_sample": have("end_sample", "long"), "peak_time_s": number("peak_time_s"),
        "band_label": text("band_label"), "low_freq_hz": number("low_freq_hz"), "high_freq_hz": number("high_freq_hz"), "effective_high_freq_hz": known(effective_high_hz), "input_sampling_frequency_hz": known(input_fs),
        "detection_sampling_frequency_hz": known(detection_fs), "legacy_artifact_score": number("artifact_score"), "legacy_spike_score": number("spike_score"), "legacy_hfo_score": number("hfo_score"),
        "legacy_classification_label": text("classification_label"), "error": text("error"),
    }
    return events.select(*(cols[c].alias(c) for c in HFO_EVENTS))


def hfo_channel_table(channels: DataFrame, table: DataFrame, minutes: float, with_ehfo: bool) -> DataFrame:
    """The written channel summary of an event table (hfo_event_table): channels without events too; deleted events count only as such (SNK05)."""
    n = lambda *classes: F.count_if(F.col("official_class").isin(*classes))
    counted = table.groupBy("channel").agg(
        F.count_if(F.col("official_class") != "deleted").alias("candidate_count"), n("HFO", "spike-HFO", "eHFO", "spike-eHFO").alias("accepted_hfo_count"), n("HFO").alias("non_spike_hfo_count"), n("spike-HFO").alias("spike_hfo_count"),
        n("eHFO").alias("ehfo_count"), n("spike-eHFO").alias("spike_ehfo_count"), n("artifact").alias("artifact_count"), n("deleted").alias("deleted_event_count"), F.count_if(F.col("boundary_warning") & (F.col("official_class") != "deleted")).alias("boundary_event_count"),
    )
    out = channels.select("channel").distinct().join(counted, "channel", "left").na.fill(0)
    rate = lambda c: ((F.col(c) / minutes) if minutes > 0 else F.lit(0.0)).cast("double")
    rates = {f"{c}_rate_per_min": rate(f"{c}_count") for c in ("candidate", "accepted_hfo", "non_spike_hfo", "spike_hfo", "ehfo", "spike_ehfo")}
    out = out.withColumns(rates | {"artifact_percentage": F.when(F.col("candidate_count") > 0, 100.0 * F.col("artifact_count") / F.col("candidate_count")).otherwise(0.0)})
    return out.select(*(c for c in HFO_SUMMARY if with_ehfo or "ehfo" not in c))


def export_hfo_folder(spark: SparkSession, folder: str, channels: DataFrame, events: DataFrame, document: str) -> None:
    """Summary, events, metadata and description of a run's oscillations, from its events and its metadata document."""
    row = spark.createDataFrame([(document,)], "d string")
    value = lambda name: F.try_variant_get(F.try_parse_json(metadata.finite_json(F.col("d"))), f"$.{name}", "double")
    facts = row.select(F.lower(F.trim(F.get_json_object(metadata.finite_json(F.col("d")), "$.detector_version"))).alias("route"), metadata.analysis_minutes(F.col("d")).alias("minutes"), *(value(n).alias(n) for n in ("effective_high_freq_hz", "input_fs", "detection_fs"))).collect()[0]
    with_ehfo = facts.route == "ehfo"
    table = hfo_event_table(events, with_ehfo, facts.effective_high_freq_hz, facts.input_fs, facts.detection_fs)
    results.write_csv(table, f"{folder}/{FILES['hfo'][0]}")
    results.write_csv(hfo_channel_table(channels, table, facts.minutes, with_ehfo), f"{folder}/{FILES['hfo'][1]}")
    metadata.write_folder_text(spark, folder, "hfo", document)
