"""Metadata documents of results: what is written of them, and what reading adds (SNK06, SNK07, HLP02-04, HLP13).

A document is a JSON text column. Each kind of result has a table of written keys; a key names where its value
comes from and what it must be. Numbers that aren't finite become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys of the written documents in their order. A key is `name` or `name=source|older source`; what
# follows the colon is its kind: text, number (finite or null), count (0 if missing), flag (false if missing), any, list, object.
REI_KEYS = """algorithm:text source_file_name:text source_file_path:text montage_used:text recommended_montage:text seizure_onset_s:number seizure_offset_s:number
baseline_window_s:any ictal_window_s:any sampling_frequency_hz=fs:number n_channels_input:count n_channels_computed:count bad_channels_excluded:flag excluded_bad_channels:list
display_filter_used_for_computation=display_filter_used_for_computation|uses_display_filter:flag analysis_filter:any notch_filter:flag notch_modes:list threshold_sigma:number
energy_window_sec:number hfer_window_sec:number baseline_samples:any ictal_samples:any"""
HFO_KEYS = """algorithm:text source_file_name:text source_file_path:text analysis_window_s:any input_sampling_frequency_hz=input_fs:number detection_sampling_frequency_hz=detection_fs:number
resampled_to_hz:number input_units:text detector_version:text algorithm_details:object source_repositories:list active_candidate_detectors:list band_label:text low_freq_hz:number
high_freq_hz:number effective_high_freq_hz:number threshold_sigma:number min_duration_ms:number max_duration_ms:number raw_candidate_events:count duration_excluded_events:count
boundary_padding_s:number boundary_excluded_events:count merge_gap_ms:number min_cycles:number detector_parameters:object event_window_ms:number notch_filter:flag notch_modes:list
input_boundary:text processing_order:list selected_channels:list bad_channels_excluded:list reference_mode:text bipolar_pairs:list preprocessing_log:list classification_status:text
classifier_implementation:text classifier_origin:object classifier_feature_freq_range_hz:any classification_label_counts:object official_label_counts:object manual_reviewed_events:count
manual_deleted_events:count total_events:count n_channels:count n_samples:count"""
GAMMA_KEYS = """algorithm:text source_file_name:text source_file_path:text analysis_window_s:any sampling_frequency_hz=fs:number processing_mode:text detector_window_s=detector_window_s|analysis_window_s:any
detector_extra_context_seconds:number detail_chunk_minutes=detail_chunk_minutes|chunk_minutes:number detail_chunk_context_seconds=detail_chunk_context_seconds|chunk_context_seconds:number
boundary_gamma_filter_context_seconds=filter_context_seconds:number n_chunks:count notch_filter:flag notch_modes:list gamma_notch_behavior:text notch_frequency_hz:number notch_r:number
total_spikes:count boundary_success_count:count gamma_positive_spikes:count gamma_success_count:count n_channels:count n_samples:count performance_assessment:any"""
#: Keys, the algorithm's name where a document has none, and the files beside the document.
KINDS = {
    "rei": (REI_KEYS, "Recruitment Energy Index", ("rei_summary.csv", "rei_heatmap.csv", "rei_metadata.json", "README.txt")),
    "hfo": (HFO_KEYS, "HFO", ("hfo_channel_summary.csv", "hfo_events.csv", "hfo_metadata.json", "README.txt")),
    "gamma": (GAMMA_KEYS, "gamma_spike", ("gamma_channel_summary.csv", "gamma_spike_events.csv", "gamma_metadata.json", "README.txt")),
}
IMPORT_FORMAT = "native_export_folder_v1"


def finite_json(text: Column) -> Column:
    """The document with null for NaN and infinities, which JSON doesn't have; what stands inside strings stays."""
    marked = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|(-?(?:NaN|Infinity)\b)', "$1\u0001$2\u0002")
    return F.replace(F.regexp_replace(marked, "\u0001-?(?:NaN|Infinity)\u0002", "null"), F.lit("\u0001\u0002"), F.lit(""))


def compacted(document: Column, kind: str) -> Column:
    """The written document of a result's metadata: the known keys under their written names, and the files beside it."""
    keys, name, files = KINDS[kind]
    doc = F.try_parse_json(finite_json(document))
    out = []
    for entry in keys.split():
        written, _, what = entry.partition(":")
        written, _, sources = written.partition("=")
        at = [f"$.{s}" for s in (sources or written).split("|")]
        value = lambda t: F.coalesce(*(F.try_variant_get(doc, p, t) for p in at))  # noqa: B023, E731
        if what == "number":
            x = value("double")
            column = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        elif what == "count":
            column = F.coalesce(value("long"), F.lit(0).cast("long"))
        elif what == "flag":
            column = F.coalesce(value("boolean"), F.lit(False))
        elif what == "text":
            column = value("string")
        else:
            column = value("variant")
            if what in ("list", "object"):
                column = F.coalesce(column, F.parse_json(F.lit("[]" if what == "list" else "{}")))
        out.append((F.coalesce(column, F.lit(name)) if written == "algorithm" else column).alias(written))
    out.append(F.array(*map(F.lit, files)).alias("output_files"))
    return F.to_json(F.struct(*out), {"ignoreNullFields": "false"})


def analysis_minutes(document: Column) -> Column:
    """Length of the analysed window in minutes; 0 where it isn't known or doesn't rise."""
    doc = F.try_parse_json(finite_json(document))
    start, stop = (F.try_variant_get(doc, f"$.analysis_window_s[{i}]", "double") for i in (0, 1))
    return F.when(stop > start, (stop - start) / 60.0).otherwise(0.0)


def imported(document: Column, folder: Column) -> Column:
    """The document as it is read back: marked as imported, with the folder and the format (HLP04)."""
    known = F.from_json(finite_json(document), "map<string,string>")
    marks = F.create_map(F.lit("imported"), F.lit("true"), F.lit("imported_from"), folder, F.lit("import_format"), F.lit(IMPORT_FORMAT))
    return F.to_json(F.map_concat(F.map_filter(F.coalesce(known, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("imported", "imported_from", "import_format")), marks))


#: What is known of each route: its band in Hz, the rate that it needs, and the classes that it gives (fixed values).
ROUTES = [
    ("pyhfo_pybrain", 80.0, 500.0, None, ["artifact", "HFO", "spike-HFO"]),
    ("pyhfo_omni_legacy", 80.0, 300.0, 1000.0, ["artifact", "HFO", "spike-HFO"]),
    ("eHFO", 80.0, 300.0, 1000.0, ["artifact", "HFO", "spike-HFO", "eHFO", "spike-eHFO"]),
]


def provenance(runs: DataFrame, route: str = "detector_version") -> DataFrame:
    """runs with known_route, band_low_hz, band_high_hz, needs_fs and model_classes of their route, whatever its case (HLP02)."""
    spark = runs.sparkSession
    known = spark.createDataFrame([(r.lower(), *rest) for r, *rest in ROUTES], "_route string, band_low_hz double, band_high_hz double, needs_fs double, model_classes array<string>")
    out = runs.join(F.broadcast(known), F.lower(route) == F.col("_route"), "left")  # as many rows as there are routes
    return out.withColumns({"known_route": F.col("_route").isNotNull(), "model_classes": F.coalesce("model_classes", F.array().cast("array<string>"))}).drop("_route")


def readme_text(kind: str) -> str:
    """A plain description of a result folder's files (HLP03)."""
    files = KINDS[kind][2]
    about = {
        "rei": "One row of the summary is a channel: its score (0 to 1), its rank, its onset in seconds from the seizure's onset, and its greatest energy over the baseline's mean. The heatmap has a column a sample, named by seconds from the window's start.",
        "hfo": "One row of the events is an oscillation. The official class is the reviewer's, or the model's where nobody reviewed. The summary counts a channel's events by official class, without deleted ones, and gives rates a minute of the analysed window.",
        "gamma": "One row of the events is a spike; samples count from 1, and times are derived from them. A spike has gamma activity where power and duration are finite and one of them is above zero. The summary counts spikes and averages finite measurements.",
    }[kind]
    return "\n".join([f"Results: {KINDS[kind][1]}", "", about, "", "Files:", *(f"- {f}" for f in files), "", "Empty cells are values that are missing or not finite.", ""])


def write_folder_text(spark: SparkSession, folder: str, kind: str, document: str) -> None:
    """The compacted metadata and the description of a result folder."""
    row = spark.createDataFrame([(document,)], "document string")
    row.select(compacted(F.col("document"), kind).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{KINDS[kind][2][2]}")
    spark.createDataFrame([(readme_text(kind),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/README.txt")
