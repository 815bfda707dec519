"""Result folders, segment tables and project documents: reading and writing (SRC07-SRC18, SNK01-SNK12)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import mathx as X

SEGMENT_SCHEMA = "edf_full_path string, edf_relative_path string, baseline_start_sec string, baseline_end_sec string, ictal_start_sec string, ictal_end_sec string, usable_for_EI string, segment_status string, subject string, run string, qc_note string, duration_sec string, seizure_onset_relative_sec string, seizure_offset_relative_sec string, seizure_duration_sec string"
REQUIRED = ("baseline_start_sec", "baseline_end_sec", "ictal_start_sec", "ictal_end_sec")
PROJECT_FORMAT, PROJECT_VERSION = "voltaflow-project", 8


def read_csv(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """CSV with a header, all columns as text: types are coerced by the reader of each table."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(columns) if columns else reader.option("inferSchema", False)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def segments(raw: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows of a batch segment table with numbers, subject and status (SRC07, SRC09, SRC10, FIL18)."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    path = F.coalesce(X.blank_to_null(have("edf_full_path")), X.blank_to_null(have("edf_relative_path")))
    found = F.regexp_extract(path, r"(?:^|/)(sub-[^/]*)", 1)
    usable, status = have("usable_for_EI"), F.lower(F.trim(have("segment_status")))
    valid = F.when(X.blank_to_null(usable).isNotNull(), X.to_bool(usable)).otherwise(F.coalesce(status == "ok", F.lit(False)))
    out = raw.select(path.alias("path"), *(X.to_float(F.col(c)).alias(c) for c in REQUIRED), F.coalesce(X.blank_to_null(have("subject")), F.when(found != "", found)).alias("subject"), valid.alias("valid"))
    return out


def exclusions(raw: DataFrame, order: Column) -> DataFrame:
    """patient_id, reason; rows without an id go, the last row of an id by `order` counts (SRC08)."""
    numbered = raw.select(X.blank_to_null(F.col("patient_id")).alias("patient_id"), "reason", order.alias("row"))
    return numbered.where("patient_id is not null").groupBy("patient_id").agg(F.max_by("reason", "row").alias("reason"))


def batch_status(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Status of each segment: skipped, invalid or ready (AGG12, JON14, SNK11)."""
    out = rows.join(excluded, rows["subject"] == excluded["patient_id"], "left")
    broken = F.col("path").isNull() | F.col("ictal_start_sec").isNull() | F.col("ictal_end_sec").isNull()
    status = F.when(F.col("patient_id").isNotNull(), "skipped").when(~F.col("valid"), "invalid").when(broken, "error").otherwise("ready")
    return out.select(*rows.columns, "reason", status.alias("status"))


def result_kind(names: list[str]) -> str | None:
    """Which results a folder holds, from its file names (SRC13)."""
    for kind, files in (("hfo", ("hfo_events.csv",)), ("gamma", ("gamma_spike_events.csv",)), ("rei", ("rei_summary.csv",))):
        if all(f in names for f in files):
            return kind
    return None


def hfo_events(raw: DataFrame, fs: Column | float = 1000.0) -> DataFrame:
    """Imported events with defaults for what a file lacks (SRC14)."""
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    num = lambda c: X.to_float(have(c))
    fs = F.lit(fs) if isinstance(fs, float) else fs
    start, end = num("start_time_s"), num("end_time_s")
    return raw.select(
        F.coalesce(X.blank_to_null(have("event_id")), F.concat_ws("_", F.lit("hfo"), have("channel"), have("start_time_s"))).alias("event_id"), have("channel").alias("channel"),
        start.alias("start_time_s"), end.alias("end_time_s"), F.coalesce(num("duration_ms"), 1000 * (end - start)).alias("duration_ms"), have("detector").alias("detector"),
        X.to_bool(have("boundary_warning")).alias("boundary_warning"), num("real_hfo_probability").alias("real_hfo_probability"), num("artifact_probability").alias("artifact_probability"),
        X.blank_to_null(have("final_model_class")).alias("final_model_class"), X.blank_to_null(have("manual_class")).alias("manual_class"),
        F.coalesce(num("start_sample"), X.round_half_even(start * fs)).cast("long").alias("start_sample"), F.coalesce(num("end_sample"), X.round_half_even(end * fs)).cast("long").alias("end_sample"),
        F.coalesce(num("peak_time_s"), (start + end) / 2).alias("peak_time_s"), F.coalesce(num("low_freq_hz"), F.lit(80.0)).alias("low_freq_hz"), F.coalesce(num("high_freq_hz"), F.lit(300.0)).alias("high_freq_hz"),
    )


def export_hfo(events: DataFrame, with_ehfo: bool = True) -> DataFrame:
    """Event rows as they are written: official class, review status, no non-finite numbers (SNK05, SNK07)."""
    official = C.export_class(C.official_class(F.col("manual_class"), F.col("final_model_class")), with_ehfo)
    status = F.when(F.col("manual_class").isNull(), "unreviewed").when(F.lower("manual_class") == "deleted", "deleted").otherwise("reviewed")
    out = events.withColumns({"official_class": official, "manual_review_status": status})
    return out.withColumns({c: C.finite(F.col(c)) for c, t in out.dtypes if t == "double"})


def export_gamma(events: DataFrame, fs: float) -> DataFrame:
    """Spike rows as they are written: samples count from 1, time is that sample over the rate (SNK04)."""
    one = F.col("sample0") + 1
    return events.select("channel", one.alias("sample"), (one / fs).alias("time_s"), C.is_gamma(F.col("power"), F.col("duration")).alias("is_gamma"), C.finite(F.col("power")).alias("gamma_power"), C.finite(F.col("duration")).alias("gamma_duration_ms"))


def gamma_events(raw: DataFrame) -> DataFrame:
    """Imported spikes: samples count from 0 again, the written time stays (SRC15)."""
    return raw.select("channel", (X.to_float(F.col("sample")) - 1).cast("long").alias("sample0"), X.to_float(F.col("time_s")).alias("time_s"), X.to_float(F.col("gamma_power")).alias("power"), X.to_float(F.col("gamma_duration_ms")).alias("duration"))


def heatmap_long(wide: DataFrame) -> DataFrame:
    """channel, t_s, hfer from a wide heatmap with headers like 0.250000s (SRC17)."""
    times = [c for c in wide.columns if c != "channel"]
    out = wide.unpivot(["channel"], [F.col(f"`{c}`") for c in times], "header", "hfer")
    return out.select("channel", F.regexp_replace("header", "s$", "").cast("double").alias("t_s"), F.col("hfer").cast("double").alias("hfer"))


def heatmap_wide(long: DataFrame, times: list[float]) -> DataFrame:
    """One column a sample: only for windows whose times the caller lists (SNK02)."""
    named = long.withColumn("header", F.concat(F.format_string("%.6f", "t_s"), F.lit("s")))
    return named.groupBy("channel").pivot("header", [f"{t:.6f}s" for t in times]).agg(F.first("hfer"))


def heatmap_display(long: DataFrame, ictal_start: float, onset: float) -> DataFrame:
    return long.select("channel", (F.col("t_s") + (ictal_start - onset)).alias("t"), F.log10(F.greatest("hfer", F.lit(1e-6))).alias("level"))


def metadata_json(values: dict, keep: dict[str, str]) -> str:
    """Metadata with only the kept keys under their written names, non-finite numbers as null (SNK06, SNK07)."""
    clean = lambda v: None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v
    return json.dumps({new: clean(values[old]) for old, new in keep.items() if old in values}, sort_keys=True)


def project_document(name: str, raw_file: str, review: dict, preprocessing: dict, computation: dict) -> str:
    return json.dumps({"format": PROJECT_FORMAT, "version": PROJECT_VERSION, "project_name": name, "source": {"raw_file": raw_file}, "review": review, "preprocessing": preprocessing, "computation": computation}, sort_keys=True)


def load_project(text: str) -> dict:
    """A checked and migrated project document (SRC11, SRC18)."""
    d = json.loads(text)
    if not isinstance(d, dict) or d.get("format") != PROJECT_FORMAT:
        raise ValueError("not a project document")
    version = d.get("version")
    if not isinstance(version, int) or isinstance(version, bool) or not 1 <= version <= PROJECT_VERSION:
        raise ValueError(f"project version {version!r} can't be read")
    source = d.get("source")
    if not isinstance(source, dict) or not (source.get("raw_file") or source.get("raw_file_relative")):
        raise ValueError("a project names its recording")
    pre = d.setdefault("preprocessing", {})
    filters = pre.get("filters", {})
    if filters and "macro" not in filters and "micro" not in filters:  # one flat filter in old documents
        pre["filters"] = {"macro": dict(filters), "micro": dict(filters)}
    view = d.get("computation", {})
    if view.get("sort_mode") == "mean":
        view["sort_mode"] = "time"
    return d


def resolve(candidates: list[str | None], exists) -> str | None:
    """The first path that exists (SRC02, SRC09, SRC12)."""
    return next((c for c in candidates if c and exists(c)), None)


def same_source(a: str, b: str) -> bool:
    """Whether two paths are the same file: equal, or of one name whatever its case (JON17)."""
    return a == b or a.rsplit("/", 1)[-1].casefold() == b.rsplit("/", 1)[-1].casefold()


def append_log(rows: DataFrame, path: str) -> None:
    """Append performance rows (SNK12)."""
    rows.write.mode("append").option("header", True).csv(path)
