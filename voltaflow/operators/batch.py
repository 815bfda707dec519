"""Batch recruitment index: a table of segments to per-recording output, with a log and resume (SNK11, JON14, AGG12, FIL18-19).

All rows of the table are one plan: what is wrong with a row is a status and a reason of that row, never a
failed job. Results go to a folder of the attempt, as many files as there are tasks, the log behind them; a row
counts as done once the log says ok, so a run that was stopped between the two has its number and its folder
used again by the next one, and a run over a finished batch writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mathx as X
from ..sources import storage
from ..sources.results import REQUIRED
from . import rei
from .blocks import BLOCK

LOG = "attempt long, row long, status string, reason string, edf string, subject string, n_channels long, excluded_channel_count long, native_fs double, fs double"


def annotation_problems(duration: Column, onset: Column, offset: Column, seizure: Column) -> Column:
    """What is inconsistent in a row's annotations, joined by "; " (empty: nothing); unknown values are consistent."""
    rules = [(onset > duration, "onset exceeds recording duration"), (offset > duration, "offset exceeds recording duration"), (seizure > duration, "seizure duration exceeds recording duration"), (offset <= onset, "offset isn't after onset")]
    return F.array_join(F.filter(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules)), lambda t: t.isNotNull()), "; ")


def sample_of(seconds: Column, fs: Column, n: Column) -> Column:
    """The nearest sample (half to even), held inside the recording."""
    return F.greatest(F.lit(0).cast("long"), F.least(X.round_half_even(seconds * fs).cast("long"), n))


def assess(raw: DataFrame, excluded: DataFrame, recordings: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """row, status (ready, skipped or error), reason, edf, subject, run, windows in seconds and samples of segment rows (row and text columns).

    excluded: patient_id, reason. recordings: path, native_fs, fs, n_samples; a path that isn't there is an error of its
    rows. Rows from first to last count, both included. A full path is taken if there is such a recording, else the relative one.
    """
    missing = [c for c in ("row", *REQUIRED) if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    text = lambda c: X.blank_to_null(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    num = lambda c: X.to_float(text(c))
    rows = raw.where(F.col("row") >= first) if last is None else raw.where(F.col("row").between(first, last))
    full, relative = text("edf_full_path"), text("edf_relative_path")
    named = F.regexp_extract(F.coalesce(relative, F.lit("")), r"(?:^|/)(sub-[^/]*)", 1)
    named_full = F.regexp_extract(F.coalesce(full, F.lit("")), r"(?:^|/)(sub-[^/]*)", 1)
    subject = F.coalesce(text("subject"), F.when(named != "", named), F.when(named_full != "", named_full), F.lit(""))
    status = F.lower(text("segment_status"))
    note = F.coalesce(text("qc_note"), F.lit(""))
    if "usable_for_EI" in raw.columns:  # a table with this column is judged by it alone
        invalid = F.when(~X.to_bool(F.col("usable_for_EI")), F.concat(F.lit("usable_for_EI is false | "), note))
    else:
        invalid = F.when(status.isNull(), "row isn't marked as valid").when(status != "ok", F.concat(F.lit("segment_status is "), status, F.lit(" | "), note))
    problems = annotation_problems(num("duration_sec"), num("seizure_onset_relative_sec"), num("seizure_offset_relative_sec"), num("seizure_duration_sec"))
    rows = rows.select("row", full.alias("full"), relative.alias("relative"), subject.alias("subject"), F.coalesce(text("run"), (F.col("row") + 1).cast("string")).alias("run"), *(num(c).alias(c) for c in REQUIRED), invalid.alias("invalid"), problems.alias("problems"))
    rows = rows.join(excluded.select(F.col("patient_id").alias("subject"), F.lit(True).alias("out"), F.col("reason").alias("why")), "subject", "left")
    known = recordings.select("path", "native_fs", "fs", "n_samples")
    at = lambda name: known.select(F.col("path").alias(name), F.struct("native_fs", "fs", "n_samples").alias(f"{name}_facts"))
    rows = rows.join(at("full"), "full", "left").join(at("relative"), "relative", "left")
    facts = F.coalesce("full_facts", "relative_facts")
    edf = F.when(F.col("full_facts").isNotNull(), F.col("full")).otherwise(F.col("relative"))
    rows = rows.withColumns({"facts": facts, "edf": edf}).withColumns({"native_fs": F.col("facts.native_fs"), "fs": F.col("facts.fs"), "n_samples": F.col("facts.n_samples")})
    bounds = {short: sample_of(F.col(c), F.col("fs"), F.col("n_samples")) for short, c in zip(("b0", "b1", "i0", "i1"), REQUIRED)}
    rows = rows.withColumns(bounds)
    skipped = F.when(F.col("out"), F.concat(F.lit("patient excluded from the index | "), F.coalesce("why", F.lit("")))).when(F.col("invalid").isNotNull(), F.col("invalid")).when(F.col("problems") != "", F.col("problems"))
    window = lambda name, lo, hi: F.format_string(f"invalid {name} window: (%d, %d)", lo, hi)
    error = (
        F.when(F.col("edf").isNull(), "no recording is named").when(F.col("facts").isNull(), F.concat(F.lit("missing recording: "), "edf"))
        .when(F.array_contains(F.array(*(F.col(c).isNull() for c in REQUIRED)), True), "a window's edge isn't a number")
        .when(F.col("b1") <= F.col("b0"), window("baseline", F.col("b0"), F.col("b1"))).when(F.col("i1") <= F.col("i0"), window("ictal", F.col("i0"), F.col("i1")))
    )
    return rows.select(
        "row", F.when(skipped.isNotNull(), "skipped").when(error.isNotNull(), "error").otherwise("ready").alias("status"), F.coalesce(skipped, error, F.lit("")).alias("reason"),
        "edf", "subject", "run", "native_fs", "fs", *REQUIRED, "b0", "b1", "i0", "i1",
    )


def cut(ready: DataFrame, signal: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, channel, segment, n, x: both windows of the ready rows, from signal (path, channel, sample, x), joined by path and block."""
    spans = F.array(F.struct(F.lit("baseline").alias("segment"), F.col("b0").alias("lo"), F.col("b1").alias("hi")), F.struct(F.lit("ictal").alias("segment"), F.col("i0").alias("lo"), F.col("i1").alias("hi")))
    wanted = ready.select("row", F.col("edf").alias("path"), F.explode(spans).alias("s")).select("row", "path", "s.*")
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    placed = signal.select("path", "channel", "sample", "x", F.floor(F.col("sample") / block).alias("block"))
    return wanted.join(placed, ["path", "block"]).where("sample >= lo and sample < hi").select("row", "channel", "segment", (F.col("sample") - F.col("lo")).alias("n"), "x")


def batch_results(ready: DataFrame, signal: DataFrame, exclude_channels: str | None = None, sigmas: float = 10.0, scratch: str | None = None) -> DataFrame:
    """One row for each channel of each ready row, as it is written; channels that the pattern finds are counted, not computed.

    Rows that name the same windows of one recording are computed once, under the least of them. Recordings of one rate are one plan; there are as many plans as distinct rates, which the caller's resampling makes one.
    With a scratch folder, which must outlast the result, the windows' samples are written there: the index reads them several times, and the signal would be made anew for each.
    """
    left = signal
    if exclude_channels:
        dropped = signal.where(F.col("channel").rlike(exclude_channels)).select("path", "channel").distinct().groupBy("path").agg(F.count("*").alias("excluded_channel_count"))
        left = signal.where(~F.col("channel").rlike(exclude_channels))
        told = ready.join(dropped.withColumnRenamed("path", "edf"), "edf", "left")
    else:
        told = ready.withColumn("excluded_channel_count", F.lit(0).cast("long"))
    parts = []
    for fs in sorted(r.fs for r in ready.select("fs").distinct().collect()):
        own = told.where(F.col("fs") == fs)
        windows = ("edf", "b0", "b1", "i0", "i1")
        once = ready.where(F.col("fs") == fs).groupBy(*windows).agg(F.min("row").alias("once"))
        segments = cut(once.withColumnRenamed("once", "row"), left)
        if scratch:
            path = f"{scratch}/{len(parts)}"
            segments.write.parquet(path)
            segments = ready.sparkSession.read.parquet(path).hint("merge")  # as with the batch's rows: its files say little about how many there are
        scored = rei.batch_scores(segments, fs, sigmas).withColumnRenamed("row", "once")
        parts.append(own.join(once.hint("merge"), list(windows)).join(scored.hint("merge"), "once").select(
            "row", "channel", F.col("score").alias("EI"), F.col("batch_rank").alias("EI_rank_desc"), F.col("onset").alias("channel_onset_sample_in_ictal_window"),
            (F.col("onset") / F.lit(fs)).alias("channel_onset_sec_in_ictal_window"), "subject", "run", F.col("edf").alias("edf_file"), "native_fs", "fs",
            F.when(F.abs(F.col("native_fs") - F.col("fs")) > 1e-8 + 1e-5 * F.abs("fs"), F.col("fs")).alias("resampled_to_fs"), *REQUIRED, F.coalesce("excluded_channel_count", F.lit(0).cast("long")).alias("excluded_channel_count"),
        ))
    if not parts:
        parts = [batch_results_empty(ready.sparkSession)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_results_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "row long, channel string, EI double, EI_rank_desc long, channel_onset_sample_in_ictal_window long, channel_onset_sec_in_ictal_window double, subject string, run string, edf_file string, native_fs double, fs double, resampled_to_fs double, baseline_start_sec double, baseline_end_sec double, ictal_start_sec double, ictal_end_sec double, excluded_channel_count long")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log of all runs; of a row, the last attempt counts."""
    if not storage.exists(spark, f"{folder}/log"):
        return spark.createDataFrame([], LOG).limit(0)  # known to be empty when it is planned, so joins with it go
    return spark.read.schema(LOG).option("header", True).csv(f"{folder}/log")


def last_status(log: DataFrame) -> DataFrame:
    """The log's last entry of each row."""
    w = Window.partitionBy("row").orderBy(F.desc("attempt"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_batch(
    spark: SparkSession, folder: str, raw: DataFrame, excluded: DataFrame, recordings: DataFrame, signal: DataFrame,
    prepare: Callable[[DataFrame], DataFrame] | None = None, exclude_channels: str | None = None, first: int = 0, last: int | None = None,
) -> dict[str, int]:
    """Write results and log below the folder; how many rows were ok, skipped, in error, and done before.

    prepare is given the signal of the recordings that are wanted (path, channel, sample, x) and filters it. Rows whose
    channels are all excluded, or whose signal has no samples in a window, are errors too. Only changed entries are logged.
    Tables with a row for each row of raw are joined by shuffles: their files are small for their number, so Spark would broadcast them.
    """
    log = read_log(spark, folder)
    attempt = (log.agg(F.max("attempt")).collect()[0][0] or 0) + 1
    before = last_status(log).select("row", F.col("status").alias("was"), F.col("reason").alias("was_reason"))
    rows = assess(raw, excluded, recordings, first, last)
    done = before.where("was = 'ok'").select("row", F.lit(True).alias("done"))
    path = storage.shared_path(spark, "batch")
    rows.join(done.hint("merge"), "row", "left").write.parquet(path)  # the plan of the run: fixed before anything is written
    n_done = spark.read.parquet(path).where("done").count()
    todo = spark.read.parquet(path).where("done is null").drop("done")
    ready = todo.where("status = 'ready'")
    results = f"{folder}/results/attempt={attempt}"
    storage.remove(spark, results)  # of a run that was stopped before its log
    if not ready.isEmpty():
        wanted = signal.join(ready.select(F.col("edf").alias("path")).distinct(), "path", "left_semi")
        scratch = storage.shared_path(spark, "segments")
        out = batch_results(ready, wanted if prepare is None else prepare(wanted), exclude_channels, scratch=scratch)
        out.repartition("row").sortWithinPartitions("row", "EI_rank_desc", "channel").write.mode("overwrite").parquet(results)
        storage.remove(spark, scratch)
    # a row has results if the attempt's folder has rows of it
    made = spark.read.parquet(results) if storage.exists(spark, results) else batch_results_empty(spark)
    made = made.groupBy("row").agg(F.count("*").alias("n_channels"), F.max("excluded_channel_count").alias("excluded_channel_count"))
    status = F.when(F.col("status") != "ready", F.col("status")).when(F.col("n_channels") > 0, "ok").otherwise("error")
    reason = F.when((F.col("status") == "ready") & F.col("n_channels").isNull(), "no channel has samples in both windows").otherwise(F.col("reason"))
    entries = todo.join(made.hint("merge"), "row", "left").select(F.lit(attempt).cast("long").alias("attempt"), "row", status.alias("status"), reason.alias("reason"), "edf", "subject", "n_channels", "excluded_channel_count", "native_fs", "fs")
    same = F.col("was").eqNullSafe(F.col("status")) & F.coalesce("was_reason", F.lit("")).eqNullSafe(F.col("reason"))
    kept = storage.shared_path(spark, "entries")
    entries.join(before.hint("merge"), "row", "left").withColumn("changed", ~same).write.parquet(kept)
    entries = spark.read.parquet(kept)
    changed = entries.where("changed").select(*[part.split()[0] for part in LOG.split(", ")])
    if not changed.isEmpty():
        changed.write.mode("append").option("header", True).csv(f"{folder}/log")
    # what isn't logged is in the log already with this status, so the log isn't read again
    last = entries.groupBy("row").agg(F.max_by("status", "changed").alias("status"))
    counts = {r.status: r["count"] for r in last.groupBy("status").count().collect()}
    for p in (path, kept):
        storage.remove(spark, p)
    return {"ok": counts.get("ok", 0), "skipped": counts.get("skipped", 0), "error": counts.get("error", 0), "done_before": n_done}


def tally(log: DataFrame) -> DataFrame:
    """status, n_rows, excluded channels of the last entries of a log (AGG12)."""
    return last_status(log).groupBy("status").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("excluded_channel_count"))), F.lit(0).cast("long")).alias("excluded_channels"))
