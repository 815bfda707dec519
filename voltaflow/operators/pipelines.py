"""Whole runs: prepared input, HFO events and gamma spikes (DSP29-DSP30, entry points B and C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classes as C
from . import dsp, events, montage, summaries
from .blocks import with_halo
from .detectors import stored

#: Bands by preset, in Hz (fixed values).
BANDS = {"Default": (80.0, 500.0), "Ripples": (80.0, 250.0), "Fast ripples": (250.0, 500.0)}


def check_parameters(low: float, high: float, fs: float, min_ms: float, max_ms: float | None) -> list[str]:
    """What is wrong with detector parameters, in words; empty if nothing is (FIL21)."""
    wrong = []
    if low <= 0 or high <= low:
        wrong.append("band edges must rise from above zero")
    if low >= fs / 2:
        wrong.append("the band starts above Nyquist")
    if min_ms <= 0 or (max_ms and max_ms < min_ms):
        wrong.append("durations must rise from above zero")
    return wrong


def prepared(signal: DataFrame, lo: int, hi: int, bad: DataFrame | None = None, reference: str = "none", mains: float | None = None, fs: float = 1000.0) -> DataFrame:
    """Slice, drop bad channels, reference, notch: channel, sample (from 0), x in microvolts (DSP30)."""
    out = signal.where((F.col("sample") >= lo) & (F.col("sample") < hi)).select("channel", (F.col("sample") - lo).alias("sample"), (F.col("x") * 1e6).alias("x"))
    out = out if bad is None else montage.without_channels(out, bad)
    if reference in ("mean", "median"):
        out = montage.common_reference(out, None, reference)
    if mains:
        out = dsp.notched(out, fs, mains).withColumnRenamed("y", "x")
    return out


def hfo_events(signal: DataFrame, fs: float, preset: str = "Default", detectors: tuple[str, ...] = ("STE", "HIL"), max_ms: float | None = None, pad: int = 0) -> DataFrame:
    """Candidates of all detectors in one band, ordered, gated and numbered: event_id, channel, start, end, detector, peak_s, boundary."""
    low, high = BANDS[preset]
    wrong = check_parameters(low, min(high, 0.95 * fs / 2), fs, 6.0, max_ms)
    if wrong:
        raise ValueError("; ".join(wrong))
    found = None
    for name in detectors:  # detectors aren't merged: one oscillation may be found by several
        part = dsp.candidates(signal, fs, name, low, high)
        found = part if found is None else found.unionByName(part)
    lengths = signal.groupBy("channel").agg((F.max("sample") + 1).alias("n_samples"))
    out = found.join(lengths, "channel")
    if max_ms:
        out = out.where((F.col("end") - F.col("start")) * 1000.0 / fs <= max_ms)
    out = out.where((F.col("start") >= pad) & (F.col("end") <= F.col("n_samples") - pad))
    name = F.lower(F.col("channel").cast("string"))
    within = Window.partitionBy("channel").orderBy("start", "end", "detector")
    sizes = out.groupBy("channel").agg(F.count("*").alias("n"))
    before = Window.orderBy(name, "channel").rowsBetween(Window.unboundedPreceding, -1)  # one row a channel
    shifts = sizes.select("channel", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    out = out.withColumn("r", F.row_number().over(within)).join(shifts, "channel")
    peak = (F.col("start") + F.col("end")) / 2 / fs
    edge = (F.col("start") < fs) | (F.col("end") > F.col("n_samples") - fs)
    return out.select(F.format_string("hfo_%06d", F.col("r") + F.col("shift")).alias("event_id"), "channel", "start", "end", "detector", peak.alias("peak_s"), edge.alias("boundary"))


def label_hfo(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Events with the model class of their scores (event_id, keep, spike, ehfo); every event needs scores (DSP29)."""
    out = found.join(scores, "event_id", "left")
    missing = F.col("keep").isNull()
    label = F.when(missing, F.raise_error(F.concat(F.lit("no scores for "), F.col("event_id")))).otherwise(C.combined_label(F.col("keep"), F.col("spike"), F.col("ehfo")))
    return out.withColumn("model_class", label)


def hfo_summary(channels: DataFrame, labelled: DataFrame, minutes: float) -> DataFrame:
    official = labelled.withColumn("official", C.export_class(F.col("model_class")))
    return summaries.hfo_summary(channels, official, minutes)


def gamma_spikes(signal: DataFrame, fs: float, chunk: int, context: int, recording: str = "r1") -> DataFrame:
    """Spikes of chunks with context, kept in their centres, then cleaned once over all channels: channel, sample, t.

    Clusters and bursts are judged on the whole recording, so chunk edges don't change them.
    """
    near = with_halo(signal, context, context, chunk).withColumn("off", F.greatest(F.col("block_id") * chunk - context, F.lit(0)))
    local = near.select("channel", "block_id", (F.col("sample") - F.col("off")).alias("sample"), "x")
    found = dsp.spikes(local, fs, ("channel", "block_id"))
    offset = F.greatest(F.col("block_id") * chunk - context, F.lit(0))
    found = found.withColumn("sample", F.col("sample") + offset).where(F.floor(F.col("sample") / chunk) == F.col("block_id"))
    rows = stored(found.select(F.lit(recording).alias("recording"), "channel", (F.col("sample") / fs).alias("t"), F.col("sample").alias("ord")), "spikes")  # read several times below
    n_channels = signal.select("channel").distinct().count()
    clusters = stored(events.anchored_clusters(rows, 0.010), "clusters")
    common = events.common_mode(clusters, n_channels).where("common").select("recording", "anchor")
    kept = events.burst_members(clusters.join(common, ["recording", "anchor"], "left_anti"), 0.3)
    return kept.where("not burst").select("channel", F.col("ord").alias("sample"), "t")
