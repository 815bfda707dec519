"""Recruitment and energy index of channels (entry point A): energy, onset, rank, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import windows as W


def energy_ratio(segments: DataFrame, fs: float, keys: tuple[str, ...] = ("channel",)) -> tuple[DataFrame, DataFrame]:
    """(baseline statistics, ictal HFER) of segments (keys, segment, n, x)."""
    width = max(1, int(fs / 2))
    energy = W.moving_energy(segments, width, (*keys, "segment"))
    stats = W.baseline_stats(energy.where("segment = 'baseline'"), keys)
    hfer = energy.where("segment = 'ictal'").join(stats.select(*keys, "mean_energy"), list(keys))
    return stats, hfer.select(*keys, "n", (F.col("energy") / F.col("mean_energy")).alias("hfer"))


def recruitment(hfer: DataFrame, onset: DataFrame, fs: float, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Mean HFER over a quarter second from the earliest onset of all channels, held inside each channel (AGG07).

    The last key is the channel; what is before it names the recording.
    """
    recording = list(keys[:-1])
    first = onset.groupBy(*recording).agg(F.min("onset").alias("first"))
    # one row without a recording; with many, spans are no small table, and neither they nor the samples are broadcast
    spans = onset.join(first, recording).hint("merge") if recording else onset.join(F.broadcast(first))
    spans = spans.withColumn("lo", F.least("first", F.col("length") - 1))
    spans = spans.withColumn("hi", F.least("length", F.col("lo") + max(1, round(0.25 * fs))))
    return hfer.join(spans, list(keys)).where("n >= lo and n < hi").groupBy(*keys).agg(F.avg("hfer").alias("magnitude"))


def raw_scores(segments: DataFrame, fs: float, sigmas: float, keys: tuple[str, ...], recording: str) -> DataFrame:
    """keys, recording, onset, timing_rank, magnitude, score (0..1 within the recording)."""
    stats, hfer = energy_ratio(segments, fs, keys)
    onset = W.onsets(hfer, stats, sigmas, keys)
    ranked = W.timing_rank(onset if recording in keys else onset.withColumn(recording, F.lit("r1")), recording)
    joined = ranked.join(recruitment(hfer, onset, fs, keys), list(keys))
    raw = F.sqrt(F.col("magnitude") * F.col("reciprocal").cast("double"))
    raw = F.when(F.isnan(raw) | (F.abs(raw) == float("inf")), 0.0).otherwise(raw)
    # one row a channel is left here, so windows over a recording are small
    out = joined.withColumn("raw", raw).withColumn("top", F.max("raw").over(Window.partitionBy(recording)))
    return out.withColumn("score", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.col("raw")))


def scores(segments: DataFrame, fs: float, sigmas: float = 10.0, ictal_start: float = -5.0, seizure_onset: float = 0.0) -> DataFrame:
    """channel, onset, timing rank, magnitude, score (0..1), final rank (ties in reversed channel order), relative onset."""
    out = raw_scores(segments, fs, sigmas, ("channel",), "recording")
    final = Window.partitionBy("recording").orderBy(F.desc("score"), F.desc("channel"))
    return out.select(
        "channel", "onset", "timing_rank", "magnitude", "score", F.row_number().over(final).cast("long").alias("final_rank"),
        (F.col("onset") / fs + (ictal_start - seizure_onset)).alias("relative_onset"),
    )


def batch_scores(segments: DataFrame, fs: float, sigmas: float = 10.0) -> DataFrame:
    """row, channel, onset, score, batch_rank (ties share the least) of segments (row, channel, segment, n, x) of many recordings."""
    out = raw_scores(segments, fs, sigmas, ("row", "channel"), "row")
    return out.select("row", "channel", "onset", "score", F.rank().over(Window.partitionBy("row").orderBy(F.desc("score"))).cast("long").alias("batch_rank"))
