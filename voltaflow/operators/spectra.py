"""Mean periodograms of long channels by group, and the lists of channels that a view shows (HLP05, AGG08, DSP13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from .blocks import windows_of

#: Samples of a segment at most, and of a channel at least.
SEGMENT, LEAST = 2048, 8


def segment_arrays(signal: DataFrame, size: int = SEGMENT) -> DataFrame:
    """channel, size, x: half-overlapping segments of size samples (a shorter channel is one segment; one of under 8 has none).

    A sample goes to the two segments over it, so segments of one channel are many groups.
    """
    lengths = signal.groupBy("channel").agg((F.max("sample") + 1).alias("n")).where(F.col("n") >= LEAST).withColumn("size", F.least("n", F.lit(size)))
    each = signal.join(lengths, "channel")
    whole = each.where(F.col("size") == size).withColumn("segment", F.explode(windows_of(F.col("sample"), size, max(1, size - size // 2))))
    whole = whole.where(F.col("segment") * max(1, size - size // 2) + size <= F.col("n"))
    short = each.where(F.col("size") < size).withColumn("segment", F.lit(0).cast("long"))
    grouped = whole.unionByName(short).groupBy("channel", "size", "segment").agg(F.array_sort(F.collect_list(F.struct("sample", "x"))).alias("v"))
    return grouped.select("channel", F.col("size").cast("int").alias("size"), F.col("v.x").alias("x"))


def power(x: np.ndarray, fs: float) -> np.ndarray:
    """Periodograms of rows: mean taken off, symmetric Hann window, not doubled."""
    window = np.hanning(x.shape[1])
    return np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * window, axis=1)) ** 2 / (fs * (window**2).sum())


def mean_periodogram(signal: DataFrame, fs: float, size: int = SEGMENT) -> DataFrame:
    """channel, bin, freq, power: the mean over a channel's segments, of signal (channel, sample, x).

    Tasks hand on sums of their segments' powers and counts, so what is shuffled doesn't grow with a channel's length
    but with the number of tasks that hold some of it.
    """
    kind = dict(signal.dtypes)["channel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            at: dict = {}
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                at.setdefault(key, []).append(i)
            for key, rows in at.items():
                x = np.stack([np.asarray(batch.column(2)[i].values, float) for i in rows])
                total, n = sums.get(key, (0.0, 0))
                sums[key] = (total + power(x, fs).sum(0), n + len(rows))
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], channel_type), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.list_(pa.float64())), pa.array([sums[k][1] for k in keys], pa.int64())],
                names=["channel", "size", "sums", "n"],
            )

    channel_type = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    parts = segment_arrays(signal, size).mapInArrow(run, f"channel {kind}, size int, sums array<double>, n long")
    each = parts.select("channel", "size", "n", F.posexplode("sums").alias("bin", "s"))
    mean = each.groupBy("channel", "size", "bin").agg((F.sum("s") / F.sum("n")).alias("power"))
    return mean.select("channel", F.col("bin").cast("long").alias("bin"), (F.col("bin") * F.lit(float(fs)) / F.col("size")).alias("freq"), "power")


def group_spectra(signal: DataFrame, groups: DataFrame, fs: float, filters: dict | None = None, size: int = SEGMENT) -> DataFrame:
    """grp, channel, bin, freq, power: each group's channels behind that group's filter; channels of neither group aren't filtered (grp null).

    groups: channel, grp. filters: group to a function from (channel, sample, x) to (channel, sample, x), or nothing.
    """
    parts = []
    placed = signal.join(groups.select("channel", "grp"), "channel", "left")
    for name in ("macro", "micro", None):
        own = placed.where(F.col("grp").isNull() | ~F.col("grp").isin("macro", "micro") if name is None else F.col("grp") == name).select("channel", "sample", "x")
        make = (filters or {}).get(name)
        parts.append(mean_periodogram(make(own) if make and name else own, fs, size).select(F.lit(name).cast("string").alias("grp"), "channel", "bin", "freq", "power"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shown_lists(channels: DataFrame, previous: DataFrame, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """keys, channel, ordinal, displayed, place of channels (keys, channel, ordinal) after previous choices (keys, channel, displayed).

    A group that has the very channels it had keeps its lists; in others everything is displayed. Either list is in the
    recording's order; place counts within group and list from 0.
    """
    have, had = channels.select(*keys, "channel", F.lit(True).alias("_now")), previous.select(*keys, "channel", F.lit(True).alias("_then"), "displayed").dropDuplicates([*keys, "channel"])
    both = have.join(had, [*keys, "channel"], "full")
    kept = both.groupBy(*keys).agg(F.min((F.col("_now").isNotNull() & F.col("_then").isNotNull()).cast("int")).alias("_same"))
    out = channels.join(had.drop("_then"), [*keys, "channel"], "left").join(kept, list(keys), "left")
    shown = F.when(F.col("_same") == 1, F.coalesce("displayed", F.lit(True))).otherwise(True)
    out = out.withColumn("displayed", shown)
    w = Window.partitionBy(*keys, "displayed").orderBy("ordinal", "channel")
    return out.select(*keys, "channel", "ordinal", "displayed", (F.row_number().over(w) - 1).cast("long").alias("place"))


def beta_flags(signal: DataFrame, fs: float, beta_hz: float, window_s: float = 20.0, ratio: float = 1.0, low_pass_hz: float = 30.0) -> DataFrame:
    """channel, window, flag of half-overlapping windows (FIL27): whether the greatest power between beta and 25 Hz is above so many times the median power.

    A window is filtered with zero phase below 30 Hz; its spectrum is the mean of half-overlapping pieces of at most
    512 samples under a periodic Hann window. Windows of one channel are many groups.
    """
    size = int(round(window_s * fs))
    step = max(1, size - int(round(0.5 * size)))
    ends = signal.groupBy("channel").agg((F.max("sample") + 1).alias("n"))
    each = signal.join(ends, "channel").select("channel", "sample", "x", "n", F.explode(windows_of(F.col("sample"), size, step)).alias("window"))
    whole = each.where(F.col("window") * step + size <= F.col("n")).groupBy("channel", "window").agg(F.array_sort(F.collect_list(F.struct("sample", "x"))).alias("v")).select("channel", "window", F.col("v.x").alias("x"))
    b, a = K.to_ba(*K.design(4, low_pass_hz, fs, "lowpass"))

    def flagged(x: np.ndarray) -> bool:
        y = K.filtfilt(b, a, x, 3 * (max(len(a), len(b)) - 1))
        piece = min(len(y), 512)
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(piece) / piece)
        parts = np.stack([y[s : s + piece] for s in range(0, len(y) - piece + 1, piece - piece // 2)])
        p = (np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * hann, axis=1)) ** 2).mean(0)
        p[1 : (piece + 1) // 2] *= 2  # one-sided; a common scale changes nothing
        freqs = np.fft.rfftfreq(piece, 1 / fs)
        band = (freqs > beta_hz) & (freqs < 25)
        return bool(band.any() and p[band].max() > np.median(p) * ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [flagged(np.asarray(x.values, float)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.bool_())], names=["channel", "window", "flag"])

    return whole.mapInArrow(run, f"channel {dict(signal.dtypes)['channel']}, window long, flag boolean")


def beta_mask(signal: DataFrame, fs: float, beta_hz: float = float("inf"), window_s: float = 20.0, ratio: float = 1.0) -> DataFrame:
    """signal (channel, sample, x) with `beta`: the flag of the window whose start is nearest, the earlier one on ties; off without a finite beta.

    Samples behind the last window's start have its flag; a channel without a whole window has none.
    """
    if beta_hz == float("inf"):
        return signal.withColumn("beta", F.lit(False))
    size = int(round(window_s * fs))
    step = max(1, size - int(round(0.5 * size)))
    flags = beta_flags(signal, fs, beta_hz, window_s, ratio)
    ends = signal.groupBy("channel").agg((F.max("sample") + 1).alias("_n"))
    last = F.floor((F.col("_n") - size) / step)
    near = F.greatest(F.lit(0), F.least(F.ceil(F.col("sample") / step - 0.5), last)).cast("long")
    placed = signal.join(ends, "channel").withColumn("window", near)
    return placed.join(flags, ["channel", "window"], "left").select(*signal.columns, F.coalesce("flag", F.lit(False)).alias("beta"))
