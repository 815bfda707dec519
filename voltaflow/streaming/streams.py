"""Structured Streaming over event tables: an extension, the reference works in batches only.

Windowed counts, sessions and burst removal use watermarks; burst removal keeps a channel's events of the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Events of a folder of Parquet files as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """Counts and mean value per event type in sliding windows; later rows than the watermark don't count."""
    w = F.window("ts", size, step)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """Sessions per channel: runs of events no more than the gap apart."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def without_bursts(events: DataFrame, gap_s: float, late: str = "10 minutes") -> DataFrame:
    """channel, ord, t of events (channel, ord, ts) without a neighbour closer than the gap, whatever order they come in.

    An event is told once the watermark has passed it by the gap: nothing that counts can come near it any more. The
    state is a channel's events of the last watermark delay and gap, and the time of the last one told before them; rows
    that come behind the watermark don't count, neither as events nor as neighbours. A timer tells a channel's last
    events when other channels move the watermark on.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, times, ords = state.get if state.exists else (None, [], [])
        mark = state.getCurrentWatermarkMs() / 1000.0
        waiting = list(zip(times, ords))
        for rows in parts:
            seconds = rows["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6
            waiting += [(float(t), int(o)) for t, o in zip(seconds, rows["ord"]) if t >= mark]
        waiting.sort()
        done = [i for i, (t, _) in enumerate(waiting) if t + gap_s < mark]
        out = []
        for i in done:
            t = waiting[i][0]
            left = waiting[i - 1][0] if i else before
            right = waiting[i + 1][0] if i + 1 < len(waiting) else None
            if (left is None or t - left >= gap_s) and (right is None or right - t >= gap_s):
                out.append((key[0], waiting[i][1], t))
        if done:
            before, waiting = waiting[done[-1]][0], waiting[done[-1] + 1 :]
        state.update((before, [t for t, _ in waiting], [o for _, o in waiting]))
        if waiting:
            state.setTimeoutTimestamp(int(max(mark, waiting[0][0] + gap_s) * 1000) + 1)
        yield pd.DataFrame(out, columns=["channel", "ord", "t"])

    kind = dict(events.dtypes)["channel"]
    placed = events.select("channel", "ord", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    schema = "before double, times array<double>, ords array<long>"
    return placed.groupBy("channel").applyInPandasWithState(run, f"channel {kind}, ord long, t double", schema, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into a memory table (for tests and small looks)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
