"""Summaries of events per channel, counts, and display statistics (AGG02-AGG24, FIL16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def hfo_summary(channels: DataFrame, events: DataFrame, minutes: float) -> DataFrame:
    """Per channel, channels without events included: counts by official class without deleted ones, rates a minute."""

    def n(*classes: str) -> Column:
        return F.count_if(F.col("official").isin(*classes))

    counted = events.groupBy("channel").agg(
        F.count_if(F.col("official") != "deleted").alias("candidate_count"), n("HFO", "spike-HFO", "eHFO", "spike-eHFO").alias("accepted_count"),
        n("HFO", "eHFO").alias("non_spike_count"), n("spike-HFO", "spike-eHFO").alias("spike_count"), n("artifact").alias("artifact_count"),
        n("deleted").alias("deleted_count"), F.count_if(F.col("boundary") & (F.col("official") != "deleted")).alias("boundary_count"),
    )
    names = [c for c in counted.columns if c != "channel"]
    out = channels.select("channel").join(counted, "channel", "left").select("channel", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))
    rates = {c.replace("_count", "_rate"): ratio(F.col(c).cast("double"), F.lit(minutes)) for c in names[:4]}
    return out.withColumns(rates | {"artifact_percentage": ratio(100.0 * F.col("artifact_count"), F.col("candidate_count"))})


def dialog_summary(events: DataFrame) -> DataFrame:
    """The dialog's split, which counts plain and early events as non-spike ones (AGG04)."""
    return events.groupBy("channel").agg(
        F.count_if(F.col("official").isin("spike-HFO", "spike-eHFO")).alias("spike_n"),
        F.count_if(F.col("official").isin("non-spike HFO", "HFO", "eHFO")).alias("non_spike_n"), F.count("*").alias("all_n"),
    )


def gamma_summary(channels: DataFrame, spikes: DataFrame) -> DataFrame:
    """channels (channel, spike_count) with gamma and other spikes, their rate, and means of finite measurements."""
    ok = lambda c: F.avg(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)))
    counted = spikes.groupBy("channel").agg(F.count_if(F.col("official") == "gamma").alias("g"), ok("power").alias("mean_power"), ok("duration").alias("mean_duration"))
    out = channels.join(counted, "channel", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    return out.select(
        "channel", F.col("spike_count").cast("long").alias("total"), F.col("g").cast("long").alias("gamma"), F.greatest(F.lit(0), F.col("spike_count") - F.col("g")).cast("long").alias("non_gamma"),
        ratio(F.col("g").cast("double"), F.col("spike_count").cast("double")).alias("gamma_rate"), "mean_power", "mean_duration",
    )


def label_counts(events: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Events per label, with zeros for classes that don't occur."""
    known = events.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    counted = events.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(counted, column, "full").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def levels(samples: DataFrame, low: float, high: float, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    return samples.groupBy(*keys).agg(F.percentile("x", F.lit(low / 100)).alias("low"), F.percentile("x", F.lit(high / 100)).alias("high"))


def padded_bounds(samples: DataFrame, keys: tuple[str, ...] = ("channel",), pad: float = 0.08) -> DataFrame:
    """Finite minimum and maximum with 8 % of the range on either side (a flat signal gets 1)."""
    ok = samples.where(~F.isnan("x") & (F.abs("x") != float("inf")))
    b = ok.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    room = F.when(F.col("hi") > F.col("lo"), pad * (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return b.select(*keys, (F.col("lo") - room).alias("lo"), (F.col("hi") + room).alias("hi"))


def sample_rate(times: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """1 over the median positive step of time."""
    w = Window.partitionBy(*keys).orderBy("t")
    steps = times.withColumn("d", F.col("t") - F.lag("t").over(w)).where("d > 0")
    return steps.groupBy(*keys).agg((1.0 / F.median("d")).alias("fs"))


def rates_by_group(channels: DataFrame) -> DataFrame:
    """Distinct rates of each group: one, or mixed from least to greatest (AGG13)."""
    g = channels.groupBy("grp").agg(F.count_distinct(F.round("rate", 6)).alias("n"), F.min(F.round("rate", 6)).alias("lo"), F.max(F.round("rate", 6)).alias("hi"))
    return g.withColumn("mixed", F.col("n") > 1)


def normalised_scores(scores: DataFrame, recording: str = "recording") -> DataFrame:
    """score over the recording's maximum (1 if that isn't positive), held to 0..1 (AGG20)."""
    top = scores.groupBy(recording).agg(F.max("score").alias("_top"))
    norm = F.col("score") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    return scores.join(top, recording).withColumn("level", F.least(F.greatest(norm, F.lit(0.0)), F.lit(1.0))).drop("_top")


def smoothed_cost(observations: DataFrame, keep: float = 0.65, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Exponential average of observations in order: keep * previous + (1 - keep) * new (AGG21)."""
    rows = observations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "v"))).alias("o"))
    first = F.col("o")[0]["v"]
    return rows.select(*keys, F.aggregate(F.slice("o", 2, F.greatest(F.size("o") - 1, F.lit(0))), first, lambda acc, o: keep * acc + (1 - keep) * o["v"]).alias("estimate"))
