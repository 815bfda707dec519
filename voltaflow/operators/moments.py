"""Moments of any ranges of a series from prefix sums (AGG19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import BLOCK


def prefix_sums(series: DataFrame, keys: tuple[str, ...] = ("channel", "k"), block: int = BLOCK) -> DataFrame:
    """keys, sample, s, q, middle of series (keys, sample, x): sums of x and its square up to and with the sample, after x's mean is taken off.

    Sums run within blocks; what the blocks before hold comes from their totals, one row each, so a long channel is many
    tasks. Taking the mean off keeps the squares from drowning the deviation.
    """
    middle = series.groupBy(*keys).agg(F.avg("x").alias("middle"))
    rows = series.join(middle, list(keys)).withColumns({"block": F.floor(F.col("sample") / block), "y": F.col("x") - F.col("middle")})
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "block").agg(F.sum("y").alias("ys"), F.sum(F.col("y") * F.col("y")).alias("yq"))
    zero = F.lit(0.0)
    totals = totals.select(*keys, "block", F.coalesce(F.sum("ys").over(before), zero).alias("s0"), F.coalesce(F.sum("yq").over(before), zero).alias("q0"))
    w = Window.partitionBy(*keys, "block").orderBy("sample").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({"s1": F.sum("y").over(w), "q1": F.sum(F.col("y") * F.col("y")).over(w)})
    return summed.join(totals, [*keys, "block"]).select(*keys, "sample", (F.col("s0") + F.col("s1")).alias("s"), (F.col("q0") + F.col("q1")).alias("q"), "middle")


def range_moments(prefix: DataFrame, ranges: DataFrame, event: str = "event_id", channel: str = "channel", other: tuple[str, ...] = ("k",), ends: DataFrame | None = None) -> DataFrame:
    """event, other keys, n, mean, sd (of n - 1) over all ranges [lo, hi) of an event together, from prefix_sums() of gapless series.

    Two samples of the prefix sums a range are read, however long the range is, with all other keys in one row. Ranges are cut
    at the series' ends; events whose ranges are the same share one computation. An event whose ranges are all empty has no
    row, one of a single sample has no deviation. With ends (channel, end: its samples), the sums aren't made twice to find them.
    """
    ends = prefix.groupBy(channel).agg((F.max("sample") + 1).alias("end")) if ends is None else ends
    cut = ranges.join(ends, channel).select(event, F.struct(F.col(channel).alias("channel"), F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", "end").alias("hi")).alias("r")).where("r.lo < r.hi")
    events = cut.groupBy(event).agg(F.array_sort(F.collect_list("r")).alias("ranges"))
    apart = events.select("ranges").distinct()
    spans = apart.select("ranges", F.explode("ranges").alias("r"))
    edges = spans.select("ranges", F.col("r.channel").alias(channel), F.explode(F.array(F.struct((F.col("r.hi") - 1).alias("sample"), F.lit(1).alias("sign")), F.struct((F.col("r.lo") - 1).alias("sample"), F.lit(-1).alias("sign")))).alias("e"))
    edges = edges.select("ranges", channel, "e.sample", "e.sign").where("sample >= 0")
    read = prefix.join(edges.select(channel, "sample").distinct(), [channel, "sample"], "left_semi")
    read = read.groupBy(channel, "sample").agg(F.collect_list(F.struct(*other, "s", "q", "middle")).alias("v"))
    met = edges.join(read, [channel, "sample"]).select("ranges", "sign", "v").repartition("ranges")  # a row an edge goes there; its keys are told apart behind
    met = met.select("ranges", "sign", F.explode("v").alias("v")).select("ranges", "sign", "v.*")
    sums = met.groupBy("ranges", *other).agg(F.sum(F.col("sign") * F.col("s")).alias("s"), F.sum(F.col("sign") * F.col("q")).alias("q"), F.first("middle").alias("middle"))
    sums = sums.withColumn("n", F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"]))
    n, s = F.col("n"), F.col("s")
    spread = F.greatest(F.lit(0.0), F.col("q") - s * s / n)
    found = sums.select("ranges", F.struct(*other, "n", (F.col("middle") + s / n).alias("mean"), F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0)))).alias("sd")).alias("m"))
    found = found.groupBy("ranges").agg(F.collect_list("m").alias("m"))
    return events.join(found, "ranges").select(event, F.explode("m").alias("m")).select(event, "m.*")


def baseline_ranges(events: DataFrame, fs: float, pre: float = 0.5, post: float = 0.5) -> DataFrame:
    """event_id, channel, lo, hi: the stretch before p1 and that behind n2 of each event, as the gamma masks have them."""
    spans = F.array(F.struct((F.col("p1") - int(pre * fs) + 1).alias("lo"), F.col("p1").alias("hi")), F.struct((F.col("n2") + 1).alias("lo"), (F.col("n2") + 1 + int(post * fs)).alias("hi")))
    return events.select("event_id", "channel", F.explode(spans).alias("r")).select("event_id", "channel", "r.*")
