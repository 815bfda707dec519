"""Steps whose tasks stay small: legs of pairs, moments of events with the same ranges."""

import re

from pyspark.sql import functions as F

from voltaflow.operators import moments, montage


def test_legs_of_pairs_are_not_merged_into_few_tasks(spark):
    signal = spark.range(4000).select((F.col("id") % 2).alias("channel"), F.floor(F.col("id") / 2).alias("sample"), F.col("id").cast("double").alias("x"))
    out = montage.bipolar(signal, spark.createDataFrame([("0-1", 0, 1)], "name string, ch1 long, ch2 long"))
    assert out.where("x = -1").count() == out.count() == 2000
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_events_of_the_same_ranges_share_their_moments(spark):
    """Moments of 2000 events with three sets of ranges are computed for three, and each event has them."""
    series = spark.range(400).select(F.lit(0).cast("long").alias("channel"), (F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("sample"), (F.col("id") * 7 % 31).cast("double").alias("x"))
    rows = [(e, 0, lo, hi) for e in range(2000) for lo, hi in ((-3, 5 + e % 3), (90, 210))]
    prefix = moments.prefix_sums(series, block=64)
    for ends in (None, spark.createDataFrame([(0, 200)], "channel long, end long")):
        out = moments.range_moments(prefix, spark.createDataFrame(rows, "event_id long, channel long, lo long, hi long"), ends=ends)
        assert re.search(r"Aggregate \[ranges#\d+\], \[ranges#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
        got = out.groupBy("k", F.col("event_id") % 3, "n", F.round("mean", 9), F.round("sd", 9)).count().collect()
        assert len(got) == 6 and {r.n for r in got} == {115, 116, 117} and sum(r["count"] for r in got) == 4000
