"""Containment of intervals in intervals without a cross join (HLP08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Times that differ by no more count as equal (seconds), and the width of a bucket of starts.
SLACK, BUCKET = 1e-9, 60.0


def covered(requests: DataFrame, held: DataFrame, key: str = "channel", slack: float = SLACK, bucket: float = BUCKET) -> DataFrame:
    """requests (key, id, t0, t1) with cover_id: the held interval (key, id, t0, t1) that covers it and ends last, null if none does.

    What starts at or before a request covers it if it ends late enough, so the running greatest end among the starts
    so far decides. It runs within buckets of time; what earlier buckets reach comes from their summaries, one row each,
    so a long channel is many tasks, and an interval reaches over as many buckets as it likes. Ties go to the smaller id.
    Intervals without a bound, or that end before they start, cover nothing; requests without a bound aren't covered.
    """
    good = held.where("t0 is not null and t1 is not null and not isnan(t0) and not isnan(t1) and t0 <= t1")
    place = lambda t: F.floor(t / bucket)
    reach = F.struct(F.col("t1").alias("end"), (-F.col("id")).alias("less"))
    starts = good.select(key, place(F.col("t0")).alias("bucket"), F.col("t0").alias("at"), F.lit(0).alias("kind"), reach.alias("reach"), *(F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("t0", "double"), ("t1", "double"))))
    at = F.col("t0") + slack
    asked = requests.select(key, place(at).alias("bucket"), at.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<end:double,less:bigint>").alias("reach"), "id", "t0", "t1")
    within = Window.partitionBy(key, "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = starts.unionByName(asked).withColumn("near", F.max("reach").over(within)).where("kind = 1")
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = good.groupBy(F.col(key).alias("_key"), place(F.col("t0")).alias("_from")).agg(F.max(reach).alias("top"))
    # a bucket of requests needs the reach of all buckets before it, whether it has starts of its own or not
    marks = sums.select("_key", F.col("_from").alias("_bucket"), "top").unionByName(asked.select(F.col(key).alias("_key"), F.col("bucket").alias("_bucket"), F.lit(None).cast("struct<end:double,less:bigint>").alias("top")).distinct())
    marks = marks.groupBy("_key", "_bucket").agg(F.max("top").alias("top")).withColumn("far", F.max("top").over(earlier))
    both = seen.join(marks.select(F.col("_key"), F.col("_bucket"), "far"), F.col(key).eqNullSafe(F.col("_key")) & F.col("bucket").eqNullSafe(F.col("_bucket")), "left")
    best = F.greatest("near", "far")
    return both.select(key, "id", "t0", "t1", F.when(best["end"] >= F.col("t1") - slack, -best["less"]).alias("cover_id"))
