"""Queries of the recruitment index and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rei
from ..operators import windows as W
from . import adapters as A

ENERGY = (
    A.SEGMENTS
    + """, energy AS (SELECT channel, segment, n, sum(x * x) OVER (PARTITION BY channel, segment ORDER BY n ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) AS energy FROM segments),
base AS (SELECT channel, CASE WHEN avg(energy) > 0 THEN avg(energy) ELSE 2.220446049250313e-16 END AS mean_energy, max(energy) AS top, stddev_samp(energy) AS sd FROM energy WHERE segment = 'baseline' GROUP BY channel),
stats AS (SELECT channel, mean_energy, top / mean_energy AS max_base, sd / mean_energy AS sd_base FROM base),
hfer AS (SELECT channel, n, energy / mean_energy AS hfer FROM energy JOIN stats USING (channel) WHERE segment = 'ictal')"""
)


def score_sql(sigmas: float) -> str:
    return f"""WITH {ENERGY}, onset AS (SELECT channel, coalesce(min(n) FILTER (hfer > max_base + {sigmas} * sd_base), max(n) + 1) AS onset, max(n) + 1 AS length FROM hfer JOIN stats USING (channel) GROUP BY channel),
ranked AS (SELECT *, row_number() OVER (ORDER BY onset, channel) AS timing_rank, (SELECT min(onset) FROM onset) AS first FROM onset),
span AS (SELECT *, least(first, length - 1) AS lo, least(length, least(first, length - 1) + 25) AS hi FROM ranked),
mag AS (SELECT channel, any_value(onset) AS onset, any_value(timing_rank) AS timing_rank, avg(hfer) AS magnitude FROM hfer JOIN span USING (channel) WHERE n >= lo AND n < hi GROUP BY channel),
raw AS (SELECT *, sqrt(magnitude * CAST(CAST(1 AS FLOAT) / CAST(timing_rank AS FLOAT) AS DOUBLE)) AS raw FROM mag),
sc AS (SELECT *, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE raw END AS score FROM raw)
SELECT channel, onset, timing_rank, round(magnitude, 6) AS magnitude, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, channel DESC) AS final_rank, round(onset / 100.0 - 5.0, 6) AS relative_onset FROM sc"""


def score(sigmas: float):
    def run(spark, sf):
        out = rei.scores(A.segments(spark, sf), A.FS, sigmas)
        return out.select("channel", "onset", "timing_rank", F.round("magnitude", 6).alias("magnitude"), F.round("score", 6).alias("score"), "final_rank", F.round("relative_onset", 6).alias("relative_onset"))

    return run


def win01(spark, sf):
    return W.moving_energy(A.segments(spark, sf), 50).select("channel", "segment", "n", F.round("energy", 6).alias("energy"))


def agg01(spark, sf):
    stats, _ = rei.energy_ratio(A.segments(spark, sf), A.FS)
    return stats.select("channel", *(F.round(c, 6).alias(c) for c in ("mean_energy", "max_base", "sd_base")))


def win02(spark, sf):
    _, hfer = rei.energy_ratio(A.segments(spark, sf), A.FS)
    return hfer.select("channel", "n", F.round("hfer", 6).alias("hfer"))


def win03(spark, sf):
    stats, hfer = rei.energy_ratio(A.segments(spark, sf), A.FS)
    return W.onsets(hfer, stats, -1.0)


def win04(spark, sf):
    s = A.signal(spark, sf).groupBy("channel").agg((F.count("*") % 7).alias("onset")).withColumn("recording", F.lit("r1"))
    return W.timing_rank(s).select("channel", "timing_rank", F.round(F.col("reciprocal").cast("double"), 6).alias("reciprocal"))


def win05b(spark, sf):
    from pyspark.sql.window import Window

    c = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("recording"), F.col("c_custkey").alias("channel"), F.floor("c_acctbal").alias("score"))
    w = Window.partitionBy("recording").orderBy(F.desc("score"))
    t = Window.partitionBy("recording").orderBy(F.desc("score"), F.desc("channel"))
    return c.select("recording", "channel", F.rank().over(w).cast("long").alias("batch_rank"), F.row_number().over(t).cast("long").alias("final_rank"))


def agg06(spark, sf):
    stats, hfer = rei.energy_ratio(A.segments(spark, sf), A.FS)
    return hfer.groupBy("channel").agg(F.round(F.max(F.when(~F.isnan("hfer"), F.col("hfer"))), 6).alias("peak"), F.round(F.avg(F.when(~F.isnan("hfer"), F.col("hfer"))), 6).alias("mean"))


def agg07(spark, sf):
    stats, hfer = rei.energy_ratio(A.segments(spark, sf), A.FS)
    out = rei.recruitment(hfer, W.onsets(hfer, stats, -1.0), A.FS)
    return out.select("channel", F.round("magnitude", 6).alias("magnitude"))


ONSET1 = "onset AS (SELECT channel, coalesce(min(n) FILTER (hfer > max_base - 1.0 * sd_base), max(n) + 1) AS onset, max(n) + 1 AS length FROM hfer JOIN stats USING (channel) GROUP BY channel)"
QUERIES = {
    "rei_score": (score(10.0), score_sql(10.0)),
    "rei_score_low_threshold": (score(-1.0), score_sql(-1.0)),
    "win01_moving_energy": (win01, f"WITH {ENERGY} SELECT channel, segment, n, round(energy, 6) AS energy FROM energy"),
    "agg01_baseline_stats": (agg01, f"WITH {ENERGY} SELECT channel, round(mean_energy, 6) AS mean_energy, round(max_base, 6) AS max_base, round(sd_base, 6) AS sd_base FROM stats"),
    "win02_baseline_normalise": (win02, f"WITH {ENERGY} SELECT channel, n, round(hfer, 6) AS hfer FROM hfer"),
    "win03_threshold_onset": (win03, f"WITH {ENERGY}, {ONSET1} SELECT * FROM onset"),
    "win04_timing_rank": (win04, f"WITH {A.SIGNAL}, o AS (SELECT channel, count(*) % 7 AS onset FROM signal GROUP BY channel), r AS (SELECT channel, row_number() OVER (ORDER BY onset, channel) AS timing_rank FROM o) SELECT channel, timing_rank, round(CAST(CAST(1 AS FLOAT) / CAST(timing_rank AS FLOAT) AS DOUBLE), 6) AS reciprocal FROM r"),
    "win05_final_and_batch_rank": (win05b, "SELECT c_nationkey AS recording, c_custkey AS channel, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal) DESC) AS batch_rank, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal) DESC, c_custkey DESC) AS final_rank FROM customer"),
    "agg06_peak_mean_hfer": (agg06, f"WITH {ENERGY} SELECT channel, round(max(hfer), 6) AS peak, round(avg(hfer), 6) AS mean FROM hfer GROUP BY channel"),
    "agg07_recruitment": (agg07, f"WITH {ENERGY}, {ONSET1}, span AS (SELECT channel, least((SELECT min(onset) FROM onset), length - 1) AS lo, length FROM onset) SELECT channel, round(avg(hfer), 6) AS magnitude FROM hfer JOIN span USING (channel) WHERE n >= lo AND n < least(length, lo + 25) GROUP BY channel"),
}
