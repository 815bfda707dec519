"""Driver tables seen as recordings, events, annotations and labels; the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import numbered
from ..operators.dsp import tasks

FS = 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to many tasks: a file of keys is one task of a scan, however long the documents are that are made of them."""
    return rows.repartition(tasks(rows))


def seconds(ts):
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, sample, x from events: one channel for each event type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "ts", "event_id", F.col("value").alias("x"))
    return numbered(e, "channel", F.to_date("ts"), ["ts", "event_id"]).select("channel", "sample", "x")


SIGNAL = "signal AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sample, value AS x FROM events)"


def long_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, sample, x from lineitem: sixteen channels."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("channel"), F.col("l_quantity").alias("x"), *order)
    return numbered(rows, "channel", F.trunc("l_shipdate", "month"), order).select("channel", "sample", "x")


LONG_SIGNAL = """long_signal AS (SELECT l_suppkey % 16 AS channel, row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS sample, l_quantity AS x FROM lineitem)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel (user), t (seconds), ord, detector, power, recording."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("channel"), seconds(F.col("ts")).alias("t"), F.col("event_id").alias("ord"), F.col("event_type").alias("detector"), F.col("value").alias("power"), F.lit("r1").alias("recording"))


DETECTIONS = "detections AS (SELECT user_id AS channel, epoch_us(ts) / 1e6 AS t, event_id AS ord, event_type AS detector, value AS power, 'r1' AS recording FROM events)"


def bad_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel (null: all), t0, t1: half an hour from each error."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    t0 = seconds(F.col("ts"))
    return e.select(F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("channel"), t0.alias("t0"), (t0 + 1800.0).alias("t1"))


INTERVALS = "intervals AS (SELECT CASE WHEN event_id % 10 <> 0 THEN user_id END AS channel, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + 1800.0 AS t1 FROM events WHERE event_type = 'error')"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, ord, is_bad from part brands, once with and once without the sign that makes them unparsable."""
    p = table(spark, sf_dir, "part").select("p_brand").distinct()
    both = p.select(F.explode(F.array(F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_brand"))).alias("label"))
    return both.select("label", F.crc32(F.col("label").cast("binary")).alias("ord"), (F.col("label") == "Brand13").alias("is_bad"))


CONTACTS = "contacts AS (SELECT label, label = 'Brand13' AS is_bad FROM (SELECT DISTINCT replace(p_brand, '#', '') AS label FROM part UNION SELECT DISTINCT p_brand FROM part))"
CORE = "regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace(trim({0}), '\\s+', ' ', 'g')), '^EEG ', ''), '(-|\\s)*G[0-9]+\\s*$', ''), '\\s+', '', 'g')"
PREFIX = "nullif(regexp_extract(" + CORE + ", '([A-Z][A-Z'']*)([0-9]+)', 1), '')"
CONTACT = "CAST(nullif(regexp_extract(" + CORE + ", '([A-Z][A-Z'']*)([0-9]+)', 2), '') AS BIGINT)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, ord: many spellings of electrode labels made from supplier keys."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k").cast("string")
    spelled = F.array(
        F.concat(F.lit("EEG RA"), k), F.concat(F.lit("EEG RA "), k, F.lit(" -G2")), F.concat(F.lit(" ra0"), k), F.concat(F.lit("EEG  rb"), k, F.lit(" G2")),
        F.concat(F.lit("A2B"), k), F.concat(F.lit("C"), k, F.lit("-C"), (F.col("k") + 1).cast("string")), F.concat(F.lit("x-"), k), F.concat(F.lit("A'"), k),
    )
    return s.select("k", F.posexplode(spelled).alias("i", "label")).select("label", (F.col("k") * 8 + F.col("i")).alias("ord"), F.lit(False).alias("is_bad"))


NAMES = """names AS (SELECT unnest(['EEG RA' || s_suppkey, 'EEG RA ' || s_suppkey || ' -G2', ' ra0' || s_suppkey, 'EEG  rb' || s_suppkey || ' G2', 'A2B' || s_suppkey, 'C' || s_suppkey || '-C' || (s_suppkey + 1), 'x-' || s_suppkey, 'A''' || s_suppkey]) AS label,
  unnest(range(0, 8)) + s_suppkey * 8 AS ord FROM supplier)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, segment (baseline or ictal: a channel's first and second half), n, x."""
    s = signal(spark, sf_dir)
    half = s.groupBy("channel").agg(F.floor(F.count("*") / 2).alias("half"))
    both = s.join(half, "channel")
    first = F.col("sample") < F.col("half")
    return both.select("channel", F.when(first, "baseline").otherwise("ictal").alias("segment"), F.when(first, F.col("sample")).otherwise(F.col("sample") - F.col("half")).alias("n"), "x")


SEGMENTS = (
    SIGNAL
    + """, halves AS (SELECT channel, count(*) // 2 AS half FROM signal GROUP BY channel),
segments AS (SELECT s.channel, CASE WHEN sample < half THEN 'baseline' ELSE 'ictal' END AS segment, CASE WHEN sample < half THEN sample ELSE sample - half END AS n, x FROM signal s JOIN halves USING (channel))"""
)


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gamma spikes from events: channel, power, duration, model and manual class."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    model = F.when(F.col("event_type") == "click", "Gamma").when(F.col("event_type") == "view", "non_gamma").otherwise("")
    manual = F.when(F.col("event_id") % 11 == 0, "gamma").when(F.col("event_id") % 13 == 0, " ")
    return e.select(
        F.col("user_id").alias("channel"), F.col("event_id").alias("event_id"), seconds(F.col("ts")).alias("t"), F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("power"),
        F.when(F.col("event_id") % 5 != 0, k).alias("duration"), model.alias("model_class"), manual.alias("manual_class"),
    )


SPIKES = """spikes AS (SELECT user_id AS channel, event_id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS power,
  CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS duration,
  CASE event_type WHEN 'click' THEN 'Gamma' WHEN 'view' THEN 'non_gamma' ELSE '' END AS model_class,
  CASE WHEN event_id % 11 = 0 THEN 'gamma' WHEN event_id % 13 = 0 THEN ' ' END AS manual_class FROM events)"""


def oscillations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HFO events from lineitem: channel, sample bounds, band edges, probabilities, labels."""
    li = table(spark, sf_dir, "lineitem")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % len(LABELS) + 1).cast("int"))
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11).cast("long")
    return li.select(
        F.concat(F.lit("ch"), (F.col("l_suppkey") % 32).cast("string")).alias("channel"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
        start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), label.alias("model_class"),
        F.when(F.col("l_linenumber") == 3, "spike-HFO").when(F.col("l_linenumber") == 5, "deleted").alias("manual_class"),
        F.when(F.col("l_linenumber") != 4, 80.0 + 170.0 * (F.col("l_linenumber") % 2)).alias("low_hz"), F.lit(500.0).alias("high_hz"),
        F.col("l_discount").alias("p_artifact"), F.col("l_tax").alias("p_spike"), F.when(F.col("l_linenumber") != 2, 1 - F.col("l_discount")).alias("p_real"), F.col("l_returnflag").alias("detector"),
    )


LABELS = ("hfo", "Real_HFO", "non-spike HFO", "spike_hfo", "spkHFO", "eHFO", "spike-ehfo", "possible artifact", "excluded", "candidate", "unknown", "", "other")
OSCILLATIONS = f"""oscillations AS (SELECT 'ch' || (l_suppkey % 32) AS channel, concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id,
  l_orderkey * 37 + l_linenumber * 11 AS start, l_orderkey * 37 + l_linenumber * 11 + CAST(trunc(l_quantity) AS BIGINT) AS "end",
  list_extract({list(LABELS)!r}, CAST(l_partkey % {len(LABELS)} + 1 AS BIGINT)) AS model_class,
  CASE WHEN l_linenumber = 3 THEN 'spike-HFO' WHEN l_linenumber = 5 THEN 'deleted' END AS manual_class,
  CASE WHEN l_linenumber <> 4 THEN 80.0::DOUBLE + 170.0 * (l_linenumber % 2) END AS low_hz, 500.0::DOUBLE AS high_hz,
  l_discount AS p_artifact, l_tax AS p_spike, CASE WHEN l_linenumber <> 2 THEN 1 - l_discount END AS p_real, l_returnflag AS detector FROM lineitem)"""
