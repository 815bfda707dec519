"""Queries of covers, moments, spectra, paths and project documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covers, moments, spectra
from ..sources import paths, projects, results
from . import adapters as A

# ---- covers


def hlp08(spark, sf):
    """Oscillations with 20 ms around them, against snippets kept for some: two seconds, or nearly a minute."""
    o = A.oscillations(spark, sf)
    t0, t1, k = F.col("start") / 1000.0, F.col("end") / 1000.0, F.col("start")
    asked = o.select("channel", k.alias("id"), (t0 - 0.02).alias("t0"), (t1 + 0.02).alias("t1")).groupBy("channel", "id").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    half = F.when(k % 97 == 0, 300.0).otherwise(1.0)
    held = o.where(k % 3 == 0).select("channel", k.alias("id"), (t0 - half).alias("t0"), F.when(k % 5 != 0, t0 + half).alias("t1"))
    return covers.covered(asked, held).select("channel", "id", "cover_id")


HLP08 = f"""WITH {A.OSCILLATIONS}, asked AS (SELECT channel, start AS id, min(start / 1000.0::DOUBLE - 0.02) AS t0, max("end" / 1000.0::DOUBLE + 0.02) AS t1 FROM oscillations GROUP BY channel, start),
held AS (SELECT channel, start AS id, start / 1000.0::DOUBLE - CASE WHEN start % 97 = 0 THEN 300.0 ELSE 1.0 END AS t0, start / 1000.0::DOUBLE + CASE WHEN start % 97 = 0 THEN 300.0 ELSE 1.0 END AS t1 FROM oscillations WHERE start % 3 = 0 AND start % 5 <> 0),
top AS (SELECT a.channel, a.id, a.t1, max(h.t1) AS reach FROM asked a JOIN held h ON h.channel = a.channel AND h.t0 <= a.t0 + 1e-9 GROUP BY ALL)
SELECT a.channel, a.id, (SELECT min(h.id) FROM held h WHERE h.channel = a.channel AND h.t0 <= a.t0 + 1e-9 AND h.t1 = top.reach) AS cover_id FROM asked a LEFT JOIN top ON top.channel = a.channel AND top.id = a.id AND top.reach >= a.t1 - 1e-9"""

# ---- moments: seven series a channel stand for frequencies


def series(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey"]
    li = A.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4 * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_suppkey") % 4).alias("channel"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("x"), *order)
    return A.numbered(li, "key", F.trunc("l_shipdate", "month"), order).select("channel", "k", "sample", "x")


def agg19(spark, sf):
    """Mean and deviation of each frequency over half a second before P1 and behind N2 of every spike (an order)."""
    k = F.col("o_orderkey")
    spikes = A.table(spark, sf, "orders").select(k.alias("event_id"), (k % 4).alias("channel"), (k % 2011).alias("p1"), (k % 2011 + 5 + k % 40).alias("n2"))
    rows = series(spark, sf)
    ends = rows.groupBy("channel", "k").agg(F.max("sample").alias("end")).groupBy("channel").agg(F.min("end").alias("end"))
    rows = rows.join(ends, "channel").where("sample <= end").drop("end")  # as long as the channel's shortest series
    out = moments.range_moments(moments.prefix_sums(rows, block=256), moments.baseline_ranges(spikes, A.FS), ends=ends.select("channel", (F.col("end") + 1).alias("end")))
    return out.select("event_id", "k", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


AGG19 = """WITH s AS (SELECT l_suppkey % 4 AS channel, l_linenumber AS k, row_number() OVER (PARTITION BY l_suppkey % 4, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey) - 1 AS sample, l_quantity AS x FROM lineitem),
e AS (SELECT channel, min(m) AS e FROM (SELECT channel, k, max(sample) AS m FROM s GROUP BY ALL) GROUP BY channel), r AS (SELECT s.* FROM s JOIN e USING (channel) WHERE sample <= e),
o AS (SELECT o_orderkey AS event_id, o_orderkey % 4 AS channel, o_orderkey % 2011 AS p1, o_orderkey % 2011 + 5 + o_orderkey % 40 AS n2 FROM orders),
w AS (SELECT event_id, channel, unnest(range(p1 - 49, p1)) AS sample FROM o UNION ALL SELECT event_id, channel, unnest(range(n2 + 1, n2 + 51)) FROM o)
SELECT event_id, k, CAST(count(*) AS DECIMAL(38, 0))::BIGINT AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM w JOIN r USING (channel, sample) GROUP BY event_id, k"""

# ---- spectra


def grouped_channels(spark, sf):
    n = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("channel"), F.when(F.col("n_nationkey") % 3 == 0, "micro").when(F.col("n_nationkey") % 3 == 1, "macro").alias("grp"))
    return n


def hlp05(spark, sf):
    """Sixteen channels of two groups and none, in segments of sixteen samples; the small group's signal is doubled in front."""
    twice = lambda s: s.withColumn("x", F.col("x") * 2)
    out = spectra.group_spectra(A.long_signal(spark, sf), grouped_channels(spark, sf), A.FS, {"micro": twice}, size=16)
    return out.select("grp", "channel", "bin", "freq", F.round("power", 6).alias("power"))


HLP05 = f"""WITH {A.LONG_SIGNAL}, n AS (SELECT channel, max(sample) + 1 AS n FROM long_signal GROUP BY channel),
g AS (SELECT s.channel, sample, CASE WHEN s.channel % 3 = 0 THEN 2 * x ELSE x END AS x, unnest(range(greatest(0, (sample - 8) // 8), sample // 8 + 1)) AS seg, n FROM long_signal s JOIN n USING (channel)),
f AS (SELECT channel, seg, sample - seg * 8 AS i, x - avg(x) OVER (PARTITION BY channel, seg) AS x FROM g WHERE sample - seg * 8 < 16 AND seg * 8 + 16 <= n),
h AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 15) AS w FROM (SELECT unnest(range(16)) AS i)),
b AS (SELECT channel, seg, bin, sum(x * w * cos(2 * pi() * bin * i / 16)) AS re, sum(x * w * sin(2 * pi() * bin * i / 16)) AS im FROM f JOIN h USING (i) CROSS JOIN (SELECT unnest(range(9)) AS bin) GROUP BY ALL)
SELECT CASE channel % 3 WHEN 0 THEN 'micro' WHEN 1 THEN 'macro' END AS grp, channel, bin, bin * 100.0::DOUBLE / 16 AS freq, round(avg(re * re + im * im) / (100.0 * (SELECT sum(w * w) FROM h)), 6) AS power FROM b GROUP BY channel, bin"""


def hlp05_lists(spark, sf):
    """Channels (suppliers) by nation, and what was shown of them before: in some nations another set of channels."""
    s = A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_name").alias("channel"), (1000000 - F.col("s_suppkey")).alias("ordinal"), "s_suppkey")
    before = s.where("grp % 4 <> 0 or s_suppkey % 3 <> 0").select("grp", "channel", (F.col("s_suppkey") % 2 == 0).alias("displayed"))
    return spectra.shown_lists(s.select("grp", "channel", "ordinal"), before)


HLP05_LISTS = """WITH s AS (SELECT s_nationkey AS grp, s_name AS channel, 1000000 - s_suppkey AS ordinal, grp % 4 <> 0 OR s_suppkey % 3 <> 0 AS had, s_suppkey % 2 = 0 AS shown FROM supplier),
d AS (SELECT *, NOT bool_and(had) OVER (PARTITION BY grp) OR shown AS displayed FROM s)
SELECT grp, channel, ordinal, displayed, row_number() OVER (PARTITION BY grp, displayed ORDER BY ordinal, channel) - 1 AS place FROM d"""

# ---- paths: customers name recordings, suppliers are the files that are there


def files(spark, sf):
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("s"), (F.col("s_suppkey") % 5).alias("k"))
    path = F.when(F.col("k") == 0, F.concat(F.lit("/full/"), "s", F.lit(".edf"))).otherwise(F.concat(F.lit("/data/sub-"), "s", F.lit("/run.edf")))
    return s.select(path.alias("path"))


def src09(spark, sf):
    c, k = A.table(spark, sf, "customer"), F.col("c_custkey")
    s = k.cast("string")
    rows = c.select(k.alias("row"), F.when(k % 3 == 0, F.concat(F.lit("/full//x/../"), s, F.lit(".edf"))).when(k % 3 == 1, " ").alias("edf_full_path"), F.when(k % 7 != 0, F.concat(F.lit("sub-"), s, F.lit("\\.\\run.edf"))).alias("edf_relative_path"))
    return paths.resolve_recordings(rows, files(spark, sf), "/data").select("row", "path", "problem")


SRC09 = """WITH c AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 3 = 0 THEN '/full/' || c_custkey || '.edf' END AS ful, CASE WHEN c_custkey % 7 <> 0 THEN '/data/sub-' || c_custkey || '/run.edf' END AS rel FROM customer),
f AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN '/full/' || s_suppkey || '.edf' ELSE '/data/sub-' || s_suppkey || '/run.edf' END AS p FROM supplier),
x AS (SELECT *, ful IN (SELECT p FROM f) AS a, rel IN (SELECT p FROM f) AS b FROM c)
SELECT row, CASE WHEN a THEN ful ELSE rel END AS path, CASE WHEN a OR b THEN NULL WHEN rel IS NULL THEN 'no recording is named' ELSE 'missing recording: ' || rel END AS problem FROM x"""


def src02(spark, sf):
    """Parts as .set files in folders by brand and size: beside some lies a file that a message names, or one of their stem, or just one."""
    p, k = A.table(spark, sf, "part"), F.col("p_partkey")
    folder = F.concat(F.lit("/eeg/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), (k % 13).cast("string"))
    name = k.cast("string")
    message = F.when(k % 4 == 0, F.concat(F.lit("no such file: 'C:\\rec\\old"), name, F.lit(".FDT' or \""), F.lit("old"), name, F.lit(".fdt\" / rec"), name, F.lit(".fdt")))
    sets = p.select(F.concat(folder, F.lit("/s"), name, F.lit(".set")).alias("path"), paths.named_companions(message).alias("expected"))
    there = p.select(F.explode(F.array(
        F.when(k % 8 == 0, F.concat(folder, F.lit("/rec"), name, F.lit(".fdt"))), F.when(k % 3 == 0, F.concat(folder, F.lit("/s"), name, F.lit(".fdt"))), F.when(k % 5 == 0, F.concat(folder, F.lit("/other"), name, F.lit(".fdt"))),
    )).alias("path")).where("path is not null")
    return paths.companions(sets, there)


SRC02 = """WITH p AS (SELECT p_partkey AS k, '/eeg/' || replace(p_brand, '#', '') || '/' || p_size || '/' || (p_partkey % 13) AS d FROM part),
f AS (SELECT d, d || '/rec' || k || '.fdt' AS f FROM p WHERE k % 8 = 0 UNION SELECT d, d || '/s' || k || '.fdt' FROM p WHERE k % 3 = 0 UNION SELECT d, d || '/other' || k || '.fdt' FROM p WHERE k % 5 = 0),
one AS (SELECT d, min(f) AS f FROM f GROUP BY d HAVING count(*) = 1),
r AS (SELECT k, p.d, CASE WHEN k % 8 = 0 THEN 0 WHEN k % 3 = 0 THEN 1 WHEN one.f IS NOT NULL THEN 2 END AS rule, one.f FROM p LEFT JOIN one ON one.d = p.d)
SELECT d || '/s' || k || '.set' AS path, CASE rule WHEN 0 THEN d || '/rec' || k || '.fdt' WHEN 1 THEN d || '/s' || k || '.fdt' WHEN 2 THEN f END AS companion, rule FROM r"""


def src12(spark, sf):
    c, k = A.table(spark, sf, "customer"), F.col("c_custkey")
    s = k.cast("string")
    rows = c.select(F.concat(F.lit("/data/projects/"), s, F.lit(".json")).alias("project_path"), F.when(k % 2 == 0, F.concat(F.lit("/full/"), s, F.lit(".edf"))).alias("raw_file"), F.when(k % 7 != 0, F.concat(F.lit("../sub-"), s, F.lit("/run.edf"))).alias("raw_file_relative"))
    return paths.resolve_projects(rows, files(spark, sf)).select("project_path", "recording")


SRC12 = """WITH c AS (SELECT '/data/projects/' || c_custkey || '.json' AS project_path, CASE WHEN c_custkey % 2 = 0 THEN '/full/' || c_custkey || '.edf' END AS ful, CASE WHEN c_custkey % 7 <> 0 THEN '/data/sub-' || c_custkey || '/run.edf' END AS rel FROM customer),
f AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN '/full/' || s_suppkey || '.edf' ELSE '/data/sub-' || s_suppkey || '/run.edf' END AS p FROM supplier)
SELECT project_path, CASE WHEN ful IN (SELECT p FROM f) THEN ful WHEN rel IN (SELECT p FROM f) THEN rel END AS recording FROM c"""

# ---- project documents, made of customers


def documents(spark, sf):
    c, k = A.spread(A.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")), F.col("c_custkey")
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    version = F.when(k % 11 == 0, F.lit('"3"')).when(k % 13 == 0, F.lit("9")).otherwise((k % 8 + 1).cast("string"))
    flat = F.concat(F.lit('{"highpass_hz": '), (k % 50).cast("string"), F.lit(', "lowpass_hz": null}'))
    filters = F.when(k % 8 < 3, flat).otherwise(F.concat(F.lit('{"macro": {"highpass_hz": 1.5, "lowpass_hz": '), (k % 90 + 10).cast("string"), F.lit('.25, "notch_mode": "50 Hz + harmonics"}}')))
    source = F.when(k % 17 == 0, F.lit('{"raw_file": " "}')).when(k % 19 == 0, F.lit("[]")).otherwise(F.concat(F.lit('{"raw_file": '), q(F.concat(F.lit("/data/sub/"), k.cast("string"), F.lit(".edf"))), F.lit("}")))
    hand = F.when(k % 5 == 0, F.lit("manual")).otherwise("auto")
    view = F.concat(F.lit('{"algorithm": '), q(F.when(k % 3 == 0, "mean").when(k % 3 == 1, "HFO").otherwise("gamma_spike")), F.lit(', "'), F.when(k % 8 < 3, "mean").otherwise("time"), F.lit('": {"t0": '), k.cast("string"), F.lit("}}"))
    text = F.concat(
        F.lit(f'{{"format": "{results.PROJECT_FORMAT}", "version": '), version, F.lit(', "source": '), source, F.lit(', "review": {"bad_channels": ["A1", "'), "c_mktsegment", F.lit('"], "bipolar_montage": {"pairs": [{"name": "A1-A2", "ch1": "A1", "ch2": "A2", "origin": '), q(hand),
        F.lit('}]}}, "preprocessing": {"filters": '), filters, F.lit('}, "display": {"reference": {"mode": '), q(F.when(k % 2 == 0, "bipolar").otherwise("average")), F.lit('}}, "computation": '), view, F.lit("}"),
    )
    return c.select(k.alias("id"), F.concat(F.lit("/data/projects/p"), k.cast("string"), F.lit(".json")).alias("project_path"), F.when(k % 23 == 0, F.lit("{broken")).otherwise(text).alias("document"))


def read_back(df):
    return df.select(
        "id", "problem", "version", "project_name", "raw_file", "raw_file_relative", F.array_join("bad_channels", ",").alias("bad"), F.coalesce(F.size("montage"), F.lit(-1)).alias("pairs"), F.col("macro.highpass_hz").alias("macro_hp"), F.col("macro.lowpass_hz").alias("macro_lp"),
        F.col("macro.notch_mode").alias("macro_notch"), F.col("micro.highpass_hz").alias("micro_hp"), F.col("micro.notch_mode").alias("micro_notch"), "algorithm", F.try_variant_get("time", "$.t0", "double").alias("t0"),
    )


def src11(spark, sf):
    return read_back(projects.read_projects(documents(spark, sf)))


def snk09(spark, sf):
    """Those that can be read, written in the present form and read again; the second reading is what counts."""
    found = projects.read_projects(documents(spark, sf)).where("problem is null")
    return read_back(projects.read_projects(found.select("id", projects.write_projects(found).alias("document"))))


def projects_sql(again):
    name, version = ("'p' || k", "8") if again else ("'untitled'", "k % 8 + 1")
    return f"""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey % 23 = 0 THEN 'not a project document' WHEN c_custkey % 11 = 0 THEN 'the version isn''t a whole number' WHEN c_custkey % 13 = 0 THEN 'a version that isn''t known'
    WHEN c_custkey % 17 = 0 THEN 'no recording is named' WHEN c_custkey % 19 = 0 THEN 'no source' END AS problem FROM customer),
  r AS (SELECT *, problem IS NULL AS ok, k % 8 < 3 AS flat FROM c{" WHERE problem IS NULL" if again else ""})
SELECT k AS id, problem, CASE WHEN k % 23 = 0 THEN NULL WHEN k % 11 = 0 THEN 3 WHEN k % 13 = 0 THEN 9 ELSE {version} END::BIGINT AS version, CASE WHEN ok THEN {name} END AS project_name, CASE WHEN ok THEN '/data/sub/' || k || '.edf' END AS raw_file,
  {"'../sub/' || k || '.edf'" if again else "NULL::VARCHAR"} AS raw_file_relative, CASE WHEN ok THEN 'A1,' || seg END AS bad, CASE WHEN ok {"AND k % 5 = 0" if again else ""} THEN 1 ELSE -1 END AS pairs, CASE WHEN NOT ok THEN NULL WHEN flat THEN k % 50 ELSE 1.5 END::DOUBLE AS macro_hp,
  CASE WHEN ok AND NOT flat THEN k % 90 + 10.25 END::DOUBLE AS macro_lp, CASE WHEN NOT ok THEN NULL WHEN flat THEN 'Off' ELSE '50 Hz + harmonics' END AS macro_notch, CASE WHEN ok AND flat THEN k % 50 END::DOUBLE AS micro_hp, CASE WHEN ok THEN 'Off' END AS micro_notch,
  CASE WHEN NOT ok THEN NULL WHEN k % 3 = 0 THEN 'ei' WHEN k % 3 = 1 THEN 'hfo' ELSE 'gamma_spike' END AS algorithm, CASE WHEN ok THEN k END::DOUBLE AS t0 FROM r"""


QUERIES = {
    "hlp08_covered_waveforms": (hlp08, HLP08),
    "agg19_baseline_moments": (agg19, AGG19),
    "agg08_group_spectra": (hlp05, HLP05),
    "hlp05_shown_lists": (hlp05_lists, HLP05_LISTS),
    "src09_resolved_recordings": (src09, SRC09),
    "src02_companions": (src02, SRC02),
    "src12_project_recordings": (src12, SRC12),
    "src11_read_projects": (src11, projects_sql(False)),
    "snk09_projects_round_trip": (snk09, projects_sql(True)),
}
