"""Queries over events: windows, joins, reviews, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classes as C
from ..operators import blocks as B
from ..operators import batch
from ..operators import events as E
from ..operators import montage as M
from ..operators import summaries as S
from ..operators import windows as W
from . import adapters as A

D, SIG, LSIG, OSC, SPK = A.DETECTIONS, A.SIGNAL, A.LONG_SIGNAL, A.OSCILLATIONS, A.SPIKES


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def flags(spark, sf):
    return A.long_signal(spark, sf).withColumn("flag", F.col("x") > 20)


FLAGS = LSIG + ", flags AS (SELECT *, x > 20 AS flag FROM long_signal)"
ISLES = FLAGS + ", isles AS (SELECT *, sample - row_number() OVER (PARTITION BY channel ORDER BY sample) AS island FROM flags WHERE flag)"


#: The same, made once where a query reads it several times.
LSIG_KEPT = LSIG.replace(" AS (", " AS MATERIALIZED (", 1)


def win06(spark, sf):
    return W.true_runs(flags(spark, sf))


def win07(spark, sf):
    return W.run_peaks(flags(spark, sf))


PEAKS = (
    ISLES
    + """, seen AS (SELECT *, lag(x) OVER r AS prev, lead(x) OVER r AS nxt, count(*) OVER (PARTITION BY channel, island) AS len, row_number() OVER (PARTITION BY channel, island ORDER BY x DESC, sample) AS best
 FROM isles WINDOW r AS (PARTITION BY channel, island ORDER BY sample)),
peaks AS (SELECT channel, sample, x FROM seen WHERE (len > 3 AND sign(nxt - x) < coalesce(sign(x - prev), 0)) OR (len <= 3 AND best = 1))"""
)


def win08(spark, sf):
    return W.poly_groups(W.run_peaks(flags(spark, sf)), 3)


def win09(spark, sf):
    s = A.long_signal(spark, sf).withColumn("flag", F.col("x") > 45)
    return W.local_maximum_of_runs(W.closing(s, 5))


def win10(spark, sf):
    n = A.long_signal(spark, sf).groupBy("channel").agg(F.count("*").alias("n"))
    return B.sliding_windows(n, 500, 100).select("channel", F.col("window_id").cast("long").alias("window_id"), "start", "stop")


def agg09(spark, sf):
    return rounded(W.lognormal_parameters(A.long_signal(spark, sf), 500, 100).select("channel", F.col("window_id").cast("long").alias("window_id"), "mu", "sigma"), "mu", "sigma")


AGG09 = f"""WITH {LSIG}, n AS (SELECT channel, count(*) AS n FROM long_signal GROUP BY channel),
w AS (SELECT channel, unnest(range(0, (n - 500) // 100 + 1)) AS window_id FROM n WHERE n >= 500),
p AS (SELECT w.channel, window_id, coalesce(avg(CASE WHEN x > 0 THEN ln(x) END), 0.0) AS mu, coalesce(stddev_samp(CASE WHEN x > 0 THEN ln(x) END), 0.0) AS sigma
 FROM w JOIN long_signal s ON s.channel = w.channel AND sample >= window_id * 100 AND sample < window_id * 100 + 500 GROUP BY ALL)"""


def win11(spark, sf):
    p = W.lognormal_parameters(A.long_signal(spark, sf), 500, 100)
    return p.select("channel", F.col("window_id").cast("long").alias("window_id"), F.round(W.lognormal_threshold(3.65, 1.0), 4).alias("threshold"))


def win12(spark, sf):
    return M.bipolar_pairs(A.contacts(spark, sf)).select("name", "ch1", "ch2", "prefix", "contact")


WIN12 = f"""WITH {A.CONTACTS}, p AS (SELECT label, is_bad, {A.PREFIX.format("label")} AS prefix, {A.CONTACT.format("label")} AS contact FROM contacts),
n AS (SELECT *, lead(label) OVER w AS ch2, lead(contact) OVER w AS nc, lead(is_bad) OVER w AS nb FROM p WHERE prefix IS NOT NULL WINDOW w AS (PARTITION BY prefix ORDER BY contact))
SELECT prefix || contact || '-' || prefix || nc AS name, label AS ch1, ch2, prefix, contact FROM n WHERE nc = contact + 1 AND NOT is_bad AND NOT nb"""


def jon16(spark, sf):
    return M.montage_skips(A.contacts(spark, sf))


JON16 = f"""WITH {A.CONTACTS}, p AS (SELECT label, is_bad, {A.PREFIX.format("label")} AS prefix, {A.CONTACT.format("label")} AS contact FROM contacts),
n AS (SELECT *, lead(contact) OVER (PARTITION BY prefix ORDER BY contact) - contact AS gap FROM p),
r AS (SELECT label, CASE WHEN prefix IS NULL THEN 'unparsed' WHEN is_bad THEN 'bad' WHEN gap <> 1 THEN 'non-consecutive' END AS reason FROM n) SELECT * FROM r WHERE reason IS NOT NULL"""


def win13(spark, sf):
    return E.burst_members(A.detections(spark, sf), 3600.0).where("not burst").select("channel", "ord", "t")


WIN13 = f"""WITH {D}, b AS (SELECT *, t - lag(t) OVER w AS before, lead(t) OVER w - t AS after FROM detections WINDOW w AS (PARTITION BY channel ORDER BY t, ord))
SELECT channel, ord, t FROM b WHERE NOT (coalesce(before < 3600.0, false) OR coalesce(after < 3600.0, false))"""


def win14(spark, sf):
    return E.anchored_clusters(A.detections(spark, sf), 600.0).select("channel", "ord", "t", "anchor")


ANCHORS = f"""WITH RECURSIVE {D}, ts AS (SELECT DISTINCT t FROM detections), a AS (SELECT min(t) AS t FROM ts UNION ALL SELECT (SELECT min(ts.t) FROM ts WHERE ts.t > a.t + 600.0) FROM a WHERE a.t IS NOT NULL),
marks AS (SELECT t AS anchor FROM a WHERE t IS NOT NULL),
clusters AS (SELECT d.*, m.anchor FROM detections d ASOF JOIN marks m ON d.t >= m.anchor)"""


def agg10(spark, sf):
    c = E.anchored_clusters(A.detections(spark, sf), 600.0)
    return E.common_mode(c, 8).select("anchor", F.col("channels").cast("long").alias("channels"), "events", "common")


def agg11(spark, sf):
    c = E.anchored_clusters(A.detections(spark, sf), 600.0)
    common = E.common_mode(c, 8).where("common").select("recording", "anchor")
    kept = E.burst_members(c.join(common, ["recording", "anchor"], "left_anti"), 3600.0)
    per = kept.groupBy("channel").agg(F.count("*").alias("not_common"), F.count_if("burst").alias("burst"), F.count_if(~F.col("burst")).alias("output"))
    total = c.groupBy("channel").agg(F.count("*").alias("input"))
    out = total.join(per, "channel", "left").select("channel", "input", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("not_common", "burst", "output")))
    return out.withColumn("common_mode", F.col("input") - F.col("not_common")).drop("not_common")


AGG11 = (
    ANCHORS
    + """, cm AS (SELECT anchor FROM clusters GROUP BY anchor HAVING count(DISTINCT channel) >= 4), rest AS (SELECT * FROM clusters WHERE anchor NOT IN (SELECT anchor FROM cm)),
b AS (SELECT *, coalesce(t - lag(t) OVER w < 3600.0, false) OR coalesce(lead(t) OVER w - t < 3600.0, false) AS burst FROM rest WINDOW w AS (PARTITION BY channel ORDER BY t, ord)),
per AS (SELECT channel, count(*) AS nc, count(*) FILTER (burst) AS burst, count(*) FILTER (NOT burst) AS output FROM b GROUP BY channel)
SELECT channel, input, coalesce(burst, 0) AS burst, coalesce(output, 0) AS output, input - coalesce(nc, 0) AS common_mode FROM (SELECT channel, count(*) AS input FROM clusters GROUP BY channel) LEFT JOIN per USING (channel)"""
)


def win15(spark, sf):
    w = Window.partitionBy("channel").orderBy("ord")
    return A.detections(spark, sf).select("channel", "ord", F.row_number().over(w).cast("long").alias("number"))


def win16(spark, sf):
    """Ids over the global order without one task: ranks within ranges of the sort key, shifted by the ranges before."""
    o = A.oscillations(spark, sf).select(F.lower("channel").alias("channel"), "start", "end", "detector", "event_id")
    within = Window.partitionBy("channel").orderBy("start", "end", "detector", "event_id")
    sizes = o.groupBy("channel").agg(F.count("*").alias("n"))
    before = Window.orderBy("channel").rowsBetween(Window.unboundedPreceding, -1)  # one row a channel
    shifts = sizes.select("channel", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    out = o.withColumn("r", F.row_number().over(within)).join(shifts, "channel")
    return out.select("event_id", "channel", F.format_string("hfo_%06d", F.col("r") + F.col("shift")).alias("id"))


def win17(spark, sf):
    return W.envelope(A.long_signal(spark, sf), 150).select("channel", F.col("bin").cast("long").alias("bin"), "first_sample", "last_sample", "first_x", "second_x")


WIN17 = f"""WITH {LSIG}, z AS (SELECT channel, min(sample) AS s0, greatest(CAST(ceil(count(*) / 150.0) AS BIGINT), 1) AS width FROM long_signal GROUP BY channel),
b AS (SELECT s.*, (sample - s0) // width AS bin FROM long_signal s JOIN z USING (channel)),
g AS (SELECT channel, bin, min(sample) AS first_sample, max(sample) AS last_sample, min(x) AS lo, max(x) AS hi, min(sample) FILTER (x = m) AS ls, min(sample) FILTER (x = k) AS hs FROM
 (SELECT *, min(x) OVER (PARTITION BY channel, bin) AS m, max(x) OVER (PARTITION BY channel, bin) AS k FROM b) GROUP BY channel, bin)
SELECT channel, bin, first_sample, last_sample, CASE WHEN hs < ls THEN hi ELSE lo END AS first_x, CASE WHEN hs < ls THEN lo ELSE hi END AS second_x FROM g"""


def win18(spark, sf):
    return W.stride(A.long_signal(spark, sf), 300)


def win19(spark, sf):
    return rounded(W.centred(A.signal(spark, sf)), "x")


def win20(spark, sf):
    base = A.long_signal(spark, sf)
    s = base.groupBy("channel").agg((F.avg("x") + F.stddev_samp("x")).alias("limit"))
    return W.true_runs(base.join(s, "channel").withColumn("flag", F.col("x") > F.col("limit"))).where("length >= 3")


def win21(spark, sf):
    c = A.spikes(spark, sf).select(F.col("channel").alias("event_id"), "power", F.col("event_id").alias("ord"))
    return W.best_candidate(c).select("event_id", "power", "ord")


def spike_windows(spark, sf, before, after):
    """Every sample above 200 as a spike's p1, with n2 30 samples later and the bounds of a window around it."""
    e = A.signal(spark, sf).where("x > 200").select("channel", F.col("sample").alias("p1"), (F.col("sample") + 30).alias("n2"))
    return e.withColumns({"lo": F.greatest(F.col("p1") - before, F.lit(0)), "hi": F.col("p1") + after})


def win22(spark, sf):
    """The best z in the search window (half a second) of every spike."""
    s = A.signal(spark, sf)
    z = s.groupBy("channel").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    near = E.event_samples(spike_windows(spark, sf, 50, 0), s, 256).join(z, "channel")
    zs = near.withColumn("z", F.round((F.col("x") - F.col("m")) / F.col("sd"), 9))
    best = F.min(F.struct((-F.col("z")).alias("a"), F.col("sample").alias("sample")))
    return zs.groupBy("channel", "p1").agg(best.alias("b")).select("channel", "p1", F.col("b.sample").alias("sample"), F.round(-F.col("b.a"), 6).alias("z"))


WIN22 = f"""WITH {SIG}, m AS (SELECT channel, avg(x) AS m, stddev_samp(x) AS sd FROM signal GROUP BY channel), e AS (SELECT channel, sample AS p1 FROM signal WHERE x > 200),
z AS (SELECT s.channel, p1, sample, round((x - m) / sd, 9) AS z FROM e JOIN signal s ON s.channel = e.channel AND sample >= p1 - 50 AND sample < p1 JOIN m ON m.channel = s.channel)
SELECT channel, p1, arg_max(sample, (z, -sample)) AS sample, round(max(z), 6) AS z FROM z GROUP BY channel, p1"""


def win23(spark, sf):
    """Masks of every spike over its own stretch, from 400 samples before p1 to 600 after."""
    s = E.event_samples(spike_windows(spark, sf, 400, 600), A.signal(spark, sf), 256)
    out = W.gamma_masks(s, A.FS).groupBy("channel", "p1").agg(F.count_if("search").alias("search_n"), F.count_if("baseline").alias("baseline_n"))
    return out.withColumn("evaluable", (F.col("baseline_n") >= int(0.25 * A.FS)) & (F.col("search_n") > 0))


WIN23 = f"""WITH {SIG}, e AS (SELECT channel, sample AS p1 FROM signal WHERE x > 200),
m AS (SELECT e.channel, p1, count(*) FILTER (sample BETWEEN p1 - 49 AND p1 - 1) AS search_n, count(*) FILTER (sample BETWEEN p1 - 49 AND p1 - 1 OR sample BETWEEN p1 + 31 AND p1 + 80) AS baseline_n FROM e JOIN signal s ON s.channel = e.channel AND sample >= p1 - 400 AND sample < p1 + 600 GROUP BY e.channel, p1)
SELECT *, baseline_n >= 25 AND search_n > 0 AS evaluable FROM m"""


def win24(spark, sf):
    r = A.long_signal(spark, sf).groupBy(F.col("channel").alias("recording")).agg(F.count("*").alias("n_samples"))
    return B.chunk_plan(r, 600, 10).withColumn("chunk_id", F.col("chunk_id").cast("long"))


def jon01(spark, sf):
    pairs = spark.createDataFrame([("0-1", 0, 1), ("1-2", 1, 2), ("2-99", 2, 99)], "name string, ch1 long, ch2 long")
    return M.bipolar(A.long_signal(spark, sf), pairs)


def jon02(how):
    return lambda spark, sf: rounded(M.common_reference(A.long_signal(spark, sf), spark.createDataFrame([(3,), (7,)], "channel long"), how), "x")


def jon02_sql(how):
    return f"WITH {LSIG}, r AS (SELECT sample, {how}(x) AS ref FROM long_signal WHERE channel NOT IN (3, 7) GROUP BY sample) SELECT channel, sample, round(x - ref, 6) AS x FROM long_signal LEFT JOIN r USING (sample)"


def jon03(spark, sf):
    return M.single_reference(A.long_signal(spark, sf), 5)


def jon04(spark, sf):
    points = A.detections(spark, sf).select("channel", "t", "ord")
    return M.bad_segment_mask(points, A.bad_intervals(spark, sf), 1800.0).select("channel", "ord", "masked")


JON04 = f"WITH {D}, {A.INTERVALS} SELECT channel, ord, EXISTS (SELECT 1 FROM intervals i WHERE (i.channel IS NULL OR i.channel = d.channel) AND d.t BETWEEN t0 AND t1) AS masked FROM detections d"


def groups(spark, sf):
    return A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("channel"), F.when(F.col("s_nationkey") % 3 == 0, "micro").when(F.col("s_nationkey") % 3 == 1, "macro").alias("grp")).where("grp is not null")


GROUPS = "groups AS (SELECT s_suppkey AS channel, CASE s_nationkey % 3 WHEN 0 THEN 'micro' ELSE 'macro' END AS grp FROM supplier WHERE s_nationkey % 3 < 2)"


def jon05(spark, sf):
    channels = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("channel"))
    modes = spark.createDataFrame([("macro", "50 Hz + harmonics")], "grp string, mode string")
    return M.notch_modes(M.group_lookup(channels, groups(spark, sf)), modes)


def jon06(spark, sf):
    p = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ch1"), (F.col("s_suppkey") + 1).alias("ch2"))
    return M.pair_groups(p, groups(spark, sf))


def windows_around(spark, sf):
    e = A.signal(spark, sf).where("x > 400").select("channel", F.col("sample").alias("event"), F.greatest(F.col("sample") - 5, F.lit(0)).alias("lo"), (F.col("sample") + 6).alias("hi"))
    return e


def jon07(spark, sf):
    out = E.waveforms(windows_around(spark, sf), A.signal(spark, sf), 256)
    return out.select("channel", "event", F.size("waveform").cast("long").alias("n"), F.round(F.aggregate("waveform", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("waveform")[0], 6).alias("first"))


JON07 = f"""WITH {SIG}, e AS (SELECT channel, sample AS event, greatest(sample - 5, 0) AS lo, sample + 6 AS hi FROM signal WHERE x > 400)
SELECT e.channel, event, count(*) AS n, round(sum(x), 6) AS total, round(arg_min(x, sample), 6) AS "first" FROM e JOIN signal s ON s.channel = e.channel AND sample >= lo AND sample < hi GROUP BY e.channel, event"""


def jon08(spark, sf):
    s = A.signal(spark, sf)
    n = s.groupBy("channel").agg(F.count("*").alias("n"))
    e = s.where("x > 400").join(n, "channel")
    lo, hi = E.fixed_window(F.col("sample"), 101, F.col("n"))
    e = e.select("channel", F.col("sample").alias("event"), lo.alias("lo"), hi.alias("hi"))
    out = E.waveforms(e, s, 256).withColumn("waveform", E.padded(F.col("waveform"), 101))
    return out.select("channel", "event", "lo", F.size("waveform").cast("long").alias("n"), F.round(F.aggregate("waveform", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


JON08 = f"""WITH {SIG}, n AS (SELECT channel, count(*) AS n FROM signal GROUP BY channel), e AS (SELECT channel, sample AS event, greatest(least(sample - 50, n - 101), 0) AS lo, n FROM signal JOIN n USING (channel) WHERE x > 400)
SELECT e.channel, event, lo, 101::BIGINT AS n, round(sum(x), 6) AS total FROM e JOIN signal s ON s.channel = e.channel AND sample >= lo AND sample < least(lo + 101, n) GROUP BY e.channel, event, lo"""


def jon09(spark, sf):
    known = A.names(spark, sf).where("ord % 8 in (0, 3, 4)").select("label", "ord")
    wanted = A.names(spark, sf).select("label").unionByName(spark.createDataFrame([("nothing",)], "label string"))
    return M.fuzzy_match(wanted, known)


KEY = "lower(regexp_replace(regexp_replace(trim(label), '(?i)^EEG\\s+', ''), '\\s+', '', 'g'))"
CORE_SQL = f"({A.PREFIX.format('label')} || {A.CONTACT.format('label')})"
JON09 = f"""WITH {A.NAMES}, known AS (SELECT label, ord, trim(label) AS k1, {KEY} AS k2, {CORE_SQL} AS k3 FROM names WHERE ord % 8 IN (0, 3, 4)),
w AS (SELECT label, trim(label) AS k1, {KEY} AS k2, {CORE_SQL} AS k3 FROM (SELECT label FROM names UNION ALL SELECT 'nothing'))
SELECT w.label, coalesce((SELECT arg_min(k.label, ord) FROM known k WHERE k.label = w.label), (SELECT arg_min(k.label, ord) FROM known k WHERE k.label = w.k1),
 (SELECT arg_min(k.label, ord) FROM known k WHERE k.k2 = w.k2), (SELECT arg_min(k.label, ord) FROM known k WHERE k.k3 = w.k3)) AS matched FROM w"""


def jon10(spark, sf):
    d = A.detections(spark, sf)
    left, right = (d.where(f"detector = '{k}'").select("channel", "t", "ord") for k in ("click", "view"))
    return E.nearest(left, right, 21600.0).select("channel", "ord", "near_ord", F.round("gap", 3).alias("gap"))


JON10 = f"""WITH {D}, p AS (SELECT l.channel, l.ord, r.ord AS near_ord, abs(r.t - l.t) AS gap, row_number() OVER (PARTITION BY l.ord ORDER BY abs(r.t - l.t), r.ord) AS k
 FROM detections l JOIN detections r ON l.channel = r.channel AND abs(r.t - l.t) <= 21600.0 WHERE l.detector = 'click' AND r.detector = 'view') SELECT channel, ord, near_ord, round(gap, 3) AS gap FROM p WHERE k = 1"""


def jon11(spark, sf):
    o = A.oscillations(spark, sf)
    log = o.where("start % 5 = 0").select("event_id", F.col("start").alias("seq"), F.when(F.col("start") % 2 == 0, "deleted").otherwise("HFO").alias("manual_class"))
    log = log.unionByName(o.where("start % 10 = 0").select("event_id", (F.col("start") + 1).alias("seq"), F.lit("artifact").alias("manual_class")))
    return E.apply_reviews(o.dropDuplicates(["event_id"]).select("event_id", "model_class"), log.dropDuplicates(["event_id", "seq"])).select("event_id", "manual_class", "review_status")


JON11 = f"""WITH {OSC}, o AS (SELECT DISTINCT event_id, start FROM oscillations), log AS (SELECT event_id, start AS seq, CASE WHEN start % 2 = 0 THEN 'deleted' ELSE 'HFO' END AS m FROM o WHERE start % 5 = 0 UNION ALL SELECT event_id, start + 1, 'artifact' FROM o WHERE start % 10 = 0),
l AS (SELECT event_id, arg_max(m, seq) AS m FROM log GROUP BY event_id)
SELECT event_id, m AS manual_class, CASE WHEN m IS NULL THEN 'unreviewed' WHEN m = 'deleted' THEN 'deleted' ELSE 'reviewed' END AS review_status FROM (SELECT DISTINCT event_id FROM o) LEFT JOIN l USING (event_id)"""


def jon12(spark, sf):
    shown = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("channel")).where("channel % 4 <> 1")
    return M.without_channels(A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("channel"), F.col("n_name").alias("name")), shown)


def jon13(spark, sf):
    o = A.table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("channel")).agg(F.sum("o_totalprice").alias("score"))
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("channel"))
    return c.join(o, "channel", "left").select("channel", F.round(F.coalesce("score", F.lit(0.0)), 2).alias("score"))


def jon14(spark, sf):
    """Customers as segments of subjects, some of whom are excluded: what the batch makes of them."""
    k, s = F.col("c_custkey"), F.concat(F.lit("sub-"), (F.col("c_custkey") % 50).cast("string"))
    edge = lambda v: F.lit(v).alias
    raw = A.table(spark, sf, "customer").select(k.alias("row"), s.alias("subject"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("edf_relative_path"), F.lit("ok").alias("segment_status"), edge("0")("baseline_start_sec"), edge("1")("baseline_end_sec"), edge("1")("ictal_start_sec"), edge("2")("ictal_end_sec"))
    reasons = A.table(spark, sf, "nation").select(F.concat(F.lit("sub-"), F.col("n_nationkey").cast("string")).alias("patient_id"), F.col("n_name").alias("reason"))
    recordings = A.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.lit(100.0).alias("native_fs"), F.lit(100.0).alias("fs"), F.lit(500).cast("long").alias("n_samples")).where("path <> 'r1'")
    return batch.assess(raw, reasons, recordings).select("row", "subject", "status", "reason")


def jon15(spark, sf):
    d = A.detections(spark, sf)
    z = d.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    chunk = F.floor((F.col("t") - F.col("t0")) / 86400.0)
    last = F.floor((F.col("t1") - F.col("t0")) / 86400.0)
    closed = F.when((F.col("t1") - F.col("t0")) % 86400.0 == 0, last - 1).otherwise(last)
    return d.join(F.broadcast(z)).select("channel", "ord", F.least(chunk, closed).alias("chunk"))


JON15 = f"WITH {D}, z AS (SELECT min(t) AS t0, max(t) AS t1 FROM detections) SELECT channel, ord, CAST(least(floor((t - t0) / 86400.0), CASE WHEN (t1 - t0) % 86400.0 = 0 THEN floor((t1 - t0) / 86400.0) - 1 ELSE floor((t1 - t0) / 86400.0) END) AS BIGINT) AS chunk FROM detections, z"


def official(spark, sf):
    o = A.oscillations(spark, sf)
    return o.withColumns({"official": C.export_class(C.official_class(F.col("manual_class"), F.col("model_class"))), "boundary": F.col("start") % 9 == 0})


def cls_sql(e, ehfo="'eHFO'", spike_ehfo="'spike-eHFO'"):
    k = f"replace(lower(trim(coalesce({e}, ''))), '_', '-')"
    return f"CASE WHEN {k} IN ('hfo', 'real-hfo', 'non-spike hfo', 'non-spike-hfo') THEN 'HFO' WHEN {k} IN ('spike-hfo', 'spkhfo') THEN 'spike-HFO' WHEN {k} = 'ehfo' THEN {ehfo} WHEN {k} = 'spike-ehfo' THEN {spike_ehfo} WHEN contains({k}, 'artifact') THEN 'artifact' WHEN {k} IN ('deleted', 'excluded') THEN 'deleted' ELSE 'candidate' END"


OFFICIAL = f"{OSC}, official AS (SELECT *, {cls_sql('coalesce(nullif(trim(manual_class), $$$$), nullif(model_class, $$$$))')} AS official, start % 9 = 0 AS boundary FROM oscillations)".replace("$$$$", "''")


def agg02(spark, sf):
    ch = spark.range(40).select(F.concat(F.lit("ch"), F.col("id").cast("string")).alias("channel"))
    out = S.hfo_summary(ch, official(spark, sf), 20.0)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


AGG02 = f"""WITH {OFFICIAL}, n AS (SELECT channel, count(*) FILTER (official <> 'deleted') AS candidate_count, count(*) FILTER (official IN ('HFO', 'spike-HFO', 'eHFO', 'spike-eHFO')) AS accepted_count, count(*) FILTER (official IN ('HFO', 'eHFO')) AS non_spike_count,
 count(*) FILTER (official IN ('spike-HFO', 'spike-eHFO')) AS spike_count, count(*) FILTER (official = 'artifact') AS artifact_count, count(*) FILTER (official = 'deleted') AS deleted_count, count(*) FILTER (boundary AND official <> 'deleted') AS boundary_count FROM official GROUP BY channel),
z AS (SELECT 'ch' || i AS channel, coalesce(candidate_count, 0) AS candidate_count, coalesce(accepted_count, 0) AS accepted_count, coalesce(non_spike_count, 0) AS non_spike_count, coalesce(spike_count, 0) AS spike_count, coalesce(artifact_count, 0) AS artifact_count, coalesce(deleted_count, 0) AS deleted_count, coalesce(boundary_count, 0) AS boundary_count FROM range(40) r(i) LEFT JOIN n ON n.channel = 'ch' || i)
SELECT *, round(candidate_count / 20.0::DOUBLE, 6) AS candidate_rate, round(accepted_count / 20.0::DOUBLE, 6) AS accepted_rate, round(non_spike_count / 20.0::DOUBLE, 6) AS non_spike_rate, round(spike_count / 20.0::DOUBLE, 6) AS spike_rate, round(CASE WHEN candidate_count > 0 THEN 100.0::DOUBLE * artifact_count / candidate_count ELSE 0 END, 6) AS artifact_percentage FROM z"""


def agg03(spark, sf):
    s = A.spikes(spark, sf)
    s = s.withColumn("official", C.gamma_class(C.official_class(F.col("manual_class"), F.col("model_class"))))
    ch = s.groupBy("channel").agg(F.count("*").alias("spike_count"))
    return rounded(S.gamma_summary(ch, s), "gamma_rate", "mean_power", "mean_duration")


GCLS = "CASE WHEN k IN ('gamma', 'gamma-spike') THEN 'gamma' WHEN k IN ('non-gamma', 'nongamma') THEN 'non-gamma' WHEN k IN ('', 'unclassified', 'unknown') THEN 'unclassified' ELSE trim(o) END"
GOFF = f"{SPK}, off AS (SELECT *, {GCLS} AS official FROM (SELECT *, regexp_replace(replace(lower(trim(coalesce(o, ''))), '_', '-'), '[\\s-]+', '-', 'g') AS k FROM (SELECT *, coalesce(CASE WHEN trim(manual_class) <> '' THEN manual_class END, CASE WHEN trim(model_class) <> '' THEN model_class END) AS o FROM spikes)))"
AGG03 = f"""WITH {GOFF}, g AS (SELECT channel, count(*) AS total, count(*) FILTER (official = 'gamma') AS gamma, avg(power) FILTER (NOT isnan(power)) AS mp, avg(duration) FILTER (NOT isnan(duration)) AS md FROM off GROUP BY channel)
SELECT channel, total, gamma, greatest(0, total - gamma) AS non_gamma, round(gamma / total, 6) AS gamma_rate, round(mp, 6) AS mean_power, round(md, 6) AS mean_duration FROM g"""


def agg04(spark, sf):
    return S.dialog_summary(official(spark, sf))


def agg05(spark, sf):
    return S.label_counts(official(spark, sf), "official", ["HFO", "spike-HFO", "eHFO", "spike-eHFO", "artifact", "deleted", "candidate", "unclassified"])


def agg13(spark, sf):
    c = A.table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("grp"), F.when(F.col("c_nationkey") % 5 == 0, 1000.0).otherwise(1000.0 + F.col("c_custkey") % 3).alias("rate"))
    return S.rates_by_group(c).select("grp", F.col("n").cast("long").alias("n"), "lo", "hi", "mixed")


def agg14(spark, sf):
    return rounded(S.levels(A.signal(spark, sf), 5, 99), "low", "high")


def agg15(spark, sf):
    return rounded(S.padded_bounds(A.signal(spark, sf)), "lo", "hi")


def agg16(spark, sf):
    return rounded(S.sample_rate(A.detections(spark, sf)), "fs", digits=9)


def agg17(spark, sf):
    f = flags(spark, sf).withColumn("flag", F.col("x") > 40)
    any_on = f.groupBy("sample").agg(F.max("flag").alias("flag")).withColumn("channel", F.lit(0))
    runs = W.true_runs(any_on).select("start", "stop")
    wide = runs.select("start", F.explode(F.sequence("start", "stop")).alias("sample"))
    inside = f.where("flag").join(wide, "sample")
    best = F.min(F.struct((-F.abs("x")).alias("a"), F.col("sample").alias("s"), F.col("x").alias("x")))
    return inside.groupBy("start", "channel").agg(F.max("x").alias("top"), F.min("sample").alias("first"), best["x"].alias("peak"), best["s"].alias("peak_at"))


AGG17 = f"""WITH {LSIG}, f AS (SELECT * FROM long_signal WHERE x > 40), s AS (SELECT DISTINCT sample FROM f), i AS (SELECT sample, sample - row_number() OVER (ORDER BY sample) AS k FROM s), r AS (SELECT min(sample) AS start, max(sample) AS stop FROM i GROUP BY k)
SELECT start, channel, max(x) AS top, min(sample) AS "first", arg_max(x, (abs(x), -sample)) AS peak, arg_max(sample, (abs(x), -sample)) AS peak_at FROM f JOIN r ON sample BETWEEN start AND stop GROUP BY start, channel"""


def agg18(spark, sf):
    o = A.oscillations(spark, sf)
    return o.groupBy("channel").agg(F.count("p_real").alias("n_real"), F.count("p_artifact").alias("n_artifact"), F.count("low_hz").alias("n_low"), F.count("manual_class").alias("n_manual"))


def agg20(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("recording"), F.col("c_custkey").alias("channel"), F.col("c_acctbal").alias("score"))
    return rounded(S.normalised_scores(c), "level")


def agg21(spark, sf):
    d = A.detections(spark, sf).select(F.col("detector").alias("kind"), F.col("ord"), F.col("power").alias("v"))
    return rounded(S.smoothed_cost(d), "estimate")


AGG21 = f"""WITH {D}, r AS (SELECT detector AS kind, power AS v, row_number() OVER (PARTITION BY detector ORDER BY ord) AS i, count(*) OVER (PARTITION BY detector) AS n FROM detections)
SELECT kind, round(sum(CASE WHEN i = 1 THEN v * pow(0.65, n - 1) ELSE 0.35 * v * pow(0.65, n - i) END), 6) AS estimate FROM r GROUP BY kind"""

QUERIES = {
    "win06_true_runs": (win06, f"WITH {ISLES} SELECT channel, min(sample) AS start, max(sample) AS stop, count(*) AS length FROM isles GROUP BY channel, island"),
    "win07_run_peaks": (win07, f"WITH {PEAKS} SELECT * FROM peaks"),
    "win08_poly_groups": (win08, f"WITH {PEAKS}, g AS (SELECT *, sum(nw) OVER (PARTITION BY channel ORDER BY sample) AS grp FROM (SELECT *, CASE WHEN sample - lag(sample) OVER (PARTITION BY channel ORDER BY sample) <= 3 THEN 0 ELSE 1 END AS nw FROM peaks)), h AS (SELECT *, lag(x, 1, 0) OVER r AS prev, lead(x, 1, 0) OVER r AS nxt, count(*) OVER (PARTITION BY channel, grp) AS n FROM g WINDOW r AS (PARTITION BY channel, grp ORDER BY sample)) SELECT channel, sample, n FROM h WHERE n = 1 OR (x >= prev AND nxt < x)"),
    "win09_detection_union": (win09, f"WITH {LSIG}, f AS (SELECT *, max(CASE WHEN x > 45 THEN 1 ELSE 0 END) OVER w AS wide FROM long_signal WINDOW w AS (PARTITION BY channel ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), c AS (SELECT *, min(wide) OVER w AS closed FROM f WINDOW w AS (PARTITION BY channel ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), i AS (SELECT *, sample - row_number() OVER (PARTITION BY channel ORDER BY sample) AS k FROM c WHERE closed = 1) SELECT channel, arg_max(sample, (x, -sample)) AS sample FROM i GROUP BY channel, k"),
    "win10_sliding_windows": (win10, f"WITH {LSIG}, n AS (SELECT channel, count(*) AS n FROM long_signal GROUP BY channel), w AS (SELECT channel, n, unnest(range(0, (n - 500) // 100 + 1)) AS window_id FROM n WHERE n >= 500) SELECT channel, window_id, window_id * 100 AS start, window_id * 100 + 500 AS stop FROM w"),
    "agg09_lognormal": (agg09, AGG09 + " SELECT channel, window_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM p"),
    "win11_lognormal_threshold": (win11, AGG09 + " SELECT channel, window_id, round(3.65 * (exp(mu - sigma * sigma) + exp(mu)) - 1.0 * (exp(mu + sigma * sigma / 2) - exp(mu - sigma * sigma)), 4) AS threshold FROM p"),
    "win12_bipolar_pairs": (win12, WIN12),
    "jon16_montage_skips": (jon16, JON16),
    "win13_burst_removal": (win13, WIN13),
    "win14_anchored_clusters": (win14, ANCHORS + " SELECT channel, ord, t, anchor FROM clusters"),
    "agg10_cluster_channels": (agg10, ANCHORS + " SELECT anchor, count(DISTINCT channel) AS channels, count(*) AS events, count(DISTINCT channel) >= 4 AS common FROM clusters GROUP BY anchor"),
    "agg11_postprocessing_qc": (agg11, AGG11),
    "win15_event_number": (win15, f"WITH {D} SELECT channel, ord, row_number() OVER (PARTITION BY channel ORDER BY ord) AS number FROM detections"),
    "win16_event_id": (win16, f"WITH {OSC} SELECT event_id, lower(channel) AS channel, printf('hfo_%06d', row_number() OVER (ORDER BY lower(channel), start, \"end\", detector, event_id)) AS id FROM oscillations"),
    "win17_envelope": (win17, WIN17),
    "win18_stride": (win18, f"WITH {LSIG}, z AS (SELECT channel, greatest(count(*) // 300, 1) AS step FROM long_signal GROUP BY channel) SELECT s.* FROM long_signal s JOIN z USING (channel) WHERE sample % step = 0"),
    "win19_trace_centring": (win19, f"WITH {SIG} SELECT channel, sample, round(x - median(x) OVER (PARTITION BY channel), 6) AS x FROM signal"),
    "win20_threshold_runs": (win20, f"WITH {LSIG}, m AS (SELECT channel, avg(x) + stddev_samp(x) AS lim FROM long_signal GROUP BY channel), i AS (SELECT channel, sample, sample - row_number() OVER (PARTITION BY channel ORDER BY sample) AS k FROM long_signal JOIN m USING (channel) WHERE x > lim) SELECT channel, min(sample) AS start, max(sample) AS stop, count(*) AS length FROM i GROUP BY channel, k HAVING count(*) >= 3"),
    "win21_max_power": (win21, f"WITH {SPK}, r AS (SELECT channel, power, event_id, row_number() OVER (PARTITION BY channel ORDER BY power DESC, event_id) AS k FROM spikes WHERE NOT isnan(power)) SELECT channel AS event_id, power, event_id AS ord FROM r WHERE k = 1"),
    "win22_best_prespike_z": (win22, WIN22),
    "win23_gamma_masks": (win23, WIN23),
    "win24_chunk_plan": (win24, f"WITH {LSIG}, n AS (SELECT channel AS recording, count(*) AS n_samples FROM long_signal GROUP BY channel), c AS (SELECT *, unnest(range(0, (n_samples + 599) // 600)) AS chunk_id FROM n) SELECT recording, n_samples, chunk_id, chunk_id * 600 AS start, least(chunk_id * 600 + 600, n_samples) AS stop, greatest(chunk_id * 600 - 10, 0) AS ext_start, least(least(chunk_id * 600 + 600, n_samples) + 10, n_samples) AS ext_stop FROM c"),
    "jon01_bipolar": (jon01, f"WITH {LSIG_KEPT}, p AS (SELECT * FROM (VALUES ('0-1', 0, 1), ('1-2', 1, 2), ('2-99', 2, 99)) v(name, ch1, ch2)), a AS MATERIALIZED (SELECT name, sample, x FROM long_signal JOIN p ON channel = ch1), b AS MATERIALIZED (SELECT name, sample, x FROM long_signal JOIN p ON channel = ch2) SELECT name, sample, a.x - b.x AS x FROM a JOIN b USING (name, sample)"),
    "jon02_common_average": (jon02("mean"), jon02_sql("avg")),
    "jon02_common_median": (jon02("median"), jon02_sql("median")),
    "jon03_single_reference": (jon03, f"WITH {LSIG}, r AS (SELECT *, max(CASE WHEN channel = 5 THEN x END) OVER (PARTITION BY sample) AS ref FROM long_signal) SELECT channel, sample, x - ref AS x FROM r WHERE ref IS NOT NULL"),
    "jon04_bad_segment_mask": (jon04, JON04),
    "jon05_group_notch": (jon05, f"WITH {GROUPS} SELECT s_suppkey AS channel, coalesce(grp, 'macro') AS grp, '50 Hz + harmonics' AS notch FROM supplier LEFT JOIN groups ON channel = s_suppkey"),
    "jon06_psd_group": (jon06, f"WITH {GROUPS} SELECT s_suppkey AS ch1, s_suppkey + 1 AS ch2, CASE WHEN a.grp = 'micro' AND b.grp = 'micro' THEN 'micro' ELSE 'macro' END AS grp_both, coalesce(a.grp, 'macro') AS grp_first FROM supplier LEFT JOIN groups a ON a.channel = s_suppkey LEFT JOIN groups b ON b.channel = s_suppkey + 1"),
    "jon07_event_waveform": (jon07, JON07),
    "jon08_candidate_waveform": (jon08, JON08),
    "jon09_fuzzy_label": (jon09, JON09),
    "jon10_nearest_event": (jon10, JON10),
    "jon11_review_match": (jon11, JON11),
    "jon12_missing_channels": (jon12, "SELECT n_nationkey AS channel, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 4 <> 1)"),
    "jon13_left_default": (jon13, "SELECT c_custkey AS channel, round(coalesce(s, 0.0), 2) AS score FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey"),
    "jon14_exclusion": (jon14, "SELECT c_custkey AS row, 'sub-' || (c_custkey % 50) AS subject, CASE WHEN n_name IS NOT NULL THEN 'skipped' WHEN c_custkey % 3 = 1 THEN 'error' ELSE 'ready' END AS status, coalesce('patient excluded from the index | ' || n_name, CASE WHEN c_custkey % 3 = 1 THEN 'missing recording: r1' ELSE '' END) AS reason FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 50"),
    "jon15_chunk_assign": (jon15, JON15),
    "agg02_hfo_summary": (agg02, AGG02),
    "agg03_gamma_summary": (agg03, AGG03),
    "agg04_dialog_summary": (agg04, f"WITH {OFFICIAL} SELECT channel, count(*) FILTER (official IN ('spike-HFO', 'spike-eHFO')) AS spike_n, count(*) FILTER (official IN ('non-spike HFO', 'HFO', 'eHFO')) AS non_spike_n, count(*) AS all_n FROM official GROUP BY channel"),
    "agg05_label_counts": (agg05, f"WITH {OFFICIAL} SELECT c AS official, count(event_id) AS n FROM (SELECT unnest(['HFO', 'spike-HFO', 'eHFO', 'spike-eHFO', 'artifact', 'deleted', 'candidate', 'unclassified']) AS c) LEFT JOIN official ON official = c GROUP BY c"),
    "agg13_sampling_rates": (agg13, "SELECT c_nationkey % 5 AS grp, count(DISTINCT r) AS n, min(r) AS lo, max(r) AS hi, count(DISTINCT r) > 1 AS mixed FROM (SELECT c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN 1000.0::DOUBLE ELSE 1000.0 + c_custkey % 3 END AS r FROM customer) GROUP BY 1"),
    "agg14_display_levels": (agg14, f"WITH {SIG} SELECT channel, round(quantile_cont(x, 0.05), 6) AS low, round(quantile_cont(x, 0.99), 6) AS high FROM signal GROUP BY channel"),
    "agg15_signal_bounds": (agg15, f"WITH {SIG} SELECT channel, round(min(x) - 0.08 * (max(x) - min(x)), 6) AS lo, round(max(x) + 0.08 * (max(x) - min(x)), 6) AS hi FROM signal GROUP BY channel"),
    "agg16_rate_from_times": (agg16, f"WITH {D}, s AS (SELECT channel, t - lag(t) OVER (PARTITION BY channel ORDER BY t) AS d FROM detections) SELECT channel, round(1.0 / median(d), 9) AS fs FROM s WHERE d > 0 GROUP BY channel"),
    "agg17_discharges": (agg17, AGG17),
    "agg18_probability_counts": (agg18, f"WITH {OSC} SELECT channel, count(p_real) AS n_real, count(p_artifact) AS n_artifact, count(low_hz) AS n_low, count(manual_class) AS n_manual FROM oscillations GROUP BY channel"),
    "agg20_score_normalise": (agg20, "SELECT c_nationkey AS recording, c_custkey AS channel, c_acctbal AS score, round(least(greatest(c_acctbal / CASE WHEN max(c_acctbal) OVER w > 0 THEN max(c_acctbal) OVER w ELSE 1.0 END, 0.0), 1.0), 6) AS level FROM customer WINDOW w AS (PARTITION BY c_nationkey)"),
    "agg21_runtime_estimate": (agg21, AGG21),
}
