"""Queries of predicates, projections, orders, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classes as C
from ..functions import labels as L
from ..functions import mathx as X
from ..operators import events as E
from ..operators import montage as M
from ..operators import batch
from ..operators import sorting as O
from . import adapters as A

D, SIG, LSIG, OSC, SPK = A.DETECTIONS, A.SIGNAL, A.LONG_SIGNAL, A.OSCILLATIONS, A.SPIKES


def fil01(spark, sf):
    lo, hi = X.window_bounds(F.lit(3.333), F.lit(9.001), F.lit(A.FS), F.lit(10**9))
    return A.long_signal(spark, sf).where((F.col("sample") >= lo) & (F.col("sample") < hi))


def fil02(spark, sf):
    wanted = spark.createDataFrame([(5, 0), (2, 1), (11, 2)], "channel long, ord long")
    return M.select_channels(A.long_signal(spark, sf), wanted)


def fil03(spark, sf):
    return M.without_channels(A.long_signal(spark, sf), spark.createDataFrame([(3,), (7,)], "channel long"))


def fil04(spark, sf):
    n = A.names(spark, sf)
    hidden = n.where("ord % 16 = 3").select(L.match_key(F.col("label")).alias("key")).distinct()
    return n.withColumn("key", L.match_key(F.col("label"))).join(hidden, "key", "left_anti").select("label", "ord")


def fil05(spark, sf):
    c = A.contacts(spark, sf)
    return c.join(c.where("is_bad").select("label"), "label", "left_anti").select("label")


def fil06(spark, sf):
    return A.long_signal(spark, sf).where((F.col("sample") + 1).between(601, 1200))


def fil08(spark, sf):
    return A.detections(spark, sf).where(X.round_half_away(F.col("power") * 10).between(1005, 2005)).select("ord", "power")


def fil09(spark, sf):
    s = A.signal(spark, sf).withColumn("t", F.col("sample") / A.FS)
    ends = s.groupBy("channel").agg((F.count("*") / A.FS).alias("length"))
    return s.join(ends, "channel").where("t > 2.0 and t < length - 2.0").select("channel", "sample")


def fil10(spark, sf):
    o = A.oscillations(spark, sf)
    return o.where((F.col("end") - F.col("start")) / 1000.0 <= 0.02).select("event_id", "start", "end")


def fil11(spark, sf):
    o = A.oscillations(spark, sf)
    n = o.groupBy("channel").agg(F.max("end").alias("n"))
    return o.join(n, "channel").where("start >= 1000 and `end` <= n - 1000").select("event_id", "start", "end")


def graded(spark, sf):
    return A.oscillations(spark, sf).withColumn("shown", C.grid_class(C.official_class(F.col("manual_class"), F.col("model_class"))))


def fil12(spark, sf):
    return graded(spark, sf).where("channel = 'ch3' and shown <> 'deleted'").select("event_id", "shown")


OFF = "coalesce(nullif(trim(manual_class), ''), nullif(model_class, ''))"
KEY = f"replace(lower(trim(coalesce({OFF}, ''))), '_', '-')"
GRID = f"CASE WHEN {KEY} = 'hfo' THEN 'HFO' WHEN {KEY} IN ('spike-hfo', 'spkhfo') THEN 'spike-HFO' WHEN {KEY} = 'ehfo' THEN 'eHFO' WHEN {KEY} = 'spike-ehfo' THEN 'spike-eHFO' WHEN {KEY} IN ('candidate', 'unknown', 'unclassified') THEN 'unclassified' WHEN contains({KEY}, 'artifact') THEN 'artifact' WHEN {KEY} IN ('deleted', 'excluded') THEN 'deleted' ELSE 'non-spike HFO' END"


def fil13(spark, sf):
    return A.oscillations(spark, sf).where((F.abs(F.col("low_hz") - 80.0) < 1e-6) & (F.abs(F.col("high_hz") - 500.0) < 1e-6)).select("event_id")


def fil14(spark, sf):
    s = A.spikes(spark, sf)
    return s.where((F.col("channel") < 50) & (C.finite(F.col("power")) >= 100.0)).select("event_id", "power")


def fil15(spark, sf):
    return graded(spark, sf).where(F.col("shown").isin("HFO", "spike-HFO", "artifact")).select("event_id", "shown")


def fil16(spark, sf):
    n = graded(spark, sf).groupBy("channel").agg(F.count_if(F.col("shown") == "spike-HFO").alias("n_spike"), F.count_if(F.col("shown") == "artifact").alias("n_artifact"))
    return n.where("n_spike > n_artifact")


def fil17(spark, sf):
    s = A.spikes(spark, sf).withColumn("is_gamma", C.is_gamma(F.col("power"), F.col("duration")) & (F.col("channel") % 3 != 0))
    return E.gamma_marker_mode(s, "non_gamma").select("channel", "event_id")


def fil18(spark, sf):
    o = A.table(spark, sf, "orders")
    usable = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, "Yes").when(F.col("o_orderkey") % 4 == 2, "0")
    status = F.lower("o_orderstatus")
    valid = F.when(F.trim(F.coalesce(usable, F.lit(""))) != "", X.to_bool(usable)).when(status != "p", status == "o").otherwise(False)
    return o.select("o_orderkey", valid.alias("valid"))


def fil19(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 900).cast("double").alias("onset"), (F.col("o_custkey") % 1200).cast("double").alias("offset"), F.lit(1000.0).alias("length"))
    checks = F.array(F.when(F.col("onset") > F.col("length"), "onset after end"), F.when(F.col("offset") > F.col("length"), "offset after end"), F.when(F.col("offset") <= F.col("onset"), "offset not after onset"))
    return o.select("o_orderkey", F.array_join(F.array_compact(checks), "; ").alias("reasons"))


def fil20(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 - 80.0).alias("b0"), (F.col("o_orderkey") % 70 - 20.0).alias("b1"), (F.col("o_custkey") % 30 - 10.0).alias("i0"), (F.col("o_custkey") % 40).cast("double").alias("i1"))
    bad = F.when(F.col("b1") <= F.col("b0"), "baseline empty").when(F.col("i1") <= F.col("i0"), "ictal empty").when(F.col("b1") > F.col("i0"), "baseline meets ictal").otherwise("ok")
    return o.select("o_orderkey", bad.alias("verdict"))


def fil22(spark, sf):
    p = A.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("hp"), (F.col("p_retailprice") / 4).alias("lp"), F.lit(1000.0).alias("fs"))
    nyquist = F.col("fs") / 2
    verdict = F.when(F.col("hp") >= nyquist, "high-pass").when(F.col("lp") >= nyquist, "low-pass").when(F.col("hp") >= F.col("lp"), "order").otherwise("ok")
    return p.select("p_partkey", verdict.alias("verdict"))


def fil23(spark, sf):
    d = A.detections(spark, sf)
    return d.select("ord", *(F.round(F.col("t") + s, 3).alias(n) for n, s in (("baseline_start", -70.0), ("baseline_end", -10.0), ("ictal_start", -5.0), ("ictal_end", 20.0))))


def fil24(spark, sf):
    return A.signal(spark, sf).select("channel", "sample", F.round(F.col("x") * 1e6, 3).alias("microvolts"))


def fil25(spark, sf):
    c = F.col("sample") / A.FS
    s = A.signal(spark, sf)
    lo = F.greatest(c - 0.25, F.lit(0.0))
    wide = F.greatest(c - 2.5, F.lit(0.0))
    return s.select("channel", "sample", *(F.round(v, 6).alias(n) for n, v in (("narrow_start", lo), ("narrow_end", lo + 0.5), ("wide_start", wide), ("wide_end", c + 2.5))))


def fil26(spark, sf):
    s = A.spikes(spark, sf).select("event_id", F.col("power").alias("t0"), F.coalesce("duration", F.lit(50.0)).alias("t1"))
    return E.cleaned_markers(s)


def labels(spark, sf):
    return A.names(spark, sf).select("label").unionByName(A.contacts(spark, sf).select("label"))


LABELS = f"{A.NAMES}, {A.CONTACTS}, labels AS (SELECT label FROM names UNION ALL SELECT label FROM contacts)"
P, K = A.PREFIX.format("label"), A.CONTACT.format("label")


def str02(spark, sf):
    lab = F.col("label")
    return labels(spark, sf).select("label", L.normalize_label(lab).alias("normalized"), L.core_contact(lab).alias("core"), L.prefix(lab).alias("prefix"), L.contact(lab).alias("contact"), L.match_key(lab).alias("match_key"))


def str04(spark, sf):
    return labels(spark, sf).select("label", L.looks_bipolar(F.col("label")).alias("bipolar"))


BARE = "regexp_replace(upper(regexp_replace(trim(label), '\\s+', ' ', 'g')), '^EEG ', '')"
BIPOLAR = f"len(p) = 2 AND len(list_filter(p, lambda q: {A.PREFIX.format('q')} IS NOT NULL)) = 2 AND NOT regexp_matches({BARE}, '(-|\\s)*G[0-9]+\\s*$')"


def str05(spark, sf):
    n = A.names(spark, sf)
    a, b = n.where("ord % 8 = 0").select((F.col("ord") / 8).cast("long").alias("k"), F.col("label").alias("a")), n.where("ord % 8 = 5").select((F.col("ord") / 8).cast("long").alias("k"), F.col("label").alias("b"))
    return a.join(b, "k").select("k", L.pair_name(F.col("a"), F.col("b")).alias("ab"), L.pair_name(F.col("a"), F.col("a")).alias("aa"))


def str07(spark, sf):
    o = A.oscillations(spark, sf).select("model_class").distinct()
    m = F.col("model_class")
    return o.select(
        "model_class", C.export_class(m).alias("export"), C.export_class(m, False).alias("export_plain"), C.display_class(m).alias("display"), C.display_class(m, False).alias("display_plain"),
        C.grid_class(m).alias("grid"), C.import_class(m).alias("imported"), C.manual_class(m).alias("manual"),
    )


#: The table of normalisers, by input (fixed values): export, export plain, display, display plain, grid, import, manual.
CLASS_TABLE = [
    ("hfo", "HFO", "HFO", "HFO", "non-spike HFO", "HFO", "HFO", "HFO"),
    ("Real_HFO", "HFO", "HFO", "HFO", "non-spike HFO", "non-spike HFO", "HFO", "HFO"),
    ("non-spike HFO", "HFO", "HFO", "non-spike HFO", "non-spike HFO", "non-spike HFO", "non-spike HFO", "non-spike HFO"),
    ("spike_hfo", "spike-HFO", "spike-HFO", "spike-HFO", "spike-HFO", "spike-HFO", "spike-HFO", "spike-HFO"),
    ("spkHFO", "spike-HFO", "spike-HFO", "spike-HFO", "spike-HFO", "spike-HFO", "spike-HFO", "spike-HFO"),
    ("eHFO", "eHFO", "HFO", "eHFO", "non-spike HFO", "eHFO", "eHFO", "eHFO"),
    ("spike-ehfo", "spike-eHFO", "spike-HFO", "spike-eHFO", "spike-HFO", "spike-eHFO", "spike-eHFO", "spike-eHFO"),
    ("possible artifact", "artifact", "artifact", "artifact", "artifact", "artifact", "artifact", "artifact"),
    ("excluded", "deleted", "deleted", "deleted", "deleted", "deleted", "deleted", "deleted"),
    ("candidate", "candidate", "candidate", "unclassified", "unclassified", "unclassified", "unclassified", "unclassified"),
    ("unknown", "candidate", "candidate", "unclassified", "unclassified", "unclassified", "unclassified", "unclassified"),
    ("", "candidate", "candidate", "unclassified", "unclassified", "non-spike HFO", None, "unclassified"),
    ("other", "candidate", "candidate", "other", "other", "non-spike HFO", "other", "unclassified"),
]
CLASS_SQL = "SELECT DISTINCT v.* FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in CLASS_TABLE) + f") v(model_class, export, export_plain, display, display_plain, grid, imported, manual) WHERE model_class IN (SELECT model_class FROM (WITH {OSC} SELECT model_class FROM oscillations))"


def str08(spark, sf):
    s = A.spikes(spark, sf)
    return s.select("event_id", C.gamma_class(C.official_class(F.col("manual_class"), F.col("model_class"))).alias("official"))


def str09(spark, sf):
    d = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels"), "doc_id", "left")
    model = F.when(F.col("quality") == 1, "HFO").when(F.col("quality") == 0, "artifact")
    return d.select("doc_id", C.official_class(F.when(F.col("toxic") == 1, "deleted"), model, F.lit("candidate")).alias("official"))


def str10(spark, sf):
    v = F.element_at(F.array(*map(F.lit, ("1.5", " ", "nan", "x", "inf", "-2e3", " 7 "))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return A.table(spark, sf, "part").select("p_partkey", X.to_float(v).alias("number"), X.blank_to_null(v).alias("text"), X.to_bool(v).alias("flag"))


def str12(spark, sf):
    o = A.oscillations(spark, sf)
    return o.select("event_id", C.band_label(F.lit("Ripples"), F.col("low_hz"), F.col("high_hz")).alias("band"), C.trailing_number(F.col("event_id")).alias("number"), C.preset_name(F.concat(F.lit(" Fast "), F.lower("detector"), F.lit("ipples"))).alias("preset"))


def str13(spark, sf):
    return A.detections(spark, sf).select("ord", X.clock(F.col("t") - 1704067200).alias("clock"))


def mth01(spark, sf):
    return A.spikes(spark, sf).select("event_id", F.round(X.decibel(F.coalesce("duration", F.lit(0.0))), 6).alias("db"))


def mth03(spark, sf):
    v = F.col("value") - 245.5
    return A.table(spark, sf, "events").select("event_id", X.round_half_away(v).cast("double").alias("away"), X.round_half_even(v).alias("even"), F.floor(v).cast("long").alias("lo"), F.ceil(v).cast("long").alias("hi"))


def mth04(spark, sf):
    return A.spikes(spark, sf).select("event_id", C.is_gamma(F.col("power"), F.col("duration")).alias("is_gamma"))


def mth05(spark, sf):
    real, artifact = C.filled_probabilities(F.col("p_real"), F.when(F.col("p_artifact") > 0.02, F.col("p_artifact")))
    return A.oscillations(spark, sf).select("event_id", F.round(real, 6).alias("p_real"), F.round(artifact, 6).alias("p_artifact"))


def mth06(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", F.round(X.nice_step(F.col("p_retailprice") / 7), 6).alias("step"))


def mth07(spark, sf):
    return spark.range(1).select(F.posexplode(X.frequency_grid()).alias("k", "f")).select(F.col("k").cast("long").alias("k"), F.round("f", 6).alias("f"))


def mth08(spark, sf):
    p = A.table(spark, sf, "part")
    hp, lp = F.col("p_size").cast("double") / 10, F.col("p_retailprice")
    return p.select("p_partkey", F.round(X.effective_high(F.col("p_retailprice"), F.lit(2000.0)), 6).alias("high"), F.round(X.filter_pad_seconds(hp, lp), 6).alias("pad"))


def mth10(spark, sf):
    return A.signal(spark, sf).groupBy("channel").agg(F.max("sample").alias("onset")).select("channel", F.round(X.relative_onset(F.col("onset"), A.FS, -5.0, 12.5), 6).alias("relative"))


def arr01(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("i") / A.FS, 6).alias("t"), F.round(F.col("x").cast("double"), 5).alias("x"))


def arr02(spark, sf):
    e = A.table(spark, sf, "embeddings")
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(v)
    return e.select("vec_id", F.round(F.array_max(F.transform("embedding", lambda x: x.cast("double") - mean(F.col("embedding")))), 5).alias("top"))


def dsp27(spark, sf):
    o = A.oscillations(spark, sf)
    keep, spike, ehfo = 1 - F.col("p_artifact") * 8, F.col("p_spike") * 10, F.col("p_artifact") * 10
    return o.select("event_id", C.combined_label(keep, spike, ehfo).alias("label"), C.fallback_label(F.col("p_artifact") * 8, F.col("p_spike") * 8, F.col("p_real")).alias("fallback"))


def jsn01(spark, sf):
    e = A.table(spark, sf, "events")
    parsed = F.from_json("props", "k bigint")
    return e.select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(parsed["k"].alias("k"), F.col("event_type").alias("kind"))).alias("json"))


def snk07(spark, sf):
    return A.spikes(spark, sf).select("event_id", C.finite(F.col("power")).alias("power"))


def prs01(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.concat(F.lit("-k1 "), F.col("event_id").cast("string"), F.lit(" -fl 10 -bh "), (F.col("event_id") % 90).cast("string")).alias("s"))
    from ..sources.settings import parsed_settings

    m = parsed_settings(F.col("s"))
    return e.select("event_id", m["k1"].cast("double").alias("k1"), m["bandwidth_low"].cast("double").alias("low"), m["bandwidth_high"].cast("double").alias("high"), m["k2"].cast("double").alias("k2"))


def srt01(spark, sf):
    o = A.oscillations(spark, sf).select("event_id", F.lower("channel").alias("channel"), "start", "end", "detector")
    return O.placed(o, [F.col("channel"), F.col("start"), F.col("end"), F.col("detector"), F.col("event_id")], F.struct("channel", F.floor(F.col("start") / 60_000)))


SUMMARY_CLICKS = (("power", 1), ("power", 2), ("delay", 1), ("delay", 2), ("ei", 1), ("rank", 2), ("channel", 1), ("channel", 2))


def srt04(spark, sf):
    s = A.spikes(spark, sf).withColumn("power", C.finite(F.col("power")))
    return O.placed(s.select("event_id", "power"), [F.col("power").asc_nulls_first(), F.col("event_id")], F.floor("power"))


def srt04_clicks(spark, sf):
    """Suppliers as a summary's rows: places of all of them after several clicks."""
    k = F.col("s_suppkey")
    rows = A.table(spark, sf, "supplier").select("s_name", (k % 7).alias("parity"), k)
    rows = rows.select(k.alias("ord"), F.when(F.col("parity") == 0, F.lower("s_name")).otherwise(F.col("s_name")).alias("channel"), F.when(k % 5 != 0, k * 37 % 101).alias("power"), F.when(k % 4 != 0, k * 53 % 97).alias("delay"), (k * 11 % 13).alias("ei"), (k * 29 % 31).alias("rank"))
    out = None
    for c, n in SUMMARY_CLICKS:
        w = Window.partitionBy("sorted_by").orderBy(*O.summary_order(c, n))  # a summary has a row a channel
        part = rows.withColumn("sorted_by", F.lit(f"{c} {n}")).select("sorted_by", "ord", F.row_number().over(w).cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def srt05(spark, sf):
    """The first three rows of a heatmap in each of its six orders."""
    s = A.signal(spark, sf).groupBy("channel").agg(F.max("x").alias("peak"), F.avg("x").alias("mean"), F.count("*").alias("n"))
    rows = s.withColumns({"ord": F.length("channel") * 100 + F.ascii("channel"), "ei": F.col("n") % 97, "delay": F.col("n") % 89})
    out = None
    for mode in (*O.HEATMAP_MODES, "original"):
        part = O.top_rows(rows, O.heatmap_order(mode), 3).select(F.lit(mode).alias("mode"), "channel", F.round("peak", 6).alias("peak"))
        out = part if out is None else out.unionByName(part)
    return out


def srt06(spark, sf):
    return O.page_of(A.detections(spark, sf).select("channel", "t", "ord"), [F.col("t"), F.col("ord")], ["channel"]).select("channel", "ord", "page", "slot")


def srt07(spark, sf):
    """Every event's place by time and by channel."""
    d = A.detections(spark, sf).select("channel", F.floor("t").alias("start"), F.col("ord").cast("string").alias("num"))
    by_time = O.placed(d, O.review_order(True), F.floor(F.col("start") / 3600)).withColumnRenamed("place", "by_time")
    return O.placed(by_time, O.review_order(False), F.struct("channel", F.floor(F.col("start") / 86400))).withColumnRenamed("place", "by_channel")


def srt08(spark, sf):
    c = A.table(spark, sf, "nation").select(F.col("n_name").alias("channel"), F.col("n_nationkey").cast("long").alias("ord"))
    wanted = A.table(spark, sf, "nation").where("n_nationkey % 4 = 1").select(F.col("n_name").alias("channel"), (100 - F.col("n_nationkey")).cast("long").alias("pos"))
    return O.display_order(c, wanted.unionByName(wanted.withColumn("pos", F.col("pos") + 50)))


def srt09(spark, sf):
    n = A.contacts(spark, sf).select("label")
    from pyspark.sql.window import Window

    # a recording has a bounded number of labels, so ranking them in one window is small
    return n.select("label", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*O.label_order(F.col("label")))).cast("long").alias("place"))


def set01(spark, sf):
    d = A.detections(spark, sf)
    parts = [d.where(f"detector = '{k}'").select("channel", "t", F.lit(k).alias("detector")) for k in ("click", "view", "error")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("channel", "detector").agg(F.count("*").alias("n"))


def set02(spark, sf):
    return O.ordered_distinct(A.detections(spark, sf), "channel", "ord")


def set03(spark, sf):
    d = A.detections(spark, sf)
    return O.ordered_union(d.where("detector = 'click' and channel % 3 = 0").select("channel", "ord"), d.where("channel % 2 = 0").select("channel", "ord"))


def set04(spark, sf):
    c = lambda q: A.detections(spark, sf).where(q).select("channel")
    return O.updated_set(c("channel % 3 = 0"), c("channel % 5 = 0"), c("channel % 7 = 0").distinct())


def set05(spark, sf):
    c = lambda q: A.detections(spark, sf).where(q).select("channel")
    return c("channel % 3 = 0").intersect(c("channel % 2 = 0"))


def set06(spark, sf):
    g = A.spikes(spark, sf).select(F.lit("gamma").alias("source"), F.col("channel").cast("string").alias("channel"), F.col("t").alias("start"), F.col("t").alias("end"))
    h = A.oscillations(spark, sf).select(F.lit("hfo").alias("source"), "channel", (F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"))
    return g.unionByName(h).groupBy("source", "channel").agg(F.count("*").alias("n"), F.round(F.min("start"), 3).alias("first"), F.round(F.max("end"), 3).alias("last"))


def dml01(spark, sf):
    d = A.detections(spark, sf).select(F.col("ord").alias("request_id"), F.element_at(F.array(F.lit("global"), F.lit("selected"), F.lit("clicked")), (F.col("ord") % 3 + 1).cast("int")).alias("scope"),
        F.when(F.col("ord") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("channels"), F.col("channel").cast("string").alias("clicked"), F.col("power").alias("t0"), F.lit(250.0).alias("t1"), F.lit("Spike").alias("kind"))
    return E.annotate(d)


def dml02(spark, sf):
    d = A.detections(spark, sf)
    base = d.select(F.col("ord").alias("id"), "power")
    changes = d.where("ord % 4 = 0").select(F.col("ord").alias("id"), (F.col("power") + 1).alias("power"), F.lit(1).cast("long").alias("seq"), F.lit("upsert").alias("op"))
    changes = changes.unionByName(d.where("ord % 12 = 0").select(F.col("ord").alias("id"), "power", F.lit(2).cast("long").alias("seq"), F.lit("delete").alias("op")))
    return rounded_power(E.merge_log(base, changes))


def rounded_power(df):
    return df.withColumn("power", F.round("power", 6))


def dml05(spark, sf):
    known = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("channel"))
    saved = A.table(spark, sf, "customer").groupBy((F.col("c_custkey") % 40).alias("channel")).agg(F.min("c_mktsegment").alias("grp"))
    saved = saved.where(F.col("grp").isin("AUTOMOBILE", "BUILDING"))
    return known.join(saved, "channel", "left").select("channel", F.coalesce("grp", F.lit("macro")).alias("grp"))


def fil07(spark, sf):
    """Half-open centres, the last one closed."""
    d = A.detections(spark, sf)
    z = d.agg(F.max("t").alias("stop"))
    t0 = 1704067200.0
    keep = (F.col("t") >= t0) & ((F.col("t") < t0 + 864000.0) | ((F.col("t") == F.col("stop")) & (F.col("stop") <= t0 + 864000.0)))
    return d.join(F.broadcast(z)).where(keep).select("ord", "t")


def srt03(spark, sf):
    return O.placed(A.detections(spark, sf).select("t", "channel", "ord"), [F.col("t"), F.col("channel"), F.col("ord")], F.floor(F.col("t") / 3600))


def srt10(spark, sf):
    h = A.oscillations(spark, sf).select((F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"), F.col("detector").alias("source"), "channel", "event_id")
    return O.placed(h, [F.col("start"), F.col("end"), F.col("source"), F.col("channel"), F.col("event_id")], F.floor(F.col("start") / 60))


def dml03(spark, sf):
    """Annotations from JSON with defaults for what is missing."""
    e = A.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.format_string('{"id":"a%d","kind":"Artifact","t_start":%d,"t_end":%d}', "event_id", "event_id", F.col("event_id") + 2)).otherwise(F.format_string('{"id":"a%d","t_start":%d}', "event_id", "event_id")).alias("j"))
    a = F.from_json("j", "id string, kind string, t_start double, t_end double, note string")
    e = e.select(a.alias("a")).select("a.*")
    return e.select("id", F.coalesce("kind", F.lit("Other")).alias("kind"), "t_start", F.coalesce("t_end", "t_start").alias("t_end"), F.coalesce("note", F.lit("")).alias("note"))


def agg12(spark, sf):
    """Orders as entries of a batch's log, some of them logged twice: the last entry counts."""
    k = F.col("o_orderkey")
    o = A.table(spark, sf, "orders").select(F.explode(F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))).cast("array<bigint>")).alias("attempt"), k.alias("row"), F.col("o_custkey").alias("c"))
    status = F.when(F.col("attempt") == 1, "error").otherwise(F.element_at(F.array(*map(F.lit, ("ok", "skipped", "error"))), (F.col("row") % 3 + 1).cast("int")))
    log = o.select("attempt", "row", status.alias("status"), F.when(status == "ok", F.col("c") % 4).alias("excluded_channel_count"))
    return batch.tally(log)


SRT04 = """WITH s AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 7 = 0 THEN lower(s_name) ELSE s_name END AS channel, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 37 % 101 END AS power, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 53 % 97 END AS delay, s_suppkey * 11 % 13 AS ei, s_suppkey * 29 % 31 AS rank FROM supplier)
SELECT 'power 1' AS sorted_by, ord, row_number() OVER (ORDER BY power NULLS FIRST, ord) AS place FROM s UNION ALL SELECT 'power 2', ord, row_number() OVER (ORDER BY power DESC NULLS LAST, ord) FROM s
UNION ALL SELECT 'delay 1', ord, row_number() OVER (ORDER BY delay NULLS LAST, ord) FROM s UNION ALL SELECT 'delay 2', ord, row_number() OVER (ORDER BY delay DESC NULLS FIRST, ord) FROM s
UNION ALL SELECT 'ei 1', ord, row_number() OVER (ORDER BY ei DESC, ord) FROM s UNION ALL SELECT 'rank 2', ord, row_number() OVER (ORDER BY rank DESC, ord) FROM s
UNION ALL SELECT 'channel 1', ord, row_number() OVER (ORDER BY lower(channel), ord) FROM s UNION ALL SELECT 'channel 2', ord, row_number() OVER (ORDER BY ord) FROM s"""
SRT05 = f"""WITH {SIG}, c AS (SELECT channel, max(x) AS peak, avg(x) AS mean, count(*) AS n, length(channel) * 100 + ascii(channel) AS ord FROM signal GROUP BY channel),
r AS (SELECT unnest(['ei_score', 'recruitment_delay', 'peak_hfer', 'mean_hfer', 'channel_name', 'original']) AS mode, unnest([
  row_number() OVER (ORDER BY n % 97 DESC, ord), row_number() OVER (ORDER BY n % 89, ord), row_number() OVER (ORDER BY peak DESC, ord), row_number() OVER (ORDER BY mean DESC, ord), row_number() OVER (ORDER BY lower(channel), ord), row_number() OVER (ORDER BY ord)]) AS place, channel, peak FROM c)
SELECT mode, channel, round(peak, 6) AS peak FROM r WHERE place <= 3"""

QUERIES = {
    "agg12_batch_tallies": (agg12, "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' ELSE 'error' END AS status, count(*) AS n_rows, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 ELSE 0 END) AS BIGINT) AS excluded_channels FROM orders GROUP BY 1"),
    "fil07_central_by_time": (fil07, f"WITH {D}, z AS (SELECT max(t) AS stop FROM detections) SELECT ord, t FROM detections, z WHERE t >= 1704067200.0 AND (t < 1704931200.0 OR (t = stop AND stop <= 1704931200.0))"),
    "srt03_detector_order": (srt03, f"WITH {D} SELECT t, channel, ord, row_number() OVER (ORDER BY t NULLS FIRST, channel NULLS FIRST, ord NULLS FIRST) - 1 AS place FROM detections"),
    "srt10_timeline_order": (srt10, f"WITH {OSC} SELECT start / 1000.0::DOUBLE AS start, \"end\" / 1000.0::DOUBLE AS \"end\", detector AS source, channel, event_id, row_number() OVER (ORDER BY o.start, o.\"end\", detector, channel, event_id) - 1 AS place FROM oscillations o"),
    "dml03_restore_annotations": (dml03, "SELECT 'a' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'Artifact' ELSE 'Other' END AS kind, event_id::DOUBLE AS t_start, (CASE WHEN event_id % 3 = 0 THEN event_id + 2 ELSE event_id END)::DOUBLE AS t_end, '' AS note FROM events"),
    "fil01_time_window": (fil01, f"WITH {LSIG} SELECT * FROM long_signal WHERE sample >= floor(3.333 * 100) AND sample < ceil(9.001 * 100)"),
    "fil02_select_channels": (fil02, f"WITH {LSIG} SELECT s.*, ord FROM long_signal s JOIN (VALUES (5, 0), (2, 1), (11, 2)) v(channel, ord) USING (channel)"),
    "fil03_exclude_bad": (fil03, f"WITH {LSIG} SELECT * FROM long_signal WHERE channel NOT IN (3, 7)"),
    "fil04_visible_channels": (fil04, f"WITH {A.NAMES}, k AS (SELECT *, lower(regexp_replace(regexp_replace(trim(label), '(?i)^EEG\\s+', ''), '\\s+', '', 'g')) AS key FROM names) SELECT label, ord FROM k WHERE key NOT IN (SELECT key FROM k WHERE ord % 16 = 3)"),
    "fil05_reference_pool": (fil05, f"WITH {A.CONTACTS} SELECT label FROM contacts WHERE NOT is_bad"),
    "fil06_central_chunk": (fil06, f"WITH {LSIG} SELECT * FROM long_signal WHERE sample + 1 BETWEEN 601 AND 1200"),
    "fil08_analysis_window": (fil08, f"WITH {D} SELECT ord, power FROM detections WHERE sign(power) * floor(abs(power * 10) + 0.5) BETWEEN 1005 AND 2005"),
    "fil09_edge_trim": (fil09, f"WITH {SIG}, n AS (SELECT channel, count(*) / 100.0::DOUBLE AS length FROM signal GROUP BY channel) SELECT channel, sample FROM signal JOIN n USING (channel) WHERE sample / 100.0::DOUBLE > 2.0 AND sample / 100.0::DOUBLE < length - 2.0"),
    "fil10_max_duration": (fil10, f"WITH {OSC} SELECT event_id, start, \"end\" FROM oscillations WHERE (\"end\" - start) / 1000.0::DOUBLE <= 0.02::DOUBLE"),
    "fil11_boundary_padding": (fil11, f"WITH {OSC} SELECT event_id, start, \"end\" FROM (SELECT *, max(\"end\") OVER (PARTITION BY channel) AS n FROM oscillations) WHERE start >= 1000 AND \"end\" <= n - 1000"),
    "fil12_review_grid": (fil12, f"WITH {OSC}, g AS (SELECT *, {GRID} AS shown FROM oscillations) SELECT event_id, shown FROM g WHERE channel = 'ch3' AND shown <> 'deleted'"),
    "fil13_band": (fil13, f"WITH {OSC} SELECT event_id FROM oscillations WHERE abs(low_hz - 80) < 1e-6 AND abs(high_hz - 500) < 1e-6"),
    "fil14_gamma_review": (fil14, f"WITH {SPK} SELECT event_id, power FROM spikes WHERE channel < 50 AND NOT isnan(power) AND power >= 100"),
    "fil15_marker_visibility": (fil15, f"WITH {OSC}, g AS (SELECT *, {GRID} AS shown FROM oscillations) SELECT event_id, shown FROM g WHERE shown IN ('HFO', 'spike-HFO', 'artifact')"),
    "fil16_summary_level": (fil16, f"WITH {OSC}, g AS (SELECT *, {GRID} AS shown FROM oscillations) SELECT channel, count(*) FILTER (shown = 'spike-HFO') AS n_spike, count(*) FILTER (shown = 'artifact') AS n_artifact FROM g GROUP BY channel HAVING count(*) FILTER (shown = 'spike-HFO') > count(*) FILTER (shown = 'artifact')"),
    "fil17_marker_build": (fil17, f"WITH {SPK} SELECT channel, event_id FROM spikes WHERE channel NOT IN (SELECT channel FROM spikes WHERE NOT isnan(power) AND duration IS NOT NULL AND (power > 0 OR duration > 0) AND channel % 3 <> 0)"),
    "fil18_row_validity": (fil18, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN true WHEN 2 THEN false ELSE CASE WHEN lower(o_orderstatus) <> 'p' THEN lower(o_orderstatus) = 'o' ELSE false END END AS valid FROM orders"),
    "fil19_annotation_consistency": (fil19, "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 900 > 1000 THEN 'onset after end' END, CASE WHEN o_custkey % 1200 > 1000 THEN 'offset after end' END, CASE WHEN o_custkey % 1200 <= o_orderkey % 900 THEN 'offset not after onset' END) AS reasons FROM orders"),
    "fil20_timing_validation": (fil20, "SELECT o_orderkey, CASE WHEN o_orderkey % 70 - 20 <= o_orderkey % 100 - 80 THEN 'baseline empty' WHEN o_custkey % 40 <= o_custkey % 30 - 10 THEN 'ictal empty' WHEN o_orderkey % 70 - 20 > o_custkey % 30 - 10 THEN 'baseline meets ictal' ELSE 'ok' END AS verdict FROM orders"),
    "fil22_filter_validation": (fil22, "SELECT p_partkey, CASE WHEN p_size * 10.0 >= 500 THEN 'high-pass' WHEN p_retailprice / 4 >= 500 THEN 'low-pass' WHEN p_size * 10.0 >= p_retailprice / 4 THEN 'order' ELSE 'ok' END AS verdict FROM part"),
    "fil23_default_windows": (fil23, f"WITH {D} SELECT ord, round(t - 70, 3) AS baseline_start, round(t - 10, 3) AS baseline_end, round(t - 5, 3) AS ictal_start, round(t + 20, 3) AS ictal_end FROM detections"),
    "fil24_unit": (fil24, f"WITH {SIG} SELECT channel, sample, round(x * 1e6, 3) AS microvolts FROM signal"),
    "fil25_context_windows": (fil25, f"WITH {SIG}, c AS (SELECT channel, sample, sample / 100.0::DOUBLE AS c FROM signal) SELECT channel, sample, round(greatest(c - 0.25, 0), 6) AS narrow_start, round(greatest(c - 0.25, 0) + 0.5, 6) AS narrow_end, round(greatest(c - 2.5, 0), 6) AS wide_start, round(c + 2.5, 6) AS wide_end FROM c"),
    "fil26_marker_cleaning": (fil26, f"WITH {SPK} SELECT event_id, least(power, coalesce(duration, 50)) AS t0, greatest(power, coalesce(duration, 50)) AS t1 FROM spikes WHERE NOT isnan(power)"),
    "str01_labels": (str02, f"WITH {LABELS} SELECT label, upper(regexp_replace(trim(label), '\\s+', ' ', 'g')) AS normalized, {P} || {K} AS core, {P} AS prefix, {K} AS contact, lower(regexp_replace(regexp_replace(trim(label), '(?i)^EEG\\s+', ''), '\\s+', '', 'g')) AS match_key FROM labels"),
    "str04_looks_bipolar": (str04, f"WITH {LABELS} SELECT label, {BIPOLAR} AS bipolar FROM (SELECT label, list_filter(list_transform(regexp_split_to_array({BARE}, '[-–—]'), lambda q: trim(q)), lambda q: q <> '') AS p FROM labels)"),
    "str05_pair_name": (str05, "SELECT s_suppkey AS k, '(EEG RA' || s_suppkey || ')-(C' || s_suppkey || '-C' || (s_suppkey + 1) || ')' AS ab, 'RA' || s_suppkey || '-RA' || s_suppkey AS aa FROM supplier"),
    "str07_class_normalise": (str07, CLASS_SQL),
    "str08_gamma_class": (str08, f"WITH {SPK}, o AS (SELECT event_id, coalesce(CASE WHEN trim(manual_class) <> '' THEN manual_class END, CASE WHEN trim(model_class) <> '' THEN model_class END, '') AS o FROM spikes) SELECT event_id, CASE lower(replace(o, '_', '-')) WHEN 'gamma' THEN 'gamma' WHEN 'non-gamma' THEN 'non-gamma' WHEN '' THEN 'unclassified' ELSE o END AS official FROM o"),
    "str09_official_class": (str09, "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'deleted' WHEN quality = 1 THEN 'HFO' WHEN quality = 0 THEN 'artifact' ELSE 'candidate' END AS official FROM documents d LEFT JOIN labels USING (doc_id)"),
    "str10_coercions": (str10, "SELECT p_partkey, [1.5, NULL, NULL, NULL, NULL, -2000.0, 7.0][p_partkey % 7 + 1]::DOUBLE AS number, nullif(trim(['1.5', ' ', 'nan', 'x', 'inf', '-2e3', ' 7 '][p_partkey % 7 + 1]), '') AS text, false AS flag FROM part"),
    "str12_band_labels": (str12, f"WITH {OSC} SELECT event_id, 'Ripples ' || CAST(CAST(low_hz AS BIGINT) AS VARCHAR) || '-500 Hz' AS band, CAST(regexp_extract(event_id, '(\\d+)$', 1) AS BIGINT) AS number, CASE WHEN lower(detector) = 'r' THEN 'Fast ripples' ELSE 'Default' END AS preset FROM oscillations"),
    "str13_clock": (str13, f"WITH {D}, s AS (SELECT ord, CAST(floor(greatest(t - 1704067200, 0)) AS BIGINT) AS s FROM detections) SELECT ord, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM s"),
    "mth01_decibel": (mth01, f"WITH {SPK} SELECT event_id, round(10 * log10(greatest(coalesce(duration, 0), 1e-20)), 6) AS db FROM spikes"),
    "mth03_rounding": (mth03, "SELECT event_id, sign(value - 245.5) * floor(abs(value - 245.5) + 0.5) AS away, round_even(value - 245.5, 0) AS even, CAST(floor(value - 245.5) AS BIGINT) AS lo, CAST(ceil(value - 245.5) AS BIGINT) AS hi FROM events"),
    "mth04_is_gamma": (mth04, f"WITH {SPK} SELECT event_id, coalesce(NOT isnan(power) AND (power > 0 OR duration > 0) AND duration IS NOT NULL, false) AS is_gamma FROM spikes"),
    "mth05_probabilities": (mth05, f"WITH {OSC}, p AS (SELECT event_id, p_real, CASE WHEN p_artifact > 0.02 THEN p_artifact END AS a FROM oscillations) SELECT event_id, round(coalesce(p_real, 1 - a), 6) AS p_real, round(coalesce(a, 1 - p_real), 6) AS p_artifact FROM p"),
    "mth06_nice_step": (mth06, "WITH p AS (SELECT p_partkey, p_retailprice / 7 AS x, pow(10.0, floor(log10(p_retailprice / 7))) AS e FROM part) SELECT p_partkey, round(e * CASE WHEN x / e <= 1 THEN 1 WHEN x / e <= 2 THEN 2 WHEN x / e <= 5 THEN 5 ELSE 10 END, 6) AS step FROM p"),
    "mth07_frequency_grid": (mth07, "SELECT k, round(100 / pow(2.0, k / 40.0::DOUBLE), 6) AS f FROM range(0, 321) r(k) WHERE 100 / pow(2.0, k / 40.0::DOUBLE) >= 30"),
    "mth08_edges": (mth08, "SELECT p_partkey, round(least(p_retailprice, 950.0), 6) AS high, round(least(greatest(2.0, CASE WHEN p_size > 0 THEN 30.0 / p_size ELSE 0 END, CASE WHEN p_retailprice > 0 THEN least(5.0, 3.0 / p_retailprice) ELSE 0 END), 30.0), 6) AS pad FROM part"),
    "mth10_relative_onset": (mth10, f"WITH {SIG} SELECT channel, round(max(sample) / 100.0 - 17.5, 6) AS relative FROM signal GROUP BY channel"),
    "arr01_waveform_axis": (arr01, "SELECT vec_id, i, round(i / 100.0, 6) AS t, round(CAST(x AS DOUBLE), 5) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)"),
    "arr02_centred_peak": (arr02, "SELECT vec_id, round(max(x) - avg(x), 5) AS top FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id"),
    "dsp27_label_combination": (dsp27, f"WITH {OSC} SELECT event_id, CASE WHEN NOT 1 - p_artifact * 8 > 0.5 THEN 'artifact' WHEN p_spike * 10 > 0.5 AND p_artifact * 10 > 0.5 THEN 'spike-eHFO' WHEN p_spike * 10 > 0.5 THEN 'spike-HFO' WHEN p_artifact * 10 > 0.5 THEN 'eHFO' ELSE 'HFO' END AS label, CASE WHEN p_artifact * 8 >= 0.5 THEN 'artifact' WHEN p_spike * 8 >= 0.5 THEN 'spike-HFO' WHEN p_real >= 0.5 THEN 'HFO' ELSE 'candidate' END AS fallback FROM oscillations"),
    "jsn01_json": (jsn01, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"kind\":\"' || event_type || '\"}' AS json FROM events"),
    "snk07_finite": (snk07, f"WITH {SPK} SELECT event_id, CASE WHEN NOT isnan(power) THEN power END AS power FROM spikes"),
    "prs01_settings": (prs01, "SELECT event_id, CAST(event_id AS DOUBLE) AS k1, 10.0::DOUBLE AS low, CAST(event_id % 90 AS DOUBLE) AS high, 3.65::DOUBLE AS k2 FROM events"),
    "srt02_candidate_order": (srt01, f"WITH {OSC} SELECT event_id, lower(channel) AS channel, start, \"end\", detector, row_number() OVER (ORDER BY lower(channel), start, \"end\", detector, event_id) - 1 AS place FROM oscillations"),
    "srt04_summary_sort": (srt04, f"WITH {SPK} SELECT event_id, CASE WHEN NOT isnan(power) THEN power END AS power, row_number() OVER (ORDER BY CASE WHEN NOT isnan(power) THEN power END NULLS FIRST, event_id) - 1 AS place FROM spikes"),
    "srt04_summary_clicks": (srt04_clicks, SRT04),
    "srt05_heatmap_top": (srt05, SRT05),
    "srt06_grid_paging": (srt06, f"WITH {D}, r AS (SELECT channel, ord, row_number() OVER (PARTITION BY channel ORDER BY t, ord) - 1 AS r FROM detections) SELECT channel, ord, r // 24 AS page, r % 24 AS slot FROM r"),
    "srt07_review_order": (srt07, f"WITH {D} SELECT channel, CAST(floor(t) AS BIGINT) AS start, CAST(ord AS VARCHAR) AS num, row_number() OVER (ORDER BY floor(t), channel, CAST(ord AS VARCHAR)) - 1 AS by_time, row_number() OVER (ORDER BY channel, floor(t), CAST(ord AS VARCHAR)) - 1 AS by_channel FROM detections"),
    "srt08_display_order": (srt08, "SELECT n_name AS channel, n_nationkey % 4 = 1 AS listed, CAST(CASE WHEN n_nationkey % 4 = 1 THEN 100 - n_nationkey ELSE n_nationkey END AS BIGINT) AS key FROM nation"),
    "srt09_label_order": (srt09, f"WITH {A.CONTACTS} SELECT label, row_number() OVER (ORDER BY {P} IS NULL, {P} NULLS FIRST, {K} NULLS FIRST, label) AS place FROM contacts"),
    "set01_detector_union": (set01, f"WITH {D} SELECT channel, detector, count(*) AS n FROM detections WHERE detector IN ('click', 'view', 'error') GROUP BY ALL"),
    "set02_ordered_distinct": (set02, f"WITH {D} SELECT channel, min(ord) AS ord FROM detections GROUP BY channel"),
    "set03_ordered_union": (set03, f"WITH {D}, a AS (SELECT channel, min(ord) AS ord FROM detections WHERE detector = 'click' AND channel % 3 = 0 GROUP BY 1), b AS (SELECT channel, min(ord) AS ord FROM detections WHERE channel % 2 = 0 GROUP BY 1) SELECT channel, 0 AS list, ord FROM a UNION ALL SELECT channel, 1, ord FROM b WHERE channel NOT IN (SELECT channel FROM a)"),
    "set04_bad_set": (set04, f"WITH {D} SELECT DISTINCT channel FROM detections WHERE (channel % 3 = 0 OR channel % 5 = 0) AND channel % 7 <> 0"),
    "set05_intersection": (set05, f"WITH {D} SELECT DISTINCT channel FROM detections WHERE channel % 6 = 0"),
    "set06_timeline": (set06, f"WITH {SPK}, {OSC}, u AS (SELECT 'gamma' AS source, CAST(channel AS VARCHAR) AS channel, t AS s, t AS e FROM spikes UNION ALL SELECT 'hfo', channel, start / 1000.0, \"end\" / 1000.0 FROM oscillations) SELECT source, channel, count(*) AS n, round(min(s), 3) AS \"first\", round(max(e), 3) AS \"last\" FROM u GROUP BY ALL"),
    "dml01_create_annotation": (dml01, f"WITH {D}, r AS (SELECT ord, channel, power, CASE ord % 3 WHEN 0 THEN [NULL] WHEN 1 THEN CASE WHEN ord % 2 = 0 THEN ['a', 'b'] ELSE [CAST(channel AS VARCHAR)] END ELSE [CAST(channel AS VARCHAR)] END AS who FROM detections) SELECT ord AS request_id, 'Spike' AS kind, unnest(who) AS channel, least(power, 250) AS t0, greatest(power, 250) AS t1 FROM r"),
    "dml02_merge_log": (dml02, f"WITH {D} SELECT ord AS id, round(CASE WHEN ord % 4 = 0 THEN power + 1 ELSE power END, 6) AS power FROM detections WHERE ord % 12 <> 0"),
    "dml05_group_restore": (dml05, "SELECT n_nationkey AS channel, CASE WHEN m IN ('AUTOMOBILE', 'BUILDING') THEN m ELSE 'macro' END AS grp FROM nation LEFT JOIN (SELECT c_custkey % 40 AS k, min(c_mktsegment) AS m FROM customer GROUP BY 1) ON k = n_nationkey"),
}
