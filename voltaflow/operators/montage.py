"""Montages, references, masks and channel lookups (JON01-JON06, JON09, JON12, JON16, WIN12, FIL02-FIL05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from .dsp import tasks


def select_channels(signal: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted channels (channel, ord)."""
    return signal.join(wanted, "channel")


def without_channels(df: DataFrame, bad: DataFrame, on: str = "channel") -> DataFrame:
    return df.join(bad, on, "left_anti")


def bipolar_pairs(contacts: DataFrame) -> DataFrame:
    """Neighbouring contacts of one electrode (label, ord): name, ch1, ch2, prefix, contact; bad contacts aren't bridged.

    A bad contact (column is_bad) breaks both pairs that it would be in.
    """
    parsed = contacts.select("label", "ord", "is_bad", L.prefix(F.col("label")).alias("prefix"), L.contact(F.col("label")).alias("contact")).where("prefix is not null")
    w = Window.partitionBy("prefix").orderBy("contact", "ord")
    nxt = parsed.withColumns({"ch2": F.lead("label").over(w), "next_contact": F.lead("contact").over(w), "next_bad": F.lead("is_bad").over(w)})
    pairs = nxt.where("next_contact = contact + 1 and not is_bad and not next_bad")
    return pairs.select(L.pair_name(F.col("label"), F.col("ch2")).alias("name"), F.col("label").alias("ch1"), "ch2", "prefix", "contact")


def montage_skips(contacts: DataFrame) -> DataFrame:
    """label, reason: unparsed labels, bad ones, and those without a next neighbour."""
    parsed = contacts.select("label", "ord", "is_bad", L.prefix(F.col("label")).alias("prefix"), L.contact(F.col("label")).alias("contact"))
    w = Window.partitionBy("prefix").orderBy("contact", "ord")
    nxt = parsed.withColumn("gap", F.lead("contact").over(w) - F.col("contact"))
    reason = F.when(F.col("prefix").isNull(), "unparsed").when(F.col("is_bad"), "bad").when(F.col("gap") != 1, "non-consecutive")
    return nxt.select("label", reason.alias("reason")).where("reason is not null")


def bipolar(signal: DataFrame, pairs: DataFrame) -> DataFrame:
    """name, sample, x of every pair: x(ch1) - x(ch2). The pair table is small; Catalyst broadcasts it by its size.

    Legs are dealt to a given number of tasks: their samples compress so well that merged partitions would have too many to group.
    """
    both = pairs.select("name", F.explode(F.array(F.struct(F.col("ch1").alias("channel"), F.lit(1.0).alias("w")), F.struct(F.col("ch2").alias("channel"), F.lit(-1.0).alias("w")))).alias("p"))
    legs = signal.join(both.select("name", "p.channel", "p.w"), "channel").select("name", "sample", "x", "w").repartition(tasks(signal), "name", "sample")
    grouped = legs.groupBy("name", "sample").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.count("*").alias("n"))
    return grouped.where("n = 2").select("name", "sample", "x")


def common_reference(signal: DataFrame, bad: DataFrame | None = None, how: str = "mean") -> DataFrame:
    """x minus the mean or median over the channels that aren't bad, per sample; null samples don't count.

    The mean is aggregated map-side and joined back; the median needs a sample's channels together.
    """
    pool = signal if bad is None else without_channels(signal, bad)
    ref = pool.groupBy("sample").agg((F.avg("x") if how == "mean" else F.median("x")).alias("ref"))
    return signal.join(ref, "sample", "left").select("channel", "sample", (F.col("x") - F.col("ref")).alias("x"))


def single_reference(signal: DataFrame, channel) -> DataFrame:
    ref = signal.where(F.col("channel") == channel).select("sample", F.col("x").alias("ref"))
    return signal.join(ref, "sample").select("channel", "sample", (F.col("x") - F.col("ref")).alias("x"))


def bad_segment_mask(points: DataFrame, intervals: DataFrame, width: float, at: str = "t") -> DataFrame:
    """points with `masked`: inside an interval (t0, t1 inclusive, channel or null for all), found by time bucket.

    An interval is listed in every bucket of `width` that it meets, so the join has a key; channel-wide and
    global intervals are joined apart, so neither has an `or` in its key.
    """
    spans = intervals.select("channel", "t0", "t1", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))).alias("bucket"))
    keyed = points.withColumns({"bucket": F.floor(F.col(at) / width), "_id": F.monotonically_increasing_id()})
    own = spans.where("channel is not null").select(F.col("channel").alias("c"), F.col("bucket").alias("b"), F.col("t0").alias("a0"), F.col("t1").alias("a1"))
    every = spans.where("channel is null").select(F.col("bucket").alias("gb"), F.col("t0").alias("g0"), F.col("t1").alias("g1"))
    hit = keyed.join(own, (F.col("channel") == F.col("c")) & (F.col("bucket") == F.col("b")) & (F.col(at) >= F.col("a0")) & (F.col(at) <= F.col("a1")), "left_semi").withColumn("masked", F.lit(True))
    rest = keyed.join(own, (F.col("channel") == F.col("c")) & (F.col("bucket") == F.col("b")) & (F.col(at) >= F.col("a0")) & (F.col(at) <= F.col("a1")), "left_anti")
    within = (F.col("bucket") == F.col("gb")) & (F.col(at) >= F.col("g0")) & (F.col(at) <= F.col("g1"))
    more = rest.join(every, within, "left_semi").withColumn("masked", F.lit(True))
    free = rest.join(every, within, "left_anti").withColumn("masked", F.lit(False))
    return hit.unionByName(more).unionByName(free).drop("bucket", "_id")


def group_lookup(channels: DataFrame, groups: DataFrame) -> DataFrame:
    """Group of each channel (default macro) and the notch mode of its group (else the macro mode, else Off)."""
    out = channels.join(groups.select("channel", "grp"), "channel", "left")
    return out.withColumn("grp", F.coalesce("grp", F.lit("macro")))


def notch_modes(channels: DataFrame, modes: DataFrame) -> DataFrame:
    macro = modes.select(F.col("grp").alias("_fallback"), F.col("mode").alias("macro_mode"))
    out = channels.join(modes, "grp", "left").withColumn("_fallback", F.lit("macro")).join(macro, "_fallback", "left")
    return out.select(*channels.columns, F.coalesce("mode", "macro_mode", F.lit("Off")).alias("notch"))


def pair_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Group of a pair by both contacts (micro only if both are), and by the first one alone."""
    a = groups.select(F.col("channel").alias("ch1"), F.col("grp").alias("g1"))
    b = groups.select(F.col("channel").alias("ch2"), F.col("grp").alias("g2"))
    out = pairs.join(a, "ch1", "left").join(b, "ch2", "left")
    both = F.when((F.col("g1") == "micro") & (F.col("g2") == "micro"), "micro").otherwise("macro")
    return out.select(*pairs.columns, both.alias("grp_both"), F.coalesce("g1", F.lit("macro")).alias("grp_first"))


def fuzzy_match(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (label) with the known label (label, ord) it stands for: exact, trimmed, by key, or by core contact."""
    first = Window.partitionBy("k").orderBy("ord")

    def by(expr, name):
        keyed = known.select(expr.alias("k"), F.col("label").alias(name), "ord").where("k is not null")
        return keyed.withColumn("n", F.row_number().over(first)).where("n = 1").select("k", name)

    label = F.col("label")
    out = wanted
    for i, expr in enumerate((label, F.trim(label), L.match_key(label), L.core_contact(label))):
        found = by(expr, f"m{i}").withColumnRenamed("k", f"k{i}")
        out = out.withColumn(f"w{i}", expr).join(found, F.col(f"w{i}") == F.col(f"k{i}"), "left")
    return out.select(*wanted.columns, F.coalesce("m0", "m1", "m2", "m3").alias("matched"))
