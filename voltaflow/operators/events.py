"""Event operators: bursts, clusters, nearest events, waveforms, reviews, annotations (WIN13-16, JON07-11, DML01-05, FIL12-17)."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Seconds of a bucket in which events are put in order.
SPAN = 3600.0


def burst_members(events: DataFrame, gap: float, channel: str = "channel", span: float = SPAN) -> DataFrame:
    """events with `burst`: a neighbour on the channel is strictly closer than the gap.

    Neighbours that close lie in the same bucket of time or within a gap of it, so a channel is many tasks.
    """
    width = max(span, gap)
    own = F.floor(F.col("t") / width)
    buckets = F.explode(F.sequence(F.floor((F.col("t") - gap) / width), F.floor((F.col("t") + gap) / width)))
    near = events.withColumn("_own", own).withColumn("_bucket", buckets)
    w = Window.partitionBy(channel, "_bucket").orderBy("t", "ord")
    before, after = F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t")
    marked = near.withColumn("burst", F.coalesce(before < gap, F.lit(False)) | F.coalesce(after < gap, F.lit(False)))
    return marked.where("_bucket = _own").drop("_bucket", "_own")


#: A wide bucket of time is at least so many tolerances long, so few events of it can be the first anchor there.
REACH = 100


def _later(t: np.ndarray, tolerance: float, since: np.ndarray) -> np.ndarray:
    """For each value of `since` the place of the first of the rising times t that is later by more than the tolerance."""
    at = np.searchsorted(t, since + tolerance, "right")
    for step, wrong in ((-1, lambda i: (i > 0) & (t[np.maximum(i - 1, 0)] - since > tolerance)), (1, lambda i: (i < len(t)) & ~(t[np.minimum(i, len(t) - 1)] - since > tolerance))):
        while (move := wrong(at)).any():  # where the sum was rounded
            at[move] += step
    return at


def _times(table: pa.Table) -> np.ndarray:
    t = np.unique(table["t"].to_numpy())
    return t[~np.isnan(t)]


def _last_anchors(key, table: pa.Table, tolerance: float) -> pa.Table:
    """What a bucket makes of the last anchor before it: the bucket's own last anchor, by its first anchor (no later than `upto`)."""
    t = _times(table)
    following, last = _later(t, tolerance, t), t.copy()
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            last[i] = last[following[i]]
    first = np.flatnonzero(np.r_[True, t[:-1] - t[0] <= tolerance]) if len(t) else np.empty(0, int)  # the others aren't the first anchor, whatever came earlier
    ends = first[np.r_[last[first][1:] != last[first][:-1], True]] if len(first) else first
    cols = {"recording": pa.array([key[0].as_py()] * len(ends), table.schema[0].type), "wide": pa.array([key[1].as_py()] * len(ends), pa.int64())}
    return pa.table({**cols, "upto": pa.array(t[ends], pa.float64()), "last": pa.array(last[ends], pa.float64())})


def _handed_on(key, table: pa.Table, tolerance: float) -> pa.Table:
    """The last anchor before each bucket, in the buckets' order (null before the first)."""
    wide, upto, last = (table[c].to_numpy() for c in ("wide", "upto", "last"))
    order = np.lexsort((upto, wide))
    wide, upto, last = wide[order], upto[order], last[order]
    buckets, starts = np.unique(wide, return_index=True)
    before, anchor = [], None
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(wide)]):
        before.append(anchor)
        at = lo if anchor is None else lo + int(_later(upto[lo:hi], tolerance, np.array([anchor]))[0])
        anchor = float(last[at]) if at < hi else anchor
    return pa.table({"recording": pa.array([key[0].as_py()] * len(buckets), table.schema[0].type), "wide": pa.array(buckets, pa.int64()), "before": pa.array(before, pa.float64())})


def _anchors(key, table: pa.Table, tolerance: float, span: float) -> pa.Table:
    """The anchors of a wide bucket, each in its narrow one, and before these the last anchor of earlier ones."""
    t, anchor = _times(table), table["before"][0].as_py()
    following, i, own = _later(t, tolerance, t).tolist(), 0, []
    if anchor is not None and len(t):
        i = int(_later(t, tolerance, np.array([anchor]))[0])
    while i < len(t):
        own.append(i)
        i = following[i]
    own = t[own]
    buckets, known = np.unique(np.floor(t / span)), np.r_[np.nan if anchor is None else anchor, own]
    earlier = known[np.searchsorted(np.floor(own / span), buckets, "left")]
    bucket, at, found = np.r_[buckets, np.floor(own / span)], np.r_[np.full(len(buckets), -np.inf), own], np.r_[earlier, own]
    cols = {"recording": pa.array([key[0].as_py()] * len(at), table.schema[0].type), "bucket": pa.array(bucket.astype(np.int64)), "at": pa.array(at)}
    return pa.table({**cols, "anchor": pa.array(found, pa.float64(), mask=np.isnan(found))})


def anchored_clusters(events: DataFrame, tolerance: float, recording: str = "recording", span: float = SPAN) -> DataFrame:
    """events with the anchor of their cluster: an event later than its anchor by more than the tolerance is the next anchor.

    Anchoring is a scan in time order, but all that a bucket of time needs of the earlier ones is their last anchor. So wide
    buckets first tell their own last anchor for each that may be their first (these lie within the tolerance of the bucket's
    first event, a hundredth of its time at most, and lead to fewer last ones); that is handed on from bucket to bucket;
    then each bucket finds its anchors. Only times go there; events meet the anchors in narrow buckets.
    """
    key, many = dict(events.dtypes)[recording], max(1, ceil(REACH * tolerance / span))
    times = events.where(F.col("t").isNotNull()).select(F.col(recording).alias("recording"), F.floor(F.floor(F.col("t") / span) / many).alias("wide"), "t")
    ends = times.groupBy("recording", "wide").applyInArrow(lambda k, t: _last_anchors(k, t, tolerance), f"recording {key}, wide long, upto double, last double")
    before = ends.groupBy("recording").applyInArrow(lambda k, t: _handed_on(k, t, tolerance), f"recording {key}, wide long, before double")
    before = before.select(F.col("recording").alias("_r"), F.col("wide").alias("_w"), "before")
    known = times.join(before, F.col("recording").eqNullSafe(F.col("_r")) & (F.col("wide") == F.col("_w"))).select("recording", "wide", "t", "before")
    found = known.groupBy("recording", "wide").applyInArrow(lambda k, t: _anchors(k, t, tolerance, span), f"recording {key}, bucket long, at double, anchor double")
    found = found.select(F.col("recording").alias(recording), F.col("bucket").alias("_bucket"), F.col("at").alias("_at"), "anchor", F.lit(False).alias("_event"))
    placed = events.withColumns({"_bucket": F.floor(F.col("t") / span), "_at": F.col("t"), "_event": F.lit(True)})
    w = Window.partitionBy(recording, "_bucket").orderBy("_at", "_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = placed.unionByName(found, allowMissingColumns=True).withColumn("anchor", F.last("anchor", ignorenulls=True).over(w))
    return both.where("_event").select(*events.columns, "anchor")


def common_mode(clusters: DataFrame, n_channels: int, recording: str = "recording", channel: str = "channel") -> DataFrame:
    """Clusters with their channel count and whether at least half of the channels (rounded up) are in them (AGG10)."""
    sizes = clusters.groupBy(recording, "anchor").agg(F.count_distinct(channel).alias("channels"), F.count("*").alias("events"))
    return sizes.withColumn("common", F.col("channels") >= -(-n_channels // 2))


def nearest(left: DataFrame, right: DataFrame, tolerance: float, key: str = "channel") -> DataFrame:
    """left (key, t, ord) with the nearest right event (key, t, ord) within the tolerance, the first one on ties.

    Times are put in buckets as wide as the tolerance, and right events are listed in three of them, so
    the join has a bounded reach on a key and no channel is compared with all of its events.
    """
    span = F.explode(F.array(*(F.floor(F.col("t") / tolerance) + d for d in (-1, 0, 1))))
    r = right.select(F.col(key).alias("_key"), F.col("t").alias("near_t"), F.col("ord").alias("near_ord"), span.alias("_bucket"))
    hit = left.withColumn("_b", F.floor(F.col("t") / tolerance))
    gap = F.abs(F.col("near_t") - F.col("t"))
    joined = hit.join(r, (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_bucket")) & (gap <= tolerance))
    best = F.min(F.struct(gap.alias("gap"), F.col("near_ord").alias("near_ord"), F.col("near_t").alias("near_t")))
    return joined.groupBy(*left.columns).agg(best.alias("m")).select(*left.columns, "m.near_ord", "m.near_t", "m.gap")


def event_samples(events: DataFrame, signal: DataFrame, block: int) -> DataFrame:
    """Samples [lo, hi) of every event's channel, joined by block: event columns, sample, x (JON07)."""
    wide = events.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    keyed = signal.withColumn("_block", F.floor(F.col("sample") / block))
    near = wide.join(keyed, ["channel", "_block"]).where("sample >= lo and sample < hi")
    return near.drop("_block")


def waveforms(events: DataFrame, signal: DataFrame, block: int) -> DataFrame:
    """Event columns and the samples as an array in order."""
    rows = event_samples(events, signal, block)
    out = rows.groupBy(*events.columns).agg(F.array_sort(F.collect_list(F.struct("sample", "x"))).alias("w"))
    return out.withColumn("waveform", F.col("w.x")).drop("w")


def fixed_window(centre: Column, length: int, n: Column) -> tuple[Column, Column]:
    """Bounds of a window of fixed length, shifted to lie in [0, n); what the signal lacks is padded later (JON08)."""
    lo = F.greatest(F.least(centre - length // 2, n - length), F.lit(0))
    return lo, F.least(lo + length, n)


def padded(waveform: Column, length: int) -> Column:
    return F.concat(waveform, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(waveform), F.lit(0))))


def latest_reviews(log: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The last entry of an append-only review log for each event (DML04)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_reviews(events: DataFrame, log: DataFrame) -> DataFrame:
    """events with the manual class and status of their latest review."""
    last = latest_reviews(log).select("event_id", F.col("manual_class").alias("_manual"))
    out = events.join(last, "event_id", "left")
    status = F.when(F.col("_manual").isNull(), "unreviewed").when(F.col("_manual") == "deleted", "deleted").otherwise("reviewed")
    return out.withColumns({"manual_class": F.col("_manual"), "review_status": status}).drop("_manual")


def merge_log(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Latest-wins merge of a table and changes (op: upsert or delete, seq): union and row_number (DML02)."""
    cols = [c for c in table.columns if c != key]
    base = table.select(key, *cols, F.lit(-1).cast("long").alias("seq"), F.lit("upsert").alias("op"))
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    both = base.unionByName(changes.select(key, *cols, "seq", "op"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1 and op = 'upsert'").select(key, *cols)


def annotate(requests: DataFrame) -> DataFrame:
    """Annotation rows of requests (scope, channels, clicked, t0, t1, kind): one for all, one per channel, or the clicked one (DML01)."""
    selected = F.when(F.size("channels") > 0, F.col("channels")).otherwise(F.array("clicked"))
    who = F.when(F.col("scope") == "global", F.array(F.lit(None).cast("string"))).when(F.col("scope") == "selected", selected).otherwise(F.array("clicked"))
    out = requests.select("*", F.explode_outer(who).alias("channel"))
    return out.select("request_id", "kind", "channel", F.least("t0", "t1").alias("t0"), F.greatest("t0", "t1").alias("t1"))


def cleaned_markers(markers: DataFrame) -> DataFrame:
    """Markers with finite times and ordered bounds (FIL26)."""
    ok = ~F.isnan("t0") & ~F.isnan("t1") & (F.abs("t0") != float("inf")) & (F.abs("t1") != float("inf"))
    return markers.where(ok).withColumns({"t0": F.least("t0", "t1"), "t1": F.greatest("t0", "t1")})


def gamma_marker_mode(spikes: DataFrame, mode: str, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Spikes shown in a mode: all, gamma, or non_gamma, which drops every channel that has a gamma spike (FIL17)."""
    if mode == "all":
        return spikes
    if mode == "gamma":
        return spikes.where("is_gamma")
    have = spikes.where("is_gamma").select(*keys).distinct()
    return spikes.join(have, list(keys), "left_anti")
