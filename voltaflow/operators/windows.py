"""Sequence operators: moving energy, onsets, ranks, runs, envelopes (WIN01-WIN23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import BLOCK, with_halo


def moving_energy(signal: DataFrame, width: int, keys: tuple[str, ...] = ("channel", "segment"), block: int = BLOCK) -> DataFrame:
    """Sum of squares over `width` samples centred as a same-size convolution is, zero-padded at each segment's edges.

    Windows are partitioned by block with a halo, so a long channel is many tasks.
    """
    before, after = width - 1 - (width - 1) // 2, (width - 1) // 2
    w = Window.partitionBy(*keys, "block_id").orderBy("n").rowsBetween(-before, after)
    near = with_halo(signal, before, after, block, "n")
    return near.withColumn("energy", F.sum(F.col("x") * F.col("x")).over(w)).where("own").drop("own", "block_id")


def baseline_stats(energy: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Per channel of the baseline: mean (a tiny value if not positive), maximum and deviation of energy over mean."""
    eps = 2.220446049250313e-16
    raw = energy.groupBy(*keys).agg(F.avg("energy").alias("m"), F.max("energy").alias("top"), F.stddev_samp("energy").alias("sd"))
    mean = F.when(F.col("m") > 0, F.col("m")).otherwise(eps)
    return raw.select(*keys, mean.alias("mean_energy"), (F.col("top") / mean).alias("max_base"), (F.col("sd") / mean).alias("sd_base"))


def onsets(hfer: DataFrame, stats: DataFrame, sigmas: float, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """First sample whose value is strictly above max + sigmas * sd of the baseline, else the segment's length."""
    hot = F.col("hfer") > F.col("max_base") + sigmas * F.col("sd_base")
    return hfer.join(stats, list(keys)).groupBy(*keys).agg(F.coalesce(F.min(F.when(hot, F.col("n"))), F.max("n") + 1).alias("onset"), (F.max("n") + 1).alias("length"))


def timing_rank(onset: DataFrame, recording: str = "recording") -> DataFrame:
    """Distinct ranks by onset (ties by channel), and the reciprocal rank in single precision."""
    w = Window.partitionBy(recording).orderBy("onset", "channel")
    out = onset.withColumn("timing_rank", F.row_number().over(w).cast("long"))
    return out.withColumn("reciprocal", (F.lit(1.0).cast("float") / F.col("timing_rank").cast("float")).cast("float"))


def _block_runs(samples: DataFrame, keys: tuple[str, ...], flag: str, block: int, best: bool = False) -> DataFrame:
    """keys, start, stop, length (and best: the sample of the first greatest x) of the maximal runs of true.

    Runs are found within blocks; only those that touch a block's edge, two a block at most, are then joined along the
    channel. So no channel's samples are one task.
    """
    placed = samples.where(flag).withColumn("_block", F.floor(F.col("sample") / block))
    island = F.col("sample") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("sample"))
    top = [F.min(F.struct((-F.col("x")).alias("less"), F.col("sample").alias("at"))).alias("top")] if best else []
    runs = placed.withColumn("_isle", island).groupBy(*keys, "_block", "_isle").agg(F.min("sample").alias("start"), F.max("sample").alias("stop"), F.count("*").alias("length"), *top).drop("_block", "_isle")
    edge = (F.col("start") % block == 0) | ((F.col("stop") + 1) % block == 0)
    w = Window.partitionBy(*keys).orderBy("start")
    apart = F.coalesce((F.col("start") != F.lag("stop").over(w) + 1).cast("int"), F.lit(1))
    joined = runs.where(edge).withColumn("_new", apart).withColumn("_run", F.sum("_new").over(w))
    joined = joined.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("length").alias("length"), *([F.min("top").alias("top")] if best else [])).drop("_run")
    return runs.where(~edge).unionByName(joined)


def true_runs(samples: DataFrame, keys: tuple[str, ...] = ("channel",), flag: str = "flag", block: int = BLOCK) -> DataFrame:
    """Maximal runs of true: keys, start, stop (inclusive), length."""
    return _block_runs(samples, keys, flag, block)


def run_peaks(samples: DataFrame, keys: tuple[str, ...] = ("channel",), flag: str = "flag", block: int = BLOCK) -> DataFrame:
    """Maxima of runs. Up to three samples: the first greatest one. More: every sample behind which the slope's sign gets less.

    Before the run the slope counts as 0, so a run that only falls has its first sample, and both ends of a top plateau count.
    The last sample never does. Three samples around a block tell whether a run is longer than three, so blocks are tasks.
    """
    near = with_halo(samples.where(flag), 3, 3, block)
    isle = near.withColumn("island", F.col("sample") - F.row_number().over(Window.partitionBy(*keys, "block_id").orderBy("sample")))
    r = Window.partitionBy(*keys, "block_id", "island").orderBy("sample")
    whole = Window.partitionBy(*keys, "block_id", "island")
    seen = isle.withColumns({"prev": F.lag("x").over(r), "next": F.lead("x").over(r), "len": F.count("*").over(whole), "best": F.min(F.struct(-F.col("x"), F.col("sample"))).over(whole)["sample"]}).where("own")
    turn = (F.col("len") > 3) & (F.signum(F.col("next") - F.col("x")) < F.coalesce(F.signum(F.col("x") - F.col("prev")), F.lit(0.0)))
    return seen.where(turn | ((F.col("len") <= 3) & (F.col("sample") == F.col("best")))).select(*keys, "sample", "x")


def local_maxima(samples: DataFrame, keys: tuple[str, ...] = ("channel",), block: int = BLOCK) -> DataFrame:
    """keys, sample of the strict local maxima, the middle of flat tops (rounded down), however long these are.

    A sample that differs from the one before begins a stretch of equal values; a stretch is a top if the signal rises into
    it and falls behind it. A block's last stretch ends with the first change of a later block.
    """
    x, prev = F.coalesce("x", F.lit(float("nan"))), F.col("prev")
    w = Window.partitionBy(*keys, "block_id").orderBy("sample")
    seen = with_halo(samples.select(*keys, "sample", x.alias("x")), 1, 0, block).withColumn("prev", F.lag("x").over(w)).where("own and x != prev")
    seen = seen.withColumns({"rises": (prev < F.col("x")) & ~F.isnan("x"), "falls": (F.col("x") < prev) & ~F.isnan("prev")})
    ends = lambda over: {"end": F.lead("sample").over(over), "down": F.lead("falls").over(over)}
    within = seen.withColumns({**ends(w), "first": F.lag("sample").over(w).isNull()})
    across = within.where("first or end is null").withColumn("last", F.col("end").isNull()).withColumns(ends(Window.partitionBy(*keys).orderBy("sample")))
    tops = within.where("end is not null").unionByName(across.where("last").drop("last"))
    return tops.where("rises and down").select(*keys, F.floor((F.col("sample") + F.col("end") - 1) / 2).cast("long").alias("sample"))


def poly_groups(peaks: DataFrame, reach: int, keys: tuple[str, ...] = ("channel",), block: int = BLOCK) -> DataFrame:
    """Groups of peaks whose next one is at most `reach` away: the peaks that stay (sample) and how many the group had (n).

    A single peak stays. Of several, those stay that are no lower than the one before and higher than the one behind; the
    sequence has a 0 in front and at its end. Neighbours come from a halo; a group's size is added up from its parts in
    blocks, of which only a block's first and last can go on in another.
    """
    span = max(block, reach)
    near = with_halo(peaks, reach, reach, span)
    g = Window.partitionBy(*keys, "block_id").orderBy("sample")
    close = lambda other, value: F.coalesce(F.when(F.abs(F.col("sample") - other) <= reach, value), F.lit(0.0))
    seen = near.withColumns({"prev": close(F.lag("sample").over(g), F.lag("x").over(g)), "next": close(F.lead("sample").over(g), F.lead("x").over(g))}).where("own")
    new = F.coalesce((F.col("sample") - F.lag("sample").over(g) > reach).cast("int"), F.lit(1))
    parts = seen.withColumn("_new", new).withColumn("part", F.sum("_new").over(g))
    sizes = parts.groupBy(*keys, "block_id", "part").agg(F.min("sample").alias("first"), F.max("sample").alias("last"), F.count("*").alias("k"))
    both = Window.partitionBy(*keys, "block_id")
    sizes = sizes.withColumn("_edge", (F.col("part") == F.min("part").over(both)) | (F.col("part") == F.max("part").over(both)))
    w = Window.partitionBy(*keys).orderBy("first")
    apart = F.coalesce((F.col("first") - F.lag("last").over(w) > reach).cast("int"), F.lit(1))
    # between a block's first and last group there may be others: the two are never one
    chain = sizes.where("_edge").withColumn("_new", apart).withColumn("_chain", F.sum("_new").over(w))
    chain = chain.withColumn("n", F.sum("k").over(Window.partitionBy(*keys, "_chain"))).select(*keys, "block_id", "part", "n")
    known = sizes.where("not _edge").select(*keys, "block_id", "part", F.col("k").alias("n")).unionByName(chain)
    return parts.join(known, [*keys, "block_id", "part"]).where("n = 1 or (x >= prev and next < x)").select(*keys, "sample", "n")


def closing(samples: DataFrame, width: int, keys: tuple[str, ...] = ("channel",), block: int = BLOCK) -> DataFrame:
    """Dilate, then erode a boolean column with an odd kernel; samples outside the signal are false. Windows are by block with a halo of two kernels."""
    k = width // 2
    w = Window.partitionBy(*keys, "block_id").orderBy("sample").rowsBetween(-k, k)
    wide = with_halo(samples, 2 * k, 2 * k, block).withColumn("_wide", F.max(F.col("flag").cast("int")).over(w))
    return wide.withColumn("closed", F.min("_wide").over(w) == 1).where("own").drop("_wide", "own", "block_id")


def local_maximum_of_runs(samples: DataFrame, keys: tuple[str, ...] = ("channel",), flag: str = "closed", block: int = BLOCK) -> DataFrame:
    """The first greatest sample of every run (WIN09's last step)."""
    return _block_runs(samples, keys, flag, block, best=True).select(*keys, F.col("top.at").alias("sample"))


def lognormal_parameters(samples: DataFrame, size: int, step: int, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Per sliding window: mean and deviation of the logarithm of positive samples; none gives zeros (AGG09, WIN10)."""
    from .blocks import windows_of

    # a window counts if it fits into the channel
    ends = samples.groupBy(*keys).agg((F.max("sample") + 1).alias("n_samples"))
    each = samples.join(ends, list(keys)).select(*keys, "x", "n_samples", F.explode(windows_of(F.col("sample"), size, step)).alias("window_id"))
    fit = each.where(F.col("window_id") * step + size <= F.col("n_samples"))
    log = F.when(F.col("x") > 0, F.ln("x"))
    return fit.groupBy(*keys, "window_id").agg(F.coalesce(F.avg(log), F.lit(0.0)).alias("mu"), F.coalesce(F.stddev_samp(log), F.lit(0.0)).alias("sigma"))


def lognormal_threshold(k1: float = 3.65, k3: float = 0.0):
    """k1 * (mode + median) - k3 * (mean - mode) of columns mu and sigma (WIN11)."""
    mu, s2 = F.col("mu"), F.col("sigma") * F.col("sigma")
    mode, median, mean = F.exp(mu - s2), F.exp(mu), F.exp(mu + s2 / 2)
    return k1 * (mode + median) - k3 * (mean - mode)


def envelope(samples: DataFrame, bins: int = 1500, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Minimum and maximum of bins of ceil(n / bins) samples, in temporal order; NaN only if the bin has nothing else (WIN17)."""
    sizes = samples.groupBy(*keys).agg(F.min("sample").alias("s0"), F.greatest(F.ceil(F.count("*") / bins), F.lit(1)).alias("width"))
    binned = samples.join(sizes, list(keys)).withColumn("bin", F.floor((F.col("sample") - F.col("s0")) / F.col("width")))
    v = F.when(~F.isnan("x"), F.col("x"))
    low = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("sample").alias("s"))))
    high = F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), F.col("sample").alias("s"))))
    out = binned.groupBy(*keys, "bin").agg(low.alias("lo"), high.alias("hi"), F.min("sample").alias("first_sample"), F.max("sample").alias("last_sample"))
    nan = F.lit(float("nan"))
    lo, hi = F.coalesce("lo.v", nan), F.coalesce(-F.col("hi.v"), nan)
    down = F.col("hi.s") < F.col("lo.s")
    return out.select(*keys, "bin", "first_sample", "last_sample", F.when(down, hi).otherwise(lo).alias("first_x"), F.when(down, lo).otherwise(hi).alias("second_x"))


def stride(samples: DataFrame, points: int = 3000, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    sizes = samples.groupBy(*keys).agg(F.greatest(F.floor(F.count("*") / points), F.lit(1)).alias("step"))
    return samples.join(sizes, list(keys)).where(F.col("sample") % F.col("step") == 0).drop("step")


def centred(samples: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """x minus the channel's median of values that aren't NaN (WIN19)."""
    mid = samples.groupBy(*keys).agg(F.median(F.when(~F.isnan("x"), F.col("x"))).alias("mid"))
    return samples.join(mid, list(keys)).withColumn("x", F.col("x") - F.col("mid")).drop("mid")


def gamma_masks(samples: DataFrame, fs: float, pre: float = 0.5, post: float = 0.5) -> DataFrame:
    """Search mask (the stretch before p1) and baseline mask (that and the stretch behind n2), p1 and n2 being samples (WIN23)."""
    before = (F.col("sample") < F.col("p1")) & (F.col("sample") > F.col("p1") - F.lit(int(pre * fs)))
    after = (F.col("sample") > F.col("n2")) & (F.col("sample") <= F.col("n2") + F.lit(int(post * fs)))
    return samples.withColumns({"search": before, "baseline": before | after})


def best_candidate(candidates: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The candidate of greatest finite power, the first one on ties (WIN21)."""
    ok = candidates.where(~F.isnan("power") & (F.abs("power") != float("inf")))
    w = Window.partitionBy(*keys).orderBy(F.desc("power"), "ord")
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
