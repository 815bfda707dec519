"""Signals in blocks: long form to blocks and back, halos, chunk plans (D1, WIN10, WIN24, STM01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 16


def to_blocks(signal: DataFrame, keys: tuple[str, ...] = ("channel",), block: int = BLOCK) -> DataFrame:
    """Long form (keys, sample, x) to one row per block: keys, block_id, start_sample, x array."""
    grouped = signal.withColumn("block_id", F.floor(F.col("sample") / block)).groupBy(*keys, "block_id")
    rows = grouped.agg(F.array_sort(F.collect_list(F.struct("sample", "x"))).alias("v"))
    return rows.select(*keys, "block_id", F.col("v")[0]["sample"].alias("start_sample"), F.col("v.x").alias("x"))


def from_blocks(blocks: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    return blocks.select(*keys, "start_sample", F.posexplode("x").alias("i", "x")).select(*keys, (F.col("start_sample") + F.col("i")).alias("sample"), "x")


def read_range(blocks: DataFrame, lo: int, hi: int, block: int = BLOCK) -> DataFrame:
    """Samples [lo, hi) of block rows; the block predicate reaches the scan, the sample predicate follows (SRC05)."""
    near = blocks.where(F.col("block_id").between(lo // block, (hi - 1) // block))
    return from_blocks(near).where((F.col("sample") >= lo) & (F.col("sample") < hi))


def with_halo(df: DataFrame, before: int, after: int, block: int = BLOCK, at: str = "sample") -> DataFrame:
    """Every row for each block whose window [start - before, end + after] it falls in: block_id and own.

    Windows of bounded reach can then be partitioned by block, so that no long channel is one task.
    """
    first, last = F.floor((F.col(at) - after) / block), F.floor((F.col(at) + before) / block)
    blocks = F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("block_id")
    return df.select("*", blocks).withColumn("own", F.col("block_id") == F.floor(F.col(at) / block))


def chunk_plan(recordings: DataFrame, chunk: int, context: int) -> DataFrame:
    """Central chunks of a recording (n_samples) with context, clipped: chunk_id, start, stop, ext_start, ext_stop (WIN24)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_samples") - 1, F.lit(0)), F.lit(chunk).cast("long"))
    out = recordings.select("*", F.posexplode(starts).alias("chunk_id", "start"))
    out = out.withColumn("stop", F.least(F.col("start") + chunk, F.col("n_samples")))
    return out.withColumns({"ext_start": F.greatest(F.col("start") - context, F.lit(0)), "ext_stop": F.least(F.col("stop") + context, F.col("n_samples"))})


def sliding_windows(lengths: DataFrame, size: int, step: int, n: str = "n") -> DataFrame:
    """Windows of `size` every `step` samples that fit: window_id, start, stop (WIN10)."""
    starts = F.when(F.col(n) >= size, F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - size, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return lengths.select("*", F.posexplode(starts).alias("window_id", "start")).withColumn("stop", F.col("start") + size)


def windows_of(sample: Column, size: int, step: int) -> Column:
    """Ids of the sliding windows over a sample, without a range join."""
    first = F.greatest(F.ceil((sample - size + 1) / step), F.lit(0)).cast("long")
    return F.sequence(first, F.floor(sample / step).cast("long"))


def numbered(rows: DataFrame, key: str, span: Column, order: list, name: str = "sample") -> DataFrame:
    """rows with their place (from 0) in each key's order, without one task for each key.

    span is a value that grows with the order (a day, a month): places are ranks within (key, span), shifted by the rows
    of the spans before, which are counted map-side. Null spans come first, as null order values do. A span's shift is a
    row before its own ones, so the rows are shuffled once and never joined.
    """
    spanned = rows.withColumn("_span", span)
    before = Window.partitionBy(key).orderBy(F.col("_span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    shifts = spanned.groupBy(key, "_span").agg(F.count("*").alias("_n")).select(key, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(key, "_span").orderBy(F.col("_shift").isNull(), *order).rowsBetween(Window.unboundedPreceding, 0)
    both = spanned.unionByName(shifts, allowMissingColumns=True)
    placed = both.withColumn(name, (F.count("*").over(within) - 2 + F.first("_shift").over(within)).cast("long"))
    return placed.where("_shift is null").drop("_span", "_shift")
