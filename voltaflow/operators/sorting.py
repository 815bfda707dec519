"""Orders, top lists, pages and ordered sets (SRT01-SRT10, SET01-SET06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from .blocks import numbered


def label_order(label: Column) -> list[Column]:
    """Parsed labels first, by electrode and contact; others behind, by text (SRT09)."""
    return [L.prefix(label).isNull(), L.prefix(label), L.contact(label), label]


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows (one at least): a top list, not a sort of everything (SRT05)."""
    return df.orderBy(*order).limit(max(1, n))


#: Orders of a heatmap's rows: a mode's column, and whether the greatest comes first; any other mode is the recording's order.
HEATMAP_MODES = {"ei_score": ("ei", True), "recruitment_delay": ("delay", False), "peak_hfer": ("peak", True), "mean_hfer": ("mean", True), "channel_name": ("lower(channel)", False)}


def heatmap_order(mode: str) -> list[Column]:
    """Order of rows (channel, ord, ei, delay, peak, mean) in a mode; ties and what has no value keep the recording's order (SRT05)."""
    if mode not in HEATMAP_MODES:
        return [F.col("ord")]
    name, down = HEATMAP_MODES[mode]
    value = F.expr(name)
    return [value.desc_nulls_last() if down else value.asc_nulls_last(), F.col("ord")]


#: Columns by which a summary is sorted: whether the first click puts the greatest first, and whether a missing value counts as the least (else the greatest).
SUMMARY_COLUMNS = {"ei": (True, True), "rank": (False, False), "hfer": (True, True), "power": (False, True), "delay": (False, False)}


def summary_order(column: str, clicks: int = 1, display: str = "ord", name: str = "channel") -> list[Column]:
    """Order of a summary after so many clicks on a column; each click on it turns it round, on the channel it goes between display order and name (SRT04)."""
    if column == name:
        return [F.col(display)] if clicks % 2 == 0 else [F.lower(name), F.col(display)]
    down, least = SUMMARY_COLUMNS.get(column, (False, False))
    down = down == (clicks % 2 == 1)
    value = F.col(column)
    first = least != down  # missing values are the least or the greatest, whichever way the column runs
    key = (value.desc_nulls_first() if first else value.desc_nulls_last()) if down else (value.asc_nulls_first() if first else value.asc_nulls_last())
    return [key, F.col(display)]


def review_order(by_time: bool) -> list[Column]:
    """Order of reviewed events (channel, start, num): by time, or by channel; numbers compare as text (SRT07)."""
    num = F.col("num").cast("string")
    return [F.col("start"), F.col("channel"), num] if by_time else [F.col("channel"), F.col("start"), num]


def placed(df: DataFrame, order: list[Column], span: Column) -> DataFrame:
    """Every row with its place (from 0) in a whole order (SRT02-SRT04, SRT07, SRT10).

    span grows with the order, as in `numbered`: rows are sorted within their span only, never all in one task.
    """
    return numbered(df.withColumn("_whole", F.lit(0)), "_whole", span, order, "place").drop("_whole")


def page_of(df: DataFrame, order: list[Column], keys: list[str], size: int = 24) -> DataFrame:
    """Page and slot of every row within its key (SRT06)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w) - 1).withColumns({"page": F.floor(F.col("_r") / size).cast("long"), "slot": (F.col("_r") % size).cast("long")}).drop("_r")


def display_order(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """channels (channel, ord) with a position: wanted ones (channel, pos; repeats count once) first, then the rest (SRT08)."""
    first = wanted.groupBy("channel").agg(F.min("pos").alias("pos"))
    return channels.join(first, "channel", "left").withColumns({"listed": F.col("pos").isNotNull(), "key": F.coalesce("pos", "ord")}).select("channel", "listed", "key")


def ordered_distinct(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """Each value at its first place (SET02)."""
    return rows.groupBy(value).agg(F.min(ordinal).alias(ordinal))


def ordered_union(first: DataFrame, second: DataFrame, value: str = "channel", ordinal: str = "ord") -> DataFrame:
    """Values of the first list, then new ones of the second (SET03)."""
    a = first.select(value, F.struct(F.lit(0).alias("list"), F.col(ordinal).alias("ord")).alias("place"))
    b = second.select(value, F.struct(F.lit(1).alias("list"), F.col(ordinal).alias("ord")).alias("place"))
    return a.unionByName(b).groupBy(value).agg(F.min("place").alias("place")).select(value, "place.list", "place.ord")


def updated_set(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """old with added without removed, each once (SET04)."""
    return old.union(added).distinct().join(removed, old.columns, "left_anti")
