"""Lists and settings around a review: choices, counts in words, detector settings of notch modes (HLP09, HLP11, HLP16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Classes that a reviewer can give, in the order in which they are shown; those of early events only where a run has them (fixed values).
CLASSES = ("artifact", "HFO", "non-spike HFO", "spike-HFO", "eHFO", "spike-eHFO", "unclassified", "deleted")


def class_options(with_ehfo: bool) -> list[str]:
    return [c for c in CLASSES if with_ehfo or "eHFO" not in c]


def choices(events: DataFrame, column: str, everything: str) -> DataFrame:
    """place, choice: `everything` first, then the column's distinct values in order. A run has few of them."""
    found = events.select(F.col(column).cast("string").alias("choice")).where("choice is not null").distinct().withColumn("list", F.lit(""))
    placed = found.select(F.row_number().over(Window.partitionBy("list").orderBy("choice")).cast("long").alias("place"), "choice")
    return events.sparkSession.createDataFrame([(0, everything)], "place long, choice string").unionByName(placed)


def count_texts(events: DataFrame, key: str, label: str, with_ehfo: bool = True) -> DataFrame:
    """key, counts: "class: n" of the classes that occur, in the shown order; labels that aren't classes don't count."""
    options = class_options(with_ehfo)
    counted = events.groupBy(key, label).agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, options)), F.col(label))
    rows = counted.where(F.col(label).isin(*options)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.concat(F.col(label), F.lit(": "), F.col("n").cast("string")).alias("t")))).alias("ts"))
    return rows.select(key, F.array_join("ts.t", ", ").alias("counts"))


def detector_settings(channels: DataFrame, recording: str = "recording", mode: str = "mode") -> DataFrame:
    """recording, settings of the channels' notch modes: hum of 60 Hz if one channel has it, else of 50 Hz, else none (HLP11)."""
    has = lambda hz: F.coalesce(F.bool_or(F.col(mode).startswith(f"{hz} Hz")), F.lit(False))
    hum = F.when(has(60), "60").when(has(50), "50").otherwise("1000000000")
    return channels.groupBy(recording).agg(F.concat(F.lit("-bl 10 -bh 60 -h "), hum, F.lit(" -k1 3.65 -dec 200")).alias("settings"))


def new_id() -> Column:
    """A new identifier: 32 hexadecimal digits (HLP16)."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
