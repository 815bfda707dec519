"""Detector settings strings: flag and value pairs with aliases (PRS01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags, the settings that they name, and defaults (fixed values). k2 keeps its own default whatever k1 is.
FLAGS = {
    "fl": "bandwidth_low", "bl": "bandwidth_low", "fh": "bandwidth_high", "bh": "bandwidth_high", "k1": "k1", "k2": "k2", "k3": "k3",
    "w": "winsize", "n": "noverlap", "buf": "buffering", "h": "hum_hz", "dt": "discharge_tolerance", "pt": "polyspike_union_time",
    "ft": "filter_type", "dec": "decimation", "ti": "time_index", "b": "beta_hz", "bw": "beta_win", "br": "beta_ar",
}
DEFAULTS = {"bandwidth_low": "10", "bandwidth_high": "60", "k1": "3.65", "k2": "3.65", "k3": "0", "hum_hz": "60", "discharge_tolerance": "0.005", "polyspike_union_time": "0.12", "filter_type": "1", "decimation": "200"}


def parsed_settings(text: Column) -> Column:
    """Map of settings by name: the last value given for a name, else its default."""
    tokens = F.split(F.trim(text), r"\s+-(?=[A-Za-z])")
    pairs = F.transform(tokens, lambda p: F.struct(F.regexp_replace(F.element_at(F.split(p, r"\s+"), 1), "^-", "").alias("k"), F.element_at(F.split(p, r"\s+"), -1).alias("v")))
    names = F.create_map(*(F.lit(x) for pair in FLAGS.items() for x in pair))
    given = F.filter(F.transform(pairs, lambda p: F.struct(names[p["k"]].alias("k"), p["v"].alias("v"))), lambda p: p["k"].isNotNull())
    defaults = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in DEFAULTS.items()))
    every = F.concat(defaults, given)
    last = F.filter(every, lambda p, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)
