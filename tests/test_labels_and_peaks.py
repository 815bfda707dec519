"""Contact labels and peaks against hand-worked values."""

from pyspark.sql import functions as F

from voltaflow.functions import labels as L
from voltaflow.operators import windows as W


def test_labels(spark):
    want = {
        "EEG RAI1-G2": ("RAI", 1, False), "EEG RAI 2 -G2": ("RAI", 2, False), "EEG RPI6 G2": ("RPI", 6, False), "RAI1": ("RAI", 1, False),
        "RAI01": ("RAI", 1, False), "A2B10": ("A", 2, False), "RA1-REF": ("RA", 1, False), "RA1-RA2": ("RA", 1, True), "EEG RA1-RA2": ("RA", 1, True),
        "RA1--RA2": ("RA", 1, True), "RA1 \u2013 RA02": ("RA", 1, True), "EEG RA1-RA2 G2": ("RA", 1, False), "Brand#13": (None, None, False), "": (None, None, False), "RG1": (None, None, False),
    }
    df = spark.createDataFrame([(k,) for k in want], "label string")
    out = df.select("label", L.prefix(F.col("label")).alias("p"), L.contact(F.col("label")).alias("c"), F.coalesce(L.looks_bipolar(F.col("label")), F.lit(False)).alias("b"))
    assert {r.label: (r.p, r.c, r.b) for r in out.collect()} == want


def peaks(spark, runs):
    rows = [(c, i, float(v), True) for c, x in runs.items() for i, v in enumerate(x)]
    return W.run_peaks(spark.createDataFrame(rows, "channel string, sample long, x double, flag boolean"))


def test_run_peaks(spark):
    got = {}
    for r in peaks(spark, {"falls": [5, 4, 3, 2, 1], "rises": [1, 2, 3, 4], "plateau": [1, 3, 3, 1], "two": [1, 5, 2, 6, 1], "short": [2, 7, 7], "flat": [2, 2, 2, 2]}).collect():
        got.setdefault(r.channel, set()).add(r.sample)
    assert got == {"falls": {0}, "plateau": {1, 2}, "two": {1, 3}, "short": {1}}


def test_poly_groups(spark):
    rows = [("a", s, float(x)) for s, x in [(0, 5), (2, 7), (4, 6), (6, 8), (8, 8), (30, 1), (50, -2), (52, -3)]]
    out = W.poly_groups(spark.createDataFrame(rows, "channel string, sample long, x double"), 3)
    # 5 7 6 8 8: 7 and the last 8 (the first isn't higher than the one behind); 1 alone; -2 is below the 0 in front, -3 below both
    assert sorted((r.sample, r.n) for r in out.collect()) == [(2, 5), (8, 5), (30, 1)]
