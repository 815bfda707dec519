"""Checks of whole tables of parameter sets: the first thing that is wrong with each (FIL21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import mathx as X

#: Routes, the highest band edge of the native one, the rate that the others detect at (fixed values).
NATIVE_ROUTE, NATIVE_TOP_HZ, DETECTION_HZ = "pyhfo_pybrain", 500.0, 1000.0
#: What each detector's parameters must be: positive, not negative, a share (0 to 1), a share below 1.
DETECTOR_RULES = {
    "ste": {"rms_window_s": "positive", "min_window_s": "positive", "min_gap_s": "not negative", "epoch_len": "positive", "min_osc": "positive", "rms_thres": "positive", "peak_thres": "positive"},
    "mni": {
        "per_chf": "share", "threshold_percentile": "share below 1", "epoch_time_s": "positive", "epo_chf_hz": "positive", "min_win_s": "positive", "min_gap_s": "not negative", "base_seg_s": "positive",
        "base_shift_s": "not negative", "base_threshold": "not negative", "base_min": "not negative",
    },
    "hilbert": {"sd_threshold": "positive", "min_window_s": "positive", "epoch_len_s": "positive"},
}
SHORTEST = {"ste": "min_window_s", "mni": "min_win_s", "hilbert": "min_window_s"}


def _breaks(value: Column, kind: str) -> Column:
    """Whether a number breaks its rule; one that is missing or not finite does."""
    good = {"positive": value > 0, "not negative": value >= 0, "share": (value > 0) & (value <= 1), "share below 1": (value > 0) & (value < 1)}[kind]
    return ~F.coalesce(good & ~F.isnan(value) & (value != float("inf")), F.lit(False))


def hfo_rules() -> list[tuple[Column, str]]:
    """(what is wrong, in words), in the order in which it is told, over the columns of a parameter set.

    Columns: route, fs, low, high, sigma, min_ms, max_ms, padding_s, gap_ms, cycles, detectors (array), ste, mni and
    hilbert (maps of numbers), analysis_s (null: no interval is known).
    """
    c = F.col
    native = c("route") == NATIVE_ROUTE
    effective = X.effective_high(c("high"), c("fs"))
    active = F.transform(F.coalesce("detectors", F.array().cast("array<string>")), F.lower)
    rules = [
        (_breaks(c("low"), "positive") | ~F.coalesce(c("high") > c("low"), F.lit(False)), "band edges must rise from above zero"),
        (native & (c("high") > NATIVE_TOP_HZ), f"the band ends above {NATIVE_TOP_HZ:g} Hz"),
        (native & (c("low") >= effective), "the band starts above what the native rate allows"),
        (~native & (c("fs") < DETECTION_HZ), f"the recording is sampled below {DETECTION_HZ:g} Hz"),
        (~native & (c("high") >= DETECTION_HZ / 2), f"the band doesn't end below {DETECTION_HZ / 2:g} Hz"),
        (_breaks(c("sigma"), "positive"), "the threshold must be positive"),
        (~F.coalesce(c("min_ms") >= 1, F.lit(False)), "the least duration is under 1 ms"),
        (~F.coalesce(c("max_ms") >= 1, F.lit(False)), "the greatest duration is under 1 ms"),
        (c("max_ms") <= c("min_ms"), "the greatest duration isn't above the least"),
        (_breaks(c("padding_s"), "not negative"), "the padding is negative"),
        (_breaks(c("gap_ms"), "not negative"), "the gap is negative"),
        (~F.coalesce(c("cycles") >= 1, F.lit(False)), "less than one cycle"),
        (F.size(active) == 0, "no detector is chosen"),
    ]
    for name, parameters in DETECTOR_RULES.items():
        rules += [(F.array_contains(active, name) & _breaks(c(name)[p], kind), f"{name} {p} must be {kind}") for p, kind in parameters.items()]
    known = c("analysis_s").isNotNull()
    rules += [
        (known & _breaks(c("analysis_s"), "positive"), "the interval must be positive"),
        (known & (c("min_ms") / 1000 >= c("analysis_s")), "the least duration isn't shorter than the interval"),
        (known & (c("max_ms") / 1000 >= c("analysis_s")), "the greatest duration isn't shorter than the interval"),
        (known & (2 * c("padding_s") >= c("analysis_s")), "the padding leaves nothing of the interval"),
    ]
    rules += [(known & F.array_contains(active, name) & (F.coalesce(c(name)[p], F.lit(0.0)) >= c("analysis_s")), f"{name} {p} isn't shorter than the interval") for name, p in SHORTEST.items()]
    return rules


def hfo_problem() -> Column:
    """The first thing that is wrong with a parameter set, null if nothing is."""
    out = None
    for wrong, text in hfo_rules():
        out = F.when(wrong, text) if out is None else out.when(wrong, text)
    return out
