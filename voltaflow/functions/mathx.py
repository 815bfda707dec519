"""Numbers: rounding conventions, decibels, scores, grids and labels (MTH01-MTH10, STR10, STR13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def window_bounds(t0: Column, t1: Column, fs: Column, n: Column) -> tuple[Column, Column]:
    """Compute window: floor and ceil of the edges, clamped, of one sample at least."""
    lo = F.least(F.greatest(F.floor(t0 * fs), F.lit(0)), n - 1)
    return lo, F.greatest(F.least(F.ceil(t1 * fs), n), lo + 1)


def decibel(p: Column, floor: float = 1e-20) -> Column:
    return 10 * F.log10(F.greatest(p, F.lit(floor)))


def effective_high(requested: Column, fs: Column) -> Column:
    return F.least(requested, 0.95 * fs / 2)


def filter_pad_seconds(high_pass: Column, low_pass: Column) -> Column:
    hp = F.when(high_pass > 0, 3.0 / high_pass).otherwise(0.0)
    lp = F.when(low_pass > 0, F.least(F.lit(5.0), 3.0 / low_pass)).otherwise(0.0)
    return F.least(F.greatest(F.lit(2.0), hp, lp), F.lit(30.0))


def nice_step(x: Column) -> Column:
    """The least of 1, 2, 5, 10 times a power of ten that isn't below x."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    ratio = x / power
    return F.when(ratio <= 1, power).when(ratio <= 2, 2 * power).when(ratio <= 5, 5 * power).otherwise(10 * power)


def frequency_grid(top: float = 100.0, voices: int = 40, least: float = 30.0) -> Column:
    whole = F.transform(F.sequence(F.lit(0), F.lit(8 * voices)), lambda k: F.lit(top) / F.pow(F.lit(2.0), k / voices))
    return F.filter(whole, lambda f: f >= least)


def relative_onset(onset: Column, fs: float, ictal_start: float, seizure_onset: float) -> Column:
    return onset / fs + (ictal_start - seizure_onset)


def clock(seconds: Column) -> Column:
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def blank_to_null(s: Column) -> Column:
    return F.when(F.trim(s) != "", F.trim(s))


def to_float(s: Column) -> Column:
    v = blank_to_null(s).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def to_bool(s: Column) -> Column:
    return F.coalesce(F.lower(F.trim(s)).isin("1", "true", "yes", "y", "t"), F.lit(False))
