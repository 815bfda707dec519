"""Event classes: normalisers, official class, probabilities and labels (STR07-STR12, DSP27-28, MTH04-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes that count as accepted oscillations (fixed values).
ACCEPTED = ("HFO", "non-spike HFO", "spike-HFO", "eHFO", "spike-eHFO")


def _key(label: Column) -> Column:
    return F.replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lit("_"), F.lit("-"))


def _cases(key: Column, cases: list[tuple[tuple[str, ...], str]]) -> Column:
    out = None
    for keys, value in cases:
        out = (F if out is None else out).when(key.isin(*keys), value)
    return out.when(key.contains("artifact"), "artifact").when(key.isin("deleted", "excluded"), "deleted")


def export_class(label: Column, with_ehfo: bool = True) -> Column:
    # fixed values: the spellings of each written class
    cases = [
        (("hfo", "real-hfo", "real hfo", "non-spike hfo", "non-spike-hfo", "non-spkhfo", "non-spk hfo"), "HFO"),
        (("spike-hfo", "spike hfo", "spkhfo", "spk-hfo", "spk hfo"), "spike-HFO"),
        (("ehfo", "e-hfo"), "eHFO" if with_ehfo else "HFO"),
        (("spike-ehfo", "spike ehfo", "spkehfo", "spk-ehfo", "spk ehfo"), "spike-eHFO" if with_ehfo else "spike-HFO"),
    ]
    return _cases(_key(label), cases).otherwise("candidate")


def display_class(label: Column, with_ehfo: bool = True) -> Column:
    plain = "HFO" if with_ehfo else "non-spike HFO"
    cases = [
        (("hfo", "real-hfo"), plain),
        (("non-spike hfo", "non-spike-hfo"), "non-spike HFO"),
        (("spike-hfo", "spkhfo"), "spike-HFO"),
        (("ehfo",), "eHFO" if with_ehfo else "non-spike HFO"),
        (("spike-ehfo",), "spike-eHFO" if with_ehfo else "spike-HFO"),
        (("candidate", "unknown", ""), "unclassified"),
    ]
    return _cases(_key(label), cases).otherwise(F.trim(label))


def grid_class(label: Column) -> Column:
    cases = [
        (("hfo",), "HFO"),
        (("spike-hfo", "spkhfo"), "spike-HFO"),
        (("ehfo",), "eHFO"),
        (("spike-ehfo",), "spike-eHFO"),
        (("candidate", "unknown", "unclassified"), "unclassified"),
    ]
    return _cases(_key(label), cases).otherwise("non-spike HFO")


def import_class(label: Column) -> Column:
    cases = [
        (("hfo", "real-hfo"), "HFO"),
        (("non-spike hfo", "non-spike-hfo"), "non-spike HFO"),
        (("spike-hfo", "spkhfo"), "spike-HFO"),
        (("ehfo",), "eHFO"),
        (("spike-ehfo",), "spike-eHFO"),
        (("candidate", "unknown"), "unclassified"),
    ]
    return F.when(_key(label) == "", F.lit(None).cast("string")).otherwise(_cases(_key(label), cases).otherwise(F.trim(label)))


def manual_class(label: Column) -> Column:
    """A manual edit: what isn't a known class is unclassified."""
    known = import_class(label)
    return F.when(known.isin(*ACCEPTED, "artifact", "deleted", "unclassified"), known).otherwise("unclassified")


def gamma_class(label: Column) -> Column:
    key = F.regexp_replace(_key(label), r"[\s-]+", "-")
    return F.when(key.isin("gamma", "gamma-spike"), "gamma").when(key.isin("non-gamma", "nongamma"), "non-gamma").when(key.isin("", "unclassified", "unknown"), "unclassified").otherwise(F.trim(label))


def official_class(manual: Column, model: Column, legacy: Column | None = None) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(manual), blank(model), *([blank(legacy)] if legacy is not None else []))


def combined_label(keep: Column, spike: Column, ehfo: Column, threshold: float = 0.5) -> Column:
    """DSP27: labels of three classifiers, each positive strictly above the threshold."""
    yes = lambda p: p > threshold
    return F.when(~yes(keep), "artifact").when(yes(spike) & yes(ehfo), "spike-eHFO").when(yes(spike), "spike-HFO").when(yes(ehfo), "eHFO").otherwise("HFO")


def fallback_label(artifact: Column, spike: Column, hfo: Column) -> Column:
    """DSP28: from plain scores; all null gives null."""
    high = lambda p: F.coalesce(p >= 0.5, F.lit(False))
    label = F.when(high(artifact), "artifact").when(high(spike), "spike-HFO").when(high(hfo), "HFO").otherwise("candidate")
    return F.when(F.coalesce(artifact, spike, hfo).isNotNull(), label)


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite (SNK07)."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def is_gamma(power: Column, duration: Column) -> Column:
    return F.coalesce((finite(power).isNotNull()) & (finite(duration).isNotNull()) & ((power > 0) | (duration > 0)), F.lit(False))


def filled_probabilities(real: Column, artifact: Column) -> tuple[Column, Column]:
    return F.coalesce(real, 1 - artifact), F.coalesce(artifact, 1 - real)


PRESETS = {"default": "Default", "ripples": "Ripples", "ripple": "Ripples", "fast ripples": "Fast ripples", "fast ripple": "Fast ripples", "fast-ripples": "Fast ripples"}


def preset_name(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PRESETS.items() for x in pair))
    return F.coalesce(known[F.lower(F.trim(name))], F.lit("Default"))


def band_label(preset: Column, low: Column, high: Column) -> Column:
    short = lambda x: F.regexp_replace(F.format_string("%.3f", x.cast("double")), r"\.?0+$", "")
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(preset, F.lit(" "), short(low), F.lit("-"), short(high), F.lit(" Hz")))


def trailing_number(event_id: Column) -> Column:
    out = F.regexp_extract(event_id, r"(\d+)$", 1)
    return F.when(out != "", out.cast("long"))
