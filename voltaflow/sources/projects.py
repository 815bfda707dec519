"""Project documents of all versions, a table at a time (HLP01, SNK09, SRC11, SRC18).

Documents are VARIANT columns: checked, brought to the present form and written by column expressions. A
document that can't be read keeps its row and says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mathx as X
from .results import PROJECT_FORMAT, PROJECT_VERSION

FILTER = "struct<highpass_hz:double,lowpass_hz:double,notch_mode:string>"
PAIRS = "array<struct<name:string,ch1:string,ch2:string,origin:string>>"
NOTCH_OFF = "Off"


def _get(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def _kind(doc: Column, path: str) -> Column:
    """The type of what is at the path ("" where there is nothing)."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(doc, path, "variant")), F.lit(""))


def problem(doc: Column) -> Column:
    """Why a parsed document can't be read, null if it can: no object, format, version, source, recording."""
    version = _kind(doc, "$.version")
    number = _get(doc, "$.version", "long")
    blank = lambda p: (_kind(doc, p) != "STRING") | X.blank_to_null(_get(doc, p, "string")).isNull()
    return (
        F.when(doc.isNull() | ~F.coalesce(F.schema_of_variant(doc), F.lit("")).startswith("OBJECT"), "not a project document")
        .when((_kind(doc, "$.format") != "STRING") | ~_get(doc, "$.format", "string").eqNullSafe(F.lit(PROJECT_FORMAT)), "another format")
        .when(version != "BIGINT", "the version isn't a whole number")
        .when(~number.between(1, PROJECT_VERSION), "a version that isn't known")
        .when(~_kind(doc, "$.source").startswith("OBJECT"), "no source")
        .when(blank("$.source.raw_file") & blank("$.source.raw_file_relative"), "no recording is named")
    )


def filter_settings(doc: Column, path: str) -> Column:
    number = lambda name: _get(doc, f"{path}.{name}", "double")
    return F.struct(number("highpass_hz").alias("highpass_hz"), number("lowpass_hz").alias("lowpass_hz"), F.coalesce(_get(doc, f"{path}.notch_mode", "string"), F.lit(NOTCH_OFF)).alias("notch_mode"))


def read_projects(documents: DataFrame, text: str = "document") -> DataFrame:
    """documents with problem and, where there is none, the sections in their present form.

    version, project_name, raw_file, raw_file_relative, annotations, hidden and bad channels, montage (pairs), groups,
    macro and micro (filters; one flat filter of old documents goes to both), time_range_s, reference_mode, algorithm
    (its first name was `mean`), time (its first name was `mean` too) and computation (as it was, a variant).
    """
    # a generated column: filters on what is read from it aren't pushed below, where a document would be parsed once more for each use
    rows = documents.select("*", F.explode(F.array(F.try_parse_json(F.col(text)))).alias("_doc"))
    doc = F.col("_doc")
    grouped = (_kind(doc, "$.preprocessing.filters.macro") != "") | (_kind(doc, "$.preprocessing.filters.micro") != "")
    section = lambda name: F.when(grouped, filter_settings(doc, f"$.preprocessing.filters.{name}")).otherwise(filter_settings(doc, "$.preprocessing.filters"))
    algorithm = F.lower(_get(doc, "$.computation.algorithm", "string"))
    names = lambda p: F.coalesce(_get(doc, p, "array<string>"), F.array().cast("array<string>"))
    out = {
        "problem": problem(doc), "version": _get(doc, "$.version", "long"), "project_name": F.coalesce(_get(doc, "$.project_name", "string"), F.lit("untitled")),
        "raw_file": X.blank_to_null(_get(doc, "$.source.raw_file", "string")), "raw_file_relative": X.blank_to_null(_get(doc, "$.source.raw_file_relative", "string")),
        "annotations": F.coalesce(_get(doc, "$.review.annotations", "array<variant>"), F.array().cast("array<variant>")), "hidden_channels": names("$.review.hidden_channels"), "bad_channels": names("$.review.bad_channels"),
        "montage": _get(doc, "$.review.bipolar_montage.pairs", PAIRS), "channel_groups": F.coalesce(_get(doc, "$.review.channel_groups", "map<string,string>"), F.create_map().cast("map<string,string>")),
        "macro": section("macro"), "micro": section("micro"), "time_range_s": _get(doc, "$.display.time_range_s", "double"), "reference_mode": F.coalesce(_get(doc, "$.display.reference.mode", "string"), F.lit("none")),
        "algorithm": F.when(algorithm.isin("gamma_spike", "hfo"), algorithm).otherwise("ei"),
        "time": F.coalesce(_get(doc, "$.computation.time", "variant"), _get(doc, "$.computation.mean", "variant")), "computation": _get(doc, "$.computation", "variant"),
    }
    kept = [c for c in documents.columns if c not in out]
    readable = {name: F.when(F.col("problem").isNull(), F.col(name)) for name in out if name not in ("problem", "version")}
    return rows.select(*kept, *[c.alias(n) for n, c in out.items()]).withColumns(readable)


def relative_path(path: Column, folder: Column) -> Column:
    """How to come from the folder to the path, both absolute."""
    a, b = F.split(path, "/"), F.split(folder, "/")
    # the place of the first part that differs
    steps = F.sequence(F.lit(1), F.least(F.size(a), F.size(b)))
    apart = F.filter(steps, lambda i: F.element_at(a, i) != F.element_at(b, i))
    common = F.coalesce(F.get(apart, 0) - 1, F.least(F.size(a), F.size(b)))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(b) - common), F.slice(a, common + 1, F.size(a))), "/")


def write_projects(projects: DataFrame, path: str | None = "project_path") -> Column:
    """The document of each row, of the columns that read_projects gives, in the present version.

    With the name of a column of the project's own path, the name and the relative path are made from it. A montage
    is stored under review only if a pair of it was made by hand, under display only if it is the reference.
    """
    edited = F.exists(F.coalesce("montage", F.array().cast(PAIRS)), lambda p: p["origin"] == "manual")
    pairs = F.struct(F.col("montage").alias("pairs"))
    name, relative = F.col("project_name"), F.col("raw_file_relative")
    if path:
        file = F.element_at(F.split(F.col(path), "/"), -1)
        name = F.coalesce(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), name)
        relative = F.coalesce(F.when(F.col("raw_file").startswith("/") & F.col(path).startswith("/"), relative_path(F.col("raw_file"), F.regexp_replace(F.col(path), "/[^/]*$", ""))), relative)
    return F.to_json(F.struct(
        F.lit(PROJECT_FORMAT).alias("format"), F.lit(PROJECT_VERSION).alias("version"), F.coalesce(name, F.lit("untitled")).alias("project_name"),
        F.struct("raw_file", relative.alias("raw_file_relative")).alias("source"),
        F.struct("annotations", "hidden_channels", "bad_channels", F.when(edited, pairs).alias("bipolar_montage"), "channel_groups").alias("review"),
        F.struct(F.struct("macro", "micro").alias("filters")).alias("preprocessing"),
        F.struct("time_range_s", F.struct(F.col("reference_mode").alias("mode"), F.when(F.col("reference_mode") == "bipolar", pairs).alias("bipolar_montage")).alias("reference")).alias("display"),
        F.col("computation").alias("computation"),
    ))
