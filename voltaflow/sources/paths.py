"""Paths of many recordings resolved at once against a listing (SRC02, SRC09, SRC12).

A listing is a table with `path`, one row a file (storage.listing gives one of a folder). Candidates of all
rows are ranked and joined to it once; no file is asked for on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mathx as X

#: Names of .fdt files in a message: what no file name may hold ends them.
FDT = r'(?i)[^\\/:*?"<>|\r\n]+\.fdt'


def normal(path: Column) -> Column:
    """The path with slashes only, without empty parts, `.` and `..` (those that lead above the start stay)."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    up = lambda at: (F.size(at) > 0) & (F.element_at(at, -1) != "..")
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda at, p: F.when((p == "") | (p == "."), at).when((p == "..") & F.coalesce(up(at), F.lit(False)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(p))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))


def below(folder: Column, path: Column) -> Column:
    """The path, taken from the folder unless it is absolute."""
    return normal(F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path)))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def first_there(rows: DataFrame, key: str, candidates: Column, listing: DataFrame) -> DataFrame:
    """key, found (the first of an array of candidate paths that is listed, else null), place (its place among them, from 0)."""
    each = rows.select(key, F.posexplode(candidates).alias("place", "candidate")).where("candidate is not null")
    there = listing.select(F.col("path").alias("candidate")).distinct()
    best = each.join(there, "candidate").groupBy(key).agg(F.min(F.struct("place", "candidate")).alias("best"))
    return rows.select(key).join(best, key, "left").select(key, F.col("best.candidate").alias("found"), F.col("best.place").alias("place"))


def resolve_recordings(rows: DataFrame, listing: DataFrame, root: str, key: str = "row") -> DataFrame:
    """rows (key, edf_full_path, edf_relative_path) with path and problem: the full path if it is there, else the relative one below the root (SRC09).

    Without a path that is there, path is the relative one's place and the problem says that it is missing; without a
    relative path either, path is null.
    """
    full, relative = X.blank_to_null(F.col("edf_full_path")), X.blank_to_null(F.col("edf_relative_path"))
    placed = rows.withColumns({"_full": normal(full), "_below": below(F.lit(root), relative)})
    found = first_there(placed, key, F.array("_full", "_below"), listing)
    path = F.coalesce("found", "_below")
    problem = F.when(F.col("found").isNotNull(), F.lit(None)).when(F.col("_below").isNull(), "no recording is named").otherwise(F.concat(F.lit("missing recording: "), "_below"))
    return placed.join(found, key).withColumns({"path": path, "problem": problem}).drop("_full", "_below", "found", "place")


def named_companions(message: Column) -> Column:
    """Names of .fdt files that a message mentions, each once whatever its case, in order (SRC02)."""
    names = F.transform(F.regexp_extract_all(message, F.lit(FDT), F.lit(0)), lambda n: F.trim(n))
    return F.filter(names, lambda n, i: ~F.exists(F.slice(names, 1, i), lambda m: F.lower(m) == F.lower(n)))


def companions(sets: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """key, companion, rule of .set files (key: their path; expected: names that opening them asked for): the .fdt file beside each (SRC02).

    The first expected name that is there (rule 0), else the file of the same stem (1), else the folder's only .fdt file (2), else none.
    """
    folder = folder_of(F.col(key))
    expected = F.transform(F.coalesce("expected", F.array().cast("array<string>")), lambda n: F.concat(folder, F.lit("/"), n))
    stem = F.concat(folder, F.lit("/"), stem_of(F.col(key)), F.lit(".fdt"))
    rows = sets.select(key, expected.alias("_expected"), folder.alias("_folder"), stem.alias("_stem"))
    found = first_there(rows, key, F.concat("_expected", F.array("_stem")), listing)
    only = listing.where(F.col("path").endswith(".fdt")).select("path").distinct().groupBy(folder_of(F.col("path")).alias("_folder")).agg(F.count("*").alias("n"), F.first("path").alias("_only")).where("n = 1")
    out = rows.join(found, key).join(only.select("_folder", "_only"), "_folder", "left")
    rule = F.when(F.col("place") < F.size("_expected"), 0).when(F.col("place").isNotNull(), 1).when(F.col("_only").isNotNull(), 2)
    return out.select(key, F.coalesce("found", "_only").alias("companion"), rule.alias("rule"))


def resolve_projects(projects: DataFrame, listing: DataFrame, key: str = "project_path") -> DataFrame:
    """projects (key, raw_file, raw_file_relative) with recording: the absolute path if it is there, else the one relative to the project's folder, else null: ask (SRC12)."""
    absolute, relative = normal(X.blank_to_null(F.col("raw_file"))), below(folder_of(F.col(key)), X.blank_to_null(F.col("raw_file_relative")))
    found = first_there(projects, key, F.array(absolute, relative), listing)
    return projects.join(found.select(key, F.col("found").alias("recording")), key)
