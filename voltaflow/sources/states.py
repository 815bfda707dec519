"""Saved states of a computation: versioned snapshots of tables and parameters (SNK10).

A snapshot's tables are written first, its manifest last, by Spark's committed writer: a reader sees the
versions that have a manifest, so a crash between tables leaves nothing to be seen. Version numbers are
claimed by exclusive creation, so two writers never share one. Manifests hold the tables' schemas, row counts
and digests, taken by an observation while they are written; restoring can compare them.

The state of a run is its parameters and all of its oscillations without waveforms. Restoring fills what older
states lack, as read_oscillations and read_parameters say.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import classes as C
from ..functions import mathx as X
from . import storage

MANIFEST = "parameters string, tables array<struct<name:string,path:string,schema:string,rows:long,digest:string>>"

#: Columns of a saved oscillation, in order, and their types; `ord` is its place in the run, from 1.
OSCILLATION = {
    "ord": "long", "event_id": "string", "channel": "string", "detector": "string", "start_sample": "long", "end_sample": "long", "start_time_s": "double", "end_time_s": "double",
    "peak_time_s": "double", "duration_ms": "double", "band_label": "string", "low_freq_hz": "double", "high_freq_hz": "double", "is_boundary": "boolean", "boundary_warning": "boolean",
    "real_hfo_probability": "double", "artifact_probability": "double", "spike_hfo_probability": "double", "final_model_class": "string", "manual_class": "string",
    "manual_review_status": "string", "artifact_score": "double", "spike_score": "double", "hfo_score": "double", "classification_label": "string", "error": "string",
}
ALGORITHMS = ("ei", "gamma_spike", "hfo")


class DamagedState(RuntimeError):
    """A table of a snapshot isn't what its manifest says."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    parameters: dict
    tables: dict[str, DataFrame]


def _digest(df: DataFrame) -> list[Column]:
    """Row count, and the sum of the rows' hashes, which doesn't depend on their order."""
    hashed = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*hashed).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")]


class StateStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _claimed(self) -> int:
        version = max((int(n.split("=")[1]) for n in storage.names(self.spark, f"{self.root}/claims")), default=0) + 1
        while not storage.claim(self.spark, f"{self.root}/claims/version={version:06d}"):
            version += 1
        return version

    def save(self, tables: dict[str, DataFrame], parameters: dict | None = None) -> int:
        """Write all tables, then the manifest; the number of the version. A version that fails leaves no files behind."""
        version = self._claimed()
        folder = f"{self.root}/data/version={version:06d}"
        try:
            written = [self._written(df, name, f"{folder}/{name}-{uuid.uuid4().hex}") for name, df in tables.items()]
            row = self.spark.createDataFrame([(json.dumps(parameters or {}, sort_keys=True), written)], MANIFEST)
            row.coalesce(1).write.mode("error").json(f"{self.root}/manifests/version={version:06d}")
        except BaseException:
            storage.remove(self.spark, folder)
            raise
        return version

    def _written(self, df: DataFrame, name: str, path: str) -> tuple:
        seen = Observation()
        df.observe(seen, *_digest(df)).write.parquet(path)
        empty = self.spark.read.schema(df.schema).parquet(path).isEmpty()  # what is left of a plan without rows may observe nothing
        got = {"rows": 0, "digest": "0"} if empty else seen.get
        return name, path, df.schema.json(), got["rows"], got["digest"]

    def manifests(self) -> DataFrame:
        """version, parameters, tables of every whole version."""
        if not storage.exists(self.spark, f"{self.root}/manifests"):
            return self.spark.createDataFrame([], f"version int, {MANIFEST}")
        return self.spark.read.schema(f"{MANIFEST}, version int").json(f"{self.root}/manifests").select("version", "parameters", "tables")

    def versions(self) -> list[int]:
        return sorted(r.version for r in self.manifests().select("version").collect())

    def restore(self, version: int | None = None, verify: bool = False) -> Snapshot:
        """The newest or the given version; with verify, every table is read and compared with its manifest first."""
        every = self.manifests()
        wanted = every.orderBy(F.desc("version")).limit(1) if version is None else every.where(F.col("version") == version)
        rows = wanted.collect()
        if not rows:
            raise LookupError(f"no version {version or ''} below {self.root}")
        row, tables = rows[0], {}
        for t in row.tables:
            df = self.spark.read.schema(StructType.fromJson(json.loads(t.schema))).parquet(t.path)
            if verify and tuple(df.agg(*_digest(df)).collect()[0]) != (t.rows, t.digest):
                raise DamagedState(f"{t.name} of version {row.version} has changed since it was saved")
            tables[t.name] = df
        return Snapshot(row.version, json.loads(row.parameters), tables)

    def vacuum(self, keep: int) -> list[int]:
        """Remove all but the newest `keep` whole versions, and what crashed writers left before them; the versions removed."""
        whole = self.versions()
        if keep < 1:
            raise ValueError("at least one version stays")
        if len(whole) <= keep:
            return []
        first = whole[-keep]
        for version in whole:
            if version < first:  # the manifest goes first, so that no reader sees a version without its tables
                storage.remove(self.spark, f"{self.root}/manifests/version={version:06d}")
        for name in storage.names(self.spark, f"{self.root}/data"):
            if int(name.split("=")[1]) < first:
                storage.remove(self.spark, f"{self.root}/data/{name}")
        return [v for v in whole if v < first]


def saved_oscillations(events: DataFrame) -> DataFrame:
    """Events as they are saved: the known columns (null where the events lack one), without waveforms."""
    return events.select(*[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in OSCILLATION.items()])


def read_oscillations(saved: DataFrame) -> DataFrame:
    """Saved events with defaults: those without a channel go; an id is made from the place; times, durations and bands are filled."""
    rows = saved_oscillations(saved)
    number = lambda c: C.finite(F.col(c))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    start = F.coalesce(number("start_time_s"), F.lit(0.0))
    end = F.coalesce(number("end_time_s"), start)
    span = F.greatest(F.lit(0.0), end - start)
    out = {
        "event_id": F.coalesce(F.when(F.col("event_id") != "", F.col("event_id")), F.format_string("hfo_%06d", F.col("ord"))), "detector": text("detector"), "band_label": text("band_label"),
        "start_sample": F.coalesce("start_sample", F.lit(0).cast("long")), "end_sample": F.coalesce("end_sample", F.lit(0).cast("long")), "start_time_s": start, "end_time_s": end,
        "peak_time_s": F.coalesce(number("peak_time_s"), start + span / 2), "duration_ms": F.coalesce(number("duration_ms"), span * 1000),
        "low_freq_hz": F.coalesce(number("low_freq_hz"), F.lit(80.0)), "high_freq_hz": F.coalesce(number("high_freq_hz"), F.lit(300.0)),
        "is_boundary": F.coalesce("is_boundary", F.lit(False)), "boundary_warning": F.coalesce("boundary_warning", F.lit(False)),
        "manual_review_status": F.coalesce(F.when(F.col("manual_review_status") != "", F.col("manual_review_status")), F.lit("unreviewed")),
    }
    out |= {c: number(c) for c in ("real_hfo_probability", "artifact_probability", "spike_hfo_probability", "artifact_score", "spike_score", "hfo_score")}
    out |= {c: X.blank_to_null(F.col(c)) for c in ("final_model_class", "manual_class", "classification_label", "error")}
    return rows.where("channel <> ''").withColumns(out).select(*OSCILLATION)


def restored_channels(events: DataFrame, listed: DataFrame) -> DataFrame:
    """channel, place, event_count: listed channels (channel, ordinal) that have events, then the others as they first come.

    One row a channel is left before the rows are placed.
    """
    have = events.groupBy("channel").agg(F.count("*").alias("event_count"), F.min("ord").alias("first"))
    names = listed.groupBy("channel").agg(F.min("ordinal").alias("ordinal"))
    placed = have.join(names, "channel", "left").withColumn("recording", F.lit(""))
    w = Window.partitionBy("recording").orderBy(F.col("ordinal").asc_nulls_last(), "first", "channel")
    return placed.select("channel", F.row_number().over(w).cast("long").alias("place"), "event_count")


def read_parameters(state: dict, duration_s: float | None = None) -> dict:
    """Parameters of a run with defaults for what an older state lacks; `mean` was the name of `time`, and of the first algorithm."""
    part = lambda name: state.get(name) if isinstance(state.get(name), dict) else {}

    def number(value: object, default: float | None) -> float | None:
        try:
            return default if value is None else float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return default

    def whole(value: object) -> int | None:
        try:
            return int(value)  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return None

    time = part("time") if "time" in state else part("mean")
    ei, gamma, hfo = part("ei"), part("gamma_spike"), part("hfo")
    algorithm = "ei" if state.get("algorithm") in (None, "", "mean") else str(state["algorithm"])
    selected = state.get("selected_abs")
    windows = lambda p: {"analysis_start_s": number(p.get("analysis_start_s", 0.0), None), "analysis_end_s": number(p.get("analysis_end_s", duration_s), None)}
    return {
        "algorithm": algorithm if algorithm in ALGORITHMS else "ei",
        "selected_abs": [n for n in map(whole, selected if isinstance(selected, list) else []) if n is not None],
        "time": {"t0": number(time.get("t0"), 0.0) or 0.0, "window_s": max(1.0, number(time.get("window_s"), 1.0) or 1.0), "link_time": bool(time.get("link_time", False))},
        "ei": {k: number(ei.get(k), None) for k in ("seizure_onset_s", "seizure_offset_s", "baseline_start_s", "baseline_end_s", "ictal_start_s", "ictal_end_s")} | {"params": dict(part("ei").get("params") or {})},
        "gamma_spike": windows(gamma),
        "hfo": windows(hfo) | {"params": dict(hfo.get("params") or {})},
    }
