"""Model scores of events in batches: a hook for models of the caller's own (DSP26, DSP29, HLP14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events that a model is given at once.
BATCH = 128
SCORES = ("keep", "spike", "ehfo")


def scored(events: DataFrame, make_model: Callable[[], Callable[[np.ndarray], dict[str, np.ndarray]]], key: str = "event_id", features: str = "waveform", batch: int = BATCH, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """key, the scores (null where a model gives none that is finite), status: ok, no features, or what went wrong.

    make_model runs once a task and gives a function from a matrix (events by features) to one array a score. Events of one
    length are given together, at most `batch` at a time, across the borders of Arrow's batches. An error of the model
    is the status of the events it was given, not a failed job.
    """
    kind = dict(events.dtypes)[key]
    names = [key, *scores, "status"]
    key_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = make_model(), {}

        def table(keys: list, columns: dict, status: str) -> pa.RecordBatch:
            finite = [[float(v) if np.isfinite(v) else None for v in columns[s]] if s in columns else [None] * len(keys) for s in scores]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, pa.float64()) for c in finite), pa.array([status] * len(keys))], names=names)

        def given(keys: list, rows: list) -> pa.RecordBatch:
            try:
                out = {s: np.asarray(v, float).reshape(-1) for s, v in model(np.stack(rows)).items()}
                short = [s for s in scores if len(out.get(s, ())) != len(keys)]
                return table(keys, {}, f"scores missing: {', '.join(short)}") if short else table(keys, out, "ok")
            except Exception as error:  # told as data, event by event
                return table(keys, {}, f"model error: {type(error).__name__}: {error}")

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                if not x.is_valid or not len(x.values):
                    yield table([k], {}, "no features")
                    continue
                row = np.asarray(x.values, float)
                keys, rows = held.setdefault(len(row), ([], []))
                keys.append(k)
                rows.append(row)
                if len(keys) == batch:
                    yield given(*held.pop(len(row)))
        for keys, rows in held.values():
            yield given(keys, rows)

    return events.select(key, features).mapInArrow(run, f"{key} {kind}, {', '.join(f'{s} double' for s in scores)}, status string")


def complete(events: DataFrame, found: DataFrame, key: str = "event_id") -> DataFrame:
    """events with their scores and status; an event that the model wasn't given is told as such, not left out."""
    return events.join(found, key, "left").withColumn("status", F.coalesce("status", F.lit("not scored")))
