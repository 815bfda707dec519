"""Runs that tell their progress and can be cancelled, a performance log, and a bounded cache of results (STM03, SNK12, STM04, HLP07, HLP16)."""

from __future__ import annotations

import contextlib
import math
import os
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .sources import storage


class Cancelled(Exception):
    """The run was asked to end."""


@dataclass(frozen=True)
class Progress:
    step: str
    steps_done: int
    jobs: int
    tasks: int
    tasks_done: int
    state: str


class Run:
    """fn(run) in a thread of its own, all of its Spark jobs under one tag.

    fn calls run.step(name) between its steps. cancel() ends the jobs under the tag and makes the next step raise
    Cancelled, so nothing that a later step would publish is published; jobs of other runs go on. What fn returns or
    raises comes from result().
    """

    def __init__(self, spark: SparkSession, fn: Callable[[Run], Any], name: str = "run", on_step: Callable[[str], None] | None = None) -> None:
        self.spark, self.fn, self.on_step = spark, fn, on_step
        self.tag = f"voltaflow-{name}-{uuid.uuid4().hex}"
        self._stop, self._steps = threading.Event(), []
        self._value: Any = None
        self._error: BaseException | None = None
        self._thread = InheritableThread(target=self._go, name=self.tag)

    def start(self) -> Run:
        self._thread.start()
        return self

    def _go(self) -> None:
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            self._value = self.fn(self)
            if self._stop.is_set():
                raise Cancelled(self.tag)
        except BaseException as error:  # given to whoever asks for the result
            self._error = Cancelled(self.tag) if self._stop.is_set() else error
        finally:
            sc.removeJobTag(self.tag)

    def step(self, name: str) -> None:
        """A new step begins; Cancelled if the run is to end."""
        if self._stop.is_set():
            raise Cancelled(self.tag)
        self._steps.append(name)
        if self.on_step:
            self.on_step(name)

    def cancel(self, wait: float = 60.0) -> None:
        """End the run; jobs that begin while it ends are cancelled too."""
        self._stop.set()
        until = time.monotonic() + wait
        while self._thread.is_alive() and time.monotonic() < until:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.2)

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        ids, tasks, done = list(tracker.getJobIdsForTag(self.tag)), 0, 0
        for info in (self.spark.sparkContext.statusTracker().getJobInfo(i) for i in ids):
            for stage in info.stageIds if info else ():
                s = self.spark.sparkContext.statusTracker().getStageInfo(stage)
                if s is not None:
                    tasks, done = tasks + s.numTasks, done + s.numCompletedTasks
        alive = self._thread.is_alive()
        state = "running" if alive else "cancelled" if isinstance(self._error, Cancelled) else "failed" if self._error else "finished"
        steps = self._steps
        return Progress(steps[-1] if steps else "", max(0, len(steps) - alive), len(ids), tasks, done, state)

    def result(self, timeout: float | None = None) -> Any:
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.tag)
        if self._error is not None:
            raise self._error
        return self._value


#: Columns of the performance log, in order (fixed names).
LOG_COLUMNS = "file_path duration_h n_channels sfreq step elapsed_s working_set_mb private_mb cpu_percent smoothness_score visible_window_s filter_mode reference_mode notes".split()


class PerformanceLog:
    """One appended row a step: elapsed time, memory, and what an observation counted while the step's table was written."""

    def __init__(self, spark: SparkSession, path: str, **context: object) -> None:
        unknown = set(context) - set(LOG_COLUMNS)
        if unknown:
            raise ValueError(f"not in the log: {', '.join(sorted(unknown))}")
        self.spark, self.path, self.context = spark, path, context

    def _memory(self) -> tuple[float | None, float]:
        runtime = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        try:
            with open("/proc/self/statm") as f:
                resident = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
        except OSError:
            resident = None
        return resident, (runtime.totalMemory() - runtime.freeMemory()) / 1e6

    def mark(self, step: str, elapsed_s: float | None = None, notes: str = "") -> None:
        resident, used = self._memory()
        text = lambda v, form="{:.3f}": "" if v is None else form.format(v)
        row = {c: str(self.context.get(c, "") or "") for c in LOG_COLUMNS} | {"step": step, "elapsed_s": text(elapsed_s, "{:.6f}"), "working_set_mb": text(resident), "private_mb": text(used), "notes": notes}
        self.spark.createDataFrame([tuple(row[c] for c in LOG_COLUMNS)], ", ".join(f"{c} string" for c in LOG_COLUMNS)).coalesce(1).write.mode("append").option("header", True).csv(self.path)

    @contextlib.contextmanager
    def step(self, name: str) -> Iterator[None]:
        """Log the block as one step; a block that raises is logged too, and the error named."""
        start, notes = time.perf_counter(), ""
        try:
            yield
        except BaseException as error:
            notes = f"failed: {type(error).__name__}"
            raise
        finally:
            self.mark(name, time.perf_counter() - start, notes)

    def write(self, name: str, df: DataFrame, path: str) -> int:
        """Write df as Parquet, as one step whose notes give the rows written; how many."""
        seen, start = Observation(), time.perf_counter()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        rows = 0 if self.spark.read.schema(df.schema).parquet(path).isEmpty() else seen.get["rows"]
        self.mark(name, time.perf_counter() - start, f"rows={rows}")
        return rows

    def read(self) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in LOG_COLUMNS)
        if not storage.exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("header", True).csv(self.path)


def filter_signature(high_pass: float | None, low_pass: float | None, notch: str = "Off") -> tuple:
    """A key of filter settings: cutoffs that aren't positive numbers are none."""
    clean = lambda v: float(v) if v is not None and math.isfinite(v) and v > 0 else None
    return clean(high_pass), clean(low_pass), str(notch)


class SegmentCache:
    """Results kept in Spark's storage, the least recently used going first, under a bound of bytes.

    A result is known by what its plan computes (DataFrame.sameSemantics) and by the caller's settings. Its size is
    measured once it is stored; one that is larger than the bound isn't kept. What goes is unpersisted.
    """

    def __init__(self, limit_bytes: int = 128 << 20) -> None:
        self.limit, self.bytes, self.hits, self.misses, self.evictions = limit_bytes, 0, 0, 0, 0
        self._held: OrderedDict[tuple, tuple[DataFrame, DataFrame, int]] = OrderedDict()
        self._lock = threading.Lock()

    def _find(self, source: DataFrame, settings: tuple) -> tuple | None:
        mine = (source.semanticHash(), settings)
        return next((k for k, (plan, _, _) in self._held.items() if k[:2] == mine and plan.sameSemantics(source)), None)

    def get(self, source: DataFrame, settings: tuple, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """make(source), kept; the kept one where the same source was made with the same settings before."""
        with self._lock:
            key = self._find(source, settings)
            if key is not None:
                self.hits += 1
                self._held.move_to_end(key)
                return self._held[key][1]
            self.misses += 1
            made = make(source).persist(StorageLevel.MEMORY_AND_DISK)
            made.count()
            size = int(str(made._jdf.queryExecution().withCachedData().stats().sizeInBytes()))
            if size > self.limit:
                made.unpersist()
                return make(source)
            self._held[(source.semanticHash(), settings, uuid.uuid4().hex)] = (source, made, size)
            self.bytes += size
            while self.bytes > self.limit:
                _, (_, old, bytes_) = self._held.popitem(last=False)
                old.unpersist()
                self.bytes -= bytes_
                self.evictions += 1
            return made

    def clear(self) -> None:
        with self._lock:
            for _, made, _ in self._held.values():
                made.unpersist()
            self._held.clear()
            self.bytes = 0

    def __len__(self) -> int:
        return len(self._held)
