"""EDF and BDF recordings as a Spark data source: ranges of a file are tasks, filters reach the reader (SRC01, SRC04).

    EdfSource.register(spark)
    spark.read.format(EdfSource.name()).load(path).where("channel = 'RA1' and record >= 600 and record < 660")

The driver lists files and their sizes only. A task gets a range of a file's bytes, reads the header itself and
owns the records that begin in its range, so a long recording is many tasks. Filters on the recording, channel and
record are applied in the reader: records outside of the range that they leave aren't read. The path is any
that pyarrow's file systems open; read_edf (recordings.py) serves stores that only Spark reads.

Writing takes rows (recording, seq, payload): a file is a recording's payloads in order, the header being the
first. Files are written under a temporary name and renamed when all tasks have ended.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "recording string, channel string, ch_idx int, fs double, record long, start_sample long, x array<double>"
SUFFIXES = (".edf", ".bdf")
#: Labels of channels that hold annotations, not samples.
ANNOTATIONS = ("EDF Annotations", "BDF Annotations")
#: Bytes of a file for one task, and of records that a task holds at once.
TASK_BYTES, HELD_BYTES = 64 << 20, 8 << 20
#: Ranges are made longer, up to TASK_BYTES, where there would be more than about this many.
TASKS = 256
FIELDS = (("label", 16), ("transducer", 80), ("dimension", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8), ("dig_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32))


def parse_header(data: bytes) -> dict:
    """Fields of an EDF or BDF header: record count and length, and per channel label, ranges and samples a record."""
    n = int(data[252:256])
    fields, at = {}, 256
    for name, width in FIELDS:
        fields[name] = [data[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
    out = {"n_channels": n, "header_bytes": int(data[184:192]), "n_records": int(data[236:244]), "record_s": float(data[244:252]), "wide": data[:1] == b"\xff"}
    out |= {k: list(map(float, fields[k])) for k in ("phys_min", "phys_max", "dig_min", "dig_max")}
    return out | {"label": fields["label"], "samples": list(map(int, fields["samples"]))}


@dataclass
class FileRange(InputPartition):
    path: str
    size: int
    lo: int
    hi: int


def read_range(opened, part: FileRange, channels: set | None = None, first: int = 0, last: int | None = None) -> Iterator[tuple[dict, int, int, np.ndarray]]:
    """header, channel index, record, physical values, of the records of a file that begin in the range and lie in [first, last)."""
    head = opened.read(256)
    head += opened.read(int(head[252:256]) * 256)
    h = parse_header(head)
    width = 3 if h["wide"] else 2
    ends = np.cumsum([0, *h["samples"]])
    record_bytes = int(ends[-1]) * width
    if not record_bytes:
        return
    whole = (part.size - h["header_bytes"]) // record_bytes
    count = whole if h["n_records"] < 0 else min(whole, h["n_records"])
    begin = lambda at: max(0, -(-(at - h["header_bytes"]) // record_bytes))
    lo, hi = max(begin(part.lo), first), min(begin(part.hi), count, count if last is None else last)
    wanted = [i for i, name in enumerate(h["label"]) if name not in ANNOTATIONS and (channels is None or name in channels)]
    if not wanted:
        return
    step = max(1, HELD_BYTES // record_bytes)
    for at in range(lo, hi, step):
        n = min(step, hi - at)
        opened.seek(h["header_bytes"] + at * record_bytes)
        body = np.frombuffer(opened.read(n * record_bytes), np.uint8).reshape(n, -1)
        for i in wanted:
            raw = body[:, ends[i] * width : ends[i + 1] * width].reshape(n, -1, width)
            if width == 2:
                values = raw.copy().view("<i2")[..., 0].astype(float)
            else:
                b = raw.astype(np.int32)
                values = (((b[..., 0] | b[..., 1] << 8 | b[..., 2] << 16) << 8) >> 8).astype(float)
            scale = (h["phys_max"][i] - h["phys_min"][i]) / (h["dig_max"][i] - h["dig_min"][i])
            values = (values - h["dig_min"][i]) * scale + h["phys_min"][i]
            for r in range(n):
                yield h, i, at + r, values[r]


class EdfReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int = TASK_BYTES) -> None:
        self.path, self.task_bytes = path, task_bytes
        self.channels: set | None = None
        self.recordings: set | None = None
        self.first, self.last = 0, None

    def pushFilters(self, filters):
        for f in filters:
            name, value = f.attribute, getattr(f, "value", None)
            known = {value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name == ("channel",) and known is not None:
                self.channels = known if self.channels is None else self.channels & known
            elif name == ("recording",) and known is not None:
                self.recordings = known if self.recordings is None else self.recordings & known
            elif name == ("record",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.last = end if self.last is None else min(self.last, end)
            else:
                yield f

    def partitions(self) -> list[FileRange]:
        store, root = pafs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        wanted = [f for f in found if f.is_file and f.path.lower().endswith(SUFFIXES) and not f.base_name.startswith(("_", ".")) and (self.recordings is None or f.base_name.rsplit(".", 1)[0] in self.recordings)]
        step = max(self.task_bytes, min(TASK_BYTES, -(-sum(f.size for f in wanted) // TASKS)))  # short ranges of many bytes would be mostly overhead
        return [FileRange(f.path, f.size, lo, min(lo + step, f.size)) for f in sorted(wanted, key=lambda f: f.path) for lo in range(0, f.size, step)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        name = partition.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        names, held, bytes_held = [p.split()[0] for p in SCHEMA.split(", ")], [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*held))
            types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        with store.open_input_file(partition.path) as opened:
            for h, i, record, x in read_range(opened, partition, self.channels, self.first, self.last):
                held.append((name, h["label"][i], i, h["samples"][i] / h["record_s"], record, record * h["samples"][i], x))
                bytes_held += x.nbytes
                if bytes_held > HELD_BYTES:
                    yield batch()
                    held, bytes_held = [], 0
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    moves: list


class EdfWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator) -> Written:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        moves, now, out = [], None, None
        for row in iterator:
            if row["recording"] != now:
                if out is not None:
                    out.close()
                now = row["recording"]
                moves.append((f"{root}/_temporary/{uuid.uuid4().hex}", f"{root}/{now}.edf"))
                out = store.open_output_stream(moves[-1][0])
            out.write(row["payload"])
        if out is not None:
            out.close()
        return Written(moves)

    def commit(self, messages) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        moves = [m for message in messages if message is not None for m in message.moves]
        if len({to for _, to in moves}) < len(moves):
            raise ValueError("a recording's rows came in several tasks: place them with edf_payloads")
        for source, to in moves:
            store.move(source, to)
        store.delete_dir(f"{root}/_temporary")

    def abort(self, messages) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for source, _ in message.moves if message is not None else ():
                store.delete_file(source)


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voltaflow-edf"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        """Make the source known to the session; filters of Python sources are pushed from here on."""
        cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner's worker needs no package then
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(cls)

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> EdfReader:
        return EdfReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> EdfWriter:
        return EdfWriter(self.options["path"])


def read_recordings(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    EdfSource.register(spark)
    return spark.read.format(EdfSource.name()).option("task_bytes", task_bytes).load(path)


def edf_payloads(signal: DataFrame, fs: int) -> DataFrame:
    """recording, seq, payload of EDF files with records of one second, from signal (recording, channel, sample, x), placed for writing.

    Values are in microvolts. Channels are in the order of their names; a channel's range is that of its values, one
    microvolt at least; what a channel lacks is 0.
    """
    low, high = -32767, 32767
    peaks = signal.groupBy("recording", "channel").agg(F.max(F.abs("x")).alias("top"), F.max("sample").alias("end"))
    limit = F.greatest(F.col("top"), F.lit(1.0))
    shown = F.when(limit < 9999.99, F.format_string("%.2f", F.ceil(limit * 100) / 100.0)).when(limit < 9999999, F.ceil(limit).cast("string")).otherwise(F.format_string("%.1e", limit * 1.1))
    peaks = peaks.select("recording", F.struct("channel", shown.alias("limit")).alias("c"), "end")
    # a recording has as many rows here as channels
    heads = peaks.groupBy("recording").agg(F.array_sort(F.collect_list("c")).alias("cs"), (F.floor(F.max("end") / fs) + 1).alias("n_records"))
    field = lambda value, width: F.rpad(F.substring(value, 1, width), width, " ")
    each = lambda make: F.array_join(F.transform("cs", make), "")
    same = lambda value, width: each(lambda c: field(F.lit(value), width))
    n = F.size("cs")
    head = F.concat(
        field(F.lit("0"), 8), field(F.lit(""), 160), field(F.lit("01.01.24"), 8), field(F.lit("00.00.00"), 8), field((256 + n * 256).cast("string"), 8), field(F.lit(""), 44), field(F.col("n_records").cast("string"), 8),
        field(F.lit("1"), 8), field(n.cast("string"), 4), each(lambda c: field(c["channel"], 16)), same("", 80), same("uV", 8), each(lambda c: field(F.concat(F.lit("-"), c["limit"]), 8)),
        each(lambda c: field(c["limit"], 8)), same(str(low), 8), same(str(high), 8), same("", 80), same(str(fs), 8), same("", 32),
    )
    header = heads.select("recording", F.lit(-1).cast("long").alias("seq"), F.encode(head, "ISO-8859-1").alias("payload"))
    records = heads.select("recording", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1)).alias("seq"), F.posexplode("cs").alias("i", "c"))
    have = signal.groupBy("recording", "channel", F.floor(F.col("sample") / fs).alias("seq")).agg(F.collect_list(F.struct((F.col("sample") % fs).alias("at"), "x")).alias("v"))
    records = records.select("recording", "seq", "i", F.col("c.channel").alias("channel"), F.col("c.limit").cast("double").alias("limit")).join(have, ["recording", "channel", "seq"], "left")
    numbers = F.map_from_entries(F.transform("v", lambda p: F.struct(p["at"], F.rint(p["x"] / F.col("limit") * high).cast("int"))))
    digital = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(fs - 1).cast("long")), lambda k: F.least(F.greatest(F.coalesce(numbers[k], F.lit(0)), F.lit(low)), F.lit(high)))
    spelled = F.array_join(F.transform(digital, lambda d: F.concat(F.lpad(F.hex(F.pmod(d, F.lit(256))), 2, "0"), F.lpad(F.hex(F.pmod(F.floor(d / 256), F.lit(256))), 2, "0"))), "")
    body = records.groupBy("recording", "seq").agg(F.array_sort(F.collect_list(F.struct("i", F.unhex(F.when(F.col("v").isNull(), F.repeat(F.lit("0000"), fs)).otherwise(spelled)).alias("b")))).alias("bs"))
    body = body.select("recording", "seq", F.unhex(F.array_join(F.transform("bs", lambda b: F.hex(b["b"])), "")).alias("payload"))
    return header.unionByName(body).repartition("recording").sortWithinPartitions("recording", "seq")


def write_recordings(signal: DataFrame, path: str, fs: int) -> None:
    """One EDF file for each recording of signal (recording, channel, sample, x)."""
    EdfSource.register(signal.sparkSession)
    edf_payloads(signal, fs).write.format(EdfSource.name()).mode("append").save(path)


def stretch_resampler(up: int, down: int, half: int, size: int, halo: int, fs: float, target_fs: float):
    """A function of grouped rows: the output samples of one stretch of a channel, from its blocks and those around it."""
    from ..functions import kernels as K

    def run(key, rows):
        recording, channel, ch_idx, stretch = (k.as_py() for k in key)
        starts = rows["start_sample"].to_numpy()
        order = np.argsort(starts, kind="stable")
        x = np.concatenate([np.asarray(rows["x"][int(i)].values) for i in order])
        lo = max(0, stretch * size - halo)
        x = x[lo - int(starts[order[0]]) :][: stretch * size + size + halo - lo]
        mine = max(0, min(size, len(x) - (stretch * size - lo)))  # input samples of this stretch
        skip = (stretch * size - lo) * up // down
        y = K.resample(x, up, down, half)[skip:][: -(-mine * up // down)]
        columns = {"recording": [recording], "channel": [channel], "ch_idx": pa.array([ch_idx], pa.int32()), "fs": [target_fs], "native_fs": [fs], "start_sample": pa.array([stretch * size * up // down], pa.int64()), "x": pa.array([y], pa.list_(pa.float64()))}
        return pa.table(columns).slice(0, int(len(y) > 0))

    return run


def resampled(blocks: DataFrame, target_fs: float | None = 1000.0, half: int = 10, length: int = 1 << 16) -> DataFrame:
    """recording, channel, ch_idx, fs, native_fs, start_sample, x at the target rate; a target of 0 or none, or a rate that is the target already, leaves it (SRC04).

    A channel is resampled in stretches with as much context as the filter reaches, so a long one is many tasks; stretches
    begin where an output sample falls on an input sample. Rates are a few numbers, each with a plan of its own.
    """
    names, out = ["recording", "channel", "ch_idx", "fs", "native_fs", "start_sample", "x"], None
    for fs in sorted(r.fs for r in blocks.select("fs").distinct().collect()):
        own = blocks.where(F.col("fs") == fs).withColumn("native_fs", F.col("fs"))
        if target_fs is None or target_fs <= 0 or abs(fs - target_fs) <= 1e-8 + 1e-5 * abs(target_fs):
            part = own.select(*names)
        else:
            ratio = Fraction(target_fs / fs).limit_denominator(1000)
            up, down = ratio.numerator, ratio.denominator
            size = math.ceil(length / down) * down
            halo = math.ceil((2 * half * max(up, down) / up + 2) / down) * down
            first, last = F.floor((F.col("start_sample") - halo) / size), F.floor((F.col("start_sample") + F.size("x") - 1 + halo) / size)
            near = own.withColumn("stretch", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
            keys = ["recording", "channel", "ch_idx", "stretch"]
            run = stretch_resampler(up, down, half, size, halo, fs, float(target_fs))
            part = near.select(*keys, "start_sample", "x").groupBy(*keys).applyInArrow(run, "recording string, channel string, ch_idx int, fs double, native_fs double, start_sample long, x array<double>")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else blocks.withColumn("native_fs", F.col("fs")).select(*names)
