"""Recordings: EDF and BDF files through Spark's binary reader, block tables, channel facts (SRC01, SRC03-SRC06)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK, read_range
from .edf_source import parse_header

#: Suffixes that are read here; other formats need a converter to the block table (Parquet).
READABLE = (".edf", ".bdf")


def suffix_reader(path: str) -> str:
    """The reader for a path's suffix: edf for .edf and .bdf, table for .parquet."""
    low = path.lower()
    if low.endswith(READABLE):
        return "edf"
    if low.rstrip("/").endswith(".parquet"):
        return "table"
    raise ValueError(f"no reader for {path!r}")


def decode(data: bytes) -> Iterator[tuple[str, int, float, np.ndarray]]:
    """label, index, rate and physical values of every channel."""
    h = parse_header(data)
    width = 3 if h["wide"] else 2
    per_record = sum(h["samples"])
    body = np.frombuffer(data, np.uint8, offset=h["header_bytes"])
    records = len(body) // (per_record * width)
    body = body[: records * per_record * width].reshape(records, per_record, width)
    if width == 2:
        values = body.copy().view("<i2")[..., 0].astype(float)
    else:
        b = body.astype(np.int32)
        values = (((b[..., 0] | b[..., 1] << 8 | b[..., 2] << 16) << 8) >> 8).astype(float)
    at = 0
    for i, n in enumerate(h["samples"]):
        scale = (h["phys_max"][i] - h["phys_min"][i]) / (h["dig_max"][i] - h["dig_min"][i])
        x = (values[:, at : at + n].reshape(-1) - h["dig_min"][i]) * scale + h["phys_min"][i]
        yield h["label"][i], i, n / h["record_s"], x
        at += n


def read_edf(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """recording, channel, ch_idx, fs, block_id, start_sample, x of EDF and BDF files; a file is read in one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["recording", "channel", "ch_idx", "fs", "block_id", "start_sample", "x"]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for label, i, fs, x in decode(content):
                    starts = range(0, len(x), block)
                    rows = len(starts)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * rows), pa.array([label] * rows), pa.array([i] * rows, pa.int32()), pa.array([fs] * rows), pa.array([s // block for s in starts], pa.int64()),
                        pa.array(list(starts), pa.int64()), pa.array([x[s : s + block] for s in starts], pa.list_(pa.float64())),
                    ], names=names)

    return files.mapInArrow(run, "recording string, channel string, ch_idx int, fs double, block_id long, start_sample long, x array<double>")


def segment(blocks: DataFrame, t0: float, t1: float, fs: float, block: int = BLOCK) -> DataFrame:
    """Samples [round(t0 fs), round(t1 fs)) in microvolts (SRC03)."""
    return read_range(blocks, round(t0 * fs), round(t1 * fs), block).withColumn("x", F.col("x") * 1e6)


def native_rates(channels: DataFrame) -> DataFrame:
    """Rate of each channel from its samples a record, else the file's (SRC06)."""
    return channels.withColumn("native_fs", F.coalesce(F.col("n_samps") / F.col("record_s"), F.col("file_fs")))


def encode_edf(channels: list[tuple[str, np.ndarray]], fs: int) -> bytes:
    """A small EDF file of one-second records, for tests and exports."""
    n, seconds = len(channels), len(channels[0][1]) // fs
    pad = lambda s, w: str(s)[:w].ljust(w).encode("latin-1")
    limit = [max(1.0, float(np.abs(x).max())) for _, x in channels]
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 + n * 256, 8) + pad("", 44) + pad(seconds, 8) + pad(1, 8) + pad(n, 4)
    cols = [[pad(c, 16) for c, _ in channels], [pad("", 80)] * n, [pad("uV", 8)] * n, [pad(f"{-m:.6g}"[:8], 8) for m in limit], [pad(f"{m:.6g}"[:8], 8) for m in limit], [pad(-32767, 8)] * n, [pad(32767, 8)] * n, [pad("", 80)] * n, [pad(fs, 8)] * n, [pad("", 32)] * n]
    head += b"".join(b"".join(c) for c in cols)
    digital = [np.clip(np.round(x / float(f"{m:.6g}"[:8]) * 32767), -32767, 32767).astype("<i2").reshape(seconds, fs) for (_, x), m in zip(channels, limit)]
    return head + b"".join(d[i].tobytes() for i in range(seconds) for d in digital)
