"""Helpers shared by the text operators: shared storage, table reading, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that separates words: space, tab, LF, VT, FF, CR (fixed by the contract).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch: documents can be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small for this session: a batch of long documents must fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of its own only where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir isn't set: executors of {master} share no local folder")
        if "dir" not in _OWN_DIR:
            _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="voltaflow-")
        base = _OWN_DIR["dir"]
    return f"{base.rstrip('/')}/voltaflow-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: work survives lost executors and isn't repeated."""
    path = path or shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for the jobs started inside, restored behind them."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables of one job in the shared folder, removed by name once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        return materialize(self.spark, df, name, path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, ()):
                remove(self.spark, path)


def map_arrow(df: DataFrame, fn: Callable[[dict], dict], schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """Apply fn (column name -> Python list, both ways) to every Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn({name: batch.column(i) for i, name in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in arrow_schema)],
                    schema=arrow_schema,
                )

    return df.mapInArrow(run, schema)


def words_of(text) -> "F.Column":
    """Array of the contract's words of a string column (null: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), "")
