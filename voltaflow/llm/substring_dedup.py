"""Substring dedup on a log-structured fingerprint index (operator 2).

A word is removed if a window of 50 words over it also starts in a document with a smaller id. Windows
are indexed in chunks: the 12-word shingles of a window have a least hash, its anchor; neighbouring
windows with the same anchor are one chunk, so about one row stands for twenty windows, and equal
windows always have equal anchors. The index is a list of immutable runs, each bucketed and sorted by
(anchor, digest of the chunk's words), holding the chunks that earlier runs don't have, with the first
document of each. A batch (documents with larger ids than all before) is merge-joined with the runs.
Equal chunks hold equal windows; where an anchor of the batch has several chunks (the borders of shared
passages) their windows are read from the first documents' texts, hashed whole in 128 bits and compared.
Beyond RUNS runs they are compacted into one; the query adds BATCHES batches, so it compacts once.

Verification is by digest: an anchor (64 bits over 12 words) is never trusted alone, the chunk's digest
(64 bits over all of its words, from another lane of word hashes) or, for windows, both lanes must agree.
Words themselves aren't compared: that would ship each repeated passage once for each of its copies.

Defined results: null text has no words; texts of fewer than 50 words stay; null ids neither match nor
remove; repeated rows and ids don't remove each other (their id isn't smaller); windows are judged on
the input; an empty table gives no rows; long texts count whole; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, map_arrow, materialize, remove, settings, shared_path, table
from .graph import release
from .ngram_join import mix

WINDOW, SHINGLE, BATCHES, RUNS = 50, 12, 6, 4
SPAN = WINDOW - SHINGLE + 1
ROOTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def powers(root: int, n: int) -> np.ndarray:
    """root to the powers 0 .. n - 1, modulo 2 to the 64."""
    have = _POWERS.get(root)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 15), root, np.uint64)
        factors[0] = 1
        have = _POWERS[root] = np.multiply.accumulate(factors)
    return have[:n]


class Words:
    """Rolling hashes of a text's words: any range of words in constant time, in two independent lanes."""

    def __init__(self, text: str | None) -> None:
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        n = self.n = len(self.words)
        pair = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), np.uint64).reshape(n, 2)
        self.sums, self.back = [], []
        for lane, root in enumerate(ROOTS):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(pair[:, lane] * powers(root, n), out=sums[1:])
            self.sums.append(sums)
            self.back.append(powers(pow(root, -1, 1 << 64), n + 1))

    def hashes(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mix((self.sums[lane][end] - self.sums[lane][start]) * self.back[lane][start] + size * np.uint64(0xA24BAED4963EE407))

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor, digest, first window and number of windows of every chunk."""
        windows = self.n - WINDOW + 1
        if windows < 1:
            none = np.empty(0, np.int64)
            return none, none, none, none
        at = np.arange(self.n - SHINGLE + 1)
        grams = self.hashes(0, at, at + SHINGLE)
        least = sliding_window_view(grams, SPAN).argmin(1) + np.arange(windows)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        size = np.diff(np.r_[first, windows])
        digest = self.hashes(1, first, first + size + WINDOW - 1)
        return grams[least[first]].view(np.int64), digest.view(np.int64), first, size

    def windows(self, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(first, first + size)
        return self.hashes(0, at, at + WINDOW).view(np.int64), self.hashes(1, at, at + WINDOW).view(np.int64)


def kept_words(text: str | None, marks: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """Number of words and the words outside of all marked windows; marks: first window, bits of windows."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not marks:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    for first, bits in marks:
        at = first
        while bits:
            skip = (bits & -bits).bit_length() - 1
            at, bits = at + skip, bits >> skip
            run = (~bits & bits + 1).bit_length() - 1  # ones in a row
            edge[at] += 1
            edge[at + run + WINDOW - 1] -= 1
            at, bits = at + run, bits >> run
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), [w for w, g in zip(words, gone.tolist()) if not g]


def fingerprint(docs: DataFrame) -> DataFrame:
    """Chunks of documents (key, th, text): anchor, digest, key, th, first, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "key", "th", "first", "size"]
        for batch in batches:
            parts, counts = [], []
            for text in batch.column(2).to_pylist():
                found = Words(text).chunks()
                parts.append(found)
                counts.append(len(found[0]))
            if not sum(counts):
                continue
            anchor, digest, first, size = (np.concatenate(x) for x in zip(*parts))
            key, th = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digest), pa.array(key), pa.array(th), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))], names=names)

    return docs.mapInArrow(run, "anchor long, digest long, key long, th long, first int, size int")


def chunk_windows(wanted: DataFrame) -> DataFrame:
    """Windows of the wanted chunks of documents (first_doc, text, chunks: anchor and digest): anchor, digest, first_doc, j, w0, w1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "first_doc", "j", "w0", "w1"]
        for batch in batches:
            out = []
            for key, text, chunks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                asked, words = {(c["anchor"], c["digest"]) for c in chunks}, Words(text)
                for a, d, first, size in zip(*(x.tolist() for x in words.chunks())):
                    if (a, d) in asked:
                        asked.discard((a, d))
                        w0, w1 = words.windows(first, size)
                        out.append((np.full(size, a), np.full(size, d), np.full(size, key), np.arange(size, dtype=np.int32), w0, w1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

    return wanted.mapInArrow(run, "anchor long, digest long, first_doc long, j int, w0 long, w1 long")


class FingerprintIndex:
    """Sorted immutable runs of chunk fingerprints: tables bucketed by anchor, one sorted file a bucket, in the shared folder.

    Use it in a with statement, or close() it: its tables go then. A batch's own classes are bucketed alike, so a merge
    join with a run shuffles neither side; what a batch costs beyond reading the runs' keys is in proportion to the batch
    and to the chunks that share an anchor with it.
    """

    SORTED = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}
    #: Texts of history are read by key through a Bloom filter that Spark bounds at 8 MB, whatever the number of keys.
    FILTERED = {"spark__sql__optimizer__runtime__bloomFilter__enabled": "true", "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0", "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1TB"}

    def __init__(self, spark: SparkSession, runs: int = RUNS, buckets: int | None = None) -> None:
        self.spark, self.limit, self.runs, self.compactions = spark, runs, [], 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def __enter__(self) -> "FingerprintIndex":
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def _write(self, rows: DataFrame) -> str:
        name, path = f"voltaflow_run_{uuid.uuid4().hex}", shared_path(self.spark, "run")
        placed = rows.repartition(self.buckets, "anchor")
        placed.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor", "digest").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        self._drop(*self.paths)
        self.runs = []

    def compact(self) -> None:
        """One run instead of many; the old ones go when the new one is written."""
        if len(self.runs) > 1:
            old, rows = self.runs, None
            for name in old:
                rows = self.spark.table(name) if rows is None else rows.unionByName(self.spark.table(name))
            self.runs = [self._write(rows)]
            self.compactions += 1
            self._drop(*old)

    def history(self, own: str) -> DataFrame | None:
        """Rows (anchor, digest, first_doc) of all runs with an anchor of the bucketed table `own`."""
        out = None
        for name in self.runs:
            found = self.spark.table(name).join(self.spark.table(own).select("anchor").hint("merge"), "anchor", "left_semi")
            out = found if out is None else out.unionByName(found)
        return out

    def add(self, batch: DataFrame, documents: DataFrame) -> DataFrame:
        """Marks (key, th, first, bits) of the batch's windows that start in a document with a smaller id, then the batch's run is added.

        batch: key, th, text, ids larger than those of all earlier batches; documents: key and text of all batches so far.
        """
        spark, scratch = self.spark, Scratch(self.spark)
        chunks = scratch.write(fingerprint(batch), "chunks")
        own = self._write(chunks.groupBy("anchor", "digest").agg(F.min("key").alias("own_first"), F.max("key").alias("own_last")))
        none = F.lit(None).cast("long")
        classes = spark.table(own).select("anchor", "digest", "own_first", "own_last", none.alias("old_first"))
        with settings(spark, **self.SORTED):
            old = self.history(own)
            if old is not None:
                old = old.select("anchor", "digest", none.alias("own_first"), none.alias("own_last"), F.col("first_doc").alias("old_first"))
                classes = classes.unionByName(old).groupBy("anchor", "digest").agg(F.min("own_first").alias("own_first"), F.max("own_last").alias("own_last"), F.min("old_first").alias("old_first"))
            # digests of the batch, and digests of history for the batch's anchors (own_first is null)
            classes = scratch.write(classes.withColumn("first_doc", F.coalesce("old_first", "own_first")), "classes")
        self.runs.append(self._write(classes.where("own_first is not null and old_first is null").select("anchor", "digest", "first_doc")))
        self._drop(own)
        release(spark)
        several = scratch.write(classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
        todo = classes.where("own_first is not null").join(several.withColumn("several", F.lit(True)).hint("merge"), "anchor", "left")
        todo = todo.where("several or own_last > first_doc").select("anchor", "digest", "first_doc")
        wanted = classes.join(several.hint("merge"), "anchor", "left_semi").groupBy("first_doc").agg(F.collect_list(F.struct("anchor", "digest")).alias("chunks"))
        wanted = scratch.write(wanted, "wanted").where(F.col("first_doc") >= -(1 << 63))  # a predicate makes Spark plan the filter
        with settings(spark, **self.FILTERED):
            texts = documents.join(wanted.hint("merge"), documents.key == wanted.first_doc).select("first_doc", "text", "chunks")
            windows = scratch.write(chunk_windows(texts), "windows")
        release(spark)
        least = windows.groupBy("w0", "w1").agg(F.min("first_doc").alias("least"), F.max("first_doc").alias("most")).where("least < most")
        late = windows.join(least, ["w0", "w1"]).where("least < first_doc")
        bits = late.select("anchor", "digest", "j").distinct().groupBy("anchor", "digest").agg(F.sum(F.expr("shiftleft(1L, j)")).alias("bits"))
        verdict = todo.join(bits, ["anchor", "digest"], "left").select("anchor", "digest", "first_doc", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        # written first, so that both sides of the join are plain shuffles, whose skewed partitions Spark can split
        verdict = scratch.write(verdict, "verdict")
        whole = F.expr("shiftleft(1L, size) - 1")
        marks = chunks.join(verdict, ["anchor", "digest"]).where("key > first_doc or bits <> 0")
        marks = marks.select("key", "th", "first", F.when(F.col("key") > F.col("first_doc"), whole).otherwise(F.col("bits")).alias("bits"))
        out = materialize(spark, marks, "marks")
        scratch.drop(*scratch.paths)
        release(spark)
        if len(self.runs) > self.limit:
            self.compact()
        return out


def apply_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs (key, th, text and others) with n_words, n_removed and kept (the words left, joined by one space)."""
    # repeated rows mark the same words: a document's marks come once, and no more than its windows
    per_doc = marks.distinct().groupBy("key", "th").agg(F.collect_list(F.struct("first", "bits")).alias("marks"))
    per_doc = materialize(docs.sparkSession, per_doc, "marks_of")
    joined = docs.join(per_doc.hint("merge"), ["key", "th"], "left")

    def run(batch: dict) -> dict:
        n, removed, kept = [], [], []
        for text, found in zip(batch["text"].to_pylist(), batch["marks"].to_pylist()):
            total, words = kept_words(text, [(m["first"], m["bits"]) for m in found or ()])
            n.append(total)
            removed.append(total - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return {"row": batch["row"], "n_words": n, "n_removed": removed, "kept": kept}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    src = joined.select(F.struct(*docs.columns).alias("row"), "text", "marks")
    schema = StructType([src.schema["row"]]).add("n_words", LongType()).add("n_removed", LongType()).add("kept", StringType())
    return map_arrow(src, run, schema, to_arrow_schema(schema)).select("row.*", "n_words", "n_removed", "kept")


def dedup(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, carry: tuple[str, ...] = (), runs: int = RUNS) -> DataFrame:
    """key, the carried columns, text, n_words, n_removed, kept; documents are indexed in batches of rising ids."""
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("text"), *(F.col(f"`{c}`").alias(f"c_{c}") for c in carry))
    cuts = rows.agg(F.percentile_approx("key", [(i + 1) / batches for i in range(batches - 1)] or [1.0], 10_000)).collect()[0][0]
    ends = sorted(set(cuts or [])) if batches > 1 else []
    marks, low = None, None
    with FingerprintIndex(spark, runs) as index:
        for high in [*ends, None]:
            part = rows.select("key", "th", "text").where(F.col("key").isNotNull())
            so_far = part.select("key", "text") if high is None else part.select("key", "text").where(F.col("key") <= high)
            part = part if low is None else part.where(F.col("key") > low)
            part = part if high is None else part.where(F.col("key") <= high)
            found = index.add(part, so_far)
            marks, low = found if marks is None else marks.unionByName(found), high
    out = apply_marks(rows, marks)
    return out.select(F.col("key").alias(key), *(F.col(f"c_{c}").alias(c) for c in carry), F.col("text").alias(text), "n_words", "n_removed", "kept")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those removed, and the digest of those kept."""
    out = dedup(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), m AS (SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h),
r AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM g JOIN m USING (h) WHERE first_doc < doc_id),
k AS (
  SELECT rid, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n_kept
  FROM (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN r USING (rid, p) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rid)
"""
