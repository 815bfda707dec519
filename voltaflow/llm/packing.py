"""Sequence packing by minimum bin slack (operator 5).

A document's tokens are cut at multiples of the capacity; full pieces are sequences of their own.
What remains of the documents is packed by length: how many remainders there are of each length is
all that matters, and there are fewer lengths than the capacity, so the driver plans on that bounded
histogram. A window opens with the longest remainder; a subset-sum over bitsets (one integer, bit s
set if sum s can be reached, counts split in powers of two) finds the multiset of other lengths that
fills it closest to capacity, and back-tracking gives its counts. The same window is used as often
as the histogram allows. If a window can't be filled, a remainder is cut to fill it. Ranks within a
length then give each document its place; ranks are made per shard and shifted, so no length, however
common, gathers in one task.

Defined results: null text counts as empty; an empty document has the one end id; repeated rows are
packed each; a long document gives many pieces; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import greatest_id, loaded
from .common import bounded_batches, map_arrow, materialize, table

CAPACITY, END_ID, SHARD_ROWS = 2048, 1, 500_000
#: Cut pieces (about 100 bytes each) up to which they are sent to the tasks that hold the ids, not joined by a shuffle.
BROADCAST_CUTS = 20_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths (length -> how many, within counts) with the greatest sum up to room."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length) if length <= room else 0, 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, part = left - take, 2 * part
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, cut from, piece length, first sequence, per sequence, offset, shift) and the number of sequences.

    Of the remainders of that length, rank r in [first, end) has j = r - first + shift and puts its piece
    [cut from, cut from + piece length) into sequence `first sequence + j // per sequence`, at `offset +
    j % per sequence * piece length`. Only windows at the very end may stay short of the capacity.
    """
    #: piece length -> blocks [origin length, first rank, end rank, cut from]; a cut's rest is a block like any other
    blocks: dict[int, list[list[int]]] = {n: [[n, 0, c, 0]] for n, c in histogram.items() if n > 0 and c > 0}
    counts = {n: b[0][2] for n, b in blocks.items()}
    rows: list[tuple] = []
    sequence = 0

    def take(length: int, many: int) -> list[list[int]]:
        out, queue = [], blocks[length]
        while many:
            origin, lo, hi, start = queue[-1]
            n = min(many, hi - lo)
            out.append([origin, lo, lo + n, start])
            many -= n
            queue[-1][1] += n
            if queue[-1][1] == hi:
                queue.pop()
        counts[length] -= sum(x[2] - x[1] for x in out)
        if not counts[length]:
            del counts[length], blocks[length]
        return out

    def place(taken: list[list[int]], length: int, per: int, offset: int) -> None:
        shift = 0
        for origin, lo, hi, start in taken:
            rows.append((origin, lo, hi, start, length, sequence, per, offset, shift))
            shift += hi - lo

    while counts:
        longest = max(counts)
        counts[longest] -= 1
        window = fill({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        slack = capacity - sum(n * m for n, m in window.items())
        times = min(counts[n] // m for n, m in window.items())
        left = {n: c - window.get(n, 0) for n, c in counts.items() if c > window.get(n, 0)}
        to_cut = max(left, default=0) if slack else 0
        if to_cut:  # longer than the slack, or the window would hold it
            times = min(times, counts[to_cut] // (window.get(to_cut, 0) + 1))
        offset = 0
        for length, many in sorted(window.items(), reverse=True):
            place(take(length, many * times), length, many, offset)
            offset += many * length
        if to_cut:
            taken = take(to_cut, times)
            place(taken, slack, 1, offset)
            rest = to_cut - slack
            blocks.setdefault(rest, []).extend([o, lo, hi, start + slack] for o, lo, hi, start in taken)
            counts[rest] = counts.get(rest, 0) + times
        sequence += times
    return rows, sequence


def pieces_of(ids: list[bytes], capacity: int = CAPACITY, small_ids: bool = False) -> dict:
    """For each document's ids (little-endian unsigned 32-bit): their number, checksums of full pieces and of the rest, and the rest's ids."""
    n, crcs, rest, rest_ids = [], [], [], []
    for raw in ids:
        full = len(raw) // 4 // capacity
        left = raw[4 * capacity * full :]
        n.append(len(raw) // 4)
        crcs.append([zlib.crc32(raw[4 * capacity * i : 4 * capacity * (i + 1)]) for i in range(full)])
        rest.append(zlib.crc32(left))
        values = np.frombuffer(left, "<u4")
        if small_ids and len(values) and values.max() > 0xFFFF:
            raise ValueError(f"id {values.max()} doesn't fit 16 bits: small_ids is for up to 65,536 ids")
        rest_ids.append(values.astype("<u2").tobytes() if small_ids else left)
    return {"doc_tokens": n, "crcs": crcs, "rest": rest, "rest_ids": rest_ids}


PIECES = "key long, doc_tokens long, crcs array<long>, rest long, rest_ids binary"
PIECES_ARROW = pa.schema([("key", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest", pa.int64()), ("rest_ids", pa.binary())])


def pack_texts(spark: SparkSession, docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack: texts become ids, an end id behind each, and these pieces, in one pass of Python."""
    bounded_batches(spark)
    with open(tokenizer_path, "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())
    end, small_ids = np.array([END_ID], "<u4").tobytes(), greatest_id(definition.value) <= 0xFFFF

    def run(batch: dict) -> dict:
        bpe = loaded(tokenizer_path, definition)
        return {"key": batch["key"]} | pieces_of([bpe.encode(t) + end for t in batch["text"].to_pylist()], capacity, small_ids)

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return pack_pieces(spark, map_arrow(src, run, PIECES, PIECES_ARROW), key, capacity, small_ids)


def pack(spark: SparkSession, ids: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, small_ids: bool = False) -> DataFrame:
    """Pack documents whose ids are in the binary column `ids`; with small_ids, 16 bits are kept of each, and a greater id is an error."""
    bounded_batches(spark)

    def run(batch: dict) -> dict:
        return {"key": batch["key"]} | pieces_of(batch["ids"].to_pylist(), capacity, small_ids)

    src = ids.select(F.col(key).cast("long").alias("key"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return pack_pieces(spark, map_arrow(src, run, PIECES, PIECES_ARROW), key, capacity, small_ids)


def pack_pieces(spark: SparkSession, pieces: DataFrame, key: str, capacity: int = CAPACITY, small_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A cut remainder's checksums need its ids, so each document keeps the ids of its remainder until the plan is made.
    """
    stored = materialize(spark, pieces, "pack")
    lens = stored.select("key", "doc_tokens", "crcs", "rest", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    lens = lens.withColumn("rem", (F.col("doc_tokens") % capacity).cast("int")).withColumn("full", F.col("doc_tokens").cast("long") / capacity)
    lens = lens.withColumn("full", F.floor("full"))

    # at most `capacity` rows reach the driver, whatever the table's size
    found = sorted((r.rem, r.n, r.full) for r in lens.groupBy("rem").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect())
    total = sum(n for _, n, _ in found)
    rows, sequences = plan({r: n for r, n, _ in found if r}, capacity)
    base, before = [], sequences
    for rem, _, full in found:
        base.append((rem, before))
        before += full
    # further work is keyed by (rem, shard): shards hold SHARD_ROWS rows of all lengths together
    shards = max(16, -(-total // SHARD_ROWS))
    lens = lens.withColumn("shard", F.pmod(F.xxhash64("key", "file", "row"), F.lit(shards)).cast("int"))
    shard_sizes = lens.groupBy("rem", "shard").agg(F.count("*").alias("n"), F.sum("full").alias("nf"))
    earlier = Window.partitionBy("rem").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = shard_sizes.select("rem", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank0"), F.coalesce(F.sum("nf").over(earlier), F.lit(0)).alias("full0"))
    within = Window.partitionBy("rem", "shard").orderBy("key", "file", "row")
    ranked = lens.withColumns({"r": F.row_number().over(within) - 1, "f": F.coalesce(F.sum("full").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranked = ranked.join(shifts, ["rem", "shard"]).join(F.broadcast(spark.createDataFrame(base or [(0, 0)], "rem int, base long")), "rem")
    ranked = ranked.withColumns({"rank": F.col("r") + F.col("rank0"), "first": F.col("base") + F.col("full0") + F.col("f")})

    whole = ranked.where("full > 0").select("key", "doc_tokens", "first", F.posexplode("crcs").alias("i", "ids_crc32"))
    whole = whole.select(F.col("key").alias(key), (F.col("i").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # the plan's size depends on the capacity, not on the table: a window repeats until one of its lengths is used up
    fixed = spark.createDataFrame(rows or [(0, 0, 0, 0, 0, 0, 1, 0, 0)], "p_rem int, r0 long, r1 long, cut long, piece long, seq long, per long, off long, shift long")
    rest = ranked.where("rem > 0").join(F.broadcast(fixed), (F.col("rem") == F.col("p_rem")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    rest = rest.withColumn("j", F.col("rank") - F.col("r0") + F.col("shift")).select(
        F.col("key").alias(key), "file", "row", "doc_tokens", "rest", "cut", (F.col("piece") != F.col("rem")).alias("is_cut"),
        F.col("piece").alias("length"),
        (F.col("full") * capacity + F.col("cut")).alias("start"),
        (F.col("seq") + F.floor(F.col("j") / F.col("per"))).alias("sequence_id"),
        (F.col("off") + (F.col("j") % F.col("per")) * F.col("piece")).alias("offset"),
    )
    cols = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = whole.unionByName(rest.where("not is_cut").withColumnRenamed("rest", "ids_crc32").select(*cols))
    n_cut = sum(r[2] - r[1] for r in rows if r[4] != r[0])
    if n_cut:
        texts = stored.select("rest_ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        bits = rest.where("is_cut")
        bits = F.broadcast(bits) if n_cut <= BROADCAST_CUTS else bits  # the plan knows how many there are
        bits = texts.join(bits, ["file", "row"]).select(*(c for c in cols if c != "ids_crc32"), "rest_ids", "cut")
        fields = [(c, pa.int64()) for c in cols]

        def checksum(batch: dict) -> dict:
            values = zip(*(batch[c].to_pylist() for c in ("rest_ids", "cut", "length")))
            kind = "<u2" if small_ids else "<u4"
            return batch | {"ids_crc32": [zlib.crc32(np.frombuffer(raw, kind)[a : a + n].astype("<u4").tobytes()) for raw, a, n in values]}

        out = out.unionByName(map_arrow(bits, checksum, ", ".join(f"{c} long" for c in cols), pa.schema(fields)))
    return out


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_texts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
