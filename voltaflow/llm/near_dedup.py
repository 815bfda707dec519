"""SimHash near-duplicate classes by pigeonhole blocks (operator 11).

A text's fingerprint has a bit set where over half of its four-word shingles' hashes have it. Two texts are
linked where their fingerprints differ in at most four bits. Fingerprints are cut into six blocks: a linked
pair agrees on two of them at least, so one table for each pair of blocks, keyed by these 21 or 22 bits,
brings every linked pair together; the distance is verified in full.

Copies are one fingerprint. In each table, fingerprints first meet the least one of their key; what that
links is joined into components. A key whose fingerprints are in one component needs no more; in the others,
those of different components are compared, in blocks of a bounded size, and tasks hand back a spanning
forest. So neither pairs of copies nor pairs inside a dense group are ever written.

Defined results: null text counts as empty; texts without words have fingerprint 0 and are linked like any
others; fewer than four words are one shingle; documents without an id take part, and their component is
named by the ids in it (null where there is none); repeated rows are copies; an empty table gives no rows;
long texts count whole; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, map_arrow, table
from .graph import collapse, components
from .ngram_join import BLOCK, blockwise, leads, tasks

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 6
#: Shingles whose bits are counted at once, rows of a block that are compared at once.
STEP, ROWS = 1 << 15, 256


def fingerprint(text: str | None) -> int:
    """64 bits: those set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(first), STEP):
        h = [xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(first[lo : lo + STEP], last[lo : lo + STEP])]
        counts += np.unpackbits(np.frombuffer(b"".join(h), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed long) of docs (doc_id, text)."""

    def run(batch: dict) -> dict:
        fps = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64)
        return {"doc_id": batch["doc_id"], "fp": fps.view(np.int64)}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long", pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Signed masks of the tables: one for each choice of the blocks - radius blocks that a close pair shares."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(ends, ends[1:])]
    every = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def strangers(radius: int) -> Callable:
    """solve() of blockwise for (fp, comp): a forest over the close pairs of different components."""

    def solve(one: list[list], other: list[list] | None) -> tuple:
        own = other is None
        (fp_a, comp_a), (fp_b, comp_b) = ([np.array(c, np.int64) for c in side] for side in (one, one if own else other))
        links = np.empty((len(fp_a), len(fp_b)), bool)
        for lo in range(0, len(fp_a), ROWS):
            part = slice(lo, lo + ROWS)
            links[part] = (np.bitwise_count((fp_a[part, None] ^ fp_b).view(np.uint64)) <= radius) & (comp_a[part, None] != comp_b)
        lead_a, lead_b = leads(links, own)
        fps = fp_a if own else np.concatenate([fp_a, fp_b])
        lead = lead_a if own else np.concatenate([lead_a, lead_b])
        kept = lead != np.arange(len(fps))
        return fps[kept], fps[lead[kept]]

    return solve


def linked(spark: SparkSession, scratch: Scratch, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """node, comp: components of the distinct fingerprints fps (fp) under links within the radius; lone ones have no row."""
    keys = F.transform(F.lit(block_masks(radius, blocks)).cast("array<bigint>"), lambda m, t: F.struct(t.alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
    held = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    shared = scratch.write(held.groupBy("t", "k").agg(F.min("fp").alias("lead"), F.count("*").alias("n")).where("n > 1"), "shared")
    # both sides grow with the corpus: neither is broadcast, however small it is here
    star = scratch.write(held.join(shared.hint("merge"), ["t", "k"]).where("fp <> lead").withColumn("close", F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= radius), "star")
    near = star.where("close").select(F.col("fp").alias("u"), F.col("lead").alias("v")).distinct()
    labels = components(spark, collapse(near))
    loose = star.join(star.where("n > 2 and not close").select("t", "k").distinct().hint("merge"), ["t", "k"], "left_semi")
    loose = loose.select("t", "k", "fp").unionByName(loose.select("t", "k", F.col("lead").alias("fp")).distinct())
    loose = loose.join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    # groups whose numbers collide are compared together, which costs comparisons and changes no link
    loose = scratch.write(loose.select(F.xxhash64("t", "k").alias("band"), "fp", F.coalesce("comp", "fp").alias("comp")), "loose")
    sizes = loose.groupBy("band").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    sizes = scratch.write(sizes.select("band", F.ceil(F.col("n") / BLOCK).alias("blocks")), "sizes")
    found = scratch.write(blockwise(loose, "band", ["fp", "comp"], sizes, strangers(radius), "u long, v long", tasks(spark)), "found")
    scratch.drop("shared", "star", "loose", "sizes")
    return components(spark, labels.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(found))


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text)."""
    bounded_batches(spark)
    scratch = Scratch(spark)
    named = scratch.write(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "fingerprints")
    distinct = scratch.write(named.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    labels = linked(spark, scratch, distinct.select("fp"), radius, blocks)
    placed = scratch.write(distinct.join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first_doc", F.coalesce("comp", "fp").alias("comp")), "placed")
    firsts = scratch.write(placed.groupBy("comp").agg(F.min("first_doc").alias("component_id")), "firsts")
    # written before it is joined with all documents: a join of two plain shuffles can split a fingerprint of many copies
    known = scratch.write(placed.join(firsts.hint("merge"), "comp").select("fp", "component_id"), "known")
    scratch.drop("distinct", "placed", "firsts", "found")
    return named.join(known.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
