"""Document fingerprints by SimHash, searched in permuted block tables (operator 7); DataFrame functions only.

Terms are pairs of neighbouring words (the first word pairs with nothing), weighted by how often they
occur. Each term's 64-bit hash votes on every bit; two counters share one long, so 32 sums carry all
64 votes. A fingerprint within the radius of another agrees with it on at least blocks - radius of the
blocks; one table per choice of so many blocks, keyed by them, finds every such fingerprint, and a pair
counts in the first table that holds it.

The query's search has a wider radius, chosen by its recall on near copies at five-word Jaccard 0.8, and
gives the matches themselves; documents of equal fingerprints are one class, named by the fingerprint.

Defined results: null text counts as empty; a text without words has fingerprint 0; documents without
an id come last, ties are ordered by text; the only document is its own next one; an empty table gives
no rows; long texts count whole; other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chat import let
from .common import materialize, table, words_of

RADIUS, BLOCKS, CHUNK, QUERY_STEP = 3, 6, 1024, 20
#: Radius of the query's search, and its blocks: one of them differs in at most radius // blocks bits.
WIDE, WIDE_BLOCKS = 11, 4
LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """Array of the hashes of all terms, repeats included."""

    def pairs(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(F.when(i > 0, F.element_at(h, F.greatest(i, F.lit(1)))).otherwise(0), x))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), pairs)


def votes(term: str) -> list[Column]:
    """Sums of the votes: the j-th holds bit j in its low half and bit j + 32 in its high half."""
    return [F.sum(F.shiftrightunsigned(term, j).bitwiseAND(F.lit(LANES))).alias(f"v{j}") for j in range(32)]


def decide(n: str) -> Column:
    """The fingerprint: bits that more than half of the weight votes for."""
    out = F.lit(0).cast("long")
    for j in range(32):
        v = F.coalesce(F.col(f"v{j}"), F.lit(0).cast("long"))
        for bit, count in ((j, v.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(v, 32))):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(2 * count > F.col(n), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, keys: list[str], term: str = "terms") -> DataFrame:
    """keys and fp of rows that hold an array of term hashes; rows are already placed by their keys."""
    each = rows.select(*keys, F.explode_outer(term).alias("h"))
    voted = each.groupBy(*keys).agg(F.count("h").alias("n"), *votes("h"))
    return voted.select(*keys, decide("n").alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def spell(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges of doc_id: bucket, rn, halo, doc_id, text, next_text.

    Ranges end at ids found by percentiles, so that they are even. The document that ends a range also
    comes, as `halo`, behind the last document of the range above it, whose next document it is; the
    largest id of all comes behind the smallest. So one shuffle serves, and no task sees all rows.
    """
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n)], 20 * n + 10_000)).collect()[0][0]
    cuts = sorted(set(found or []))
    place = F.lit(0)
    if cuts:
        ends, step = F.lit([int(c) for c in cuts]).cast("array<bigint>"), 1
        while step * 2 <= len(cuts):
            step *= 2
        steps = []
        while step:
            steps.append(step)
            step //= 2
        place = F.aggregate(  # how many ends are below the id, by halving steps
            F.array(*map(F.lit, steps)), F.lit(0),
            lambda at, s: F.when((at + s <= len(cuts)) & (F.element_at(ends, F.least(at + s, F.lit(len(cuts)))) < F.col("doc_id")), at + s).otherwise(at),
        )
        place = F.least(place, F.lit(len(cuts) - 1))
    placed = docs.select("doc_id", "text", F.coalesce(place, F.lit(0)).alias("own"))
    if cuts:
        is_end = F.coalesce(F.element_at(ends, F.col("own") + 1) == F.col("doc_id"), F.lit(False))
        copies = F.when(is_end, F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("halo")), F.struct(((F.col("own") + 1) % len(cuts)).alias("bucket"), F.lit(True).alias("halo"))))
        placed = placed.select("doc_id", "text", F.explode(copies.otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("halo"))))).alias("p"))
        placed = placed.select("doc_id", "text", "p.*")
    else:  # no ids at all: the first of the order is behind the last too
        placed = placed.select("doc_id", "text", F.col("own").alias("bucket"), F.lit(False).alias("halo"))
    order = Window.partitionBy("bucket").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    first = F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if not cuts else F.lit(None)
    return placed.withColumns({"rn": F.row_number().over(order), "next_text": F.coalesce(F.lead("text").over(order), first)})


def near(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp (of queries), n_near: how many other fingerprints of fps lie within the radius.

    Both hold distinct 64-bit fingerprints. Keys that many fingerprints share are split into chunks, and
    a query meets chunks, not single fingerprints, so no group of pairs is ever written out.
    """
    ends = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(blocks)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = [signed(sum(parts[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        rows = F.transform(F.lit(masks).cast("array<bigint>"), lambda m, t: F.struct(t.alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
        return df.withColumn("x", F.explode(rows)).select(F.col("fp").alias(name), "x.t", "x.k")

    asked = tables(queries, "q")
    held = tables(fps, "fp").join(asked.select("t", "k").distinct().hint("merge"), ["t", "k"], "left_semi")
    sizes = held.groupBy("t", "k").agg(F.count("*").alias("n"))
    held = held.join(sizes, ["t", "k"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / CHUNK)))
    chunks = held.groupBy("t", "k", "chunk").agg(F.collect_list("fp").alias("fps"))
    met = asked.hint("merge").join(chunks, ["t", "k"])  # both sides grow with the corpus: neither is broadcast

    def counts(x: Column) -> Column:
        diff = x.bitwiseXOR(F.col("q"))
        earlier = F.exists(F.slice(F.lit(masks).cast("array<bigint>"), F.lit(1), F.col("t")), lambda m: diff.bitwiseAND(m) == 0)
        return (F.bit_count(diff) <= radius) & (diff != 0) & ~earlier

    return met.select("q", F.size(F.filter("fps", counts)).cast("long").alias("n")).groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("n_near"))


def matches(fps: DataFrame, queries: DataFrame, radius: int = WIDE, blocks: int = WIDE_BLOCKS) -> DataFrame:
    """fp (of queries), near: array of all other fingerprints of fps within the radius.

    Both hold distinct 64-bit fingerprints. Fingerprints are kept by each of their blocks; a query asks for
    each block with up to radius // blocks bits changed. A pair comes from the first block that gives it.
    """
    ends, flips = [64 * i // blocks for i in range(blocks + 1)], radius // blocks
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = [signed(((1 << hi) - 1) ^ ((1 << lo) - 1)) for lo, hi in zip(ends, ends[1:])]
    changes = [[signed(sum(1 << b for b in c)) for n in range(flips + 1) for c in combinations(range(lo, hi), n)] for lo, hi in zip(ends, ends[1:])]
    longs = lambda v: F.lit(v).cast("array<bigint>")
    own = F.transform(longs(masks), lambda m, t: F.struct(t.alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
    held = fps.select("fp", F.explode(own).alias("x")).select("fp", "x.t", "x.k")
    sizes = held.groupBy("t", "k").agg(F.count("*").alias("n"))
    held = held.join(sizes, ["t", "k"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / CHUNK)))
    chunks = held.groupBy("t", "k", "chunk").agg(F.collect_list("fp").alias("fps"))

    def keys(t: int) -> Column:
        return F.transform(longs(changes[t]), lambda c: F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(masks[t])).bitwiseXOR(c).alias("k")))

    asked = queries.select(F.col("fp").alias("q"), F.explode(F.flatten(F.array(*map(keys, range(blocks))))).alias("x")).select("q", "x.t", "x.k")
    met = asked.hint("merge").join(chunks, ["t", "k"])

    def close(x: Column) -> Column:
        diff = x.bitwiseXOR(F.col("q"))
        earlier = F.exists(F.slice(longs(masks), F.lit(1), F.col("t")), lambda m: F.bit_count(diff.bitwiseAND(m)) <= flips)
        return (F.bit_count(diff) <= radius) & (diff != 0) & ~earlier

    found = met.select("q", F.filter("fps", close).alias("some")).where(F.size("some") > 0)
    return found.groupBy(F.col("q").alias("fp")).agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("near"))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, likenesses; for ids divisible by 20 the near fingerprints (and how many lie within RADIUS) and how many other documents have the same one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(spark, docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", F.when(~F.col("halo"), edited))
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("sha"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("kind"), F.when(~F.col("halo"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256))).alias("sha"), F.col("edited").alias("body")),
    )
    each = rows.select("bucket", "rn", "halo", "doc_id", "n_chars", F.explode(both).alias("v")).where("not halo or v.kind = 0")
    keys = ["bucket", "rn", "halo", "doc_id", "n_chars", "kind", "sha"]
    each = each.select(*keys[:5], F.col("v.kind").alias("kind"), F.col("v.sha").alias("sha"), terms(F.col("v.body")).alias("terms"))
    fps = fingerprints(each, keys)
    one = fps.groupBy("bucket", "rn", "halo", "doc_id", "n_chars").agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"), F.max("sha").alias("sha")
    )
    order = Window.partitionBy("bucket").orderBy("rn")
    one = one.withColumn("next_fp", F.coalesce(F.lead("fp").over(order), F.first("fp").over(order))).where("not halo")
    one = materialize(spark, one.select("doc_id", "n_chars", "sha", "fp", "edited_fp", "next_fp"), "simhash")
    asked = one.where(F.col("doc_id") % QUERY_STEP == 0)
    held = materialize(spark, one.groupBy("fp").agg((F.count("*") - 1).alias("n_same"), F.max(F.col("doc_id") % QUERY_STEP == 0).alias("asked")), "simhash_held")
    found = matches(held.select("fp"), held.where("asked").select("fp"))
    found = held.where("asked").join(found, "fp", "left").select("fp", "n_same", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    n_near = F.size(F.filter("near", lambda x: F.bit_count(x.bitwiseXOR(F.col("fp"))) <= RADIUS)).cast("long")
    cols = ["doc_id", "n_chars", "sha", "fp", "edited_fp", "next_fp"]
    out = asked.hint("merge").join(found, "fp").select(*cols, n_near.alias("n_near"), "n_same", F.transform("near", spell).alias("near_fingerprints"))
    rest = one.where((F.col("doc_id") % QUERY_STEP != 0) | F.col("doc_id").isNull()).select(*cols, F.lit(None).cast("long").alias("n_near"), F.lit(None).cast("long").alias("n_same"), F.lit(None).cast("array<string>").alias("near_fingerprints"))
    return out.unionByName(rest).select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), spell(F.col("fp")).alias("fingerprint"), spell(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near", "n_same", "near_fingerprints",
    )
