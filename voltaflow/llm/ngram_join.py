"""N-gram Jaccard join with Bayesian candidate pruning (operator 6).

Documents are sets of five-word shingles; two are linked at a Jaccard similarity of at least 0.8. Equal
sets are one class of copies and are joined once, under a number of their own. MinHash bands (32 of 5)
bring together the distinct sets that may be similar; a pair at exactly 0.8 shares no band with
probability 3e-6. In each band, sets meet their leader: MinHash values are compared 32 at a time, and a
pair is dropped as soon as the posterior probability of reaching the threshold (uniform prior) falls
below the tolerance. Bands with a dropped pair are compared throughout, block by block, but for sets
that are in one component already. What may be linked is thus in one component of surviving pairs, and
these are verified exactly: a set is kept as its difference from the component's pivot, which cancels out
between any two, and blocks of differences meet. Tasks hand back counts and spanning forests, never pairs.

In a component of n different texts, n * n comparisons of short differences are made (they are what the
exact number of links asks for), but texts are shipped twice whatever n is, and each difference once for
every BLOCK sets; components, bands and links give rows in proportion to n.

Defined results: texts of fewer than five words are one shingle of all their words; texts without words
are copies of each other; null text counts as empty; a null id has no class and no links; repeated
rows are copies; one id on several different texts gives one row for each of them, by its own set; an
empty table gives no rows; long texts count whole; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, map_arrow, table
from .graph import collapse, components, release

SHINGLE, THRESHOLD, BANDS, BAND_ROWS, STEP, TOLERANCE = 5, 0.8, 32, 5, 32, 1e-9
#: Sets in a block, bytes of their differences in a block; pairs compared and columns multiplied at once.
BLOCK, BLOCK_BYTES, PAIRS, COLUMNS = 2048, 16 << 20, 1 << 16, 4096
HASHES = BANDS * BAND_ROWS
_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
ODD = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total = total + h[j : j + n] * ODD[j]
    return np.unique(mix(total))


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 2048):
        out = np.minimum(out, (low[None, i : i + 2048] * MULTIPLY[:, None] + ADD[:, None]).min(1))
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    return mix((rows * ODD[5 : 5 + BAND_ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * ODD[15]).astype(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches below which the posterior of reaching the threshold is under the tolerance).

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), whose mass above t
    is the chance of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Indices of the pairs (rows of signatures a and b) that may still reach the threshold when all values are compared."""
    num, den = ratio(threshold)
    left = np.flatnonzero((size_a * den >= num * size_b) & (size_b * den >= num * size_a))
    matches = np.zeros(len(left), np.int16)
    for n, least in least_matches(threshold, tolerance):
        matches += (a[left, n - STEP : n] == b[left, n - STEP : n]).sum(1, dtype=np.int16)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
    return left


def ratio(threshold: float) -> tuple[int, int]:
    limit = Fraction(str(threshold))
    return limit.numerator, limit.denominator


def common_counts(rows_a: list[np.ndarray], rows_b: list[np.ndarray]) -> np.ndarray:
    """How many values each of rows_a shares with each of rows_b (distinct values in a row): matrix products over values that occur on both sides."""
    own = rows_a is rows_b
    all_a = np.concatenate(rows_a)
    all_b = all_a if own else np.concatenate(rows_b)
    if own:
        value, times = np.unique(all_a, return_counts=True)
        value = value[times > 1]
    else:
        value = np.intersect1d(all_a, all_b)
    out = np.zeros((len(rows_a), len(rows_b)), np.float32)
    if not len(value):
        return out

    def placed(rows: list[np.ndarray], every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(value, every), len(value) - 1)
        hit = value[at] == every
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit]
        order = np.argsort(at[hit], kind="stable")
        return row[order], at[hit][order]

    (row_a, col_a), (row_b, col_b) = placed(rows_a, all_a), placed(rows_b, all_b)
    for lo in range(0, len(value), COLUMNS):
        width = min(COLUMNS, len(value) - lo)
        have = []
        for n, row, col in ((len(rows_a), row_a, col_a), (len(rows_b), row_b, col_b)):
            part = slice(*np.searchsorted(col, [lo, lo + width]))
            m = np.zeros((n, width), np.float32)
            m[row[part], col[part] - lo] = 1
            have.append(m)
        out += have[0] @ have[1].T
    return out


def linked(diff_a: list[np.ndarray], size_a: np.ndarray, diff_b: list[np.ndarray], size_b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix: which sets of a and b reach the threshold, from their sizes and their differences to one pivot set.

    The pivot cancels out: sets differ from each other where exactly one of them differs from it. With s the
    sum of two sizes and d the size of their difference, the similarity is (s - d) / (s + d).
    """
    num, den = ratio(threshold)
    len_a, len_b = (np.array([len(d) for d in x], np.int64) for x in (diff_a, diff_b))
    d = len_a[:, None] + len_b - 2 * common_counts(diff_a, diff_b).astype(np.int64)
    out = (den - num) * (size_a[:, None] + size_b) >= (den + num) * d
    if diff_a is diff_b:
        np.fill_diagonal(out, False)
    return out


def leads(links: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least index in each row's component, of rows a (0 ..) and rows b (behind them; the same as a with own)."""
    na, nb = links.shape
    none = na + nb
    a, b = np.arange(na), np.arange(nb) if own else np.arange(na, none)
    while True:
        new_a = np.minimum(a, np.where(links, b[None, :], none).min(1, initial=none))
        new_b = new_a if own else np.minimum(b, np.where(links, new_a[:, None], none).min(0, initial=none))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def blockwise(rows: DataFrame, key: str, columns: list[str], blocks: DataFrame, solve: Callable, schema: str, partitions: int) -> DataFrame:
    """solve(own block's columns, other block's columns or None) for each pair of blocks of each key.

    rows are dealt into their key's number of blocks (key, blocks) by their first column; each pair of blocks is one
    group, so a task holds two blocks at a time however many rows the key has. Columns come as lists.
    """
    placed = rows.join(blocks, key).withColumn("own", F.pmod(F.xxhash64(columns[0]), F.col("blocks")).cast("int"))
    placed = placed.select(key, *columns, "own", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("x"))
    placed = placed.select(key, F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", *columns)
    names, width = [part.split()[0] for part in schema.split(", ")], len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides = None, ([], [])

        def solved() -> Iterator[pa.RecordBatch]:
            one, other = sides
            if group is not None and len(one) + len(other) > 1 and (group[1] == group[2] or one and other):
                out = solve([list(c) for c in zip(*one)], [list(c) for c in zip(*other)] if group[1] != group[2] else None)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=names)

        for batch in batches:
            k, i, j, own = (batch.column(c).to_pylist() for c in range(4))
            values = zip(*(batch.column(4 + c).to_pylist() for c in range(width)))
            for at, o, row in zip(zip(k, i, j), own, values):
                if at != group:
                    yield from solved()
                    group, sides = at, ([], [])
                sides[o != at[1]].append(row)
        yield from solved()

    keys = [key, "i", "j"]
    return placed.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def signatures(docs: DataFrame) -> DataFrame:
    """key, th, n (shingles), set_key (128-bit digest of the set), sig (16 bits of each MinHash value), bands of docs (key, text)."""

    def run(batch: dict) -> dict:
        sets = [shingles(t) for t in batch["text"].to_pylist()]
        hashed = [minhash(s) if len(s) else None for s in sets]
        return {
            "key": batch["key"], "th": batch["th"], "n": [len(s) for s in sets], "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "sig": [None if h is None else h.astype("<u2").tobytes() for h in hashed], "bands": [[] if h is None else band_keys(h) for h in hashed],
        }

    schema = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("set_key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    return map_arrow(docs.select("key", "th", "text"), run, "key long, th long, n int, set_key binary, sig binary, bands array<long>", schema)


def pruned(pairs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """u, v, strong: whether the pair (u, v, n_u, n_v, sig_u, sig_v) survives the pruning."""

    def run(batch: dict) -> dict:
        sig_u, sig_v = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_u", "sig_v"))
        n_u, n_v = (batch[c].to_numpy().astype(np.int64) for c in ("n_u", "n_v"))
        strong = np.zeros(len(n_u), bool)
        strong[survivors(sig_u, sig_v, n_u, n_v, threshold, tolerance)] = True
        return {"u": batch["u"], "v": batch["v"], "strong": strong}

    return map_arrow(pairs, run, "u long, v long, strong boolean", pa.schema([("u", pa.int64()), ("v", pa.int64()), ("strong", pa.bool_())]))


def strangers(threshold: float, tolerance: float) -> Callable:
    """solve() of blockwise for (sid, comp, n, sig): a forest over the pairs of different components that survive the pruning."""

    def solve(one: list[list], other: list[list] | None) -> tuple:
        own = other is None
        (sid_a, comp_a, n_a, sig_a), (sid_b, comp_b, n_b, sig_b) = one, one if own else other
        sig_a, sig_b = (np.frombuffer(b"".join(s), "<u2").reshape(-1, HASHES) for s in (sig_a, sig_b))
        n_a, n_b, comp_a, comp_b = (np.array(x, np.int64) for x in (n_a, n_b, comp_a, comp_b))
        links = np.zeros((len(n_a), len(n_b)), bool)
        for lo in range(0, len(n_a), max(1, PAIRS // len(n_b))):
            part = slice(lo, lo + max(1, PAIRS // len(n_b)))
            at_a, at_b = np.nonzero(comp_a[part, None] != comp_b)
            at_a += lo
            if own:
                at_a, at_b = at_a[at_a < at_b], at_b[at_a < at_b]
            good = survivors(sig_a[at_a], sig_b[at_b], n_a[at_a], n_b[at_b], threshold, tolerance)
            links[at_a[good], at_b[good]] = True
        if own:
            links |= links.T
        lead_a, lead_b = leads(links, own)
        sids = np.array([*sid_a, *([] if own else sid_b)], np.int64)
        lead = lead_a if own else np.concatenate([lead_a, lead_b])
        kept = lead != np.arange(len(sids))
        return sids[kept], sids[lead[kept]]

    return solve


def exact(threshold: float) -> Callable:
    """solve() of blockwise for (sid, n, diff): exact links of every set, counted, and a forest over them."""

    def solve(one: list[list], other: list[list] | None) -> tuple:
        own = other is None
        (sid_a, n_a, diff_a), (sid_b, n_b, diff_b) = one, one if own else other
        diff_a = [np.frombuffer(d, np.uint64) for d in diff_a]
        diff_b = diff_a if own else [np.frombuffer(d, np.uint64) for d in diff_b]
        links = linked(diff_a, np.array(n_a, np.int64), diff_b, np.array(n_b, np.int64), threshold)
        lead_a, lead_b = leads(links, own)
        sids = np.array([*sid_a, *([] if own else sid_b)], np.int64)
        count = links.sum(1) if own else np.concatenate([links.sum(1), links.sum(0)])
        lead = lead_a if own else np.concatenate([lead_a, lead_b])
        kept = count > 0
        return sids[kept], count[kept].astype(np.int64), sids[lead[kept]]

    return solve


def differences(joined: DataFrame) -> DataFrame:
    """comp, sid, n, diff: the shingles in which a text differs from its component's pivot; from rows (comp, sid, text, pivot)."""

    def run(batch: dict) -> dict:
        n, diff, last, pivot = [], [], None, None
        for comp, text, other in zip(batch["comp"].to_pylist(), batch["text"], batch["pivot"]):
            if comp != last:  # rows of one component come together
                last, pivot = comp, shingles(other.as_py())
            own = shingles(text.as_py())
            n.append(len(own))
            diff.append(np.setxor1d(own, pivot, assume_unique=True).tobytes())
        return {"comp": batch["comp"], "sid": batch["sid"], "n": n, "diff": diff}

    schema = pa.schema([("comp", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("diff", pa.binary())])
    return map_arrow(joined.select("comp", "sid", "text", "pivot"), run, "comp long, sid long, n int, diff binary", schema)


def distinct_sets(scratch: Scratch, named: DataFrame) -> DataFrame:
    """sid (a number of its own), set_key, first_doc and th (the text with the least id), n, sig, bands of every distinct set.

    Copies are combined before the shuffle. Numbers are given while the table is written and read back from there.
    """
    first = named.groupBy("set_key").agg(F.min(F.struct("key", "th")).alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    first = first.select(F.monotonically_increasing_id().alias("sid"), "set_key", F.col("doc.key").alias("first_doc"), F.col("doc.th").alias("th"), "n", "sig", "bands")
    return scratch.write(first, "sets")


def candidate_groups(spark: SparkSession, scratch: Scratch, sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """node, comp: components of the distinct sets whose MinHash values leave a link possible.

    Each set first meets the leader (least number) of each of its bands. Where a leader's pair is dropped, the band's sets
    may still be linked to each other: those bands' sets meet block by block, unless one leader links them already.
    """
    banded = sets.where("n > 0").select("sid", F.explode("bands").alias("band"))
    shared = scratch.write(banded.groupBy("band").agg(F.min("sid").alias("lead"), F.max("sid").alias("last")).where("lead < last"), "bands")
    star = scratch.write(banded.join(shared, "band").where("sid <> lead").select("band", "sid", "lead"), "star")
    pairs = star.select(F.col("sid").alias("u"), F.col("lead").alias("v")).distinct()
    ends = [sets.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "uv"]
    # both sides grow with the corpus: neither is broadcast, however small it is here
    met = scratch.write(pruned(pairs.join(ends[0].hint("merge"), "u").join(ends[1].hint("merge"), "v"), threshold, tolerance), "met")
    strong = scratch.write(collapse(met.where("strong").select("u", "v")), "strong")
    known = strong.groupBy(F.col("u").alias("sid")).agg(F.min("v").alias("comp"))  # sets of one label are in one component
    weak = star.join(met.where("not strong").select(F.col("u").alias("sid"), F.col("v").alias("lead")), ["sid", "lead"], "left_semi").select("band").distinct()
    loose = star.join(weak.hint("merge"), "band", "left_semi")
    loose = loose.select("band", "sid").unionByName(loose.select("band", F.col("lead").alias("sid")).distinct())
    loose = loose.join(known.hint("merge"), "sid", "left").select("band", "sid", F.coalesce("comp", "sid").alias("comp"))
    loose = scratch.write(loose, "loose")
    blocks = loose.groupBy("band").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    blocks = scratch.write(blocks.select("band", F.ceil(F.col("m") / BLOCK).alias("blocks")), "loose_blocks")
    rows = loose.join(sets.select("sid", "n", "sig").hint("merge"), "sid")
    found = blockwise(rows, "band", ["sid", "comp", "n", "sig"], blocks, strangers(threshold, tolerance), "u long, v long", tasks(spark))
    more = scratch.write(found, "more")
    return components(spark, collapse(strong.unionByName(more)))


def tasks(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(text: str) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def jaccard_join(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """key, class_id (least id of the documents connected by links and copies), text_id (least id with the same set), n_links (other sets linked)."""
    return classes(spark, docs, key, text, threshold, tolerance).select(F.col("key").alias(key), "class_id", "text_id", "n_links")


def classes(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """key, th (text_hash), class_id, text_id, n_links as jaccard_join gives them, and class_th: class_id and class_th together name one text of the class."""
    bounded_batches(spark)
    scratch = Scratch(spark)
    src = docs.select(F.col(key).cast("long").alias("key"), text_hash(text).alias("th"), F.col(text).alias("text"))
    named = scratch.write(signatures(src.where("key is not null")), "signatures")
    sets = distinct_sets(scratch, named)
    release(spark)
    groups = candidate_groups(spark, scratch, sets, threshold, tolerance).withColumnRenamed("node", "sid")
    scratch.drop("bands", "star", "met", "strong", "loose", "loose_blocks", "more")
    wanted = groups.join(sets.select("sid", F.col("first_doc").alias("key"), "th").hint("merge"), "sid")
    texts = scratch.write(src.join(wanted.hint("merge"), ["key", "th"]).select("comp", "sid", "text"), "texts")
    release(spark)
    # written before it is joined: a join of two plain shuffles can split a component of many texts
    pivots = scratch.write(texts.where("sid = comp").groupBy("comp").agg(F.first("text").alias("pivot")), "pivots")
    diffs = differences(texts.join(pivots.hint("merge"), "comp"))
    diffs = scratch.write(diffs.groupBy("comp", "sid").agg(F.first("n").alias("n"), F.first("diff").alias("diff")), "diffs")  # repeated rows come once
    sizes = diffs.groupBy("comp").agg(F.count("*").alias("m"), F.sum(F.octet_length("diff")).alias("bytes"))
    sizes = scratch.write(sizes.select("comp", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks")), "sizes")
    found = scratch.write(blockwise(diffs, "comp", ["sid", "n", "diff"], sizes, exact(threshold), "sid long, links long, lead long", tasks(spark)), "found")
    labels = components(spark, collapse(found.select(F.col("sid").alias("u"), F.col("lead").alias("v")))).withColumnRenamed("node", "sid")
    counts = found.groupBy("sid").agg(F.sum("links").alias("n_links"))
    named_sets = scratch.write(sets.select("sid", "set_key", "first_doc", "th").join(labels.join(counts, "sid").hint("merge"), "sid", "left"), "named_sets")
    firsts = named_sets.where("comp is not null").groupBy("comp").agg(F.min(F.struct("first_doc", "th")).alias("least"))
    # written before it is joined with all documents: a join of two plain shuffles can split a set with many copies
    known = named_sets.join(firsts.hint("merge"), "comp", "left").select("set_key", F.col("first_doc").alias("text_id"), F.coalesce("least.first_doc", "first_doc").alias("class_id"), F.coalesce("least.th", "th").alias("class_th"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    known = scratch.write(known, "known")
    scratch.drop("sets", "texts", "pivots", "diffs", "sizes", "found", "named_sets")
    out = named.select("key", "th", "set_key").join(known.hint("merge"), "set_key").select("key", "th", "class_id", "class_th", "text_id", "n_links")
    none = F.lit(None).cast("long")
    nulls = docs.where(F.col(key).isNull()).select(none.alias("key"), text_hash(text).alias("th"), none.alias("class_id"), none.alias("class_th"), none.alias("text_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nulls)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join(spark, table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), k AS (SELECT doc_id, md5(coalesce(string_agg(g, chr(10) ORDER BY g), '')) AS h, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS text_id FROM k),
x AS (SELECT s.doc_id, g, n FROM s JOIN t USING (doc_id) WHERE doc_id = text_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (SELECT u, v FROM p WHERE 5 * c >= 4 * (na + nb - c)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
c AS (SELECT u, min(v) AS least FROM reach GROUP BY u), l AS (SELECT u, count(*) AS n_links FROM both_ways GROUP BY u)
SELECT doc_id, least(text_id, coalesce(c.least, text_id)) AS class_id, text_id, coalesce(n_links, 0) AS n_links
FROM t LEFT JOIN c ON c.u = text_id LEFT JOIN l ON l.u = text_id
"""
