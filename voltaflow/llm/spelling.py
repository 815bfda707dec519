"""Spelling variant grouping by letter-parity bitmask bands (operator 13).

A word's mask has one bit for each letter, set where the letter occurs an odd number of times. Replacing a
letter flips two bits, inserting or deleting one flips one. The mask is cut into three bands, so words of
one length that are near agree on one band at least, and words whose lengths differ by one on two of them.
Words of one length meet by one equal band, in blocks of a bounded size: masks are compared first, then halves
of the words (one replaced letter leaves one half), then the words. Words whose lengths differ by one meet by two
equal bands in a join. A pair comes from its first table only.

Forms are followed by pointer jumping: a form occurs twice as often at least, so chains are short.

Defined results: null text has no words; a null id counts as empty before the colon; repeated rows count as
rows; ties of forms go to the smaller word in code-point order; an empty table gives no rows; long texts
count whole; other columns aren't read.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table
from .ngram_join import blockwise, tasks

RUN, LEAST_CHARS, LEAST_COUNT, STEP, BANDS = r"[A-Za-zÀ-ÿ]+", 5, 3, 97, 3
#: Letters from common to rare, dealt to the bands in turn, so that each splits words about as well; bits of a band.
LETTERS, WIDTH = "eaisnrtolucdmphgbvfyqxjkzw", 30
#: Words of a block, and those compared with a block at once.
HELD, ROWS = 8192, 128
#: A form occurs at least so many times as often as the word.
TIMES = 2


def occurrences(docs: DataFrame) -> DataFrame:
    """word: every run of letters of docs (doc_id, text), one of its letters deleted where the step divides its hash."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    runs = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(F.pmod("h", F.lit(STEP)) == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(docs: DataFrame) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return occurrences(docs).where(F.char_length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def band(word: Column, number: int) -> Column:
    """Parity bits of every third letter of the alphabet as it is ordered by LETTERS, from the number-th."""
    place = lambda c: F.when(F.ascii(c) < 128, F.position(c, F.lit(LETTERS)) - 1).otherwise(F.ascii(c) - 192 + len(LETTERS))
    own = F.filter(F.transform(F.split(word, ""), place), lambda s: s % BANDS == number)
    return F.aggregate(own, F.lit(0).cast("long"), lambda m, s: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(s / BANDS).cast("int"))))


def replaced(one: list[list], other: list[list] | None) -> tuple:
    """solve() of blockwise for (word, n, t, rest, halves) of one band and length: pairs that may differ in one letter.

    The masks of the other two bands (rest: the next band's low, the one's after that high) differ in two bits, and one half
    of the words is equal. A pair that an earlier table has too is left to it.
    """
    own = other is None
    (word_a, n_a, t, rest_a, half_a), (word_b, n_b, _, rest_b, half_b) = one, one if own else other
    rest_a, half_a, rest_b, half_b = (np.array(c, np.int64) for c in (rest_a, half_a, rest_b, half_b))
    low = np.int64((1 << WIDTH) - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(rest_a), ROWS):
        start = lo if own else 0
        x = rest_a[lo : lo + ROWS, None] ^ rest_b[start:]
        i, j = np.nonzero(np.bitwise_count(x) == 2)
        x = x[i, j]
        i, j = i + lo, j + start
        h = half_a[i] ^ half_b[j]
        good = ((h >> np.int64(32)) == 0) | ((h & np.int64(0xFFFFFFFF)) == 0)
        # of table 1, band 0 is the one after the next; of table 2, bands 0 and 1 are the next ones
        if t[0] == 1:
            good &= (x >> np.int64(WIDTH)) != 0
        elif t[0] == 2:
            good &= ((x >> np.int64(WIDTH)) != 0) & ((x & low) != 0)
        if own:
            good &= i < j
        found.append((i[good], j[good]))
    i, j = (np.concatenate(c).tolist() for c in zip(*found))
    return [word_a[k] for k in i], [n_a[k] for k in i], [word_b[k] for k in j], [n_b[k] for k in j]


def near_pairs(spark: SparkSession, scratch: Scratch, words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every pair of words (word, n) one edit apart, once."""
    length = F.char_length("word")
    middle = F.floor(length / 2).cast("int")
    part = lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))
    halves = F.shiftleft(part(F.substring("word", F.lit(1), middle)), 32).bitwiseOR(part(F.substring("word", middle + 1, length)))
    masked = words.select("word", "n", length.alias("l"), halves.alias("halves"), *[band(F.col("word"), i).alias(f"m{i}") for i in range(BANDS)])
    masked = scratch.write(masked, "masks")
    m = [F.col(f"m{i}") for i in range(BANDS)]

    # equal lengths: words of one band meet in blocks
    rest = lambda i: m[(i + 1) % BANDS].bitwiseOR(F.shiftleft(m[(i + 2) % BANDS], WIDTH))
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.xxhash64(F.lit(i), m[i], F.col("l")).alias("key"), rest(i).alias("rest")) for i in range(BANDS)])
    held = masked.select("word", "n", "halves", F.explode(tables).alias("x")).select("x.key", "word", "n", "x.t", "x.rest", "halves")
    sizes = scratch.write(held.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", F.ceil(F.col("k") / HELD).alias("blocks")), "band_sizes")
    same = blockwise(held, "key", ["word", "n", "t", "rest", "halves"], sizes, replaced, "a string, n_a long, b string, n_b long", tasks(spark))

    # lengths that differ by one: two bands are equal, which leaves few words a key
    def side(name: str, shift: int) -> DataFrame:
        """Entries by two bands and the shorter's length (shift: the longer's)."""
        two = [F.struct(F.lit(i).alias("t"), m[i].alias("k"), m[(i + 1) % BANDS].alias("k2"), (F.col("l") - shift).alias("at"), m[(i + 2) % BANDS].alias("third")) for i in range(BANDS)]
        out = masked.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.explode(F.array(*two)).alias("x"))
        return out.select(name, f"n_{name}", "x.t", "x.k", "x.k2", "x.at", F.col("x.third").alias(f"third_{name}"))

    # both sides grow with the vocabulary: neither is broadcast; one letter more flips one bit of the third band
    met = side("a", 0).hint("merge").join(side("b", 1), ["t", "k", "k2", "at"]).where(F.bit_count(F.col("third_a").bitwiseXOR(F.col("third_b"))) == 1)
    every = same.unionByName(met.select("a", "n_a", "b", "n_b"))
    return every.where(F.levenshtein("a", "b", 1) == 1)


def roots(spark: SparkSession, scratch: Scratch, forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the end of each chain, by pointer jumping on written tables."""
    at = scratch.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.write(at.join(above.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    bounded_batches(spark)
    scratch = Scratch(spark)
    words = scratch.write(counted(docs), "words")
    pairs = scratch.write(near_pairs(spark, scratch, words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("own"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("own"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("own").alias("own"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    good = -F.col("best.less") >= TIMES * F.col("own")
    best = scratch.write(best.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "best")
    ends = roots(spark, scratch, best.where("form is not null"))
    out = words.join(best.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    return variants(spark, table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)
  )
), runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
), each AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(bytes) // 2), lambda i: ('0x' || bytes[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM each CROSS JOIN tab
), kept AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, i, word[1:i - 1] AS l, word[i + 1:] AS r FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT word, l || r FROM holes WHERE l || r IN (SELECT word FROM words)
  UNION SELECT l || r, word FROM holes WHERE l || r IN (SELECT word FROM words)
), best AS (
  SELECT a AS word, count(*) AS n_near, max(w.n) AS top, min(b) FILTER (w.n = m) AS form
  FROM (SELECT a, b, max(n) OVER (PARTITION BY a) AS m FROM pairs JOIN words ON word = b) JOIN words w ON w.word = b GROUP BY a
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (SELECT word, word AS tip FROM formed UNION ALL SELECT walk.word, form FROM walk JOIN formed ON formed.word = walk.tip WHERE form IS NOT NULL)
SELECT formed.word, formed.form, walk.tip AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN walk ON walk.word = formed.word JOIN formed e ON e.word = walk.tip AND e.form IS NULL
"""
