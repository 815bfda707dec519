"""Quality rules as a bitmask ledger (operator 8); DataFrame functions only.

Every rule is evaluated once per document: its measurements and one failure bit go into a ledger.
Policies are versioned sets of rules, stored as masks; applying one is a bitwise and, and ablations
(what a rule rejects alone, what leaving it out would keep) are bitwise aggregations of the ledger.

Defined results: null text has no words and fails `few_words`, as does an empty one; repeated rows
are judged each; long texts are judged whole, in n log n; an empty table gives no rows; other columns
aren't read by the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import let
from .common import table, words_of

WINDOW, MIN_WORDS = 5, 10
#: Rules in bit order; a bit never changes its meaning, new rules get new bits.
RULES = ("few_words", "repeats", "symbols", "shouting", "word_length", "duplicate_lines")
#: Policies by version: the rules that reject.
POLICIES = {1: ("few_words", "repeats"), 2: RULES}


def mask_of(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def repeated_words(words: Column) -> Column:
    """Words in windows of five that occur at least twice in the array."""

    def covered(starts: Column) -> Column:
        ends = F.transform(starts, lambda p, k: F.when(k < F.size(starts) - 1, F.least(F.lit(WINDOW), F.element_at(starts, k + 2) - p)).otherwise(WINDOW))
        return F.aggregate(ends, F.lit(0), lambda a, x: a + x)

    def found(pairs: Column) -> Column:  # sorted by hash, so equal windows are neighbours
        last = F.size(pairs)
        before = lambda k: F.when(k > 0, F.element_at(pairs, F.greatest(k, F.lit(1)))["h"])
        after = lambda k: F.when(k < last - 1, F.element_at(pairs, F.least(k + 2, last))["h"])
        twice = F.filter(pairs, lambda x, k: F.coalesce(before(k) == x["h"], F.lit(False)) | F.coalesce(after(k) == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def judged(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(pairs, found))

    def hashed(hashes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(*(F.element_at(hashes, i + j) for j in range(WINDOW))))
        return F.when(F.size(hashes) < 2 * 1 + WINDOW - 1, 0).otherwise(let(grams, judged))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def measure(text: Column) -> Column:
    """Struct of all measurements of a text column."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def length_without(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"),
        length_without(r"[\x20\x09-\x0D]+").cast("long").alias("word_chars"),
        length_without(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        length_without(r"[^\p{Lu}]+").cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """The key (or, with keep, all columns as the struct `row`), the measurements and fail_bits."""
    first = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if keep else F.col(key).alias(key)
    m = docs.select(first, measure(F.col(text)).alias("m"))
    names = ("word_chars", "n_symbols", "n_upper")
    m = m.select("row" if keep else key, "m.w.*", "m.l.*", *(F.col(f"m.{n}").alias(n) for n in names))
    failed = {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"),
        "shouting": 2 * F.col("n_upper") > F.col("word_chars"),
        "word_length": F.col("word_chars") > 40 * F.col("n_words"),
        "duplicate_lines": (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) & (F.col("n_dup_lines") >= 3),
    }
    bits = None
    for i, rule in enumerate(RULES):
        bit = F.when(failed[rule], F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return m.withColumn("fail_bits", bits)


def passes(version: int, bits: str = "fail_bits") -> Column:
    """Whether a document passes the policy of that version."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """rule, n_failed, n_only: documents that fail the rule, and those that no other rule of the policy rejects.

    The ledger is first counted by its bits (at most 2 to the number of rules rows), then split up by rule.
    """
    mask = mask_of(POLICIES[version])
    counted = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[version])))
    split = counted.select("n", "bits", rules.alias("r")).select("n", "bits", "r.*")
    return split.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base verdict, failure bits and the current policy's verdict of every document."""
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(1)).alias("base_failed"), passes(2).alias("kept"), "fail_bits")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (
  SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
), h AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + 4], ' ')) AS n FROM g
), c AS (
  SELECT rid, CAST(sum(least(5, nxt - i)) AS BIGINT) AS n_repeat_words FROM (
    SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) AS nxt FROM h WHERE n > 1
  ) GROUP BY rid
), l AS (
  SELECT rid, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
), m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_lines AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN c USING (rid)
), f AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3 THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""
