"""The corpus pipeline: five stages applied one after the other to `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage carries the other columns as one struct, so that none of their names can clash with its
own. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaflow.llm import ngram_join, packing, quality, secrets, substring_dedup
from voltaflow.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy. Null and empty texts fail it (too few words); repeated rows are judged alike, long texts as a whole."""
    return quality.ledger(docs, keep=True).where(quality.passes(2)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the text of the least id, of several texts of that id the one of the least hash.

    An id with several texts is judged text by text. Of repeated rows of the text that stays, one stays (the least by its
    other columns). Null texts and texts without words are one class; documents without an id all stay.
    """
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), ngram_join.text_hash("text").alias("th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = ngram_join.classes(spark, docs)
    first = found.where("key = class_id and th = class_th").select(F.col("key").alias("id"), "th").distinct()
    stay = packed.join(first, ["id", "th"], "left_semi")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.to_json(F.struct(*others)) if others else F.lit("")
    once = stay.groupBy("id", "th").agg(F.min_by("row", rank).alias("row"))
    return once.select("row.*").unionByName(docs.where("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a document with a smaller id repeats; unchanged texts stay as they are, null ones too.

    Repeated rows lose the same words; documents without an id lose none; a text that loses words is its words joined
    by one space, and its count of characters follows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("others"))
    out = substring_dedup.dedup(spark, packed, batches=4, carry=("others",), runs=2)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text")
    column = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"others.`{c}`").alias(c) for c in others}
    if "n_chars" in others:
        column["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("others.n_chars")).alias("n_chars")
    return out.select(*(column[c] for c in docs.columns))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; null texts stay null, every row is scanned as a whole, and the count of characters follows."""
    return secrets.redact_documents(spark, docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences. Null texts count as empty; repeated rows and rows without an id are packed like any others."""
    import public_tokenizers

    return packing.pack_texts(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("secret scans", secret_scans),
    ("packing", sequence_packing),
]

#: The near-duplicate and packing stages are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
