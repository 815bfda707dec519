"""Every registered text query on the smallest tables: against its SQL, or against the tokenizers library."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from voltaflow.llm import queries, unigram  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(df.collect()) == key(rel.select(*df.columns).fetchall())


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_equals_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    rows = queries.QUERIES["op1_bpe_round_trip"](spark, SF).collect()
    source = texts(spark)
    assert len(rows) == len(source)
    for r in rows:
        ids = tok.encode(source[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3_equals_the_library(spark, tmp_path):
    """The query on the given documents and on awkward rows: the library's Unigram over words marked at each space."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unk = unigram.vocabulary(P.path("piece_bpe_32k.model"))
    ref = Tokenizer(models.Unigram(pieces, unk_id=unk, byte_fallback=True))
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    size = lambda t: len(ref.encode(t or "", add_special_tokens=False).ids)
    source = texts(spark)
    got = queries.QUERIES["op3_token_counts"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((k, size(t)) for k, t in source.items())
    rows = [(1, None), (2, ""), (3, "  a  b\n\tc ▁ "), (3, "  a  b\n\tc ▁ "), (4, "word " * 40000), (5, "x" * 3000), (None, "no id"), (6, "é中😀\x00")]
    spark.createDataFrame([(k, t, 5, "clash", 0.5) for k, t in rows], "doc_id long, text string, n_tokens int, key string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op3_token_counts"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((k, size(t)) for k, t in rows), key=repr)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op3_token_counts"](spark, f"{tmp_path}/none").count() == 0
