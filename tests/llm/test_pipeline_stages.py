"""The pipeline's stages where rows or names are awkward."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_text_operators import fixture_docs  # noqa: E402

from voltaflow.llm import packing  # noqa: E402

STAGE = dict(corpus_pipeline.STAGES)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def words(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("rows", [
    [(5, "A"), (5, "B")], [(3, "A"), (5, "A"), (5, "B")], [(5, "A"), (5, "A"), (5, "B"), (7, "B"), (5, "B")], [(9, "A"), (5, "B"), (5, "A'"), (2, "B'")], [(5, "A"), (5, "A'"), (6, "A")],
])
def test_an_id_with_several_texts_loses_no_class(spark, rows):
    """A' is near A: 60 words with one changed at the end."""
    full = [(k, words(t[0]) + (" changed" if t.endswith("'") else "")) for k, t in rows]
    docs, _ = fixture_docs(spark, full)
    got = texts(STAGE["n-gram Jaccard join"](spark, docs, ""))
    assert sum(got.values()) == len({t[0] for _, t in rows})  # one row of each class
    for (k, t), n in got.items():
        same = [x for x, u in full if u[:2] == t[:2]]
        assert n == 1 and (k, t) in full and k == min(same)


def test_names_that_clash_and_columns_that_differ(spark):
    rows = [(1, words("a", 80)), (2, words("b", 80)), (3, words("a", 80)), (None, words("a", 80)), (4, words("c", 20) + " " + words("b", 70))]
    docs = spark.createDataFrame([(k, "en", i, "x", True, 1, "h", "c", t, 7, 3, {"a": 1}, "r") for i, (k, t) in enumerate(rows)], "doc_id long, lang string, n_chars long, kept string, n_removed boolean, _once long, th string, class_id string, text string, n_words long, key long, row map<string,int>, others string")
    one = STAGE["n-gram Jaccard join"](spark, docs, "")
    assert one.columns == docs.columns and one.dtypes == docs.dtypes
    assert Counter((r.doc_id, r.n_chars, r.kept, r.row["a"], r.others) for r in one.collect()) == Counter((k, i, "x", 1, "r") for i, (k, _) in enumerate(rows) if i != 2)
    cut = STAGE["substring dedup"](spark, one, "")
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    got = {r.doc_id: r for r in cut.collect()}
    assert got[4].text == words("c", 20) and got[4].n_chars == len(got[4].text) and got[1].text == rows[0][1] and got[1].n_chars == 0 and got[4].n_removed is True
    kept = STAGE["quality rules"](spark, cut.drop("row"), "")
    assert kept.count() == 4
    safe = STAGE["secret scans"](spark, kept, "")
    assert safe.columns == kept.columns and STAGE["packing"](spark, safe, "").count() >= 4


def test_empty_tables_pass_through(spark):
    docs, _ = fixture_docs(spark, [(1, "one")])
    docs = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0, name
    assert STAGE["packing"](spark, docs, "").count() == 0 and packing
