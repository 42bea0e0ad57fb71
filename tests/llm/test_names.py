"""Extra columns with the names that operators use for themselves come through unchanged."""

import pytest

from ledgerline.llm import lines, mixing, simhash, toxicity
from ledgerline.llm.work import Scratch, free

HELPERS = ["_id", "_ID2", "_print", "_none", "_gone", "_text", "_words", "_own", "_source", "_whole", "_spans", "_pieces", "_toxic_score"]
DDL = "doc_id bigint, text string, source string, n_chars bigint, " + ", ".join(f"{h} string" for h in HELPERS)


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["some words of a first text\nand a line", "another text that has other words\nand a line", None, "", "a third one, quite apart"]
    rows = [(i, t, "ab"[i % 2], 7, *[f"{h}{i}" for h in HELPERS]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def unchanged(found, docs, n=None):
    assert set(found.columns) - {"lines_before", "lines_after"} == set(docs.columns)
    rows = found.collect()
    assert all(r[h] == f"{h}{r.doc_id}" for r in rows for h in HELPERS)
    assert n is None or len(rows) == n


def test_names_are_free():
    assert free(["_ID", "x", "__id"], "_id", "_id", "y") == ["___id", "____id", "y"]


def test_lines(spark, docs):
    unchanged(lines.cleaned(docs, Scratch(spark, "t")), docs, 5)
    unchanged(lines.deduplicated(docs, Scratch(spark, "t")), docs)


def test_simhash(spark, docs):
    unchanged(simhash.deduplicated(docs, Scratch(spark, "t")), docs, 4)


def test_mixing(spark, docs):
    unchanged(mixing.mixed_texts(docs, Scratch(spark, "t"), mixing.Recipe(stride=1)), docs)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5)], "doc_id bigint, quality int, toxic int")
    unchanged(toxicity.without_toxic(docs, labels, Scratch(spark, "t"), limit=1.1), docs, 5)
