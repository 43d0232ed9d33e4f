"""Odd rows in every stage of the pipeline: nulls, empty and long texts, ties, repeats, no rows."""

from __future__ import annotations

import collections
import os

import pytest

import corpus_pipeline as pipeline
from labmesh.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")

DOC = "doc_id long, text string, lang string, source string, n_chars long, taken int, score string"
LABELS = "doc_id long, quality int, toxic int"
LONG = "Some words of a very long text. " * 20_000


@pytest.fixture
def folder(spark, tmp_path):
    labels = [(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, None, s, None, 5, "x") for i, t, s in rows], DOC)


ODD = [
    (1, "some words that stand here for a text of a document", "a"),
    (1, "some words that stand here for a text of a document", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \n\t", "b"),
    (5, LONG, "b"),
    (None, "a row without an id", "a"),
    (None, "a row without an id", "a"),
    (None, None, None),
    (7, "", "b"),
    (7, "a b c", "b"),
]


def texts(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_the_columns(spark, folder):
    docs = documents(spark, *ODD)
    for _, stage in pipeline.STAGES[:3]:
        assert stage(spark, docs, folder).columns == docs.columns
    coded = pipeline.encoded(spark, docs, folder)
    assert set(coded.columns) == set(docs.columns) - {"text"} | {"token_ids", "n_tokens", "round_trip"}


def test_nothing_in_nothing_out(spark, folder):
    empty = documents(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_quality_without_a_pattern_loses_nothing(spark, folder):
    docs = documents(spark, *ODD)
    assert texts(pipeline.good_quality(spark, docs, folder)) == texts(docs)


def test_one_of_each(spark, folder):
    kept = texts(pipeline.one_of_each(spark, documents(spark, *ODD), folder))
    assert all(n == 1 for (i, _), n in kept.items() if i is not None)
    assert kept[None, "a row without an id"] == 2 and kept[None, None] == 1
    # Of rows that share an id the first by text stays.
    assert kept[7, ""] == 1 and (7, "a b c") not in kept


def test_an_id_with_a_third_of_the_rows(spark, folder):
    rows = [(k, f"text number {k} with words of its own {k * k} {k + 7}", "a") for k in range(100)]
    rows += [(500, f"row {k} of one id", "a") for k in range(60)]
    kept = texts(pipeline.one_of_each(spark, documents(spark, *rows), folder))
    assert sum(n for (i, _), n in kept.items() if i == 500) == 1 and len(kept) == 101


def test_mixed_never_takes_a_document_without_words(spark, folder):
    rows = texts(pipeline.mixed(spark, documents(spark, *ODD), folder))
    assert all(i is None or (t and t.strip()) for i, t in rows)
    assert rows[7, "a b c"] >= 1 and rows[None, None] == 1


def test_encoded(spark, folder):
    rows = pipeline.encoded(spark, documents(spark, *ODD), folder).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0]
    assert max(r["n_tokens"] for r in rows) > 100_000
    same = {tuple(r["token_ids"]) for r in rows if r["doc_id"] == 1}
    assert len(same) == 1
