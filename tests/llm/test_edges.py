"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigloom.llm import bpe, cotraining, fingerprints, line_dedup, mixing, near_dedup, quality_rules, secrets, toxicity, url_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "This sentence is one of very many and goes on for a while without an end. " * 4000
ROWS = [
    (1, "", "en", "src0", 0),
    (2, None, None, None, None),
    (None, "A text without an id, of some words that are plain.", "en", "src1", 50),
    (None, None, None, None, None),
    (3, LONG, "en", "src0", len(LONG)),
    (4, "x" * 100_000, "de", "src1", 100_000),
    (5, "A plain text that stands here twice, with one id.", "fr", "src2", 49),
    (5, "A plain text that stands here twice, with one id.", "fr", "src2", 49),
    (5, "Another text of the same id, which is not a copy.", "fr", "src2", 49),
    (6, " \n\t\n ", "xx", "", -5),
    (7, "ünïcödé 漢字 \U0001f600 'll 12345   \n", "es", "src9", 20),
]
LABELS = "doc_id long, quality int, toxic int"
CLASHING = ["level", "bar", "stratum", "signals", "id", "th", "runs", "rid", "gone", "nth", "finish", "key", "source_name", "whole", "parts", "words", "n", "h1", "band", "head", "content", "first", "toxic", "score", "keep", "quality", "chosen"]


def extra(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (5, 1, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, LABELS).cache()


APPLIED = {
    "cotraining": lambda d, lab: cotraining.scored(d, lab),
    "line_dedup": lambda d, lab: line_dedup.drop_repeats(d),
    "secrets": lambda d, lab: secrets.scan(d, [(f, t) for f, t in secrets.labelled_examples(each=20)]),
    "toxicity": lambda d, lab: toxicity.scored(d, lab),
    "bpe": lambda d, lab: bpe.encode(d),
    "near_dedup": lambda d, lab: near_dedup.drop_near_duplicates(d),
    "quality_rules": lambda d, lab: quality_rules.judged(d, lab),
    "accepted": lambda d, lab: quality_rules.accepted(d, lab),
    "mixing": lambda d, lab: mixing.mixed(d, share=1.0),
    "fingerprints": lambda d, lab: fingerprints.differences(d),
}
#: Rows of the result over ROWS.
SIZES = {"cotraining": 11, "line_dedup": 11, "secrets": 1, "toxicity": 11, "bpe": 11, "near_dedup": 10, "quality_rules": 11, "accepted": 11, "mixing": 11, "fingerprints": 0}


@pytest.mark.parametrize("name", APPLIED)
def test_odd_rows(docs, labels, name):
    assert len(APPLIED[name](docs, labels).collect()) == SIZES[name]


@pytest.mark.parametrize("name", APPLIED)
def test_clashing_names(docs, labels, name):
    found = APPLIED[name](extra(docs), extra(labels.drop("quality", "toxic")).drop("quality", "toxic").withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0)))
    rows = found.collect()
    assert len(rows) == SIZES[name]
    if name in ("line_dedup", "bpe", "near_dedup", "accepted", "mixing"):
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)


@pytest.mark.parametrize("name", APPLIED)
def test_empty_tables(spark, docs, labels, name):
    none, no_labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert APPLIED[name](none, no_labels).collect() == []
    assert APPLIED[name](none, labels).collect() == []
    assert len(APPLIED[name](docs, no_labels).collect()) == SIZES[name]


def test_odd_rows_with_secrets(spark):
    """Rows of the result where there are hits: null ids, repeated rows and clashing names; a very long text is scanned to its end."""
    key = "AKIA" + "Q2W3E4R5T6Y7U8I9"
    rows = [(None, f"key={key}"), (1, f"key={key}"), (1, f"key={key}"), (2, None), (3, ""), (4, "word " * 50_000 + key + ".")]
    found = secrets.scan(extra(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(((r["doc_id"] or -1), r["nth"], r["candidate"], r["format"], r["is_secret"]) for r in found) == [(i, 0, key, "access_key_id", True) for i in (-1, 1, 1, 4)]
    assert found[0].asDict().keys() == {"doc_id", "nth", "candidate", "format", "score", "is_secret"}


def test_odd_rows_with_versions(spark):
    """As many shared paragraphs with several; repeated rows; null ids; clashing names; a very long document."""
    body = [f"paragraph {i}" for i in range(4)]
    long_ = [f"line {i}" for i in range(20_000)]
    rows = [(None, body), (1, [*body, "x"]), (1, [*body, "x"]), (2, [*body, "y"]), (3, [" ", ""]), (4, long_), (5, [*long_, "end"])]
    docs = extra(spark.createDataFrame([(i, "\n".join(t)) for i, t in rows] + [(6, None), (7, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in fingerprints.differences(docs).collect()}
    assert got.keys() == {1, 2, 5}
    assert (got[1]["previous_id"], len(got[1]["added"]), got[1]["removed"]) == (None, 1, [])
    assert got[2]["previous_id"] in (None, 1) and len(got[2]["added"]) == 1
    assert (got[5]["previous_id"], len(got[5]["added"]), got[5]["removed"]) == (4, 1, [])


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_urls(spark):
    pages = spark.createDataFrame([(1, None), (None, "http://a.example/x"), (2, ""), (3, "http://spam.example/x"), (3, "http://spam.example/x"), (4, "http://b.example/" + "y" * 20_000)], "page_id long, url string")
    found = url_model.filtered(pages.withColumn("gram", F.lit(1)).withColumn("key", F.lit(2)))
    assert found.count() == 6
    assert url_model.filtered(pages.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, labels, tmp_path, stage):
    name, run = corpus_pipeline.STAGES[stage]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for d in (docs, spark.createDataFrame([], SCHEMA), extra(docs)):
        found = run(spark, d, str(tmp_path))
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == d.columns
        found.collect()
