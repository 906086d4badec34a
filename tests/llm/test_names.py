"""Columns called like the operators' own: kept as they are, and without effect."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm.decontaminate import decontaminate
from feedloom.llm.line_dedup import dedup_lines
from feedloom.llm.ngram_model import score_texts, train
from feedloom.llm.toxicity import FEATURE_BITS, Tagger, score_toxicity
from feedloom.llm.url_filter import judge_urls
from feedloom.llm.words import set_aside

OWN = ["_row", "_lines", "_gone", "_gone_id", "_text_hash", "_key", "_text", "_found", "_words", "_won", "_id", "_kept", "user_row"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 30")
    return table.select("*", *(F.concat(F.lit(f"{name}-"), F.col("doc_id")).alias(name) for name in OWN))


def same_but_for_names(docs, apply):
    """The operator's rows with and without the clashing columns."""
    plain = {r["doc_id"]: r.asDict() for r in apply(docs.drop(*OWN)).collect()}
    found = apply(docs)
    for r in found.collect():
        row = r.asDict()
        for name in OWN:
            if name in row:
                assert row.pop(name) == f"{name}-{row['doc_id']}"
        assert row == plain[row["doc_id"]]
    return found.columns


def test_lines(docs):
    assert set(OWN) <= set(same_but_for_names(docs, dedup_lines))


def test_toxicity(docs):
    weights = np.random.default_rng(1).normal(size=1 << FEATURE_BITS).astype(np.float32)
    tagger = Tagger(weights, -1.0, np.zeros(4), np.array([-1.0, 0.5, 1.0]))
    assert set(OWN) <= set(same_but_for_names(docs, lambda d: score_toxicity(d, tagger)))


def test_scores(docs):
    model = train(docs.select("text"), order=2, shards=2)
    assert set(OWN) <= set(same_but_for_names(docs, lambda d: score_texts(d, model)))


def test_urls(spark, docs):
    rules = spark.createDataFrame([("org", "/", "block", 0)], "host string, path string, verdict string, tier int")
    pages = docs.withColumn("url", F.concat(F.lit("http://a.org/"), F.col("doc_id")))
    assert set(OWN) <= set(same_but_for_names(pages, lambda d: judge_urls(d, rules)))


def test_benchmark(spark, docs):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(3)
    found = decontaminate(docs.limit(5), items, keep=("_row", "doc_id", "_kept"))
    assert found.columns[:3] == ["_row", "doc_id", "_kept"]
    assert all(r["_row"] == f"_row-{r['doc_id']}" for r in found.collect())


def test_near_duplicate_stage(spark, docs):
    same_but_for_names(docs, lambda d: corpus_pipeline.drop_near_duplicates(spark, d, SMALL))


def test_names_are_given_back(docs):
    renamed, back, (text, own) = set_aside(docs, "text", "_text")
    assert text == "text" and back[own] == "_text" and not any(c.startswith("_") for c in renamed.columns)
    assert renamed.withColumnsRenamed(back).columns == docs.columns


def test_one_very_long_text(spark):
    """A text of several megabytes beside a short one."""
    line = "one line of some words that comes again and again here\n"
    docs = spark.createDataFrame([(1, line * 50_000), (2, "short")], "doc_id long, text string")
    tagger = Tagger(np.zeros(1 << FEATURE_BITS, np.float32), -3.0, np.zeros(4), np.array([0.0, 0.1, 0.0]))
    scores = {r["doc_id"]: r["toxic_tokens"] for r in score_toxicity(docs, tagger).collect()}
    assert scores[1] > 10_000 * scores[2] > 0
