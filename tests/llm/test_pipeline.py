"""The pipeline's stages against plain versions of their decisions."""

import re

import pytest
from conftest import SMALL
from test_line_dedup import plain_dedup
from test_simhash import plain_components, plain_fingerprint

import __spark_entry__ as entry_points
import corpus_pipeline
from feedloom.llm.pieces import MODEL, processor
from feedloom.llm.toxicity import score_toxicity, train_tagger


def plain_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def windows(text):
    words = plain_words(text)
    n = min(10, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_and_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    names = entry_points.queries()
    assert names["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_toxicity_stage(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    scores = {r["doc_id"]: r["toxicity"] for r in score_toxicity(docs, train_tagger(docs, labels)).collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert set(by_id(kept)) == {i for i, s in scores.items() if s < 0.5}


def test_line_dedup_stage(spark, docs):
    rows = sorted(by_id(docs).items())
    texts, _ = plain_dedup([(i, r["text"]) for i, r in rows], 50)
    got = by_id(corpus_pipeline.drop_repeated_lines(spark, docs, SMALL))
    assert [got[i]["text"] for i, _ in rows] == texts
    assert [got[i]["n_chars"] for i, _ in rows] == list(map(len, texts))


def test_near_duplicate_stage(spark, docs):
    classes = plain_components({i: plain_fingerprint(r["text"]) for i, r in by_id(docs).items()})
    got = by_id(corpus_pipeline.drop_near_duplicates(spark, docs, SMALL))
    assert set(got) == set(classes.values())
    twice = docs.filter("doc_id < 20").union(docs.filter("doc_id < 20"))
    assert corpus_pipeline.drop_near_duplicates(spark, twice, SMALL).count() == len(
        set(plain_components({i: plain_fingerprint(r["text"]) for i, r in by_id(twice).items()}).values())
    )


def test_decontamination_stage(spark, docs):
    items = [windows(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    wanted = set().union(*items)
    sizes = {len(w) for w in wanted}

    def clean(text):
        words = plain_words(text)
        return not any(tuple(words[i : i + n]) in wanted for n in sizes for i in range(len(words) - n + 1))

    got = set(by_id(corpus_pipeline.drop_contaminated(spark, docs, SMALL)))
    assert got == {i for i, r in by_id(docs).items() if clean(r["text"])} and len(got) < docs.count()


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(r["round_trip"] and len(r["ids"]) == r["n_ids"] for r in rows)
    own = processor(MODEL)
    assert all(own.decode(list(s["ids"])) == own.decode(list(r["ids"])) for r in rows for s in r["samples"])


def test_stages_take_empty_and_null_documents(spark, docs):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "one two three", None, "s", 13)]
    odd = spark.createDataFrame(rows, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SMALL).count() == 0, name
        assert stage(spark, odd, SMALL).count() == (2 if name == "simhash" else 4), name
