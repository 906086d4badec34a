"""The model against a plain Kneser-Ney reading of the same texts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL

from feedloom.llm import ngram_model
from feedloom.llm.ngram_model import discounts, score_texts, train
from feedloom.llm.queries import QUERIES


def plain_tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.words = Counter(w for t in texts for w in plain_tokens(t))
        self.levels = []
        grams = Counter()
        for t in texts:
            w = ["<s>"] * (order - 1) + plain_tokens(t)
            grams.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        for _ in range(order):
            totals = defaultdict(lambda: [0, 0, 0, 0])
            for g, c in grams.items():
                totals[g[:-1]][0] += c
                totals[g[:-1]][min(c, 3)] += 1
            kinds = Counter(grams.values())
            d = discounts(__import__("numpy").array([kinds[k] for k in (1, 2, 3, 4)]))
            self.levels.insert(0, (grams, totals, d))
            grams = Counter(g[1:] for g in grams)

    def p(self, gram):
        p = 1 / (len(self.words) + 1)
        for n, (grams, totals, d) in enumerate(self.levels, 1):
            tail = gram[len(gram) - n :]
            total = totals.get(tail[:-1])
            if total:
                c = grams.get(tail, 0)
                p = (max(c - d[min(c, 3)], 0) + sum(d[k] * total[k] for k in (1, 2, 3)) * p) / total[0]
        return p

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + plain_tokens(text)
        return sum(math.log10(self.p(tuple(w[i : i + self.order]))) for i in range(len(w) - self.order + 1))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_the_plain_model(spark, monkeypatch, order):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    texts += ["", None, "the the the THE", "unheard-of words entirely", "the the the THE", "of the " * 4000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train(frame.filter("doc_id % 3 <> 0"), order=order, shards=7)
    plain = Plain([t for i, t in enumerate(texts) if i % 3], order)
    assert (model.n_tokens, model.n_distinct) == (sum(plain.words.values()), len(plain.words))
    for r in score_texts(frame, model).collect():
        assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), rel=1e-9)


def test_query_base_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in docs}
    counts = Counter(w for r in docs if not out[r["doc_id"]] for w in plain_tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in QUERIES["op4_lm_scores"](spark, SMALL).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        tokens, got = plain_tokens(r["text"]), rows[r["doc_id"]]
        assert (got["n_tokens"], got["n_known"]) == (len(tokens), sum(w in counts for w in tokens))
        assert (got["held_out"], got["train_tokens"]) == (out[r["doc_id"]], n)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert got["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in rows.values() if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    import numpy as np

    texts = ["a b a c", "a b b", "c a b a b"]
    model = train(spark.createDataFrame([(t,) for t in texts], "text string"), order=2, shards=3)
    scorer = ngram_model.Scorer(model)
    words = np.unique(np.concatenate([ngram_model.tokens_of(t) for t in texts]))
    unknown = np.array([12345], np.uint64)
    for context in [*words, ngram_model.BEGIN, 999]:
        last = np.concatenate((words, unknown))
        rows = np.stack([np.full(len(last), context, np.uint64), last])
        assert scorer.probabilities(rows).sum() == pytest.approx(1.0)


def test_edges(spark):
    rows = [(None, "a b", 1.5), (1, None, 2.5), (1, None, 2.5), (2, "", 3.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    empty = train(docs.limit(0), shards=2)
    got = score_texts(docs, empty).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in got] == [
        (None, 3, 0, 0.0), (1, 1, 0, 0.0), (1, 1, 0, 0.0), (2, 1, 0, 0.0)
    ]
    assert score_texts(docs.limit(0), empty).count() == 0
