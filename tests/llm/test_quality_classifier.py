"""The classifier against a plain, one-feature-at-a-time reading of the method."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ORACLE

from feedloom.llm import quality_classifier as qc
from feedloom.llm.hash_arrays import mix
from feedloom.llm.quality_classifier import Settings, form_of, score_quality, train_classifier
from feedloom.llm.queries import QUERIES


def plain_features(text):
    words = re.findall(r"\w+|[^\w\s]+", text or "")
    lower = [w.lower() for w in words]
    forms = [form_of(w) for w in words]
    forms = ["=" if i and lower[i] == lower[i - 1] else f for i, f in enumerate(forms)]
    counts = Counter()
    for items, longest, kind, seed in ((lower, 2, 10, 1), (forms, 3, 20, 2)):
        for n in range(1, longest + 1):
            for i in range(len(items) - n + 1):
                h = np.full(1, kind + n, np.uint64)
                for item in items[i : i + n]:
                    h = mix(np.array([qc._hash(item, seed)], np.uint64), h)
                counts[int(h[0]) >> (64 - qc.BITS)] += 1
    norm = math.sqrt(sum(counts.values()))
    return {p: math.sqrt(c) / norm for p, c in counts.items()}


def plain_weight(z, n, s):
    return 0.0 if abs(z) <= s.l1 else -(z - math.copysign(s.l1, z)) / ((s.beta + math.sqrt(n)) / s.alpha + s.l2)


def plain_score(features, state, offset, s):
    total = offset + sum(plain_weight(*state.get(p, (0.0, 0.0)), s) * v for p, v in {**features, qc.PLACES: 1.0}.items())
    return 1 / (1 + math.exp(-total))


def plain_training(shards, offset, s):
    shared = {}
    for _ in range(s.rounds):
        met = {}
        for texts in shards:
            own = dict(shared)
            for features, label in texts:
                slope = plain_score(features, own, offset, s) - label
                for p, v in {**features, qc.PLACES: 1.0}.items():
                    z, n = own.get(p, (0.0, 0.0))
                    g = slope * v
                    sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / s.alpha
                    own[p] = (z + g - sigma * plain_weight(z, n, s), n + g * g)
            for p, state in own.items():
                if state[1] != shared.get(p, (0.0, 0.0))[1]:
                    met.setdefault(p, []).append(state)
        shared.update({p: tuple(np.mean(states, axis=0)) for p, states in met.items()})
    return shared


TEXTS = [
    "Good words here, and more of them.", "BAD!! BAD!! BAD!! TEXT!!", "The river runs 42 miles.", "Buy buy buy buy now now", "x " * 50, "",
    None, "One two three four", "SHOUTING$$$ all*** the### time%%%", "A plain sentence about a house.", "été Été ÉTÉ ß", "Good words here, and more of them.",
]
LABELS = [1, 0, 1, 0, 0, 0, 1, 1, 0, 1, 1, 0]


@pytest.mark.parametrize("shard_texts", [100, 4])
def test_scores_match_the_plain_method(spark, monkeypatch, shard_texts):
    monkeypatch.setattr(qc, "SHARD_TEXTS", shard_texts)
    s = Settings(rounds=3)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(LABELS)), "doc_id long, quality int")
    model = train_classifier(docs, labels, settings=s)
    assert model.share == pytest.approx(0.5)
    means = {}
    for text, label in zip(TEXTS, LABELS):
        means.setdefault(text or "", []).append(label)
    places = {r["text"]: r["p"] for r in docs.selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) p").collect()}
    k = -(-len(TEXTS) // shard_texts)
    shards = [[] for _ in range(k)]
    for text in sorted(means, key=places.get):
        shards[places[text] % k].append((plain_features(text), float(np.mean(means[text]))))
    state = plain_training(shards, 0.0, s)
    for r in score_quality(docs, model).collect():
        assert r["quality_score"] == pytest.approx(plain_score(plain_features(r["text"]), state, 0.0, s), abs=1e-4)


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op13_quality"](spark, ORACLE).collect()}
    docs = spark.read.parquet(f"{ORACLE}/documents.parquet")
    assert set(rows) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{ORACLE}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[i]["score"], y) for i, y in labels.items() if rows[i]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.97
    assert np.mean([s >= 0.3 for s in good]) >= 0.98


def test_labels_do_not_leak(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "alpha beta")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["quality_score"] for r in score_quality(docs, train_classifier(docs, labels)).collect()}
    assert got[1] == got[3] > got[2]


def test_edges(spark):
    rows = [(None, "a b", 1.5, 7), (1, None, 2.5, 7), (1, None, 2.5, 7), (2, "", 3.5, 7), (3, " \n", 4.5, 7), (4, "lang word " * 300_000, 0.0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score double, place int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None), (4, 5)], "doc_id long, quality int")
    for usable, share in ((labels, 0.5), (labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0)):
        model = train_classifier(docs, usable)
        scored = score_quality(docs, model)
        assert scored.columns == ["doc_id", "text", "place", "quality_score"]
        got = scored.collect()
        assert len(got) == 6 and model.share == share and all(0 <= r["quality_score"] <= 1 for r in got)
        assert len({r["quality_score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert score_quality(docs.limit(0), train_classifier(docs.limit(0), labels)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    assert qc.training_texts(docs, labels, "doc_id", "text", "quality", 5000)[0].count() == 2000
    assert 400 < qc.training_texts(docs, labels, "doc_id", "text", "quality", 500)[0].count() < 600
