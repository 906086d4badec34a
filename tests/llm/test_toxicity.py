"""Forward-backward against enumeration, held-out accuracy, edge cases."""

import itertools

import numpy as np
import pytest
from conftest import ORACLE, SMALL

from feedloom.llm.queries import QUERIES
from feedloom.llm.toxicity import CHAIN, Emissions, Tagger, _all_chains, _chains, _pieces, fit, forward_backward, measure, score_toxicity, train_tagger, words_of


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    pairs = rng.normal(size=4)
    sizes = np.array([3, 1, 5])
    at, mask = _chains(sizes)
    emission = rng.normal(size=sizes.sum())
    marginals, expected = forward_backward(emission[at], mask, pairs)
    wanted_pairs = np.zeros(4)
    for chain, n in enumerate(sizes):
        e, total, p = emission[at[chain, :n]], 0.0, np.zeros(n)
        joint = np.zeros(4)
        for y in itertools.product((0, 1), repeat=int(n)):
            steps = [2 * a + b for a, b in zip(y, y[1:])]
            w = np.exp(sum(e[i] for i in range(n) if y[i]) + sum(pairs[s] for s in steps))
            total += w
            p += w * np.array(y)
            for s in steps:
                joint[s] += w
        assert marginals[chain, :n] == pytest.approx(p / total)
        wanted_pairs += joint / total
    assert expected == pytest.approx(wanted_pairs)
    assert not marginals[~mask].any()


def test_pieces_of_a_text_pass_messages(monkeypatch):
    rng = np.random.default_rng(6)
    sizes = [1, CHAIN, 5 * CHAIN + 3, 0, CHAIN + 1, 3 * CHAIN]
    emissions = [rng.normal(size=n) * 3 for n in sizes]
    tagger = Tagger(np.zeros(0), 0.0, rng.normal(size=4) * 2, np.zeros(3))
    full = [n for n in sizes if n]
    cut = [_all_chains(np.concatenate(emissions), *_chains(np.array(sizes)), _pieces(np.array(sizes)), tagger.pairs), *measure(tagger, emissions)]
    monkeypatch.setattr("feedloom.llm.toxicity.CHAIN", max(sizes))
    at, mask = _chains(np.array(full))
    whole, expected = forward_backward(np.concatenate(emissions)[at], mask, tagger.pairs)
    assert cut[0][0] == pytest.approx(whole[mask]) and cut[0][1] == pytest.approx(expected)
    assert cut[1] == pytest.approx(whole[mask])
    assert cut[2][[0, 1, 2, 4, 5], 0] == pytest.approx(whole.sum(axis=1)) and not cut[2][3].any()


def test_marginals_of_a_span_do_not_depend_on_its_place():
    pairs = np.array([2.0, -2.0, -2.0, 2.0])
    tagger = Tagger(np.zeros(0), 0.0, pairs, np.zeros(3))
    for place in range(100, 100 + CHAIN):
        emission = np.full(400, -1.0)
        emission[place : place + 3] = 3.0
        marginals, _ = measure(tagger, [emission])
        if place == 100:
            first = marginals[place - 5 : place + 8]
        assert marginals[place - 5 : place + 8] == pytest.approx(first, abs=1e-9)


def test_spans_and_scores_follow_the_words(spark):
    rng = np.random.default_rng(2)
    fill = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice(fill, 30))
        if i % 5 == 0:
            words[3:5] = ["vile", "rude"]
            words[20] = "vile"
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    tagger = fit(texts, labels, 0.2)
    probe = ["w1 w2 Vile RUDE w3 " + "w4 " * (2 * CHAIN) + "vile", "w1 w2 w3", None, "", "w5 vile"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(probe)] + [(1, "w1 w2 w3", "x")], "doc_id long, text string, toxic_spans string")
    rows = score_toxicity(docs, tagger).orderBy("doc_id").collect()
    assert [[(s["start"], s["end"]) for s in r["toxic_spans"]] for r in rows[:2]] == [[(6, 15), (len(probe[0]) - 4, len(probe[0]))], []]
    scores = {r["doc_id"]: r["toxicity"] for r in rows}
    assert scores[0] > 0.5 > scores[1] and scores[2] == scores[3] < 0.5 and len(rows) == 6
    assert score_toxicity(docs.limit(0), tagger).count() == 0


def test_batches_do_not_change_marginals():
    tagger = fit(["good day"] * 30 + ["vile day"] * 30, [0] * 30 + [1] * 30, 0.5)
    emissions = Emissions(tagger)
    texts = [words_of("vile day " * n) for n in (1, 50, 0, 200)]
    whole, found = measure(tagger, [emissions(t) for t in texts])
    alone = [measure(tagger, [emissions(t)]) for t in texts]
    assert whole == pytest.approx(np.concatenate([a[0] for a in alone]))
    assert found == pytest.approx(np.concatenate([a[1] for a in alone]))


def test_without_labels_all_scores_are_the_share(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["toxicity"] for r in score_toxicity(docs, train_tagger(docs, none)).collect()] == pytest.approx([1e-6] * 2)
    ones = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert [r["toxicity"] for r in score_toxicity(docs, train_tagger(docs, ones)).collect()] == pytest.approx([1 - 1e-6] * 2)


def test_held_out_accuracy(spark):
    found = QUERIES["op7_toxicity"](spark, ORACLE).join(spark.read.parquet(f"{ORACLE}/labels.parquet"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert QUERIES["op7_toxicity"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def labelled_texts(n, toxic_each):
    """``n`` different texts; every ``toxic_each``-th is toxic and says "vile", as one in twenty clean ones does."""
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        toxic = int(i % toxic_each == 0)
        words = [f"w{j}" for j in rng.integers(0, 300, 30)]
        if toxic or i % 20 == 1:
            words[5] = "vile"
        out.append((i, " ".join(words), toxic))
    return out


@pytest.mark.parametrize("toxic_each", [2, 3, 9])
def test_seeds_do_not_depend_on_the_mix_of_labels(toxic_each):
    rows = labelled_texts(360, toxic_each)
    tagger = fit([t for _, t, _ in rows], [label for *_, label in rows], 0.12)
    marginals, _ = measure(tagger, [Emissions(tagger)(words_of("w1 w2 vile w3"))])
    assert marginals[2] > 0.5 > marginals[[0, 1, 3]].max()


def test_sample_is_filled_with_different_short_texts(spark, monkeypatch):
    rows = labelled_texts(300, 4)
    rows += [(1000 + i, "one clean text", 0) for i in range(400)] + [(2000 + i, f"vile {i} " + "x" * 400, 1) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr("feedloom.llm.toxicity.fit", lambda texts, labels, share: seen.update(texts=texts, labels=labels, share=share))
    train_tagger(docs, labels, max_toxic=60, max_clean=120, max_chars=300)
    assert sum(seen["labels"]) == 60 and len(seen["labels"]) == 180 == len(set(seen["texts"]))
    assert max(map(len, seen["texts"])) <= 300 and seen["share"] == pytest.approx(375 / 1000)
    truth = {t: label for _, t, label in rows}
    assert [truth[t] for t in seen["texts"]] == seen["labels"]
