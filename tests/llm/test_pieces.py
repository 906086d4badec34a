"""Sampled segmentations against the enumerated lattice, and exact round trips."""

from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from feedloom.llm import pieces
from feedloom.llm.pieces import MODEL, SPACE, Vocabulary, decode_ids, encode_pieces, marked, processor, sample_segmentations
from feedloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(MODEL)


def enumerated(text, vocabulary):
    """Log probability of every segmentation of a marked text."""
    p = vocabulary.processor
    pieces = {p.id_to_piece(i): i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    found = {}

    def go(at, ids, weight):
        if at == len(text):
            found[tuple(ids)] = weight
            return
        for end in range(at + 1, min(len(text), at + 16) + 1):
            if (i := pieces.get(text[at:end])) is not None:
                go(end, [*ids, i], weight + vocabulary.weights[i])
        if text[at] not in pieces:
            raw = text[at].encode()
            go(at + 1, [*ids, *vocabulary.bytes[list(raw)].tolist()], weight + vocabulary.byte_weight * len(raw))

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: w - total for ids, w in found.items()}


@pytest.mark.parametrize("text", ["ab aé\n", "the", "𝄞a b"])
def test_all_segmentations_with_their_probabilities(vocabulary, text):
    expected = enumerated(marked(text), vocabulary)
    got = sample_segmentations([text], len(expected) + 5, [3], vocabulary)[0]
    assert {tuple(ids.tolist()): pytest.approx(lp) for ids, lp, _ in got} == expected
    assert all(inclusion == 1.0 for _, _, inclusion in got)


def test_draws_are_without_replacement(vocabulary):
    text, n = "ab aé\n", 20_000
    expected = enumerated(marked(text), vocabulary)
    seen, horvitz = Counter(), 0.0
    for row in sample_segmentations([text] * n, 3, np.arange(n) * 7919, vocabulary):
        seen[tuple(tuple(ids.tolist()) for ids, _, _ in row)] += 1
        horvitz += sum(np.exp(lp) / inclusion for _, lp, inclusion in row)
    for triple in permutations(expected, 3):
        a, b, c = (np.exp(expected[t]) for t in triple)
        p = a * b / (1 - a) * c / (1 - a - b)
        assert abs(seen[triple] / n - p) < 5 * np.sqrt(p / n) + 1e-3
    assert horvitz / n == pytest.approx(1.0, abs=0.01)


def test_rows_do_not_depend_on_their_batch(vocabulary):
    texts = ["the quick brown fox", "jumps over\nthe dog", "", "the the the", "x" * 3000]
    whole = sample_segmentations(texts, 4, np.arange(5), vocabulary)
    for i, t in enumerate(texts):
        alone = sample_segmentations([t], 4, [i], vocabulary)[0]
        assert [a.tolist() for a, _, _ in alone] == [a.tolist() for a, _, _ in whole[i]]
        assert [x[1:] for x in alone] == [pytest.approx(x[1:]) for x in whole[i]]


def test_query_round_trips(spark):
    rows = QUERIES["op2_sentencepiece"](spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r["round_trip"] for r in rows)
    assert all(r["n_ids"] == len(processor(MODEL).encode(docs[r["doc_id"]])) for r in rows)


def test_samples_decode_to_their_texts(spark):
    texts = ["Hello  world\n\tx ", " a", "", None, "İx \xa0y", "ﬁ 𝄞 x", "é" * 5000, "trailing   ", f"a{SPACE}b"]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, samples int")
    rows = sorted(decode_ids(encode_pieces(docs, k=3)).collect(), key=lambda r: r["doc_id"] or 0)
    own = processor(MODEL)
    for r, t in zip(rows, texts):
        wanted = (t or "").replace(SPACE, " ")
        assert r["decoded"] == wanted
        assert [own.decode(list(s["ids"])) for s in r["samples"]] == [wanted] * len(r["samples"])
        assert len({tuple(s["ids"]) for s in r["samples"]}) == len(r["samples"])
    assert [len(r["samples"]) for r in rows if not r["text"]] == [1, 1]
    assert encode_pieces(docs.limit(0)).count() == 0


def test_clashing_names_and_decoded_texts(spark):
    rows = [(1, "a b  c", 5, "k", "t"), (2, None, 6, "k", "t"), (2, "", 6, "k", "t"), (None, "<s> é🙂 ▁", 7, "k", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int, _text string, ids string")
    coded = encode_pieces(docs, decoded="back")
    assert coded.columns == ["doc_id", "text", "_key", "_text", "ids", "samples", "back"]
    for r in coded.collect():
        assert r["back"] == (r["text"] or "").replace("▁", " ") and r["_key"] >= 5 and r["_text"] == "k"
    assert {tuple(r) for r in decode_ids(encode_pieces(docs)).select("text", "decoded").collect()} == {
        tuple(r) for r in coded.select("text", "back").collect()
    }
    assert encode_pieces(docs.limit(0), decoded="back").count() == 0


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "some words over and over, étrange 日本 " * 60_000)], "doc_id long, text string")
    (row,) = encode_pieces(docs, decoded="back").collect()
    assert row["back"] == row["text"] and len(row["samples"]) == 2 and len(row["ids"]) > 500_000


def test_chunks_known_from_batch_to_batch(spark, vocabulary, monkeypatch):
    texts = ["a  b ", " ", "", "x▁y", "<s> </s> <unk> <0x41>", "\u0000a \u2028b", "é \U0001F600  z\r\n\t q", "ab cd ab", "ab ef gh", "ab"] * 3
    own, known = processor(MODEL), pieces.KnownChunks(MODEL)
    monkeypatch.setattr(pieces, "KNOWN_CHUNKS", 6)
    alone = [sample_segmentations([t], 3, [i], vocabulary)[0] for i, t in enumerate(texts)]
    for start in range(0, len(texts), 4):  # chunks are forgotten and made anew
        batch = texts[start : start + 4]
        met = known.meet([pieces.chunks_of(t) for t in batch])
        ids, ends = known.encode(*met)
        assert [part.tolist() for part in np.split(ids, ends[:-1])] == own.encode(batch)
        drawn = pieces._sampled(known.lattices, *met, 3, np.arange(start, start + len(batch)))
        for row, expected in zip(drawn, alone[start : start + 4]):
            assert [s[0].tolist() for s in row] == [s[0].tolist() for s in expected]
            assert np.allclose([s[1:] for s in row], [s[1:] for s in expected])
    assert len(known.uses) < len({c for t in texts for c in pieces.chunks_of(t)}) + 6


def test_chunks_that_come_again_are_made_once(monkeypatch):
    made = []

    class Counted(pieces.Lattices):
        def __init__(self, chunks, vocabulary):
            made.extend(chunks)
            super().__init__(chunks, vocabulary)

    monkeypatch.setattr(pieces, "Lattices", Counted)
    monkeypatch.setattr(pieces, "BATCH_CHARS", 40)
    monkeypatch.setattr(pieces, "KNOWN_CHUNKS", 60)
    texts = [f"far{i % 25} once{i} a{i}b once{i}c" for i in range(100)]  # each far chunk comes again 25 texts later
    batches = list(pieces.known_batches(pa.array(texts), MODEL))
    assert len(batches) > 20 and [b[0] for b in batches] == [0, *(b[1] for b in batches[:-1])] and batches[-1][1] == 100
    assert sorted(made) == sorted({c for t in texts for c in pieces.chunks_of(t)})


@pytest.mark.parametrize("kept, chars", [(4, 10**9), (200_000, 30), (4, 30)])
def test_batches_that_know_what_is_to_come(vocabulary, monkeypatch, kept, chars):
    texts = ["a  b ", None, " ", "", "x▁y", " lead", "\u0000a \u2028b", "é \U0001F600  z\r\n\t q", "▁", "ab cd ab", "ab ef gh", "   ", "ab", None] * 3
    monkeypatch.setattr(pieces, "KNOWN_CHUNKS", kept)
    monkeypatch.setattr(pieces, "GROUP_CHARS", chars)
    monkeypatch.setattr(pieces, "BATCH_CHARS", 12)
    column = pa.array(["not in it  ", *texts, "nor▁this"]).slice(1, len(texts))
    seen = 0
    for start, end, known, met in pieces.known_batches(column, MODEL):
        assert start == seen
        seen = end
        ids, ends = known.encode(*met)
        assert [part.tolist() for part in np.split(ids, ends[:-1])] == processor(MODEL).encode([t or "" for t in texts[start:end]])
        drawn = pieces._sampled(known.lattices, *met, 3, np.arange(start, end))
        for i, row in enumerate(drawn, start):
            expected = sample_segmentations([texts[i] or ""], 3, [i], vocabulary)[0]
            assert [s[0].tolist() for s in row] == [s[0].tolist() for s in expected]
            assert np.allclose([s[1:] for s in row], [s[1:] for s in expected])
    assert seen == len(texts)


def test_steps_opened_late_change_nothing(vocabulary, monkeypatch):
    texts = ["the quick brown fox jumps over the lazy dog " * 40, "sure", "", "x" * 400, "etwas Längeres\nüber Wörter " * 20]
    whole = sample_segmentations(texts, 6, np.arange(5), vocabulary)
    for opened in (1, 10**6):
        monkeypatch.setattr(pieces, "OPENED", opened)
        for row, other in zip(whole, sample_segmentations(texts, 6, np.arange(5), vocabulary)):
            assert [(a.tolist(), *rest) for a, *rest in row] == [(a.tolist(), *rest) for a, *rest in other]
