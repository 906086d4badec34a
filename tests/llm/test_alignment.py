"""Alignment against a plain reading, token pair by token pair; the perfect hash against dictionaries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from feedloom.llm import alignment, perfect_hash
from feedloom.llm.alignment import BYTE_MODEL, PIECE_MODEL, align_tokenizers, count_pairs, encode_both, pair_table
from feedloom.llm.queries import QUERIES
from feedloom.session import materialize


def plain_encodings(texts):
    """Ids and byte ranges of both tokenizers, by the libraries that own the files."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(BYTE_MODEL)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=PIECE_MODEL)
    letters = alignment.byte_alphabet()
    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        a_bytes = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        b = second.encode(text or "")
        pieces = [second.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[1:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        fine = text and b"".join(a_bytes) == whole == b"".join(b_bytes)
        out.append(([], []) if not fine else (ranges(a, a_bytes), ranges(b, b_bytes)))
    return out


def ranges(ids, parts):
    at, out = 0, []
    for i, part in zip(ids, parts):
        out.append((i, at, at + len(part)))
        at += len(part)
    return out


def plain_links(a, b):
    return [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]


def plain_groups(a, b):
    common, out = {x[2] for x in a} & {y[2] for y in b}, []
    a, b = iter(a), iter(b)
    for _ in common:
        sides = []
        for side in (a, b):
            own = []
            for token in side:
                own.append(str(token[0]))
                if token[2] in common:
                    break
            sides.append(",".join(own))
        out.append("|".join(sides))
    return out


def plain_alignment(texts):
    coded = plain_encodings(texts)
    links = [plain_links(a, b) for a, b in coded]
    counts = Counter(pair for own in links for pair in own)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for (a, b), own in zip(coded, links):
        groups = plain_groups(a, b)
        rows.append((len(a), len(b), len(groups), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), ";".join(groups)))
    return rows, counts


ODD = [
    None, "", " ", "a", "  two  spaces ", "<|endoftext|> <s> </s> <unk> plain", "été naïve 日本語 🙂 Ⅷ½", "▁ mark", "line\nline\ttab\r\n",
    "\x00\x01 control", "don't DON'T we'll", "x" * 300, "١٢٣ ٤", "ﬁ ligature Å Å", "a", "a", " 　wide", "é combining ​ zero",
]


def test_odd_texts_match_the_plain_reading(spark):
    rows = [(i if i else None, t, 7) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(3)
    expected, counts = plain_alignment(ODD)
    got = {r["doc_id"] or 0: tuple(r)[1:] for r in align_tokenizers(docs).collect()}
    assert [got[i] for i in range(len(ODD))] == expected
    assert expected[5][0] > 10 and sum(bool(e[0]) for e in expected) >= 12
    table = pair_table(spark, count_pairs(materialize(encode_both(docs, "doc_id", "text"), "t"))).collect()
    assert {(r["a"], r["b"]): r["count"] for r in table} == counts


@pytest.mark.parametrize("fan, held", [(16, 1_500_000), (2, 40)])
def test_query_matches_the_plain_reading(spark, monkeypatch, fan, held):
    monkeypatch.setattr(alignment, "FAN", fan)
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 700")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    expected, _ = plain_alignment([t for _, t in texts])
    got = {r["doc_id"]: tuple(r)[1:] for r in align_tokenizers(docs.repartition(11, "doc_id")).collect()}
    assert [got[i] for i, _ in texts] == expected


def test_query_columns(spark):
    rows = QUERIES["op11_alignment"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert set(rows[0].asDict()) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in sorted(rows, key=lambda r: r["doc_id"])[:40]:
        a, b = plain_encodings([texts[r["doc_id"]]])[0]
        groups = plain_groups(a, b)
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), len(groups), len(a) + len(b) - len(groups))
        assert r["groups_sha256"] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")


def test_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "a long text " * 200_000), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in align_tokenizers(docs).collect()}
    assert rows[1]["n_links"] == rows[1]["n_a"] + rows[1]["n_b"] - rows[1]["n_groups"] and rows[1]["n_links"] >= 600_000
    assert tuple(rows[2])[1:] == (0, 0, 0, 0, 0, 0, "")
    for empty in (docs.limit(0), docs.filter("doc_id = 2")):
        assert align_tokenizers(empty).count() == empty.count()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n, tmp_path):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    made = perfect_hash.build(keys)
    assert sorted(made.numbers(keys).tolist()) == list(range(n))
    perfect_hash.save(str(tmp_path), "x", keys)
    made, stored = perfect_hash.load(str(tmp_path), "x")
    assert np.array_equal(stored[perfect_hash.verified(made, stored, keys)], keys)
    others = np.setdiff1d(np.random.default_rng(9).integers(0, 1 << 63, 1000).astype(np.uint64), keys)
    assert (perfect_hash.verified(made, stored, others) == -1).all()
    assert perfect_hash.load(str(tmp_path), "y") is None
    if n >= 1000:
        assert 64 * len(made.bits) / n < 6
