"""Counts against the encoder, and block scans against a plain reading of the files."""

import numpy as np
import pytest
from conftest import SMALL

from feedloom.llm.hash_arrays import new_file
from feedloom.llm.queries import QUERIES
from feedloom.llm.token_counts import VOCABULARY, encoding, scan_token_files, token_counts


def test_query_matches_the_encoder(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    encode = encoding(VOCABULARY).encode_ordinary
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op6_token_counts"](spark, SMALL).collect()}
    assert got == {r["doc_id"]: len(encode(r["text"])) for r in docs}


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    expected = []
    for f in range(4):
        ids = rng.choice(np.array([7, 8, 9], "<u2"), 200 if f else 0, p=[0.3, 0.4, 0.3])
        if f == 2:
            ids[:90] = 8  # a document over many blocks
        if f == 3:
            ids[-1] = 7
        with new_file(str(tmp_path), f"f{f}") as out:
            out.write(ids.tobytes())
        start, ordinal = 0, 0
        for at in np.flatnonzero(ids == 7).tolist():
            expected.append((f"f{f}", ordinal, start, at - start, True))
            start, ordinal = at + 1, ordinal + 1
        if start < len(ids):
            expected.append((f"f{f}", ordinal, start, len(ids) - start, False))
    rows = scan_token_files(spark, str(tmp_path), end=7, block_tokens=block).collect()
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_odd_size_is_an_error(spark, tmp_path):
    with new_file(str(tmp_path), "odd") as out:
        out.write(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        scan_token_files(spark, str(tmp_path)).collect()


def test_nulls_empty_long_and_repeated(spark):
    long = "word <|endoftext|> " * 20_000
    rows = [(1, None, "a"), (None, "one two", "a"), (2, "", "b"), (2, "", "b"), (3, long, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    size = {t: len(encoding(VOCABULARY).encode_ordinary(t or "")) for _, t, _ in rows}
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts(docs, block_tokens=1000).collect()]
    assert sorted(got, key=str) == sorted(((i, size[t]) for i, t, _ in rows), key=str)
    assert token_counts(docs.limit(0)).count() == 0
