"""Near-duplicates against all pairs, and fingerprints against a plain reading of their definition."""

import random
import re

import numpy as np
import xxhash
from conftest import SMALL

from feedloom.llm import simhash
from feedloom.llm.queries import QUERIES
from feedloom.llm.simhash import fingerprint, near_duplicates, near_links


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable; ``prints``: id -> fingerprint."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 4):
            a, b = find(i), find(ids[k + 1 + j])
            part[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    expected = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    classes = plain_components(expected)
    rows = QUERIES["op8_simhash"](spark, SMALL).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in expected.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre, 0, (1 << 64) - 1}
    for _ in range(700):  # a cloud around one centre, chains, and strangers
        x = centre if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    expected = plain_components({p: p for p in prints})
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(rows, "fingerprint long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in near_links(frame).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    part = {p: p for p in prints}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == expected


def test_large_runs_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2000, 3)).astype(np.uint64)
    prints = np.unique(base[rng.integers(0, 40, 2000)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    monkeypatch.setattr(simhash, "RUN_PAIRS", 16)
    a, b = simhash._run_links(prints, 4)
    expected = plain_components({int(p): int(p) for p in prints})
    part = {int(p): int(p) for p in prints}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for x, y in zip(prints[a].tolist(), prints[b].tolist()):
        x, y = find(x), find(y)
        part[max(x, y)] = min(x, y)
    assert {p: find(p) for p in part} == expected


def test_nulls_empty_long_and_repeated(spark):
    long = "alpha beta gamma delta " * 30_000
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \n\t", None), (4, "One two", "x"), (5, "one  TWO", "x"), (5, "one  TWO", "x"),
        (None, "one two", "x"), (7, long, "x"), (8, "Élan élan un deux", "x"), (9, "élan élan un deux", "x"), (None, "zq", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted(
        [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, 4), (7, 7), (8, 8), (9, 9), (None, None)], key=str
    )
    assert fingerprint(long) == plain_fingerprint(long)
    assert near_duplicates(docs.limit(0)).count() == 0
