"""Deleted lines against a plain search over all runs."""

import random
import re
from collections import Counter

import pytest
from conftest import SMALL

from feedloom.llm.line_dedup import dedup_lines
from feedloom.llm.queries import QUERIES


def plain_dedup(docs, min_words):
    """``docs``: (id, text), distinct and in order; every run of at least min_words words, the long way."""
    held = []
    for _, text in docs:
        lines = [(i, line, len(re.findall(r"[^\x20\x09-\x0D]+", line))) for i, line in enumerate((text or "").split("\n"))]
        held.append([x for x in lines if x[2]])
    once = Counter(x[1] for lines in held for x in lines)
    seen, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(held):
        for i in range(len(lines)):
            words, run = 0, []
            for j in range(i, len(lines)):
                if once[lines[j][1]] < 2:
                    break
                run.append(lines[j][1])
                words += lines[j][2]
                if words >= min_words:
                    if seen.setdefault(tuple(run), (d, i)) < (d, i):
                        gone[d].update(x[0] for x in lines[i : j + 1])
    out = []
    for (_, text), g in zip(docs, gone):
        out.append(None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in g))
    return out, [len(g) for g in gone]


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    texts, removed = plain_dedup(docs, 50)
    assert sum(removed)
    got = {r["doc_id"]: r for r in QUERIES["op3_line_dedup"](spark, SMALL).collect()}
    assert [got[i]["text"] for i, _ in docs] == texts
    assert [got[i]["n_removed"] for i, _ in docs] == removed
    assert [got[i]["n_lines"] for i, _ in docs] == [t.count("\n") + 1 for _, t in docs]


@pytest.mark.parametrize("min_words", [1, 5, 9])
def test_random_lines(spark, min_words):
    rng = random.Random(min_words)
    pool = ["a b c", "d", "e f", "", "  ", "g h i j", "a b", "x\ty z"]
    docs = []
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
        lines += [f"own line {i}"] * (rng.random() < 0.5)
        if i > 9 and rng.random() < 0.4:
            lines += rng.choice(docs[:9])[1].split("\n")
        docs.append((i, "\n".join(lines)))
    texts, removed = plain_dedup(docs, min_words)
    frame = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_removed int")
    got = dedup_lines(frame, min_words=min_words).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == removed
    assert [r["text"] for r in got] == texts


def test_nulls_repeats_and_empty(spark):
    long = "\n".join(f"line {i % 7} of the long text" for i in range(300))
    rows = [(2, "one two three\nfour five six"), (2, "one two three\nfour five six"), (None, "one two three\nfour five six"), (5, None), (6, ""), (7, long)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(frame, min_words=6).collect()]
    text = "one two three\nfour five six"
    seven = next(r for r in got if r[0] == 7)
    assert seven == (7, plain_dedup([(7, long)], 6)[0][0], 300, plain_dedup([(7, long)], 6)[1][0])
    assert sorted((r for r in got if r[0] != 7), key=str) == sorted(
        [(2, text, 2, 0), (2, text, 2, 0), (None, "", 2, 2), (5, None, 0, 0), (6, "", 1, 0)], key=str
    )
    assert dedup_lines(frame.limit(0)).count() == 0
