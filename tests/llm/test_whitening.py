"""Whitening against a plain reading in exact and extended arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL

from feedloom.llm.queries import QUERIES
from feedloom.llm.whitening import HIGH, refined_eigenvectors, whiten


def integers(vectors):
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]


def plain_covariance(x):
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    y = [[n * row[i] - s[i] for i in range(d)] for row in x]
    return s, np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_query_against_plain_arithmetic(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = integers([r["embedding"] for r in table])
    n, d = len(x), len(x[0])
    s, v = plain_covariance(x)
    values = np.linalg.eigh(v)[0][::-1]
    got = rows_of(QUERIES["op12_whitening"](spark, SMALL))
    assert set(got) == {r["vec_id"] for r in table} and all(sorted(g) == list(range(1, 33)) for g in got.values())
    for r, row in zip(table, x):
        mine = got[r["vec_id"]]
        assert {g["n"] for g in mine.values()} == {n}
        assert {g["deviation"] for g in mine.values()} == {sum((n * c - t) ** 2 for c, t in zip(row, s))}
    w = np.array([[got[r["vec_id"]][k]["whitened"] for k in range(1, 33)] for r in table])
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(row, s)] for row in x])
    for k in range(32):  # an eigenvector of v, up to its sign: what the rows' projections say about it
        own = np.linalg.lstsq(centred, w[:, k] * math.sqrt(values[k]), rcond=None)[0]
        assert np.abs(v @ own - values[k] * own).max() < 1e-9 * values[0] and abs(own @ own - 1) < 1e-9
    first = next(iter(got.values()))
    assert [first[k]["explained"] for k in range(1, 33)] == pytest.approx((values / np.trace(v))[:32].tolist(), rel=1e-9)
    error = np.abs(np.cov(w.T, bias=True) - np.eye(32)).max()
    assert first[1]["identity_error"] <= 1e-9 and error <= 1e-9


@pytest.mark.parametrize("kind", ["spread", "cluster", "equal", "tiny", "rank", "one"])
def test_refinement_reaches_double_precision(kind):
    rng = np.random.default_rng(5)
    d = 40 if kind != "one" else 1
    values = {
        "spread": np.linspace(1, 40, d), "cluster": 1 + np.repeat([0, 1e-7, 2e-7, 1], 10) + np.arange(d) * 1e-12,
        "equal": np.repeat([3.0, 2.0], d // 2), "tiny": np.logspace(-12, 3, d), "rank": np.r_[np.zeros(30), np.arange(1.0, 11)],
        "one": np.array([4.0]),
    }[kind]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(HIGH)
    for _ in range(4):
        q = q @ (np.asarray(1.5, HIGH) * np.eye(d, dtype=HIGH) - 0.5 * (q.T @ q))  # orthogonal in extended precision
    a = q @ np.diag(values.astype(HIGH)) @ q.T
    a = (a + a.T) / 2
    found, x, steps = refined_eigenvectors(a)
    top = values.max()
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-15 * top * d
    assert np.abs(x.T @ x - np.eye(d)).max() <= 1e-15
    assert np.abs(a @ x - x * found).max() <= 1e-15 * top * d
    assert steps <= 12
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    if d > 1:
        assert np.abs(single.T @ single - np.eye(d)).max() > 1e-9  # what there was to correct


def test_offsets_do_not_matter(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-100, 100, (60, 5))
    near = [(i, [float(c) / 64 for c in v], 0) for i, v in enumerate(base)]
    far = [(i, [float(c + 400_000) / 64 for c in v], 0) for i, v in enumerate(base)]
    schema = "vec_id long, embedding array<double>, component int"
    a, b = (rows_of(whiten(spark.createDataFrame(rows, schema))) for rows in (near, far))
    for i in range(60):
        for k in range(1, 6):
            assert a[i][k]["deviation"] == b[i][k]["deviation"] and a[i][k]["whitened"] == b[i][k]["whitened"]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (1, [1.0, 2.0]), (None, [3.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, whitened string, _id int")
    got = whiten(frame).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == [
        (False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (True, 0, 1), (True, 0, 2)
    ]
    assert {r["whitened"] for r in got if r["component"] == 2} == {0.0}  # two distinct rows have one direction
    assert {r["explained"] for r in got if r["component"] == 1} == {1.0} and {r["n"] for r in got} == {3}
    assert [r["vec_id"] for r in got if r["deviation"] == max(x["deviation"] for x in got)] == [None, None]
    one = whiten(frame.filter("vec_id = 1").limit(1)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    for empty in (frame.limit(0), frame.filter("vec_id = 2")):
        assert whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert whiten(empty).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<float>")).collect()
