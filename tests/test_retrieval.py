import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import meta, text, vectors
from feedloom.operators import chunks, encoder, quantised, search


def loop_windows(s, size, overlap):
    s = " ".join(s.split())
    out, i = [], 0
    while True:
        out.append(s[i : i + size])
        if i + size >= len(s):
            return out
        i += size - overlap


@pytest.mark.parametrize("size,overlap", [(40, 10), (40, 0), (7, 6), (800, 120)])
def test_windows_equal_a_loop(spark, size, overlap):
    numbers = " ".join(str(i) for i in range(900))
    texts = ["", "a", "x" * size, "x" * (size + 1), numbers, "é ü\u3000ß\x1c" * 30, "  lead\n\n and\ttrail "]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {}
    for r in chunks.cut(df, "text", size, overlap).orderBy("n", "chunk_index").collect():
        got.setdefault(r["n"], []).append(r["text"])
    assert [got[i] for i in range(len(texts))] == [loop_windows(t, size, overlap) for t in texts]


def test_bad_windows():
    with pytest.raises(ValueError):
        text.check_window(10, 10)


def test_neighbours_share_the_overlap(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(200))),)], "text string")
    parts = [r["text"] for r in chunks.cut(df, "text", 40, 10).orderBy("chunk_index").collect()]
    assert all(a[-10:] == b[:10] for a, b in zip(parts, parts[1:]))


def test_ids_collapse_copies_and_upsert_overwrites(spark):
    df = spark.createDataFrame([("s", 0, "same"), ("s", 3, "same"), ("t", 1, "same")], "source string, row_index int, text string")
    named = chunks.with_ids(df, F.lit("u"))
    assert sorted((r["source"], r["row_index"]) for r in named.collect()) == [("s", 0), ("t", 1)]
    changed = named.where("source = 's'").withColumn("row_index", F.lit(9))
    assert sorted(r["row_index"] for r in chunks.upsert_chunks(named, changed).collect()) == [1, 9]


def test_context_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", 0, "A" * 1000), (1, 2, "b", 1, "B" * 1000), (1, 3, "c", 2, "C")],
        "query_id int, rank int, source string, row_index int, text string",
    )
    row = chunks.pack_context(df, limit_chars=1200).first()
    assert row["segments"] == 1 and row["context"].startswith("[1] source=a row=0\nAAAA")


def test_notes_first_limit_after_sort(spark):
    rows = [(f"id{i}", "row" if i else "note", "s", i if i else -1, f"t{i}") for i in range(20, -1, -1)]
    df = spark.createDataFrame(rows, "id string, type string, source string, row_index bigint, text string")
    top = chunks.list_chunks(df, "s", 3).collect()
    assert [(r["type"], r["row_index"]) for r in top] == [("note", -1), ("row", 1), ("row", 2)]


def test_edits_and_notes(spark):
    base = spark.createDataFrame([("s", 0, "one"), ("s", 1, "two")], "source string, row_index bigint, text string")
    stored = chunks.with_ids(base, F.lit("u")).withColumn("type", F.lit("sample_row"))
    target = stored.where("text = 'one'").first()["id"]
    edits = spark.createDataFrame([(target, "older", 1), (target, "newest", 2)], "id string, text string, edited_at int")
    texts = {r["id"]: r["text"] for r in chunks.apply_edits(stored, edits).collect()}
    assert texts[target] == "newest" and len(texts) == 2
    note = spark.createDataFrame([("u", "s", "remember")] * 2, "user_id string, source string, text string")
    assert chunks.add_notes(stored, note).where("type = 'note'").count() == 1


def test_edits_move_vectors_and_leave_the_others(spark):
    rows = [(i, "u", "s", i, t, [0.5, float(i)]) for i, t in enumerate(["one", "two", "three", None])]
    stored = spark.createDataFrame(rows, "id bigint, user_id string, source string, row_index int, text string, vector array<double>")
    edits = spark.createDataFrame(
        [(0, "older", 1), (0, "newest", 2), (1, "two", 1), (2, None, 1), (3, "filled", 1), (77, "nobody", 1)],
        "id bigint, text string, edited_at int",
    )

    def encode(df):
        return df.withColumn("vector", F.array(F.length("text").cast("double"), F.lit(-1.0)))

    after, changed = chunks.edited_vectors(stored, edits, encode)
    assert sorted(r["id"] for r in changed.collect()) == [0, 3]
    assert {r["id"]: (r["text"], r["vector"]) for r in after.collect()} == {
        0: ("newest", [6.0, -1.0]), 1: ("two", [0.5, 1.0]), 2: ("three", [0.5, 2.0]), 3: ("filled", [6.0, -1.0]),
    }
    assert after.columns == stored.columns
    same, none = chunks.edited_vectors(stored, edits.limit(0), encode)
    assert none.count() == 0 and sorted(same.collect()) == sorted(stored.collect())


def test_retrieval_packs_the_tenants_chunks(spark):
    rows = [(1, "a", "s", 0, "login failed"), (2, "b", "s", 1, "login failed again"), (3, "a", "t", 2, "invoice total"), (4, None, "t", 3, "login")]
    texts = spark.createDataFrame(rows, "id bigint, user_id string, source string, row_index int, text string")
    model = encoder.fit_encoder(texts, dim=256)
    questions = spark.createDataFrame([(7, "login failed")], "query_id bigint, text string")
    packed = chunks.retrieve(model.encode(texts), questions, model.encode, "a", k=2).collect()
    assert [(r["query_id"], r["segments"]) for r in packed] == [(7, 2)]
    assert packed[0]["context"].startswith("[1] source=s row=0\nlogin failed\n") and "again" not in packed[0]["context"]
    assert chunks.retrieve(model.encode(texts), questions, model.encode, "nobody").count() == 0


def test_row_index_zero_stays_zero(spark):
    df = spark.createDataFrame([('{"row_index": 0, "tags": ["a"]}',), ("{}",)], "m string")
    rows = df.select(meta.read_metadata(F.col("m")).alias("m")).select("m.*").collect()
    assert [(r["row_index"], r["type"], r["tags"]) for r in rows] == [(0, "excel", ["a"]), (-1, "excel", [])]


def brute(corpus, queries, k):
    out = {}
    for q, v in queries:
        scored = []
        for i, w in corpus:
            if w is None or len(w) != len(v):
                continue
            a, b = np.array(v, float), np.array(w, float)
            n = (np.linalg.norm(a) or 1e-12) * (np.linalg.norm(b) or 1e-12)
            scored.append((1 - float(a @ b) / n, i))
        out[q] = [i for _, i in sorted((round(d, 9), i) for d, i in scored)[:k]]
    return out


def vectors_frame(spark, rows, key):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} bigint, vector array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    corpus = [(i, list(rng.normal(size=8))) for i in range(300)]
    corpus += [(900, [0.0] * 8), (901, [1.0] * 5), (902, None), (903, corpus[5][1])]
    return corpus, [(i, list(rng.normal(size=8))) for i in range(9)] + [(50, corpus[5][1])]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_exact_neighbours_equal_brute_force(spark, cloud, monkeypatch):
    corpus, queries = cloud
    c, q = vectors_frame(spark, corpus, "id").repartition(5), vectors_frame(spark, queries, "query_id")
    assert found(search.nearest(c, q, 7)) == brute(corpus, queries, 7)
    # Several query blocks give the same result.
    monkeypatch.setattr(search, "BLOCK_BYTES", 3 * 8 * 8)
    assert found(search.nearest(c, q, 7)) == brute(corpus, queries, 7)
    # More neighbours than rows: all usable rows.
    assert len(found(search.nearest(c.limit(4), q, 10))[0]) <= 4


def test_zero_vector_and_wrong_length(spark):
    c = vectors_frame(spark, [(1, [0, 0]), (2, [1, 0]), (3, [1, 0, 0])], "id")
    q = vectors_frame(spark, [(1, [1, 0])], "query_id")
    rows = {r["id"]: r["distance"] for r in search.nearest(c, q, 5).collect()}
    assert rows == {2: 0.0, 1: 1.0}
    with pytest.raises(ValueError, match="differ in length"):
        search.nearest(c, vectors_frame(spark, [(1, [1, 0]), (2, [1])], "query_id"), 1)
    joined = c.select(F.round(vectors.cosine_distance(F.col("vector"), F.array(F.lit(1.0), F.lit(0.0))), 6)).collect()
    assert sorted(map(str, [r[0] for r in joined])) == ["0.0", "1.0", "None"]


def test_index_with_all_probes_is_exact(spark, cloud, tmp_path):
    corpus, queries = cloud
    path = str(tmp_path / "index")
    search.write_index(vectors_frame(spark, corpus, "id"), path, 8, bits=2)
    index, q = spark.read.parquet(path), vectors_frame(spark, queries, "query_id")
    near = search.nearest_in_index(index, q, 5, bits=2, probes=3)
    exact = search.nearest(vectors_frame(spark, corpus, "id"), q, 5)
    rates = [r["recall"] for r in search.recall(near, exact).collect()]
    assert len(rates) == len(queries) and sum(rates) / len(rates) > 0.6
    plan = index.where(F.col("cell").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


@pytest.mark.parametrize("rows", [500, 3000])
def test_fitted_cells_reach_nine_tenths_on_random_vectors(spark, tmp_path, rows):
    rng = np.random.default_rng(9)
    made = rng.normal(size=(rows, 64))
    corpus = vectors_frame(spark, [(i, v.tolist()) for i, v in enumerate(made)] + [(rows, [1.0])], "id")
    queries = vectors_frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 64)))], "query_id")
    centres, path = search.fit_centres(corpus, 64, cells=64), str(tmp_path / "index")
    assert centres.shape == (64, 64) and search.fit_centres(corpus.limit(0), 64).shape == (1, 64)
    search.write_index(corpus, path, 64, centres=centres)
    index = spark.read.parquet(path)
    assert index.count() == rows
    found = search.nearest_in_index(index, queries, 10, probes=40, centres=centres)
    rates = [r["recall"] for r in search.recall(found, search.nearest(corpus, queries, 10)).collect()]
    assert len(rates) == 20 and sum(rates) / 20 >= 0.9


def test_many_queries_need_one_scan_and_no_driver(spark, cloud, monkeypatch):
    corpus, queries = cloud
    c, q = vectors_frame(spark, corpus, "id").repartition(3), vectors_frame(spark, queries + [(70, None)], "query_id")
    monkeypatch.setattr(search, "BLOCK_BYTES", 5 * 8 * 8)
    near = search.nearest(c, q, 4)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and found(near) == brute(corpus, queries, 4)
    assert search.nearest(c, q.where("query_id < 0"), 4).count() == 0
    assert search.nearest(c.limit(0), q, 4).count() == 0


@pytest.mark.parametrize("rows", [500, 3000])
def test_quantised_index(spark, tmp_path, rows):
    rng = np.random.default_rng(5)
    made = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(rows, 64)))]
    odd = [(rows, [1.0]), (rows + 1, None), (rows + 2, [float("nan")] * 64), (rows + 3, [0.0] * 64), (rows + 4, made[7][1])]
    corpus = vectors_frame(spark, made + odd, "id")
    queries = vectors_frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 64)))] + [(90, made[7][1])], "query_id")
    path = str(tmp_path / "index")
    quantised.write_quantised(corpus, path, quantised.fit_codebook(corpus, 64))
    index = quantised.open_quantised(spark, path)
    assert index.codes(spark).count() == rows + 2 == index.vectors(spark).count()
    assert index.codes(spark).where("length(code) <> 16").count() == 0
    exact = search.nearest(corpus, queries, 10)
    near = quantised.nearest_quantised(index, queries, 10)
    rates = [r["recall"] for r in search.recall(near, exact).collect()]
    assert len(rates) == 21 and sum(rates) / 21 >= 0.9
    assert found(near)[90][:2] == [7, rows + 4]  # equal vectors: the smaller id first
    # A list as long as the index is the exact search.
    assert found(quantised.nearest_quantised(index, queries, 10, rows + 2)) == found(exact)
    assert "dynamicpruning" in quantised.nearest_quantised(index, queries, 10)._jdf.queryExecution().executedPlan().toString()


def test_quantised_index_of_few_rows(spark, tmp_path):
    corpus = vectors_frame(spark, [(1, [1, 0, 0]), (2, [0, 1, 0])], "id")
    queries = vectors_frame(spark, [(5, [1, 1, 0])], "query_id")
    index = quantised.write_quantised(corpus, str(tmp_path / "two"), quantised.fit_codebook(corpus, 3))
    assert found(quantised.nearest_quantised(index, queries, 5)) == {5: [1, 2]}
    none = corpus.limit(0)
    index = quantised.write_quantised(none, str(tmp_path / "none"), quantised.fit_codebook(none, 3), blocks=2)
    assert quantised.shortlist(index, queries, 5).count() == 0


def test_quantised_recall_does_not_fall_with_the_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    # twelve copies of each vector, so that a fixed short list holds four different ones
    made = np.repeat(rng.normal(size=(2500, 64)), 12, axis=0)
    corpus = vectors_frame(spark, [(i, v.tolist()) for i, v in enumerate(made)], "id")
    queries = vectors_frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 64)))], "query_id")
    index = quantised.write_quantised(corpus, str(tmp_path / "index"), quantised.fit_codebook(corpus, 64))
    exact = found(search.nearest(corpus, queries, 10))

    def recall(near):
        return sum(len(set(found(near)[q]) & set(exact[q])) for q in exact) / 200

    assert recall(quantised.rerank(index, quantised.shortlist(index, queries, 50), queries, 10)) < 0.9
    assert recall(quantised.nearest_quantised(index, queries, 10)) >= 0.98
    assert found(quantised.nearest_quantised(index, queries, 10, margin=None)) == exact


def test_rows_in_reach_by_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    corpus = vectors_frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))], "id")
    queries = vectors_frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 8)))], "query_id")
    index = quantised.write_quantised(corpus, str(tmp_path / "index"), quantised.fit_codebook(corpus.limit(20), 8, 2), blocks=2)
    bounded = queries.withColumn("bound", F.when(F.col("query_id") < 8, F.col("query_id") / 8))
    want = sorted(map(tuple, quantised.rows_in_reach(index, bounded).collect()))
    monkeypatch.setattr(search, "BLOCK_BYTES", 4 * 8 * 8)
    by_blocks = quantised.rows_in_reach(index, bounded)
    assert "CoGroup" in by_blocks._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, by_blocks.collect())) == want and len(want) > 60


def test_encoder_puts_like_texts_together(spark):
    docs = spark.createDataFrame(
        [(1, "login failed for user"), (2, "invoice total is wrong"), (3, "user login failed again"), (4, None)],
        "id bigint, text string",
    )
    model = encoder.fit_encoder(docs, dim=256)
    corpus = model.encode(docs)
    asked = model.encode(spark.createDataFrame([(1, "login failed")], "query_id bigint, text string")).select("query_id", "vector")
    assert set(found(search.nearest(corpus.select("id", "vector"), asked, 2))[1]) == {1, 3}
    own = encoder.encode_with(docs, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert own.where("id = 4").first()["vector"] == [0.0, 1.0]
