"""Nearest neighbours over a vector table, by cosine distance.

Query vectors of a proven size are broadcast and the corpus never moves: every
task scores its batches with a matrix product and hands on at most k rows per
query. Beyond that size queries and corpus meet as blocks: each block of queries
is replicated to every block of the corpus by an equi-join on block numbers, so
that the corpus is still scanned once and no query passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import session
from feedloom.functions.vectors import TINY_NORM
from feedloom.operators.profile import top_by

#: Bytes of query vectors shipped to every executor at a time, and of a block of corpus or queries beyond that.
BLOCK_BYTES = 32 * 1024 * 1024

RESULT_SCHEMA = "query_id bigint, id bigint, distance double"


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, TINY_NORM, lengths)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) blocks of bounded size, streamed one at a time.

    The first vector sets the length; one of another length is an error.
    """
    ids: list[int] = []
    vectors: list[list[float]] = []
    dim = None
    for row in queries.where(F.col("vector").isNotNull()).toLocalIterator(prefetchPartitions=True):
        dim = dim or len(row[1])
        if len(row[1]) != dim:
            raise ValueError(f"query vectors differ in length: {dim} and {len(row[1])}")
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) * dim * 8 >= BLOCK_BYTES:
            yield np.array(ids), np.array(vectors, dtype=np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors, dtype=np.float64)


def _best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> pd.DataFrame:
    """The k smallest (distance, id) per query position."""
    order = np.lexsort((ids, distance, query))
    query, ids, distance = query[order], ids[order], distance[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.array([], int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = rank < k
    return pd.DataFrame({"q": query[keep], "id": ids[keep], "distance": distance[keep]})


def unit_rows(column: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have the length, their vectors scaled to length one)."""
    sized = np.array([v is not None and len(v) == dim for v in column], dtype=bool)
    if not sized.any():
        return sized, np.zeros((0, dim))
    return sized, _unit(np.stack(column[sized].to_numpy()).astype(np.float64))


#: Turns a column of stored vectors into (usable rows, matrix); quantised codes bring their own.
Reader = Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]


def _no_rows() -> pd.DataFrame:
    return pd.DataFrame({"q": np.array([], int), "id": np.array([], np.int64), "distance": []})


def _nearer(best: pd.DataFrame, row_ids: np.ndarray, rows: np.ndarray, unit: np.ndarray, k: int, allowed=None) -> pd.DataFrame:
    """The k best rows per query position of those found so far and ``rows``."""
    # Slices keep the score matrix small whatever the block and batch sizes.
    step = max(1, 4_000_000 // len(unit))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        distance = 1.0 - rows[part] @ unit.T
        if allowed is not None:
            distance = np.where(allowed(part), distance, np.inf)
        distance = np.where(np.isnan(distance), np.inf, distance)
        n = min(k, distance.shape[0])
        near = np.argpartition(distance, n - 1, axis=0)[:n]
        worst = np.take_along_axis(distance, near, 0).max(axis=0)
        r, q = np.nonzero((distance <= worst) & np.isfinite(distance))
        found = pd.DataFrame({"q": q, "id": row_ids[part][r], "distance": distance[r, q]})
        both = pd.concat([best, found]) if len(best) else found
        best = _best(both["q"].to_numpy(), both["id"].to_numpy(), both["distance"].to_numpy(), k)
    return best


def _named(best: pd.DataFrame, query_ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query_ids[best["q"].to_numpy(int)], "id": best["id"], "distance": best["distance"]})


def _scan(corpus: DataFrame, block, k: int, probes=None, cell_of=None, read: Reader | None = None) -> DataFrame:
    """Per task the k best corpus rows of each query in the block."""
    ids, vectors = block
    read = read or partial(unit_rows, dim=vectors.shape[1])
    shipped = corpus.sparkSession.sparkContext.broadcast((ids, _unit(vectors), probes, cell_of))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, unit, cells, place = shipped.value
        best = _no_rows()
        for batch in batches:
            usable, rows = read(batch["vector"])
            allowed = None
            if place is not None and len(rows):
                own = place(rows)
                allowed = lambda part: (own[part, None, None] == cells[None, :, :]).any(axis=2)
            best = _nearer(best, batch["id"].to_numpy()[usable], rows, unit, k, allowed)
        yield _named(best, query_ids)

    return corpus.mapInPandas(score, RESULT_SCHEMA)


def _by_blocks(corpus: DataFrame, queries: DataFrame, dim: int, count: int, row_bytes: int, score, schema: str = RESULT_SCHEMA) -> DataFrame:
    """``score`` (rows, asked) of every pair of blocks.

    A row's block follows from its content, so a task that runs again deals the same rows. Both numbers
    of blocks follow from counts; a group holds one block of each side.
    """
    n_corpus = max(1, -(-corpus.count() * row_bytes // BLOCK_BYTES))
    n_queries = max(1, -(-count * dim * 8 // BLOCK_BYTES))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        number = F.pmod(F.xxhash64(*df.columns), F.lit(n_own)).alias(own)
        return df.select("*", number, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    left = dealt(corpus, "corpus_block", n_corpus, "query_block", n_queries).groupBy("corpus_block", "query_block")
    right = dealt(queries, "query_block", n_queries, "corpus_block", n_corpus).groupBy("corpus_block", "query_block")
    return left.cogroup(right).applyInPandas(score, schema)


def _best_of_block(k: int, dim: int, read: Reader):
    """Scores a pair of blocks: the k best corpus rows of each query."""

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return _named(_no_rows(), np.array([], np.int64))
        usable, matrix = read(rows["vector"])
        _, unit = unit_rows(asked["vector"], dim)
        return _named(_nearer(_no_rows(), rows["id"].to_numpy()[usable], matrix, unit, k), asked["query_id"].to_numpy())

    return score


def _query_size(queries: DataFrame) -> tuple[int, int]:
    """(length, number) of the query vectors, which must have one length."""
    size = F.size("vector")
    least, dim, count = queries.agg(F.min(size), F.max(size), F.count(F.lit(1))).first()
    if least != dim:
        raise ValueError(f"query vectors differ in length: {least} and {dim}")
    return dim, count


def search_rows(corpus: DataFrame, queries: DataFrame, k: int, read: Reader | None = None, row_bytes: int | None = None) -> DataFrame:
    """:func:`nearest` over any stored form of the vectors: ``read`` turns the column into a matrix.

    ``corpus`` is (id, vector), ``queries`` (query_id, vector). All query vectors must have one length.
    """
    queries = queries.where(F.col("vector").isNotNull())
    dim, count = _query_size(queries)
    if not count:
        return queries.sparkSession.createDataFrame([], RESULT_SCHEMA + ", rank int")
    if count * dim * 8 <= BLOCK_BYTES:
        asked = queries.collect()  # at most BLOCK_BYTES of vectors
        block = np.array([r[0] for r in asked]), np.array([r[1] for r in asked], dtype=np.float64)
        return _best_rows(_scan(corpus, block, k, read=read), k)
    read = read or partial(unit_rows, dim=dim)
    return _best_rows(_by_blocks(corpus, queries, dim, count, row_bytes or dim * 8, _best_of_block(k, dim, read)), k)


#: Turns a column of stored vectors into (matrix, how much nearer than measured each row may be).
SlackReader = Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]

WITHIN_SCHEMA = "query_id bigint, id bigint"


def _within(ids: np.ndarray, rows: np.ndarray, slack: np.ndarray, query_ids: np.ndarray, unit: np.ndarray, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
    step = max(1, 4_000_000 // max(1, len(unit)))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        r, q = np.nonzero(1.0 - rows[part] @ unit.T - slack[part, None] <= bounds)
        yield pd.DataFrame({"query_id": query_ids[q], "id": ids[part][r]})


def rows_within(corpus: DataFrame, queries: DataFrame, read: SlackReader, row_bytes: int) -> DataFrame:
    """(query_id, id): every row that, its slack allowed, is as near to a query as that query's bound.

    ``corpus`` is (id, vector), ``queries`` (query_id, vector, bound), and ``read`` turns the column into a
    matrix and a slack per row. Rows go on as they are found; nothing is gathered.
    """
    queries = queries.where("vector IS NOT NULL AND bound IS NOT NULL")
    dim, count = _query_size(queries)
    if not count:
        return queries.sparkSession.createDataFrame([], WITHIN_SCHEMA)
    if count * dim * 8 <= BLOCK_BYTES:
        asked = queries.select("query_id", "vector", "bound").collect()  # at most BLOCK_BYTES of vectors
        query_ids, vectors, bounds = (np.array(column) for column in zip(*asked))
        shipped = corpus.sparkSession.sparkContext.broadcast((query_ids, _unit(vectors.astype(np.float64)), bounds))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _within(batch["id"].to_numpy(), *read(batch["vector"]), *shipped.value)

        return corpus.mapInPandas(scan, WITHIN_SCHEMA)

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": np.array([], np.int64), "id": np.array([], np.int64)})
        _, unit = unit_rows(asked["vector"], dim)
        of_block = asked["query_id"].to_numpy(), unit, asked["bound"].to_numpy()
        return pd.concat(_within(rows["id"].to_numpy(), *read(rows["vector"]), *of_block))

    return _by_blocks(corpus, queries.select("query_id", "vector", "bound"), dim, count, row_bytes, score, WITHIN_SCHEMA)


def named_vectors(df: DataFrame, key: str) -> DataFrame:
    """The first two columns as (key, vector)."""
    return df.select(F.col(df.columns[0]).alias(key), F.col(df.columns[1]).alias("vector"))


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, distance, rank): the exact k nearest corpus rows per query.

    ``corpus`` is (id, vector), ``queries`` is (query_id, vector). Corpus rows of
    another length are skipped, a zero vector has distance 1, ties go to the
    smaller id. The corpus is scanned once for any number of queries.
    """
    return search_rows(named_vectors(corpus, "id"), named_vectors(queries, "query_id"), k)


def _over_blocks(queries: DataFrame, scan, k: int) -> DataFrame:
    """Rank the scans of all query blocks.

    One block stays lazy. With more, each block's result is stored before the
    next block is fetched, so the driver never holds more than two blocks.
    """
    spark, done, pending = queries.sparkSession, None, None
    for block in _blocks(queries):
        if pending is not None:
            stored = session.materialize(pending, "neighbours")
            done = stored if done is None else done.unionAll(stored)
        pending = _best_rows(scan(block), k)
    if pending is None:
        return spark.createDataFrame([], RESULT_SCHEMA + ", rank int")
    return pending if done is None else done.unionAll(session.materialize(pending, "neighbours"))


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    return top_by(found, ["query_id"], [F.asc("distance"), F.asc("id")], k)


# --- approximate search -----------------------------------------------------


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, bits))


def _cell_of(rows: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Random-hyperplane cell: one bit per side of a plane."""
    return ((rows @ planes) > 0) @ (1 << np.arange(planes.shape[1]))


#: Rows of the sample that cells are fitted to.
FITTED_ROWS = 8192


def fitted_sample(corpus: DataFrame, dim: int) -> np.ndarray:
    """Unit vectors of the first ``FITTED_ROWS`` rows by a hash of the id; rows with entries that are no numbers left out."""
    rows = named_vectors(corpus, "id").where(F.size("vector") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FITTED_ROWS).select("vector").collect()
    matrix = np.array([r["vector"] for r in sample], dtype=np.float64).reshape(-1, dim)
    return _unit(matrix[np.isfinite(matrix).all(axis=1)])


def fit_centres(corpus: DataFrame, dim: int, cells: int = 64, rounds: int = 10) -> np.ndarray:
    """Unit centres of cells, by spherical k-means over the first ``FITTED_ROWS`` rows by a hash of the id.

    At most one centre per sampled row. The sample decides where cells lie, never which rows are found.
    """
    unit = fitted_sample(corpus, dim)
    if not len(unit):
        return np.zeros((1, dim))
    centres = unit[:cells]
    for _ in range(rounds):
        own = _centre_of(unit, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        used = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(used[:, None], _unit(sums), centres)
    return centres


def _centre_of(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell whose centre has the least angle to each row."""
    return (rows @ centres.T).argmax(axis=1)


def _cells(dim: int, bits: int, seed: int, centres: np.ndarray | None) -> Callable[[np.ndarray], np.ndarray]:
    if centres is not None:
        return partial(_centre_of, centres=centres)
    return partial(_cell_of, planes=_planes(dim, bits, seed))


#: Planes nearest to a query whose crossings are tried in all combinations.
PROBED_PLANES = 8


def _probes(vectors: np.ndarray, planes: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` cells nearest to each query: its own, then those across its nearest planes.

    A cell's distance is the sum of the squared margins of the planes between it and the query.
    """
    margins = np.abs(vectors @ planes)
    m = min(margins.shape[1], PROBED_PLANES)
    near = np.argsort(margins, axis=1)[:, :m]
    crossed = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    cost = np.take_along_axis(margins, near, axis=1) ** 2 @ crossed.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :count]
    flips = (crossed[best] * (1 << near)[:, None, :]).sum(axis=2)
    return _cell_of(vectors, planes)[:, None] ^ flips


def write_index(
    corpus: DataFrame, path: str, dim: int, bits: int = 8, seed: int = 42, centres: np.ndarray | None = None
) -> None:
    """Write (id, vector) partitioned by cell, so a search reads only probed cells.

    Cells lie between random planes, or around ``centres`` where given (:func:`fit_centres`).

    A hot cell is spread over several files: rows are distributed by cell and a
    salt from the id, never by cell alone.
    """
    rows = corpus.select(F.col(corpus.columns[0]).alias("id"), F.col(corpus.columns[1]).alias("vector"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell_of = _cells(dim, bits, seed, centres)
        for batch in batches:
            sized = batch[[v is not None and len(v) == dim for v in batch["vector"]]].copy()
            if len(sized):
                matrix = np.stack(sized["vector"].to_numpy()).astype(np.float64)
                sized["cell"] = cell_of(matrix).astype("int32")
                yield sized

    labelled = rows.mapInPandas(label, "id bigint, vector array<double>, cell int")
    salted = labelled.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16)))
    salted.write.partitionBy("cell").parquet(path)


def nearest_in_index(
    index: DataFrame, queries: DataFrame, k: int = 5, bits: int = 8, seed: int = 42, probes: int = 4,
    centres: np.ndarray | None = None,
) -> DataFrame:
    """Approximate k nearest rows from an index written by :func:`write_index`.

    Only partitions of probed cells are read; their rows are ranked by exact
    distance. More probes raise recall, up to all cells with
    ``probes = 2 ** bits`` and at most eight bits. An index around ``centres`` needs the same here. A query whose cells hold fewer than ``k`` rows is searched
    in the whole index, so ``k`` rows come whenever the index has them.
    """
    queries = queries.select(
        F.col(queries.columns[0]).alias("query_id"), F.col(queries.columns[1]).alias("vector")
    )

    def scan(block) -> DataFrame:
        cell_of = _cells(block[1].shape[1], bits, seed, centres)
        if centres is None:
            cells = _probes(block[1], cell_of.keywords["planes"], probes)
        else:
            cells = np.argsort(-(block[1] @ centres.T), axis=1, kind="stable")[:, :probes]
        wanted = [int(c) for c in np.unique(cells)]
        rows = index.where(F.col("cell").isin(wanted)).select("id", "vector")
        return _scan(rows, block, k, cells, cell_of)

    found = session.materialize(_over_blocks(queries, scan, k), "probed")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
    short = session.materialize(queries.join(full, "query_id", "left_anti"), "short-queries")
    if short.isEmpty():
        return found
    whole = nearest(index.select("id", "vector"), short, k)
    return found.join(full, "query_id", "left_semi").select(*whole.columns).unionAll(whole)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, found, wanted, recall): share of the exact neighbours found."""
    hits = exact.select("query_id", "id").join(
        approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left"
    )
    counted = hits.groupBy("query_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"))
    return counted.withColumn("recall", F.col("found") / F.col("wanted"))
