"""Approximate neighbours from product-quantised codes.

A vector is cut into parts, and each part is stored as the number of its nearest
centre: one byte a part, and two for the length of what the decoded vector misses.
A search scans the codes, measures the angle between the unquantised query and each
decoded vector (the asymmetric distance), fetches the vectors of a short list by id
and measures them exactly. The k-th of these bounds the distances that still matter:
a second scan lists every row that may be as near, whatever the number of rows, for
the error of an asymmetric distance is known from the missing length. The vectors
lie in folders by a hash of the id, so that only folders with listed ids are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import session
from feedloom.functions.vectors import cosine_distance
from feedloom.operators.profile import top_by
from feedloom.operators.search import fitted_sample, named_vectors, rows_within, search_rows, unit_rows

#: Centres of a part: as many as one byte tells apart.
LEVELS = 256


@dataclass(frozen=True)
class Codebook:
    """The centres of each part of a unit vector."""

    centres: list[np.ndarray]

    @property
    def edges(self) -> np.ndarray:
        return np.cumsum([0] + [c.shape[1] for c in self.centres])

    @property
    def dim(self) -> int:
        return int(self.edges[-1])

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """The number of the nearest centre of every part, one byte each."""
        edges = self.edges
        parts = [_nearest_centre(unit[:, a:b], c) for a, b, c in zip(edges, edges[1:], self.centres)]
        return np.stack(parts, axis=1).astype(np.uint8)

    def missing(self, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what the decoded vectors miss, rounded up to two bytes each."""
        length = np.linalg.norm(unit - self.decode(codes), axis=1)
        short = length.astype(np.float16)
        return np.where(short < length, np.nextafter(short, np.float16(np.inf)), short)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centres)], axis=1)


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def fit_codebook(corpus: DataFrame, dim: int, parts: int = 16, rounds: int = 12) -> Codebook:
    """Centres by k-means, a part at a time, over the sample of :func:`fitted_sample`.

    The sample decides how vectors are rounded, never which rows are in the index. Without any usable
    row every centre is zero.
    """
    sample = fitted_sample(corpus, dim)
    centres = []
    for columns in np.array_split(np.arange(dim), min(parts, dim)):
        rows = sample[:, columns]
        found = rows[:LEVELS].copy() if len(rows) else np.zeros((1, len(columns)))
        for _ in range(rounds if len(rows) else 0):
            own = _nearest_centre(rows, found)
            counts = np.bincount(own, minlength=len(found))[:, None]
            sums = np.zeros_like(found)
            np.add.at(sums, own, rows)
            found = np.where(counts > 0, sums / np.maximum(counts, 1), found)
        centres.append(found)
    return Codebook(centres)


CODES = "id bigint, code binary, missing binary"


@dataclass(frozen=True)
class QuantisedIndex:
    """An index folder: ``codes`` (id, code, missing), ``vectors`` (id, vector, by block) and the ``codebook``."""

    path: str
    codebook: Codebook
    blocks: int

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(CODES).parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")

    def block_of(self, id: str):
        return F.pmod(F.xxhash64(id), F.lit(self.blocks)).cast("int")


#: Vectors that share a folder, on average.
BLOCK_ROWS = 65_536


def write_quantised(corpus: DataFrame, path: str, codebook: Codebook, blocks: int | None = None) -> QuantisedIndex:
    """Index (id, vector) below ``path``; ids are bigint.

    Rows of another length or with entries that are no finite numbers are left out. The number of
    folders follows the number of rows (at least 16) unless given.
    """
    spark = corpus.sparkSession
    rows = named_vectors(corpus, "id")
    usable = (F.size("vector") == codebook.dim) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = rows.where(usable)
    index = QuantisedIndex(path, codebook, blocks or max(16, -(-rows.count() // BLOCK_ROWS)))
    placed = rows.withColumn("block", index.block_of("id"))
    placed.repartition("block").write.partitionBy("block").parquet(f"{path}/vectors")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, unit = unit_rows(batch["vector"], codebook.dim)
            codes = codebook.encode(unit)
            missing = [m.tobytes() for m in codebook.missing(unit, codes)]
            yield pd.DataFrame({"id": batch["id"], "code": [c.tobytes() for c in codes], "missing": missing})

    stored = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
    stored.mapInPandas(encode, CODES).write.parquet(f"{path}/codes")
    centres = [
        (i, j, centre.tolist(), index.blocks)
        for i, part in enumerate(codebook.centres)
        for j, centre in enumerate(part)
    ]
    spark.createDataFrame(centres, "part int, level int, centre array<double>, blocks int").coalesce(1).write.parquet(
        f"{path}/codebook"
    )
    return index


def open_quantised(spark: SparkSession, path: str) -> QuantisedIndex:
    """An index that :func:`write_quantised` wrote, in this session or another."""
    rows = spark.read.parquet(f"{path}/codebook").orderBy("part", "level").collect()
    parts: dict[int, list] = {}
    for r in rows:
        parts.setdefault(r["part"], []).append(r["centre"])
    return QuantisedIndex(path, Codebook([np.array(c) for c in parts.values()]), rows[0]["blocks"])


def _code_bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


def shortlist(index: QuantisedIndex, queries: DataFrame, rows: int) -> DataFrame:
    """(query_id, id, distance, rank): the nearest rows of each query by asymmetric distance, from codes alone."""
    codebook = index.codebook

    def read(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(column), dtype=bool), codebook.decode(_code_bytes(column))

    codes = index.codes(queries.sparkSession).select("id", F.col("code").alias("vector"))
    return search_rows(codes, named_vectors(queries, "query_id"), rows, read, codebook.dim * 8)


#: Standard errors of an asymmetric distance that a row may be off and still be listed: one row in 700 is off by more.
MARGIN = 3.0


def rows_in_reach(index: QuantisedIndex, bounded: DataFrame, margin: float | None = MARGIN) -> DataFrame:
    """(query_id, id): every row whose exact distance may be at most the bound, from codes alone.

    ``bounded`` is (query_id, vector, bound). The missing part of a vector lies in no direction of its own,
    so its share in a distance has a standard error of its length over the root of the dimension. Without a
    margin its whole length counts, and no row within the bound is left out.
    """
    codebook = index.codebook
    share = 1.0 if margin is None else min(1.0, margin / codebook.dim**0.5)

    def read(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        stored = _code_bytes(column)
        missing = np.ascontiguousarray(stored[:, -2:]).view(np.float16)[:, 0]
        return codebook.decode(stored), missing.astype(np.float64) * share + 1e-9

    codes = index.codes(bounded.sparkSession).select("id", F.concat("code", "missing").alias("vector"))
    return rows_within(codes, bounded, read, codebook.dim * 8)


def exact_distances(index: QuantisedIndex, listed: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, distance) of listed rows (query_id, id, rank).

    Only folders that hold a listed id are read, where Spark finds the list small enough to broadcast.
    """
    wanted = listed.where("rank > 0").select("query_id", "id").distinct().withColumn("block", index.block_of("id"))
    fetched = index.vectors(queries.sparkSession).join(wanted, ["block", "id"])
    asked = named_vectors(queries, "query_id").withColumnRenamed("vector", "asked")
    return fetched.join(asked, "query_id").select(
        "query_id", "id", cosine_distance(F.col("vector"), F.col("asked")).alias("distance")
    )


def rerank(index: QuantisedIndex, listed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of the listed rows by exact distance, ties to the smaller id."""
    return _nearest_of(exact_distances(index, listed, queries), k)


def _nearest_of(measured: DataFrame, k: int) -> DataFrame:
    return top_by(measured, ["query_id"], [F.asc("distance"), F.asc("id")], k)


def measured_rows(
    index: QuantisedIndex, queries: DataFrame, k: int, rows: int | None = None, margin: float | None = MARGIN
) -> DataFrame:
    """(query_id, id, distance): all rows that a search for k rows fetches, by exact distance; each is fetched once.

    These are the short list of ``rows`` (5 k unless given) and every row that may be as near as its k-th.
    """
    listed = session.materialize(shortlist(index, queries, max(k, rows or 5 * k)), "shortlist")
    first = session.materialize(exact_distances(index, listed, queries), "measured")
    # a query with fewer rows has listed the whole index
    bound = _nearest_of(first, k).where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    bounded = session.materialize(named_vectors(queries, "query_id").join(bound, "query_id"), "bounds")
    reach = rows_in_reach(index, bounded, margin).join(listed.select("query_id", "id"), ["query_id", "id"], "left_anti")
    others = session.materialize(reach.withColumn("rank", F.lit(max(k, rows or 5 * k) + 1)), "in-reach")
    return first.unionAll(exact_distances(index, others, queries))


def nearest_quantised(
    index: QuantisedIndex, queries: DataFrame, k: int = 5, rows: int | None = None, margin: float | None = MARGIN
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of the rows that :func:`measured_rows` fetches.

    ``queries`` is (query_id, vector) with vectors of the index's length. Recall depends on the margin, not on
    the number of rows; no margin (None) makes the result exact. k rows come whenever the index has them.
    """
    return _nearest_of(measured_rows(index, queries, k, rows, margin), k)
