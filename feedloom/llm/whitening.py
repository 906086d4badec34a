"""Whitening of embeddings by eigenvectors that are found in single precision and then refined.

Entries become integers first (``floor(64 c) + 1000000``), so sums and products over all rows are exact:
every task adds up integers, Spark adds up the tasks' sums, and the driver holds one matrix of dimension by
dimension. Products are of entries from which a whole number near the mean is taken; what is left of the
mean is taken off exactly. The covariance is therefore right to the last digit, whatever the offset.

Its eigenvectors come from a float32 solver. Ogita and Aishima's iteration corrects them with matrix
products in extended precision: each step squares the error. The step divides by differences of
eigenvalues; where they lie closer together than the error bound, the small problem within that cluster is
solved on its own, the vectors are turned by its solution, and the iteration goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

SCALE, OFFSET = 64.0, 1_000_000
#: Rows that a worker holds at once.
BATCH_ROWS = 4096
#: Magnitude of 64 c up to which entries are exact integers whose batch products fit a double.
LARGEST = 1 << 19
HIGH = np.longdouble


class Whitener(NamedTuple):
    n: int  #: rows of the fit list
    sums: list[int]  #: per dimension, of the integer entries
    components: np.ndarray  #: columns are unit eigenvectors, by falling eigenvalue
    values: np.ndarray  #: their eigenvalues
    explained: np.ndarray  #: eigenvalues over the trace


def _pack_triangle(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.triu_indices(len(m))
    return i, j, m[i, j]


def _unpack_triangle(rows: list, d: int, kind=object) -> np.ndarray:
    out = np.zeros((d, d), kind)
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def usable_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x, the entries as integers, of rows whose vector is neither null nor empty nor holds a null, NaN or infinity.

    An entry beyond 2^19 in magnitude after scaling is an error, for sums of products would not be exact.
    """
    v = F.col("_v")
    rows = df.select(F.col(id).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is not below infinity
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & fine)
    too_large = F.exists(v, lambda c: F.abs(c * SCALE) >= float(LARGEST))
    checked = F.when(too_large, F.raise_error(F.lit("an entry is too large to be whitened exactly")).cast("array<double>")).otherwise(v)
    return rows.select(F.col("_id"), F.transform(checked, lambda c: F.floor(c * SCALE) + F.lit(OFFSET)).alias("_x"))


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows, ``BATCH_ROWS`` at a time; vectors of another length are an error."""
    for at in range(0, batch.num_rows, BATCH_ROWS):
        part = batch.slice(at, BATCH_ROWS)
        lists = part.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        if sizes.min() != sizes.max():
            raise ValueError("vectors of different lengths cannot be whitened together")
        yield part.column(0), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(sizes), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and sum of every dimension, exact: one row per dimension and task meets in Spark's sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for _, x in _matrix(batch):
                own = x.sum(axis=0)
                if total is not None and len(own) != len(total):
                    raise ValueError("vectors of different lengths cannot be whitened together")
                n, total = n + len(x), own if total is None else total + own
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total)), "v": pa.array(total)})

    wide = F.sum(F.col("v").cast("decimal(38,0)"))
    found = rows.mapInArrow(add, "i int, n long, v long").groupBy("i").agg(F.sum("n").alias("n"), wide.alias("v")).orderBy("i").collect()
    if not found:
        return 0, []
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of different lengths cannot be whitened together")
    return found[0]["n"], [int(r["v"]) for r in found]


def _products(rows: DataFrame, middle: np.ndarray) -> np.ndarray:
    """Exact sums of products of the entries less ``middle``, as Python integers."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _matrix(batch):
                y = (x - middle).astype(np.float64)  # whole numbers below 2^20: sums of 2^12 products are exact
                own = (y.T @ y).astype(np.int64)
                total = own if total is None else total + own
        if total is not None:
            i, j, v = _pack_triangle(total)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(v)})

    wide = F.sum(F.col("v").cast("decimal(38,0)")).alias("v")
    found = rows.mapInArrow(multiply, "i int, j int, v long").groupBy("i", "j").agg(wide).select("i", "j", F.col("v").cast("string").alias("v"))
    return _unpack_triangle([{"i": r["i"], "j": r["j"], "v": int(r["v"])} for r in found.collect()], len(middle))


def _high(value: int, divisor: int) -> np.longdouble:
    """A quotient of whole numbers, correct in extended precision."""
    whole, rest = divmod(value, divisor)
    return HIGH(whole) + HIGH(rest) / HIGH(divisor)


def _clusters(values: np.ndarray, gap: np.longdouble) -> list[np.ndarray]:
    """Runs of at least two falling eigenvalues whose neighbours differ by at most ``gap``."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > gap) + 1
    return [run for run in np.split(np.arange(len(values)), cuts) if len(run) > 1]


def refined_eigenvectors(a: np.ndarray, x: np.ndarray | None = None, steps: int = 30) -> tuple[np.ndarray, np.ndarray, int]:
    """Falling eigenvalues and eigenvectors (columns) of a symmetric matrix in extended precision, and the steps taken.

    ``x`` is where the iteration starts, by default the float32 solver's vectors. A step (Ogita and Aishima,
    "Iterative refinement for symmetric eigenvalue decomposition") needs six products of the size of ``a``.
    """
    a = np.asarray(a, HIGH)
    d = len(a)
    size = np.abs(a).max() if d else HIGH(0)
    if not size:
        return np.zeros(d, HIGH), np.eye(d, dtype=HIGH), 0
    a = a / size  # float32 has a small range
    if x is None:
        x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    x = np.asarray(x, HIGH)
    unit = np.eye(d, dtype=HIGH)
    eps = np.finfo(HIGH).eps
    norm = np.sqrt((a * a).sum())
    best = None
    for step in range(1, steps + 1):
        r = unit - x.T @ x
        s = x.T @ a @ x
        s = (s + s.T) / 2  # else rounding, over a small gap, is no turn
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        bound = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        floor = 8 * d * eps * norm
        if best is not None and bound >= best[0] / 2 and bound <= 64 * floor:
            break  # as good as the precision allows
        best = (bound, values, x)
        if bound <= floor:
            break
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= bound
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        for run in _clusters(values, bound):  # the step cannot tell these apart: turn them by their own problem
            own = x[:, run]
            middle = values[run].mean()
            small = own.T @ (a @ own - middle * own)
            small = (small + small.T) / 2
            spread = np.abs(small).max()
            if spread > 64 * eps:
                x[:, run] = own @ np.asarray(np.linalg.eigh((small / spread).astype(np.float64))[1][:, ::-1], HIGH)
        x = x + x @ (unit - x.T @ x) / 2  # turns within close clusters leave their square behind
    _, values, x = best
    return values * size, x / np.sqrt((x * x).sum(axis=0)), step


def fit_whitener(rows: DataFrame) -> Whitener:
    """Fit to rows of ``usable_vectors``; the driver gets sums per dimension and per pair of dimensions only."""
    n, sums = _sums(rows)
    d = len(sums)
    if not n:
        return Whitener(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    middle = [(2 * s + n) // (2 * n) for s in sums]  # the whole number next to the mean
    rest = [s - n * m for s, m in zip(sums, middle)]
    products = _products(rows, np.array(middle, np.int64))
    covariance = np.array([[_high(n * products[i, j] - rest[i] * rest[j], n * n) for j in range(d)] for i in range(d)], HIGH)
    values, components, _ = refined_eigenvectors(covariance)
    trace = np.trace(covariance)
    floor = d * np.finfo(np.float64).eps * max(values.max(), HIGH(0))
    values = np.where(values > floor, values, 0)  # no variance but rounding
    explained = values / trace if trace > 0 else values
    return Whitener(n, sums, components.astype(np.float64), values.astype(np.float64), explained.astype(np.float64))


def _projected(x: np.ndarray, middle: np.ndarray, fraction: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return ((x - middle).astype(np.float64) - fraction) @ turn


def _plan(model: Whitener, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    k = min(components, len(model.sums))
    middle = np.array([(2 * s + model.n) // (2 * model.n) for s in model.sums], np.int64)
    fraction = np.array([float(_high(s - model.n * int(m), model.n)) for s, m in zip(model.sums, middle)])
    scale = np.where(model.values[:k] > 0, 1 / np.sqrt(np.where(model.values[:k] > 0, model.values[:k], 1)), 0)
    return middle, fraction, model.components[:, :k] * scale, k


def identity_error(rows: DataFrame, model: Whitener, components: int = 32) -> float:
    """Largest entry of the whitened rows' covariance less the identity, over components that have variance.

    Measured on all rows, not derived from the model.
    """
    if not model.n:
        return 0.0
    middle, fraction, turn, k = _plan(model, components)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, x in _matrix(batch):
                w = _projected(x, middle, fraction, turn)
                products += w.T @ w
                total += w.sum(axis=0)
        i, j, v = _pack_triangle(products)
        i, j, v = np.append(i, np.arange(k)), np.append(j, np.full(k, -1)), np.append(v, total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(v)})

    found = rows.mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = np.zeros(k)
    for r in found:
        if r["j"] < 0:
            mean[r["i"]] = r["v"] / model.n
    covariance = _unpack_triangle([r for r in found if r["j"] >= 0], k, np.float64) / model.n - np.outer(mean, mean)
    live = model.values[:k] > 0
    error = np.abs(covariance - np.eye(k))[np.ix_(live, live)]
    return float(error.max()) if error.size else 0.0


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    ``component`` counts from 1 by falling eigenvalue, up to ``components`` and the dimension. ``deviation``
    is the exact sum of (n x - S)^2 over the dimensions, null where it does not fit 64 bits. A component
    without variance (one row, equal rows, dependent dimensions) has 0.0 for whitened and explained and does
    not count in identity_error. Null and empty vectors and those with a null, NaN or infinite entry have no
    rows; an empty table gives an empty result; vectors of different lengths are an error. Rows that repeat
    are rows each, null ids stay null, other columns are not looked at.
    """
    rows = usable_vectors(df, id, vector)
    model = fit_whitener(rows)
    schema = (
        StructType().add(id, df.schema[id].dataType).add("component", IntegerType()).add("n", LongType())
        .add("deviation", LongType()).add("whitened", DoubleType()).add("explained", DoubleType()).add("identity_error", DoubleType())
    )
    if not model.n:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, components)
    middle, fraction, turn, k = _plan(model, components)
    n = model.n
    rest = np.array([s - n * int(m) for s, m in zip(model.sums, middle)], object)
    largest = (1 << 63) - 1

    def deviations(x: np.ndarray) -> list:
        y = x - middle
        span = n * int(np.abs(y).max()) + max(abs(int(r)) for r in rest)
        if span * span * len(rest) <= largest:
            far = n * y - rest.astype(np.int64)
            return (far * far).sum(axis=1).tolist()
        far = n * y.astype(object) - rest
        return [s if s <= largest else None for s in (far * far).sum(axis=1).tolist()]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _matrix(batch):
                m = len(x)
                place = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(place)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)), pa.array(deviations(x), pa.int64()).take(pa.array(place)),
                        pa.array(_projected(x, middle, fraction, turn).ravel()), pa.array(np.tile(model.explained[:k], m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(project, schema)
