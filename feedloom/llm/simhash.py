"""SimHash near-duplicates, found through one-wildcard segment variants.

Fingerprints that differ in at most d bits are cut into s segments with s > d / 2, so that in one
segment they differ in one bit at most. Each segment is indexed once for every one of its bits with that
bit wiped; two segments that differ in at most one bit share the variant that wipes it. Variants meet by
equality, and pairs are verified on all 64 bits.

Only distinct fingerprints are indexed, so a group of copies is one row. The variants are shuffled by
their key and sorted; a task then walks its sorted runs in numpy and hands on a spanning forest of each
run's links, never the pairs. A large run is cut further by exact segments of the bits that the key
leaves open, which loses no link, so its cost stays near linear.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import connected_components
from feedloom.session import materialize

BITS = 64
SEED = 42
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Runs up to so many fingerprints are compared pair by pair; longer ones are cut first.
RUN_PAIRS = 512


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit by bit the majority of the XXH64 of all word shingles (A-Z lower-cased); 0 without words.

    A text of fewer words is one shingle. A bit is set when over half of the hashes have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(len(words) - shingle + 1, 1)
    last = ends[min(shingle, len(words)) - 1 :] - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), last[:n].tolist())), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        block = np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += block.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = 4) -> DataFrame:
    """Add the 64-bit fingerprint as a signed long; null and empty texts have 0."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return docs.withColumn(name, prints(F.col(text)))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs in at most one bit."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _spread(values: np.ndarray, first: int, bits: int) -> np.ndarray:
    return (values >> np.uint64(first)) & np.uint64((1 << bits) - 1)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between positions, those that a spanning forest needs."""
    root = np.arange(int(max(a.max(), b.max())) + 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _run_links(prints: np.ndarray, distance: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked fingerprints of a run, enough of them to connect what the run connects.

    A run above RUN_PAIRS is cut by the exact values of distance + 1 segments of the whole
    fingerprint: two prints within the distance agree on one of these. Groups that a cut cannot
    make smaller any more are compared in blocks.
    """
    n = len(prints)
    if n <= RUN_PAIRS:
        far = np.bitwise_count(prints[:, None] ^ prints[None, :])
        a, b = np.nonzero(np.triu(far <= distance, 1))
        return _forest(a, b) if len(a) else (a, b)
    out_a, out_b = [], []
    cuts = [BITS * i // (distance + 1) for i in range(distance + 2)]
    for low, high in zip(cuts, cuts[1:]):
        value = _spread(prints, low, high - low)
        order = np.argsort(value, kind="stable")
        edges = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(order, edges):
            if len(group) < 2:
                continue
            if len(group) <= RUN_PAIRS:
                a, b = _run_links(prints[group], distance)
                out_a.append(group[a])
                out_b.append(group[b])
                continue
            for i in range(0, len(group), RUN_PAIRS):  # blocks against what follows
                left = group[i : i + RUN_PAIRS]
                for j in range(i, len(group), RUN_PAIRS):
                    right = group[j : j + RUN_PAIRS]
                    near = np.bitwise_count(prints[left][:, None] ^ prints[right][None, :]) <= distance
                    a, b = np.nonzero(np.triu(near, 1) if i == j else near)
                    if len(a):
                        a, b = left[a], right[b]
                        keep = _forest(a, b)
                        out_a.append(keep[0])
                        out_b.append(keep[1])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return _forest(a, b) if len(a) else (a, b)


def near_links(prints: DataFrame, distance: int = 4, name: str = "fingerprint") -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``distance`` bits, transitively.

    Every pair within the distance is connected by the links returned; a pair itself may be left out
    where others already connect it. Null fingerprints have no links.
    """
    variants = [
        F.struct(
            F.lit(wiped).cast("byte").alias("bit"),
            F.shiftrightunsigned(F.col(name), first).bitwiseAND((1 << bits) - 1)
            .bitwiseAND(~(1 << (wiped - first))).alias("key"),
        )
        for first, bits in segments(distance)
        for wiped in range(first, first + bits)
    ]
    keyed = prints.filter(F.col(name).isNotNull()).select(name).distinct()
    keyed = keyed.select(F.col(name).alias("print"), F.explode(F.array(*variants)).alias("v"))
    # one long holds the wiped bit and the rest of its segment (at most 32 bits when distance > 1)
    key = F.shiftleft(F.col("v.bit").cast("long"), 56).bitwiseXOR(F.col("v.key"))
    sorted_runs = keyed.select(key.alias("key"), "print").repartition("key").sortWithinPartitions("key")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solve(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
            edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            size = np.diff(edges)
            got_a, got_b = [], []
            pairs = edges[:-1][size == 2]
            if len(pairs):
                near = np.bitwise_count(values[pairs] ^ values[pairs + 1]) <= distance
                got_a.append(values[pairs[near]])
                got_b.append(values[pairs[near] + 1])
            for start, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist()):
                run = values[start : start + n]
                a, b = _run_links(run, distance)
                if len(a):
                    got_a.append(run[a])
                    got_b.append(run[b])
            if not got_a:
                return None
            a, b = np.concatenate(got_a).view(np.int64), np.concatenate(got_b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((held_keys, batch.column(0).to_numpy()))
            values = np.concatenate((held, batch.column(1).to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if whole and (made := solve(keys[:whole], values[:whole])) is not None:
                yield made
            held_keys, held = keys[whole:], values[whole:]
        if len(held) and (made := solve(held_keys, held)) is not None:
            yield made

    return sorted_runs.mapInArrow(links, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    distance: int = 4,
    shingle: int = 4,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: its id, the columns of ``extra``, fingerprint (long), component_id and _part.

    _part names the component too, by one of its fingerprints, and is never null.

    Documents link when their fingerprints differ in at most ``distance`` bits; component_id is the
    smallest id reachable over links. Null and empty texts share the fingerprint 0 and link to each
    other like any others. Null ids are kept but never name a component, unless all ids of one are null.
    Rows that repeat are returned each; an empty table gives an empty result. Columns other than the two
    named are not looked at.
    """
    narrow = docs.select(id, *extra, F.col(text).alias("_text"))
    narrow = with_fingerprints(narrow, "_text", shingle=shingle)
    narrow = materialize(narrow.drop("_text"), "fingerprints")
    classes = materialize(narrow.groupBy("fingerprint").agg(F.min(id).alias("_least")), "classes")
    # nodes are fingerprints; the smallest id of a component is summed up afterwards
    parts = materialize(connected_components(near_links(classes, distance)), "components")
    of = classes.join(parts, classes["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "_least", F.coalesce("component", "fingerprint").alias("_part")
    )
    least = of.groupBy("_part").agg(F.min("_least").alias("component_id"))
    labels = of.join(least, "_part").select("fingerprint", "component_id", "_part")
    return narrow.join(labels, "fingerprint")
