"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

Both encodings of a text cut the same bytes. Every byte offset where a token of either ends closes one link,
the pair of tokens that meet before it; offsets where both end close a group. So links are a merge of two
sorted arrays, for whole batches of texts laid end to end.

How often an id pair is linked in the corpus is counted in dense vectors. A first pass over the texts writes
the pairs of each task; their union, merged in a tree over the tasks, is hashed by a minimal perfect hash;
the tasks' counts are added to vectors that the hash indexes, and these are summed in a tree as well. A
second pass aligns every text again and looks its pairs up, comparing the stored keys. Pairs are dealt to
``SHARDS`` shards by a hash, so a task holds a shard of a bounded number of tasks only; the number of
different pairs is bounded by the two vocabularies and grows far slower than the corpus.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from feedloom.llm import perfect_hash
from feedloom.llm.hash_arrays import map_array, mix, write_array
from feedloom.llm.token_counts import PATTERN
from feedloom.session import materialize, scratch_path

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARDS = 64
#: Tasks whose pairs or vectors are merged at once.
FAN = 16
#: Different pairs that a task holds before it hands them on.
HELD_PAIRS = 1_500_000
#: Tokens that a worker aligns at once, and characters that it encodes at once; longer texts go alone.
BATCH_TOKENS, BATCH_CHARS = 400_000, 1_000_000
BATCH_ROWS = 500
LOW = np.uint64(0xFFFFFFFF)


# ---- the two tokenizers


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """A byte-level BPE file: ids of texts, and every id's bytes.

    Where the file merges in the order of its ids, which is checked, a faster encoder for such
    vocabularies gives the same ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        made = [model["vocab"][a + b] for a, b in pairs]
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        if made == sorted(made) and made[0] >= 256:
            import tiktoken

            last = made[-1]  # what follows is special
            plain = {token: i for token, i in ranks.items() if i <= last}
            coder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
            self.encode = lambda texts: [coder.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            slow.encode_special_tokens = True
            self.encode = lambda texts: [slow.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokens:
    """A SentencePiece file: ids of texts, and every id's bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
        ]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(byte_model: str, piece_model: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(byte_model), PieceTokens(piece_model)


def id_kind(byte_model: str, piece_model: str) -> str:
    """Two bytes an id where both vocabularies fit, else four."""
    return "<u2" if all(len(kind.bytes) <= 1 << 16 for kind in tokenizers(byte_model, piece_model)) else "<u4"


def encode_both(docs: DataFrame, id: str, text: str, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """id, a, b: both encodings of the text with a space before it, as arrays of ``id_kind`` in binary.

    Both are empty for null and empty texts and where the bytes of either are not those of the text.
    """
    schema = StructType().add("id", docs.schema[id].dataType).add("a", BinaryType()).add("b", BinaryType())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers(byte_model, piece_model)
        kind = id_kind(byte_model, piece_model)
        for batch in _slices(batches):
            found = [(b"", b"")] * batch.num_rows
            for places, texts in _runs(batch.column(1).to_pylist()):
                spaced = [" " + t for t in texts]
                for at, t, a, b in zip(places, spaced, first.encode(spaced), second.encode(texts)):
                    whole = t.encode()
                    if all(b"".join(map(own.bytes.__getitem__, ids)) == whole for own, ids in ((first, a), (second, b))):
                        found[at] = np.array(a, kind).tobytes(), np.array(b, kind).tobytes()
            columns = [pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(encode, schema)


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Places and texts, a bounded number of characters at a time, without the empty ones."""
    places, held, size = [], [], 0
    for at, text in enumerate(texts):
        if text:
            places.append(at)
            held.append(text)
            size += len(text)
        if size >= BATCH_CHARS:
            yield places, held
            places, held, size = [], [], 0
    if held:
        yield places, held


# ---- links of a batch


class Links(NamedTuple):
    a: np.ndarray  #: all A ids of the texts, laid end to end
    b: np.ndarray
    keys: np.ndarray  #: the id pair of each link
    a_done: np.ndarray  #: whether an A token ends with the link
    b_done: np.ndarray
    cuts: np.ndarray  #: links before each text, and at last all


def align(a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray) -> Links:
    """Links of texts whose two encodings cover the same bytes."""
    a_all, b_all = np.concatenate(a), np.concatenate(b)
    a_ends, b_ends = np.cumsum(a_lengths[a_all]), np.cumsum(b_lengths[b_all])
    marks = np.zeros(a_ends[-1] + 1, np.uint8)
    marks[a_ends] = 1
    marks[b_ends] += 2
    ends = np.flatnonzero(marks)
    a_done, b_done = (marks[ends] & 1).astype(np.int64), (marks[ends] >> 1).astype(np.int64)
    left, right = a_all[np.cumsum(a_done) - a_done], b_all[np.cumsum(b_done) - b_done]
    keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
    text_ends = a_ends[np.cumsum(list(map(len, a))) - 1]
    return Links(a_all, b_all, keys, a_done > 0, b_done > 0, np.append(0, np.searchsorted(ends, text_ends, "right")))


def groups_of(links: Links, a_names: np.ndarray, b_names: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Number of groups of every text, and the groups written out."""
    last = links.a_done & links.b_done
    group = np.cumsum(last) - last
    before = [np.append(0, np.cumsum(done)[last]) for done in (links.a_done, links.b_done)]  # tokens before each group
    a_group, b_group = group[links.a_done], group[links.b_done]
    parts = np.empty(len(links.a) + len(links.b), object)
    # a group's A tokens follow the B tokens of the groups before it, its B tokens follow its own A tokens
    a_last = np.arange(1, len(links.a) + 1) == before[0][a_group + 1]
    b_last = np.arange(1, len(links.b) + 1) == before[1][b_group + 1]
    parts[np.arange(len(links.a)) + before[1][a_group]] = a_names[links.a.astype(np.int64) * 2 + a_last]
    parts[np.arange(len(links.b)) + before[0][b_group + 1]] = b_names[links.b.astype(np.int64) * 2 + b_last]
    groups = np.append(0, np.cumsum(last))[links.cuts]
    cuts, listed = (before[0] + before[1])[groups].tolist(), parts.tolist()
    return np.diff(groups), ["".join(listed[p:q])[:-1] for p, q in zip(cuts, cuts[1:])]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _batches(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray]]]:
    """Places and encodings of the texts that have tokens, a bounded number of tokens at a time."""
    places, a, b, size = [], [], [], 0
    for at, (x, y) in enumerate(zip(batch.column("a"), batch.column("b"))):
        x, y = x.as_buffer(), y.as_buffer()
        if not x.size:
            continue
        places.append(at)
        a.append(np.frombuffer(x, kind))
        b.append(np.frombuffer(y, kind))
        size += len(a[-1]) + len(b[-1])
        if size >= BATCH_TOKENS:
            yield places, a, b
            places, a, b, size = [], [], [], 0
    if places:
        yield places, a, b


def _lengths(kind: ByteTokens | PieceTokens) -> np.ndarray:
    return np.fromiter(map(len, kind.bytes), np.int64, len(kind.bytes))


# ---- counts of pairs


class PairCounts(NamedTuple):
    folder: str  #: of the hashes and vectors
    best: np.ndarray  #: by B id, the highest count of a pair with it


def _shard_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, np.uint64(77)) >> np.uint64(40)).astype(np.int64) * SHARDS >> 24


def _by_shard(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the places of their keys."""
    shard = _shard_of(keys)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
    for s in np.unique(shard).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(every), np.int64)
    np.add.at(sums, at, np.concatenate(counts))
    return every, sums


def _task_pairs(encoded: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """The first pass: leaf (the task), shard, keys and counts of the pairs that a task has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers(byte_model, piece_model)
        a_lengths, b_lengths, kind = _lengths(first), _lengths(second), id_kind(byte_model, piece_model)
        keys, counts, held = [], [], 0

        def result() -> pa.RecordBatch:
            every, sums = _merged(keys, counts)
            rows = [(s, every[at].tobytes(), sums[at].tobytes()) for s, at in _by_shard(every)]
            return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names=["shard", "keys", "counts"])

        for batch in batches:
            for _, a, b in _batches(batch, kind):
                own, times = np.unique(align(a, b, a_lengths, b_lengths).keys, return_counts=True)
                keys.append(own)
                counts.append(times)
                held += len(own)
                if held >= HELD_PAIRS:
                    every, sums = _merged(keys, counts)
                    keys, counts, held = [every], [sums], len(every)
                if held >= HELD_PAIRS // 2 and len(keys) == 1:
                    yield result()
                    keys, counts, held = [], [], 0
        if keys:
            yield result()

    return encoded.select("a", "b").mapInArrow(count, "shard long, keys binary, counts binary").withColumn("leaf", F.spark_partition_id())


def _group_rows(table: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in table.column(column)]


def count_pairs(encoded: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> PairCounts:
    """How often every id pair is linked in ``encoded`` (a stored result of ``encode_both``)."""
    spark = encoded.sparkSession
    folder = scratch_path(spark, "pairs")
    found = materialize(_task_pairs(encoded, byte_model, piece_model), "task-pairs")
    best = np.zeros(len(tokenizers(byte_model, piece_model)[1].bytes), np.int64)
    leaves = found.agg(F.max("leaf")).first()[0]
    if leaves is None:
        return PairCounts(folder, best)

    def unite(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(_group_rows(table, "keys", "<u8")))
        return pa.table({"shard": table.column("shard")[:1], "leaf": table.column("leaf")[:1], "keys": pa.array([keys.tobytes()], pa.binary())})

    def hash_keys(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = np.unique(np.concatenate(_group_rows(table, "keys", "<u8")))
        perfect_hash.save(folder, f"{shard:03d}", keys)
        return pa.table({"shard": [shard], "pairs": [len(keys)]})

    keys, last = found.select("shard", "leaf", "keys"), leaves
    while last >= FAN:
        keys = keys.withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("int")).groupBy("shard", "leaf").applyInArrow(unite, "shard long, leaf int, keys binary")
        last //= FAN
    keys.groupBy("shard").applyInArrow(hash_keys, "shard long, pairs long").collect()  # one row per shard

    def add(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        made, stored = perfect_hash.load(folder, f"{shard:03d}")
        vector = np.zeros(len(stored), np.int64)
        for own, times in zip(_group_rows(table, "keys", "<u8"), _group_rows(table, "counts", "<i8")):
            vector[perfect_hash.verified(made, stored, own)] += times
        return pa.table({"shard": [shard], "leaf": table.column("leaf")[:1], "vector": pa.array([vector.tobytes()], pa.binary())})

    def total(table: pa.Table) -> np.ndarray:
        return sum(_group_rows(table, "vector", "<i8"))

    def sum_up(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table.column("shard")[:1], "leaf": table.column("leaf")[:1], "vector": pa.array([total(table).tobytes()], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        shard, vector = table.column("shard")[0].as_py(), total(table)
        write_array(folder, f"{shard:03d}-counts", vector)
        b = (map_array(folder, f"{shard:03d}-keys") & LOW).astype(np.int64)
        highest = np.zeros(len(best), np.int64)
        np.maximum.at(highest, b, vector)
        met = np.flatnonzero(highest)
        return pa.table({"b": met, "best": highest[met]})

    def up(column: str):
        return F.floor(F.col(column) / FAN).cast("int")

    kind = "shard long, leaf int, vector binary"
    vectors, last = found.withColumn("leaf", up("leaf")).groupBy("shard", "leaf").applyInArrow(add, kind), leaves // FAN
    while last >= FAN:
        vectors = vectors.withColumn("leaf", up("leaf")).groupBy("shard", "leaf").applyInArrow(sum_up, kind)
        last //= FAN
    highest = vectors.groupBy("shard").applyInArrow(finish, "b long, best long").groupBy("b").agg(F.max("best").alias("best"))
    for r in highest.collect():  # one row per B id
        best[r["b"]] = r["best"]
    return PairCounts(folder, best)


class _Lookup:
    """Counts of keys from the shards, which are mapped when they are first needed."""

    def __init__(self, folder: str):
        self.folder, self.shards = folder, {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for s, at in _by_shard(keys):
            if s not in self.shards:
                self.shards[s] = (perfect_hash.load(self.folder, f"{s:03d}"), map_array(self.folder, f"{s:03d}-counts"))
            made, counts = self.shards[s]
            if made is not None:
                number = perfect_hash.verified(*made, keys[at])
                out[at] = np.where(number >= 0, counts[np.maximum(number, 0)], 0)
        return out


def pair_table(spark: SparkSession, counts: PairCounts) -> DataFrame:
    """The counted pairs as rows: a, b, count."""
    folder = counts.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (s for batch in batches for s in batch.column(0).to_pylist()):
            keys, vector = map_array(folder, f"{s:03d}-keys"), map_array(folder, f"{s:03d}-counts")
            if keys is not None:
                columns = (keys >> np.uint64(32)).astype(np.int64), (keys & LOW).astype(np.int64), np.asarray(vector)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "count"])

    return spark.range(0, SHARDS, 1, SHARDS).mapInArrow(read, "a long, b long, count long")


def align_documents(encoded: DataFrame, counts: PairCounts, id: str = "doc_id", byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """The second pass: for every row of ``encoded`` its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = StructType().add(id, encoded.schema["id"].dataType)
    for name in names:
        schema = schema.add(name, LongType())
    schema = schema.add("groups", StringType())
    folder, best = counts

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers(byte_model, piece_model)
        a_lengths, b_lengths, kind = _lengths(first), _lengths(second), id_kind(byte_model, piece_model)
        a_names = np.array([f"{i}{end}" for i in range(len(a_lengths)) for end in ",|"], object)
        b_names = np.array([f"{i}{end}" for i in range(len(b_lengths)) for end in ",;"], object)
        counted = _Lookup(folder)
        for batch in _slices(batches):
            numbers, groups = np.zeros((len(names), batch.num_rows), np.int64), [""] * batch.num_rows
            for places, a, b in _batches(batch, kind):
                links = align(a, b, a_lengths, b_lengths)
                pairs, at = np.unique(links.keys, return_inverse=True)
                found = counted(pairs)
                highest = found == best[(pairs & LOW).astype(np.int64)]
                n_groups, texts = groups_of(links, a_names, b_names)
                sums = [np.diff(np.append(0, np.cumsum(v[at]))[links.cuts]) for v in (highest, found)]
                numbers[:, places] = list(map(len, a)), list(map(len, b)), n_groups, np.diff(links.cuts), *sums
                for place, text in zip(places, texts):
                    groups[place] = text
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, numbers), pa.array(groups)], names=schema.names)

    return encoded.mapInArrow(look_up, schema)


def align_tokenizers(docs: DataFrame, id: str = "doc_id", text: str = "text", byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """One row per row of ``docs``: its id and how the two encodings of its text align.

    n_a and n_b count tokens, n_groups and n_links groups and links, n_best the links whose count in the
    corpus is the highest of their B id, count_sum adds the counts of the links up; ``groups`` lists the ids
    (``a1,a2|b1;a3|b2``). Null and empty texts, and texts whose bytes an encoding does not keep, have zeros
    and empty groups and count nothing. Rows that repeat are rows each, null ids stay null, an empty table
    gives an empty result, other columns are not looked at. Whole texts are aligned: a worker holds a batch
    of texts, or one text where that is longer. Both files must be readable under their path by every executor.
    """
    encoded = materialize(encode_both(docs, id, text, byte_model, piece_model), "encoded")
    return align_documents(encoded, count_pairs(encoded, byte_model, piece_model), id, byte_model, piece_model)
