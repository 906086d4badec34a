"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped into the scoring workers.

Texts become 64-bit word hashes. Each task sums up the n-grams of its texts and hands them on as packed
columns, one row per shard; the shuffle brings a shard's n-grams together, where they are summed,
written to the shared folder as sorted hash arrays and turned into the (n-1)-grams of the next order,
whose counts are the numbers of different words before them. A shard holds whole contexts, so their
totals need no further shuffle; the few contexts of very frequent words are spread over all shards by
the word that follows, and their totals are added up when the model is opened.

A worker maps the arrays into memory and scores texts in batches: the n-grams of a batch are looked up
once each, in sorted order. Memory follows the batch and the shard, never the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm import hash_arrays as arrays
from feedloom.session import scratch_path

BEGIN, END = 0, 1
#: Tokens that a task holds at once, when it counts and when it scores.
BATCH_TOKENS = 2_000_000
SCORE_TOKENS = 1_000_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_BIG = 255


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, cut at ASCII white space), then the end mark."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    out = np.full(len(words) + 1, END, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return out


def _batches(
    frames: Iterator[pa.RecordBatch], most: int = BATCH_TOKENS
) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the input with the tokens of their texts (last column), cut after ``most`` tokens."""
    for frame in frames:
        start, held, size = 0, [], 0
        for i, text in enumerate(frame.column(frame.num_columns - 1)):
            held.append(tokens_of(text.as_py()))
            size += len(held[-1])
            if size >= most:
                yield frame.slice(start, i + 1 - start), held
                start, held, size = i + 1, [], 0
        if held:
            yield frame.slice(start), held


def _grams(texts: list[np.ndarray], order: int) -> np.ndarray:
    """One column of ``order`` words per token, the token last; texts are padded with begin marks."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.concatenate(texts)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.empty((order, len(flat)), np.uint64)
    for back in range(order):
        rows[order - 1 - back] = np.where(within >= back, np.roll(flat, back), BEGIN)
    return rows


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in order, with the sums of their counts."""
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    first = np.concatenate(([True], np.any(rows[:, 1:] != rows[:, :-1], axis=0)))
    starts = np.flatnonzero(first)
    return rows[:, starts], np.add.reduceat(counts[order], starts)


def _shards(rows: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """Shard by context; contexts of frequent words only (the empty one too) are spread by the word after it."""
    context = rows[:-1]
    spread = np.all(np.isin(context, frequent), axis=0) if len(context) else np.ones(rows.shape[1], bool)
    keys = arrays.row_keys(context)
    keys[spread] = arrays.mix(rows[-1, spread], keys[spread])
    return arrays.shard_of(keys, shards)


def _packed(rows: np.ndarray, counts: np.ndarray, frequent: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, payload): the columns of the words, then the counts."""
    shard = _shards(rows, frequent, shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        pick = order[edges[s] : edges[s + 1]]
        payload = rows[:, pick].tobytes() + counts[pick].astype(np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([payload], pa.binary())], ["shard", "payload"])


def _unpacked(payload: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(payload, np.uint64).reshape(order + 1, -1)
    return words[:order], words[order].view(np.int64)


def _totals(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the contexts in order, and by context: sum of counts, words seen once, twice, more often."""
    keys = arrays.row_keys(rows[:-1])
    kinds = np.stack([counts, counts == 1, counts == 2, counts > 2]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
    return keys[order][starts], np.add.reduceat(kinds[:, order], starts, axis=1)


def _store(folder: str, order: int, shard: int, rows: np.ndarray, counts: np.ndarray, frequent: np.ndarray) -> None:
    """The arrays of a shard: n-gram keys and counts, context keys and totals, counts of counts."""
    name = f"{order}-{shard}"
    keys = arrays.row_keys(rows)
    place = np.argsort(keys, kind="stable")
    keys, kept = keys[place], counts[place]
    big = np.flatnonzero(kept >= _BIG)
    arrays.write_array(folder, f"{name}-keys", keys)
    arrays.write_array(folder, f"{name}-counts", np.minimum(kept, _BIG).astype(np.uint8))
    arrays.write_array(folder, f"{name}-big", np.stack([big, kept[big]]).astype(np.int64))
    spread = np.all(np.isin(rows[:-1], frequent), axis=0) if order > 1 else np.ones(rows.shape[1], bool)
    for kind, pick in (("own", ~spread), ("part", spread)):
        if pick.any():
            contexts, totals = _totals(rows[:, pick], counts[pick])
            arrays.write_array(folder, f"{name}-{kind}", contexts)
            arrays.write_array(folder, f"{name}-{kind}-totals", totals)
    arrays.write_array(folder, f"{name}-kinds", np.array([(counts == k).sum() for k in range(1, 5)], np.int64))


class Model(NamedTuple):
    """Where a trained model is kept, and what every worker needs of it."""

    folder: str
    order: int
    shards: int
    frequent: np.ndarray
    n_tokens: int
    n_distinct: int


def train(texts: DataFrame, order: int = 2, text: str = "text", shards: int | None = None) -> Model:
    """Count the texts and store the model in the shared folder.

    ``shards`` defaults to the session's shuffle partitions; a shard's n-grams are held by one task.
    Null and empty texts count as an end mark each. Without any text the model is uniform.
    """
    spark = texts.sparkSession
    folder = scratch_path(spark, "ngrams")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    column = texts.select(F.col(text).alias("text"))

    def count_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _batches(frames):
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

    words = column.mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    shard = F.shiftright(F.shiftrightunsigned("word", 40) * shards, 24).cast("int")

    def store_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in frames]
        if not held:
            return
        words, counts, at = map(np.concatenate, zip(*held))
        for s in np.unique(at):
            pick = np.flatnonzero(at == s)
            pick = pick[np.argsort(words[pick], kind="stable")]
            arrays.write_array(folder, f"words-{s}-keys", words[pick])
            arrays.write_array(folder, f"words-{s}-counts", counts[pick])
        yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([len(words)])], ["n", "v"])

    stored = words.withColumn("shard", shard).repartitionById(shards, "shard").mapInArrow(store_words, "n long, v long")
    size = stored.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_tokens, n_distinct = size["n"] or 0, size["v"] or 0

    def often(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for s in frame.column(0).to_pylist():
                if (keys := arrays.map_array(folder, f"words-{s}-keys")) is not None:
                    found = keys[arrays.map_array(folder, f"words-{s}-counts") > n_tokens / (4 * shards)]
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["word"])

    # a word is frequent when its n-grams could fill a fourth of a shard: fewer than 4 * shards words
    rows = spark.range(shards).mapInArrow(often, "word long").collect()
    frequent = np.unique(np.array([BEGIN, *(r["word"] % (1 << 64) for r in rows)], np.uint64))

    def count_grams(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _batches(frames):
            grams = _grams(held, order)
            yield from _packed(*_summed(grams, np.ones(grams.shape[1], np.int64)), frequent, shards)

    def reduce_grams(n: int):
        def reduce(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_shard: dict[int, list] = {}
            for frame in frames:
                for s, payload in zip(frame.column(0).to_pylist(), frame.column(1)):
                    by_shard.setdefault(s, []).append(_unpacked(payload.as_py(), n))
            for s in sorted(by_shard):
                held = by_shard.pop(s)
                grams, counts = _summed(np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held]))
                del held
                _store(folder, n, s, grams, counts, frequent)
                if n > 1:  # each different n-gram is one more word before its (n-1)-gram
                    lower = _summed(grams[1:], np.ones(grams.shape[1], np.int64))
                    yield from _packed(*lower, frequent, shards)

        return reduce

    kind = "shard int, payload binary"
    level = column.mapInArrow(count_grams, kind)
    for n in range(order, 0, -1):
        level = level.repartitionById(shards, "shard").mapInArrow(reduce_grams(n), kind)
    level.count()
    return Model(folder, order, shards, frequent, n_tokens, n_distinct)


class _Order:
    """The arrays of one order, mapped when first needed."""

    def __init__(self, model: Model, n: int):
        self.model, self.n = model, n
        kinds = np.zeros(4, np.int64)
        parts, totals = [np.zeros(0, np.uint64)], [np.zeros((4, 0), np.int64)]
        for s in range(model.shards):
            if (own := arrays.map_array(model.folder, f"{n}-{s}-kinds")) is not None:
                kinds += own
            if (part := arrays.map_array(model.folder, f"{n}-{s}-part")) is not None:
                parts.append(part)
                totals.append(arrays.map_array(model.folder, f"{n}-{s}-part-totals"))
        keys, totals = np.concatenate(parts), np.concatenate(totals, axis=1)
        self.spread_keys, at = np.unique(keys, return_inverse=True)
        self.spread_totals = np.zeros((4, len(self.spread_keys)), np.int64)
        for row, values in zip(self.spread_totals, totals):
            np.add.at(row, at, values)
        self.discounts = discounts(kinds)
        self.map = lru_cache(maxsize=None)(lambda name, s: arrays.map_array(model.folder, f"{n}-{s}-{name}"))

    def look_up(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the columns' n-grams, and the four totals of their contexts (0: never seen)."""
        counts, totals = np.zeros(rows.shape[1], np.int64), np.zeros((4, rows.shape[1]), np.int64)
        shard, keys, contexts = _shards(rows, self.model.frequent, self.model.shards), arrays.row_keys(rows), arrays.row_keys(rows[:-1])
        order = np.lexsort((keys, shard))
        edges = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            pick = order[edges[s] : edges[s + 1]]
            at, there = arrays.find(self.map("keys", s), keys[pick])
            if there.any():
                found = self.map("counts", s)[at[there]].astype(np.int64)
                big, values = self.map("big", s)
                large = found == _BIG
                found[large] = values[np.searchsorted(big, at[there][large])]
                counts[pick[there]] = found
            own = pick[np.argsort(contexts[pick], kind="stable")]
            at, there = arrays.find(self.map("own", s), contexts[own])
            if there.any():
                totals[:, own[there]] = self.map("own-totals", s)[:, at[there]]
        own = np.argsort(contexts, kind="stable")
        at, there = arrays.find(self.spread_keys, contexts[own])
        totals[:, own[there]] = self.spread_totals[:, at[there]]
        return counts, totals


def discounts(kinds: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and more, from the numbers of n-grams counted one to four times.

    Where a number is zero the formula has no value; the discounts are then a half, one and one and a half.
    """
    n = kinds.astype(float)
    if not n[:4].all():
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), raw))])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.orders = [_Order(model, n) for n in range(1, model.order + 1)]
        self.words = lru_cache(maxsize=None)(lambda kind, s: arrays.map_array(model.folder, f"words-{s}-{kind}"))

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        """Training counts of sorted words."""
        out = np.zeros(len(words), np.int64)
        edges = np.searchsorted(arrays.shard_of(words, self.model.shards), np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            at, there = arrays.find(self.words("keys", s), words[edges[s] : edges[s + 1]])
            if there.any():
                out[edges[s] : edges[s + 1]][there] = self.words("counts", s)[at[there]]
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of the last word of each column after the others; one unknown word shares the rest."""
        p = np.full(rows.shape[1], 1.0 / (self.model.n_distinct + 1))
        for n, order in enumerate(self.orders, 1):
            tail = rows[-n:]
            counts, totals = order.look_up(tail)
            d = order.discounts
            kept = np.maximum(counts - d[np.minimum(counts, 3)], 0.0)
            seen = totals[0] > 0
            held_back = d[1] * totals[1] + d[2] * totals[2] + d[3] * totals[3]
            p = np.where(seen, (kept + held_back * p) / np.maximum(totals[0], 1), p)
        return p

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """By text: tokens, known tokens, base log10 sum, log10 probability."""
        rows = _grams(texts, self.model.order)
        distinct, place = np.unique(arrays.row_keys(rows), return_index=True, return_inverse=True)[1:]
        log_p = np.log10(self.probabilities(rows[:, distinct]))[place]
        words, place = np.unique(rows[-1], return_inverse=True)
        counts = self.word_counts(words)
        n, v = self.model.n_tokens, self.model.n_distinct
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))[place]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        return sizes, *(np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64)[place], base, log_p))


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, base_score, score and perplexity of every row.

    score is the log10 probability of the whole text, its end included. Rows that repeat are scored and
    returned each; null and empty texts hold the end only; columns called like a result column are
    replaced.
    """
    made = "n_tokens long, n_known long, base_score double, score double, perplexity double"
    names = [part.split()[0] for part in made.split(", ")]
    kept = [c for c in docs.columns if c not in (*names, text)]
    # the text comes last, whatever the others are called
    narrow = docs.select(*kept, F.col(text)).toDF(*(f"c{i}" for i in range(len(kept) + 1)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for part, held in _batches(frames, SCORE_TOKENS):
            scorer = scorer or Scorer(model)
            sizes, known, base, log_p = scorer.score(held)
            columns = [part.column(i) for i in range(len(kept))]
            made = [pa.array(x) for x in (sizes, known, base, log_p, 10 ** (-log_p / sizes))]
            yield pa.RecordBatch.from_arrays(columns + made, kept + names)

    schema = docs.select(*kept).schema
    for part in made.split(", "):
        schema = schema.add(*part.split())
    return narrow.mapInArrow(run, schema)


def held_out(id: Column, parts: int = 10) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as an empty text, held out."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % parts == 0
