"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, or of other signs. Two readings of a text give the features: the
lower-cased words themselves (one and two in a row) and their forms (one to three in a row): small letters,
capitals, digits, the signs; a word that repeats the one before it has the form ``=``. Every n-gram is
hashed to one of ``2 ** BITS`` places; a text is the square roots of its counts, scaled to length one.

Training keeps, per place, the sums that the method needs (z and n), from which a weight follows; places
without enough evidence keep the weight zero. The training texts are dealt to shards by a hash of their
content, and each shard's features are written once, as one file in the shared folder. In each round every
shard goes through its file, starting from the shared sums, and Spark averages the sums of a place over the
shards that met it. Tasks stream, and hold two vectors of fixed size.
Scoring is a sparse dot product with the weights, over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from feedloom.llm.hash_arrays import mix, new_file, read_range
from feedloom.session import scratch_path

BITS = 18
PLACES = 1 << BITS  # one more place, after these, is the constant's
#: Words that a worker remembers; the table starts anew when it is full.
REMEMBERED_WORDS = 200_000
#: Words that a worker turns into features at once.
BATCH_WORDS = 200_000
#: Texts a shard has about.
SHARD_TEXTS = 2_000
#: Sums travel as whole numbers of this unit, so that their order does not matter.
UNIT = float(1 << 24)
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Settings(NamedTuple):
    alpha: float = 1.0  #: learning rate
    beta: float = 1.0
    l1: float = 0.02  #: evidence below which a weight stays zero
    l2: float = 0.05
    rounds: int = 6


class Classifier(NamedTuple):
    share: float  #: share of good texts among the labelled ones
    weights: np.ndarray  #: by place, the constant's last


def form_of(word: str) -> str:
    """What a word looks like: small letters, capitals, both, digits, or its first signs."""
    if not (word[0].isalnum() or word[0] == "_"):
        return word[:3]
    if word.isdigit():
        return "0"
    if word.islower():
        return "a"
    if word.isupper():
        return "A" if len(word) > 1 else "I"
    return "Aa" if word[0].isupper() and word[1:].islower() else "x"


def _hash(text: str, seed: int) -> int:
    data = text.encode("utf-8", "replace")
    return zlib.crc32(data, seed) << 32 | zlib.crc32(data, ~seed & 0xFFFFFFFF)


class Features:
    """Places and values of texts; hashes of words are remembered up to a fixed number."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.hashes = np.zeros((2, REMEMBERED_WORDS), np.uint64)
        self.again = np.uint64(_hash("=", 2))

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        out = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            at = known.get(word)
            if at is None:
                at = known[word] = len(known)
                self.hashes[:, at] = _hash(word.lower(), 1), _hash(form_of(word), 2)
            out[i] = at
        return out

    def _read(self, text: str) -> np.ndarray:
        """Hashes of a text's words and forms, in two rows."""
        words, parts = _TOKEN.findall(text), []
        for at in range(0, len(words), BATCH_WORDS // 2):
            if len(self.known) > REMEMBERED_WORDS // 2:
                self.known.clear()
            parts.append(self.hashes[:, self._ids(words[at : at + BATCH_WORDS // 2])])
        return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.uint64)

    def batches(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of texts: where each one's places end, the places, their values."""
        held, size = [], 0
        for text in texts:
            held.append(self._read(text or ""))
            size += held[-1].shape[1]
            if size >= BATCH_WORDS:
                yield self._counted(held)
                held, size = [], 0
        if held:
            yield self._counted(held)

    def _counted(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([h.shape[1] for h in held])
        doc = np.repeat(np.arange(len(held), dtype=np.int64), sizes)
        words, forms = np.concatenate(held, axis=1)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        forms = np.where(same, self.again, forms)
        keys = []
        for column, longest, kind in ((words, 2, 10), (forms, 3, 20)):
            for n in range(1, min(longest, len(column)) + 1):
                m = len(column) - n + 1
                gram = np.full(m, kind + n, np.uint64)
                for k in range(n):
                    gram = mix(column[k : k + m], gram)
                inside = doc[:m] == doc[n - 1 :]
                keys.append((doc[:m] << BITS | (gram >> np.uint64(64 - BITS)).astype(np.int64))[inside])
        key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        owner, place = key >> BITS, key & (PLACES - 1)
        norms = np.sqrt(np.bincount(owner, count, len(held)))
        return np.cumsum(np.bincount(owner, minlength=len(held))), place, np.sqrt(count) / norms[owner]


def weights_of(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    strong = np.abs(z) > s.l1
    return np.where(strong, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2), 0.0)


def follow(z: np.ndarray, n: np.ndarray, place: np.ndarray, value: np.ndarray, label: float, offset: float, s: Settings) -> None:
    """Take one text in, changing z and n at its places; ``label`` may lie between 0 and 1."""
    w = weights_of(z[place], n[place], s)
    g = (1 / (1 + np.exp(-(offset + w @ value))) - label) * value
    before = n[place]
    after = before + g * g
    z[place] += g - (np.sqrt(after) - np.sqrt(before)) / s.alpha * w
    n[place] = after


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def training_texts(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, max_texts: int) -> tuple[DataFrame, int, float]:
    """Different labelled texts (place, text, label), how many labels there are, and the share of ones."""
    usable = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1))
    usable = usable.groupBy(F.col(id).alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("_y"))
    n, share = usable.agg(F.count("*"), F.avg("_y")).first()
    if not n:
        return docs.select(F.lit(0).alias("place"), F.col(text).alias("text"), F.lit(0.0).alias("label")).limit(0), 0, 0.5
    part = 1 << 20
    chosen = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(part)) < int(part * min(1.0, max_texts / n)))
    texts = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(chosen, "_id").withColumn("place", F.xxhash64("text"))
    sums = found.groupBy("place", F.xxhash64(F.lit(1), "text").alias("more"))  # equal texts count once
    return sums.agg(F.first("text").alias("text"), F.avg("_y").alias("label")), n, share


def train_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_texts: int = 20_000,
    settings: Settings = Settings(),
) -> Classifier:
    """Fit on documents with a label of 0 or 1; other labels and null ids are not used.

    An id with several labels has their mean, equal texts are one text with the mean of theirs, null texts
    are empty ones. Where there are more than ``max_texts`` labelled ids, about that many are taken by a hash
    of the id; nothing else is left out. Without labels of both kinds all texts get the share of ones (one
    half without any label).
    """
    texts, n, share = training_texts(docs, labels, id, text, label, max_texts)
    flat = Classifier(share, np.zeros(PLACES + 1))
    if not n or share in (0.0, 1.0):
        return flat
    shards = -(-min(n, max_texts) // SHARD_TEXTS)

    # the same texts in the same order, also when a task runs again
    dealt = texts.withColumn("shard", F.pmod("place", F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "place", "label")
    folder = scratch_path(docs.sparkSession, "quality-texts")
    files = _write_features(dealt.select("shard", "text", "label"), folder)
    offset = _logit(share)
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    for _ in range(settings.rounds):
        z, n = _round(docs.sparkSession, folder, files, z, n, offset, settings)
    return Classifier(share, weights_of(z, n, settings))


_RECORD = np.dtype([("label", "<f8"), ("size", "<i8")])
_FEATURE = np.dtype([("place", "<i4"), ("value", "<f4")])
READ_BYTES = 8 << 20


def _write_features(dealt: DataFrame, folder: str) -> list[tuple[str, int]]:
    """One file per shard: for every text a record and its features. Returns names and sizes, a row per shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        rows = ((shard, text, label) for b in batches for shard, text, label in zip(*(b.column(i).to_pylist() for i in range(3))))
        for shard, own in groupby(rows, key=itemgetter(0)):
            name, size = f"shard-{shard:05d}", 0
            with new_file(folder, name) as out:
                while part := list(islice(own, 256)):
                    labels = iter([label for _, _, label in part])
                    for ends, place, value in features.batches([text for _, text, _ in part]):
                        both = np.empty(len(place), _FEATURE)
                        both["place"], both["value"] = place, value
                        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                            data = np.array([(next(labels), b - a)], _RECORD).tobytes() + both[a:b].tobytes()
                            out.write(data)
                            size += len(data)
            yield pa.RecordBatch.from_pydict({"name": [name], "size": [size]})

    return sorted((r["name"], r["size"]) for r in dealt.mapInArrow(write, "name string, size long").collect())


def _read_features(path: str, size: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Labels, places and values of a shard's texts, a few megabytes at a time."""
    data, at, done = b"", 0, 0

    def more(wanted: int) -> None:
        nonlocal data, at, done
        while len(data) - at < wanted:
            new = read_range(path, done, READ_BYTES)
            data, at, done = data[at:] + new, 0, done + len(new)

    while done - (len(data) - at) < size:
        more(_RECORD.itemsize)
        label, n = np.frombuffer(data, _RECORD, 1, at)[0]
        at += _RECORD.itemsize
        more(n * _FEATURE.itemsize)
        found = np.frombuffer(data, _FEATURE, n, at)
        at += n * _FEATURE.itemsize
        yield float(label), found["place"], found["value"]


def _round(
    spark: SparkSession, folder: str, files: list[tuple[str, int]], z0: np.ndarray, n0: np.ndarray, offset: float, s: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Every shard goes once through its texts; sums are averaged over the shards that met a place."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for batch in batches for i in batch.column(0).to_pylist()):
            z, n = z0.copy(), n0.copy()
            for label, place, value in _read_features(f"{folder}/{files[i][0]}", files[i][1]):
                follow(z, n, np.append(place, PLACES), np.append(value, 1.0), label, offset, s)
            met = np.flatnonzero(n != n0)
            whole = [np.rint(v[met] * UNIT).astype(np.int64) for v in (z, n)]
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(whole[0]), pa.array(whole[1])], names=["place", "z", "n"])

    sums = spark.range(0, len(files), 1, len(files)).mapInArrow(train, "place int, z long, n long")
    # at most one row per place comes back
    found = sums.groupBy("place").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("k")).toArrow()
    place, k = found["place"].to_numpy(), found["k"].to_numpy()
    z, n = z0.copy(), n0.copy()
    z[place], n[place] = found["z"].to_numpy() / k / UNIT, found["n"].to_numpy() / k / UNIT
    return z, n


def score_quality(docs: DataFrame, model: Classifier, text: str = "text", name: str = "quality_score") -> DataFrame:
    """Every row of ``docs`` with a score from 0 to 1, higher where the label 1 is likelier.

    Null and empty texts, and texts of white space, get the score of a text without words. Whole texts are
    read: a worker holds the words of a batch, or of one text where that is longer. Rows that repeat are
    scored each, an empty table gives an empty result, a column of that name is replaced.
    """
    offset, weights = _logit(model.share) + float(model.weights[-1]), model.weights.astype(np.float32)

    def scores(texts: list[str | None], features: Features) -> np.ndarray:
        out = []
        for ends, place, value in features.batches(texts):
            sums = np.append(0.0, np.cumsum(weights[place] * value))[np.append(0, ends)]
            out.append(1 / (1 + np.exp(-(offset + np.diff(sums)))))
        return np.concatenate(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            if batch.num_rows:
                found = pa.array(scores(batch.column(at).to_pylist(), features))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), found], names=schema.names)

    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c != name]
    schema = StructType([docs.schema[i] for i in kept]).add(name, DoubleType())
    return docs.mapInArrow(score, schema)
