"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The labels at hand mark documents, so tokens are labelled first: in the toxic documents of the training
sample, a token is toxic when its word, or a beginning or end of it, is far more frequent in toxic
documents than chance allows (a likelihood-ratio test) and in a larger part of them than of the clean
ones (``LEAST_LIFT`` times); all other tokens are clean. The field has two
states, hashed features of the word, and transitions, and is fitted to these tokens by its gradient from
forward-backward. The chain of a document is its whole text: pieces of ``CHAIN`` tokens run side by side,
and the messages between pieces come from a scan over the pieces' transfer matrices, so marginals do not
depend on where a piece ends. A document's score is a logistic function of the expected number of toxic
tokens and the greatest marginal, fitted on sample documents that the field has not seen.

The fit uses a bounded sample (``max_toxic`` and ``max_clean`` different texts of at most ``max_chars``
characters, chosen by a hash of the id); class shares are counted over all training labels. Scoring reads
whole texts, in batches of pieces, and needs the weight table only, one megabyte, and some 200 bytes a
token of the longest text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import set_aside
from feedloom.llm.workers import tidy

CHAIN = 64
FEATURE_BITS = 17
#: Words whose emission a worker remembers; the table starts anew when it is full.
REMEMBERED_WORDS = 100_000
#: Tokens that a worker holds at once.
BATCH_TOKENS = 200_000
#: 20 is reached by chance about once in 100,000 features.
LEAST_RATIO = 20.0
#: A rate in toxic documents over that in clean ones, whatever the sample's mix of the two.
LEAST_LIFT = 3.0
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[int]:
    """Hashed features: the word, its beginnings of three to seven letters, its ends of three and four."""
    made = [f"w{word}"] + [f"p{word[:n]}" for n in range(3, 8) if len(word) > n] + [f"s{word[-n:]}" for n in (3, 4) if len(word) > n]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1) for f in made]


class Tagger(NamedTuple):
    """``pairs``: log weights of (clean, clean), (clean, toxic), (toxic, clean), (toxic, toxic)."""

    weights: np.ndarray
    bias: float
    pairs: np.ndarray
    scale: np.ndarray  # constant, expected toxic tokens, greatest marginal


def _chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of texts laid end to end: a matrix of token places by piece (-1 beyond the end), and its mask."""
    starts = np.cumsum(sizes) - sizes
    per = _pieces(sizes)
    first = np.repeat(starts, per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * CHAIN
    ends = np.repeat(starts + sizes, per)
    at = first[:, None] + np.arange(CHAIN)
    mask = at < ends[:, None]
    return np.where(mask, at, 0), mask


def _pieces(sizes: np.ndarray) -> np.ndarray:
    return -(-sizes // CHAIN)


def _odds(emission: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(emission, -40, 40))


def _transfers(emission: np.ndarray, mask: np.ndarray, linked: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """By piece, the matrix from the state before it to the state at its end, up to a factor: (2, 2, pieces).

    A piece that is not ``linked`` begins a text and takes nothing from before.
    """
    odds = _odds(emission)
    c2c, c2t, t2c, t2t = np.exp(pairs)
    clean = np.where(linked, [[c2c], [t2c]], 1.0)
    toxic = np.where(linked, [[c2t], [t2t]], 1.0) * odds[:, 0]
    for t in range(1, emission.shape[1]):
        live = mask[:, t]
        if not live.any():
            break
        new_clean, new_toxic = clean * c2c + toxic * t2c, (clean * c2t + toxic * t2t) * odds[:, t]
        total = (new_clean + new_toxic).sum(axis=0)
        clean, toxic = np.where(live, new_clean / total, clean), np.where(live, new_toxic / total, toxic)
    return np.stack([clean, toxic], axis=1)


def _messages(moves: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward message into, and backward message at the end of, every piece: two of (2, pieces).

    ``per`` is the number of pieces of each text; all texts take the same step at once.
    """
    before, after = np.full(moves.shape[1:], 0.5), np.ones(moves.shape[1:])
    by_length = np.argsort(-per, kind="stable")
    starts = (np.cumsum(per) - per)[by_length]
    steps = range(1, int(per.max(initial=0)))
    longer = np.searchsorted(-per[by_length], -np.arange(len(steps) + 1) - 1, "right")  # texts with more than j pieces
    for j in steps:
        own = starts[: longer[j]] + j
        f = (before[:, None, own - 1] * moves[:, :, own - 1]).sum(axis=0)
        before[:, own] = f / f.sum(axis=0)
    for j in reversed(steps):
        own = starts[: longer[j]] + j
        b = (moves[:, :, own] * after[None, :, own]).sum(axis=1)
        after[:, own - 1] = b / b.sum(axis=0)
    return before, after


def forward_backward(
    emission: np.ndarray,
    mask: np.ndarray,
    pairs: np.ndarray,
    linked: np.ndarray | None = None,
    before: np.ndarray | None = None,
    after: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state by piece and token, and the expected counts of the four transitions.

    ``emission`` is the log weight of toxic over clean. The messages are scaled to sum to one. A ``linked``
    piece goes on from the message ``before`` it; ``after`` is the message at the piece's end. Without
    these, each piece is a text.
    """
    n, length = emission.shape
    if linked is None:
        linked, before, after = np.zeros(n, bool), np.ones((2, n)), np.ones((2, n))
    odds = _odds(emission)
    c2c, c2t, t2c, t2t = np.exp(pairs)
    ahead = np.empty((length + 1, 2, n))  # by token, from the one before the piece on
    ahead[0] = clean, toxic = before
    for t in range(length):
        clean, toxic = clean * c2c + toxic * t2c, clean * c2t + toxic * t2t
        if not t:
            clean, toxic = np.where(linked, clean, 1.0), np.where(linked, toxic, 1.0)
        toxic = toxic * odds[:, t]
        total = clean + toxic
        clean, toxic = clean / total, toxic / total
        ahead[t + 1] = clean, toxic
    marginals, expected = np.empty((n, length)), np.zeros(4)
    b_clean, b_toxic = after
    for t in range(length - 1, -1, -1):
        clean, toxic = ahead[t + 1]
        p = toxic * b_toxic / (clean * b_clean + toxic * b_toxic)
        live = mask[:, t]
        marginals[:, t] = np.where(live, p, 0.0)
        e_clean, e_toxic = b_clean, b_toxic * odds[:, t]
        was_clean, was_toxic = ahead[t]
        joint = np.stack([was_clean * c2c * e_clean, was_clean * c2t * e_toxic, was_toxic * t2c * e_clean, was_toxic * t2t * e_toxic])
        expected += (joint / joint.sum(axis=0))[:, live if t else linked].sum(axis=1)
        new_clean, new_toxic = c2c * e_clean + c2t * e_toxic, t2c * e_clean + t2t * e_toxic
        total = new_clean + new_toxic
        b_clean, b_toxic = np.where(live, new_clean / total, 1.0), np.where(live, new_toxic / total, 1.0)
    return marginals, expected


def _seeds(texts: list[np.ndarray], toxic: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """By word: whether one of its features (a row of ``matrix``) marks toxic documents beyond chance."""
    seen = np.zeros((2, (1 << FEATURE_BITS) + 1))
    for words, label in zip(texts, toxic.tolist()):
        seen[label, np.unique(matrix[np.unique(words)])] += 1
    total, share = seen.sum(axis=0), toxic.mean()
    clean_rate, toxic_rate = seen / np.bincount(toxic, minlength=2)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        part = seen[1] / total
        ratio = 2 * (np.nan_to_num(seen[1] * np.log(part / share)) + np.nan_to_num(seen[0] * np.log((1 - part) / (1 - share))))
        marked = (ratio > LEAST_RATIO) & (toxic_rate > LEAST_LIFT * clean_rate)
    marked[-1] = False  # the place that fills up short rows
    return marked[matrix].any(axis=1)


def _all_chains(emission: np.ndarray, at: np.ndarray, mask: np.ndarray, per: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals by token and expected transitions of whole texts, over blocks of pieces."""
    linked = np.ones(len(at), bool)
    linked[(np.cumsum(per) - per)[per > 0]] = False
    blocks = [slice(i, i + 4096) for i in range(0, len(at), 4096)]
    moves = np.concatenate([_transfers(emission[at[b]], mask[b], linked[b], pairs) for b in blocks], axis=2)
    before, after = _messages(moves, per)
    marginals, expected = np.zeros(len(emission)), np.zeros(4)
    for b in blocks:
        own, live = at[b], mask[b]
        p, moved = forward_backward(emission[own], live, pairs, linked[b], before[:, b], after[:, b])
        marginals[own[live]] = p[live]
        expected += moved
    return marginals, expected


def fit(texts: list[str], labels: list[int], share: float, steps: int = 60) -> Tagger:
    """Fit to labelled texts; ``share`` is the share of toxic texts among all, sampled evenly or not."""
    flat = Tagger(np.zeros(1 << FEATURE_BITS, np.float32), -40.0, np.zeros(4), np.array([_logit(share), 0.0, 0.0]))
    toxic = np.array(labels, np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return flat
    ids: dict[str, int] = {}  # words become numbers at once: a sample has millions of them
    split = []
    for t in texts:
        words = words_of(t)
        split.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
    unused = 1 << FEATURE_BITS  # one weight beyond the table stays zero
    width = len(features("x" * 9))
    matrix = np.full((len(ids), width), unused, np.int32)
    for i, word in enumerate(ids):
        made = features(word)
        matrix[i, : len(made)] = made
    del ids
    is_seed = _seeds(split, toxic, matrix)
    if not is_seed.any():
        return flat

    field = np.ones(len(split), bool)
    if toxic.sum() >= 20:  # seven tenths of each class train the field, the rest the score
        for label in (0, 1):
            own = np.flatnonzero(toxic == label)
            field[own] = np.arange(len(own)) % 10 < 7
    chosen = [i for i in np.flatnonzero(field).tolist() if len(split[i])]
    sizes = np.array([len(split[i]) for i in chosen])
    tokens = np.concatenate([split[i] for i in chosen])
    wanted = (is_seed[tokens] & np.repeat(toxic[chosen] == 1, sizes)).astype(float)
    at, mask = _chains(sizes)
    y = wanted > 0
    live = np.ones(len(y), bool)
    live[np.cumsum(sizes) - sizes] = False  # the first token of a text follows none
    had = np.bincount((2 * y[:-1] + y[1:])[live[1:]], minlength=4).astype(float)
    del y, live
    weights, pairs = np.zeros(unused + 1), np.zeros(4)
    bias = _logit(max(wanted.mean(), 1e-6))
    sums = [np.full(unused + 1, 1e-8), 1e-8, np.full(4, 1e-8)]
    for _ in range(steps):  # Adagrad on the penalised log likelihood
        emission = (bias + weights[matrix].sum(axis=1))[tokens]
        p, expected = _all_chains(emission, at, mask, _pieces(sizes), pairs)
        by_word = np.bincount(tokens, wanted - p, len(matrix))
        slope = np.bincount(matrix.ravel(), np.repeat(by_word, width), unused + 1) - 0.05 * weights
        slope[unused] = 0.0
        slopes = [slope, by_word.sum(), had - expected - 0.05 * pairs]
        for s, g in enumerate(slopes):
            sums[s] = sums[s] + g * g
        weights = weights + 0.5 * slopes[0] / np.sqrt(sums[0])
        bias += 0.2 * slopes[1] / np.sqrt(sums[1])
        pairs = pairs + 0.1 * slopes[2] / np.sqrt(sums[2])
    tagger = Tagger(weights[:unused].astype(np.float32), float(bias), pairs, np.zeros(3))

    rest = ~field if not field.all() else field
    by_word = tagger.bias + np.append(tagger.weights, 0)[matrix].sum(axis=1)
    held = [by_word[split[i]] for i in np.flatnonzero(rest)]
    found = measure(tagger, held)[1]
    x = np.column_stack([np.ones(len(held)), np.log1p(found[:, 0]), found[:, 1]])
    t = toxic[rest]
    scale = np.zeros(3)
    for _ in range(50):  # Newton steps of a penalised logistic regression
        q = 1 / (1 + np.exp(-x @ scale))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        scale = scale + np.linalg.solve(hessian, x.T @ (t - q) - 0.1 * scale)
    scale[0] += _logit(share) - _logit(toxic.mean())  # the sample's share of toxic texts is not that of all
    return tagger._replace(scale=scale)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


class Emissions:
    """Log weights of words, remembered up to a fixed number."""

    def __init__(self, tagger: Tagger):
        self.tagger, self.known = tagger, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        known, weights, bias = self.known, self.tagger.weights, self.tagger.bias
        for i, w in enumerate(words):
            value = known.get(w)
            if value is None:
                if len(known) >= REMEMBERED_WORDS:
                    known.clear()
                value = known[w] = bias + float(weights[features(w)].sum())
            out[i] = value
        return out


def measure(tagger: Tagger, emissions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens laid end to end; and by text: expected toxic tokens, greatest marginal."""
    sizes = np.fromiter(map(len, emissions), np.int64, len(emissions))
    out = np.zeros((len(sizes), 2))
    if not sizes.sum():
        return np.zeros(0), out
    at, mask = _chains(sizes)
    marginals, _ = _all_chains(np.concatenate(emissions), at, mask, _pieces(sizes), tagger.pairs)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    out[some] = np.stack([np.add.reduceat(marginals, starts), np.maximum.reduceat(marginals, starts)], axis=1)
    return marginals, out


def _spans(text: str, marginals: np.ndarray) -> list[dict]:
    """Runs of toxic tokens as character offsets."""
    runs: list[dict] = []
    before = False
    for match, p in zip(_WORD.finditer(text.lower()), marginals.tolist()):
        if p >= 0.5:
            if before:
                runs[-1]["end"] = match.end()
            else:
                runs.append({"start": match.start(), "end": match.end()})
        before = p >= 0.5
    return runs


def train_tagger(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_toxic: int = 1500,
    max_clean: int = 3500,
    max_chars: int = 20_000,
) -> Tagger:
    """Fit on documents with a label of 0 or 1; other labels, null ids and null texts are not used.

    Texts above ``max_chars`` characters are left out and copies count once, with the label of the copy
    that comes first by a hash of its id; of what is left, at most ``max_toxic`` and ``max_clean`` texts
    come to the driver. Without labels of both kinds every text gets the share of toxic labels as its score.
    """
    usable = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(id).agg(F.max(label).alias("_label"))
    counts = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    place = F.xxhash64("_id").bitwiseAND(~1)  # the last bit is the label's
    short = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).filter(F.length("_text") <= max_chars)
    digests = [F.xxhash64("_text").alias("_d1"), F.xxhash64(F.lit(1), "_text").alias("_d2")]  # 128 bits, without copying texts
    short = short.select("_text", place.alias("_place"), "_id", *digests)
    labelled = short.drop("_text").join(usable, F.col("_id") == F.col(id))
    marked = F.col("_place").bitwiseOR(F.col("_label").cast("long"))
    once = labelled.groupBy("_d1", "_d2").agg(F.min(marked).alias("_first"))  # copies count once
    once = once.select("_d1", "_d2", F.col("_first").bitwiseAND(~1).alias("_place"), F.col("_first").bitwiseAND(1).alias("_label"))
    first = once.orderBy("_place", "_d1", "_d2")
    picked = first.filter("_label = 1").limit(max_toxic).union(first.filter("_label = 0").limit(max_clean))
    rows = (
        short.drop("_id").join(F.broadcast(picked), ["_d1", "_d2", "_place"])
        .dropDuplicates(["_d1", "_d2"]).select("_place", "_d1", "_d2", "_text", "_label").collect()
    )
    rows.sort(key=lambda r: (r["_place"], r["_d1"], r["_d2"]))
    return fit([r["_text"] for r in rows], [r["_label"] for r in rows], share)


def score_toxicity(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with toxicity (0 to 1), toxic_tokens (expected number) and toxic_spans (offsets).

    Null and empty texts get the score of a text without toxic tokens. Offsets count the characters of the
    lower-cased text, runs of neighbouring toxic tokens are one span. Rows that repeat are scored each; an
    empty table gives an empty result; columns of these three names are replaced.
    """

    @F.pandas_udf("toxicity double, toxic_tokens double, toxic_spans array<struct<start:int,end:int>>")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(tagger)

        def solve(texts: list, held: list[np.ndarray]) -> pd.DataFrame:
            marginals, found = measure(tagger, held)
            x = np.column_stack([np.ones(len(held)), np.log1p(found[:, 0]), found[:, 1]])
            ends = np.cumsum([len(h) for h in held])
            spans = [
                _spans(t, marginals[e - len(h) : e]) if most >= 0.5 else []
                for t, h, e, most in zip(texts, held, ends, found[:, 1])
            ]
            return pd.DataFrame({"toxicity": 1 / (1 + np.exp(-x @ tagger.scale)), "toxic_tokens": found[:, 0], "toxic_spans": spans})

        for batch in batches:
            parts, texts, held, size = [], [], [], 0
            for value in batch:
                texts.append(value)
                held.append(emissions(words_of(value)))
                size += len(held[-1])
                if size >= BATCH_TOKENS:
                    parts.append(solve(texts, held))
                    texts, held, size = [], [], 0
            if texts or not parts:
                parts.append(solve(texts, held))
            yield pd.concat(parts, ignore_index=True)

    docs, back, (text,) = set_aside(docs.drop("toxicity", "toxic_tokens", "toxic_spans"), text)
    scored = docs.withColumn("_found", run(F.col(text)))
    return scored.select(*docs.columns, "_found.*").withColumnsRenamed(back)
