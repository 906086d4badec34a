"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k without replacement.

A text's lattice has a node per place and an edge per vocabulary piece; the weight of a piece falls with
its rank in the vocabulary, and a segmentation has the probability of its edges' weights over that of all
paths. No piece crosses from a letter to the space mark, so the lattice is a chain of chunk lattices, and
equal chunks share theirs: the backward sums give every edge its probability given its node.

The sampler is a perturbed best-first search from the root. A node stands for all segmentations that
begin alike, and its perturbed value is the greatest Gumbel among them, so the search pops whole
segmentations in falling order of their perturbed values. Popping one leaves, at each node on its way, the
set of all other ways to go on; such a set is one frontier entry, whose value is a Gumbel at the set's log
probability, conditioned to stay below the value popped. Only the best entry is opened next. The values of
a row come from its key, so they do not depend on batches, partitions or retries. The value next in line
after k pops is the threshold that gives each sample its inclusion probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.hash_arrays import mix
from feedloom.llm.workers import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Chunks up to so many characters are summed up without logarithms: 32,000^-60 is still a float.
LINEAR_CHARS = 60
#: Characters of texts that a worker takes at once.
BATCH_CHARS = 400_000
#: Characters of texts whose chunks are numbered before any of them is worked on.
GROUP_CHARS = 32_000_000
#: Chunks that a task keeps from batch to batch, with their lattices and ids.
KNOWN_CHUNKS = 200_000
#: Chunks of texts that are sampled together.
SAMPLER_CHUNKS = 200_000
#: Steps of a path whose perturbed values are made at once, at first.
OPENED = 24
#: Slots of the table of piece beginnings, in bits.
_SLOT_BITS = 18


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


class Vocabulary:
    """Pieces as a tree of their beginnings, with log weights, and the byte pieces for what has none.

    The tree is a hash table over (beginning, next character); ``beginning`` and ``piece`` are those that
    an entry leads to, a piece is -1 where the beginning is none.
    """

    def __init__(self, model: str):
        self.processor = p = processor(model)
        usable = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        pieces = {i: p.id_to_piece(i) for i in usable}
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces.values()):
            raise ValueError("a piece holds a space mark after a letter; chunks cannot be told apart")
        weights = np.zeros(p.get_piece_size())
        for rank, i in enumerate(sorted(usable, key=lambda i: (-p.get_score(i), i)), 1):
            weights[i] = -np.log(rank)
        begun: dict[str, int] = {"": 0}
        keys: list[int] = []
        for piece in pieces.values():
            for size in range(1, len(piece) + 1):
                if piece[:size] not in begun:
                    begun[piece[:size]] = len(begun)
                    keys.append(begun[piece[: size - 1]] << 21 | ord(piece[size - 1]))
        made = np.full(len(begun), -1, np.int32)
        for i, piece in pieces.items():
            made[begun[piece]] = i
        order = np.argsort(slots := self._slot(np.array(keys, np.int64)))
        slots = slots[order]
        self._keys = np.append(np.array(keys, np.int64)[order], -1)  # the last one is for empty slots
        self._again = np.append(slots[1:] == slots[:-1], [False, False])  # the next entry has the same slot
        self._entry = np.full(1 << _SLOT_BITS, len(keys), np.int32)
        self._entry[slots[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.beginning = order + 1
        self.piece = made[self.beginning]
        self.longest = max(map(len, pieces.values()))
        self.weights, self.chances = weights, np.exp(weights)
        self.bytes = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_weight = -float(np.log(len(usable) + 1))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)

    def extended(self, beginnings: np.ndarray | int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which beginnings go on with one more character, and the entries that they lead to."""
        keys = codes | (beginnings << 21)
        entry = self._entry[self._slot(keys)]
        found = self._keys[entry] == keys
        others = np.flatnonzero(self._again[entry] & ~found)
        while len(others):
            entry[others] += 1
            at = entry[others]
            found[others] = same = self._keys[at] == keys[others]
            others = others[self._again[at] & ~same]
        goes_on = np.flatnonzero(found)
        return goes_on, entry[goes_on]


@lru_cache(maxsize=2)
def vocabulary_of(model: str) -> Vocabulary:
    return Vocabulary(model)


class Lattices:
    """Lattices of distinct chunks, laid end to end.

    Chunks are given without their first space mark.

    A node is known by the first edge out of it; its other edges come behind it, shortest first. ``heads``
    are the chunks' first edges. An edge has the first edge of the node where it ends (``onward``, -1 at
    the chunk's end), its ``piece`` (a vocabulary id, or minus one minus the character that goes byte by
    byte), its probability ``p`` given its node, and the sum of these up to it (``upto``, 2 at a node's last).
    """

    COLUMNS = ("onward", "piece", "p", "upto")

    def __init__(self, chunks: list[str], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        ends = np.cumsum(sizes + 1) - 1  # a node per place and one for each chunk's end
        n_nodes = int((sizes + 1).sum())
        characters = np.ones(n_nodes, bool)
        characters[ends] = False
        places = np.flatnonzero(characters)
        codes = np.full(n_nodes, 0x1FFFFF)  # no character: nothing goes on beyond a chunk's end
        codes[places] = np.frombuffer((SPACE * bool(chunks) + SPACE.join(chunks)).encode("utf-32-le", "surrogatepass"), np.uint32)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # by size: the places where pieces begin, and the pieces
        live, beginnings = places, 0
        for size in range(1, vocabulary.longest + 1):
            goes_on, entry = vocabulary.extended(beginnings, codes[live + (size - 1)] if size > 1 else codes[live])
            piece = vocabulary.piece[entry]
            begun = live[goes_on]
            if size == 1:  # a character without a piece goes byte by byte
                pieces = (-1 - codes[live]).astype(np.int32)
                pieces[goes_on] = np.where(piece >= 0, piece, pieces[goes_on])
                found.append((live, pieces))
            else:
                hit = np.flatnonzero(piece >= 0)
                found.append((begun[hit], piece[hit]))
            live, beginnings = begun, vocabulary.beginning[entry]
            if not len(live):
                break

        # edges in order of their node, shortest first
        degree = np.zeros(n_nodes, np.int32)
        for sources, _ in found:
            degree[sources] += 1
        n_edges = int(degree.sum())
        place = np.cumsum(degree, dtype=np.int32) - degree
        first = place.copy()
        target, self.piece = np.empty(n_edges, np.int32), np.empty(n_edges, np.int32)
        for size, (sources, pieces) in enumerate(found, 1):
            put = place[sources]
            target[put], self.piece[put] = sources + size, pieces
            place[sources] = put + 1
        self.heads = first[ends - sizes].astype(np.int64)
        self.onward = np.where(characters, first, np.int32(-1))[target]
        odd = np.flatnonzero(self.piece < 0)
        odd_weight = vocabulary.byte_weight * _utf8_sizes(-1 - self.piece[odd])

        # backward sums, from the chunks' ends on: all nodes at one distance from their end together
        short = sizes <= LINEAR_CHARS
        self.p = vocabulary.chances[np.maximum(self.piece, 0)]
        self.p[odd] = np.exp(odd_weight)
        self.upto = np.empty(n_edges)
        sums = np.ones(n_nodes)
        self._sum_up(ends[short], sizes[short], first, degree, target, self.p, sums, False)
        of_owner = np.repeat(sums, degree)
        self.p *= sums[target]
        self.p /= of_owner
        self.upto /= of_owner
        if not short.all():  # the sums of long chunks leave the range of floats; theirs are logarithms
            weight = vocabulary.weights[np.maximum(self.piece, 0)]
            weight[odd] = odd_weight
            logs = np.zeros(n_nodes)
            long = np.flatnonzero(np.repeat(np.repeat(~short, sizes + 1), degree))
            self._sum_up(ends[~short], sizes[~short], first, degree, target, weight, logs, True)
            of_owner = np.repeat(logs, degree)[long]
            self.p[long] = np.exp(weight[long] + logs[target[long]] - of_owner)
            self.upto[long] = np.exp(self.upto[long] - of_owner)
        self.upto[place[places] - 1] = 2.0  # a node's last edge takes what is left
        self.n_edges = n_edges

    def log_p(self, edges: np.ndarray) -> np.ndarray:
        return np.log(self.p[edges])

    def add(self, other: Lattices) -> None:
        """Lay other chunks' lattices behind these; the columns have room to grow beyond ``n_edges``."""
        edges, n_edges = self.n_edges, self.n_edges + other.n_edges
        self.heads = np.concatenate((self.heads, other.heads + edges))
        other.onward[other.onward >= 0] += edges
        for name in self.COLUMNS:
            column = getattr(self, name)
            if n_edges > len(column):
                column = np.empty(2 * n_edges, column.dtype)
                column[:edges] = getattr(self, name)[:edges]
                setattr(self, name, column)
            column[edges:n_edges] = getattr(other, name)
        self.n_edges = n_edges

    def keep(self, chunks: np.ndarray) -> None:
        """Leave only the chunks at these rising places."""
        sizes = np.diff(self.heads, append=self.n_edges)[chunks]
        edges = _ranges(self.heads[chunks], sizes)
        heads = np.cumsum(sizes) - sizes
        back = np.repeat(heads - self.heads[chunks], sizes).astype(np.int32)
        back[self.onward[edges] < 0] = 0
        self.onward[edges] += back
        for name in self.COLUMNS:
            column = getattr(self, name)
            column[: len(edges)] = column[edges]
        self.heads, self.n_edges = heads, len(edges)

    def _sum_up(self, ends: np.ndarray, sizes: np.ndarray, first: np.ndarray, degree: np.ndarray, target: np.ndarray, weight: np.ndarray, sums: np.ndarray, logs: bool) -> None:
        if not len(ends):
            return
        # nodes by distance from their end, those with most edges first
        distance = _ranges(np.ones(len(sizes), np.int64), sizes)
        nodes = np.repeat(ends, sizes) - distance
        most = int(degree.max())
        rank = distance * (most + 1) + (most - degree[nodes])
        n_ranks = int(sizes.max() + 1) * (most + 1)
        # how many nodes of a distance have at least so many edges
        table = np.bincount(rank, minlength=n_ranks).reshape(-1, most + 1)
        np.cumsum(table, axis=1, out=table)
        nodes = nodes[np.argsort(rank.astype(np.uint16) if n_ranks <= 1 << 16 else rank, kind="stable")]
        first = first[nodes].astype(np.int64)
        start = 0
        for row in table[1:, ::-1]:
            counts = row.tolist()
            end = start + counts[0]
            edges = first[start:end]
            total = weight[edges] + sums[target[edges]] if logs else weight[edges] * sums[target[edges]]
            self.upto[edges] = total
            for j in range(1, most):
                if not (n := counts[j + 1]):
                    break
                at = edges[:n] + j
                if logs:
                    np.logaddexp(total[:n], weight[at] + sums[target[at]], out=total[:n])
                else:
                    total[:n] += weight[at] * sums[target[at]]
                self.upto[at] = total[:n]
            sums[nodes[start:end]] = total
            start = end

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node, by its probability."""
        edges = nodes.copy()
        further = np.flatnonzero(self.upto[edges] <= u)
        u = u[further]
        while len(further):
            at = edges[further] + 1
            edges[further] = at
            on = np.flatnonzero(self.upto[at] <= u)
            further, u = further[on], u[on]
        return edges

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, one after the other, and where each edge's begin, and the end."""
        pieces = self.piece[edges]
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces, np.arange(len(pieces) + 1)
        character = -1 - pieces[odd]
        n = _utf8_sizes(character)
        starts = np.ones(len(pieces) + 1, np.int64)
        starts[0], starts[odd + 1] = 0, n
        made = np.repeat(pieces, starts[1:])
        np.cumsum(starts, out=starts)
        # the bytes of characters in UTF-8: six bits each, after a lead that tells their number
        at = _ranges(starts[odd], n)
        j = _ranges(np.zeros(len(n), np.int64), n)
        n, bits = np.repeat(n, n), np.repeat(character, n)
        bits = bits >> (6 * (n - 1 - j))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        made[at] = self.vocabulary.bytes[np.where(j == 0, lead | bits, 0x80 | (bits & 0x3F))]
        return made, starts


def _utf8_sizes(characters: np.ndarray) -> np.ndarray:
    return 1 + (characters > 0x7F) + (characters > 0x7FF) + (characters > 0xFFFF).astype(np.int64)


def uniforms(keys: np.ndarray, counter: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from keys and what they are drawn for."""
    x = mix(np.broadcast_to(np.asarray(counter, np.int64), keys.shape).view(np.uint64), keys)
    return ((x >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)


def _counter(draw: int, place: np.ndarray, depth: np.ndarray | int = 0) -> np.ndarray:
    return (place << 24) + (depth << 8) + draw


def _below(log_mass: np.ndarray, u: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbels at ``log_mass``, conditioned to stay below ``bound``."""
    return log_mass - np.log(np.exp(log_mass - bound) - np.log(u))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Paths(NamedTuple):
    """One segmentation per row, laid end to end."""

    starts: np.ndarray  # first step by row, and the end
    heads: np.ndarray  # first step by chunk, and the end
    edge: np.ndarray


class _Frontier:
    """The other ways to go on from each step of paths: their perturbed values, opened as far as they can matter.

    A Gumbel at the log probability m of a set is below m + ``REACH``, as uniforms are 52 bits, and m falls
    along a path. So the steps of a row from ``opened`` on stay below ``bound``, and they are opened only
    when no value beats that.
    """

    REACH = 37.0  # above -log(-log(1 - 2**-53))

    def __init__(self, pop: int, path: _Paths, log_p: np.ndarray, fixed: np.ndarray, taken: np.ndarray, value: np.ndarray, alive: np.ndarray):
        self.pop, self.path, self.fixed, self.taken, self.below = pop, path, fixed, taken, value
        self.sums = np.concatenate(([0.0], np.cumsum(log_p)))
        self.sizes = np.diff(path.starts)
        self.opened = np.where(alive, fixed, self.sizes)  # before that steps are shared with the path it left
        self.bound = np.where(alive & (self.opened < self.sizes), np.inf, -np.inf)
        self.values = np.full(len(path.edge), -np.inf)
        self.top, self.step = np.full(len(fixed), -np.inf), np.zeros(len(fixed), np.int64)

    def open(self, rows: np.ndarray, sampler: Sampler) -> None:
        """Open at least ``OPENED`` more steps of the rows."""
        starts, opened = self.path.starts[rows], self.opened[rows]
        until = np.minimum(self.sizes[rows], 2 * opened - self.fixed[rows] + OPENED)
        steps = _ranges(starts + opened, until - opened)
        row = np.repeat(rows, until - opened)
        within = steps - self.path.starts[row]
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.log(-np.expm1(np.minimum(sampler.lattices.log_p(self.path.edge[steps]), -0.0)))
            if self.taken.shape[1]:
                branch = np.flatnonzero((within == self.fixed[row]) & (self.taken[row] >= 0).any(axis=1))
                edges = self.path.edge[steps[branch]]
                closed = np.column_stack([self.taken[row[branch]], edges])
                rest[branch] = sampler.others(sampler.node(self.path, steps[branch]), closed)[1]
            mass = self.sums[steps] - self.sums[self.path.starts[row]] + rest
            made = _below(mass, uniforms(sampler.keys[row], _counter(2 * self.pop + 1, within)), self.below[row])
        made[~np.isfinite(mass)] = -np.inf
        self.values[steps] = made
        self.opened[rows] = until
        self.bound[rows] = np.where(until < self.sizes[rows], self.sums[starts + until] - self.sums[starts] + self.REACH, -np.inf)
        self.find(rows)

    def take(self, rows: np.ndarray) -> None:
        """Shut the best step of the rows."""
        self.values[self.path.starts[rows] + self.step[rows]] = -np.inf
        self.find(rows)

    def find(self, rows: np.ndarray) -> None:
        """The rows' best opened step, the first of equals."""
        rows = rows[self.opened[rows] > self.fixed[rows]]
        n = self.opened[rows] - self.fixed[rows]
        steps = _ranges(self.path.starts[rows] + self.fixed[rows], n)
        values, heads = self.values[steps], np.cumsum(n) - n
        top = np.maximum.reduceat(values, heads) if len(rows) else np.zeros(0)
        at = np.flatnonzero(values == np.repeat(top, n))
        which = np.repeat(np.arange(len(rows)), n)[at]
        place = np.zeros(len(rows), np.int64)
        place[which[::-1]] = (at - heads[which])[::-1]
        self.top[rows], self.step[rows] = top, place + self.fixed[rows]


class Sampler:
    """Samples the rows of a batch in step: each pop serves every row that has segmentations left."""

    def __init__(self, lattices: Lattices, sizes: np.ndarray, roots: np.ndarray, keys: np.ndarray):
        self.lattices, self.keys = lattices, keys
        self.chunks_end = np.cumsum(sizes)
        self.chunks_start = self.chunks_end - sizes
        self.roots = roots.astype(np.int32)
        self.row_of_chunk = np.repeat(np.arange(len(sizes)), sizes)
        self._fixed = [np.zeros(len(sizes), np.int64)]  # by pop and row: the step at which its path left another

    def _walk(self, pop: int, chunk: np.ndarray, node: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Freely drawn edges from the nodes on to their chunks' ends: how many for each node, and all in order."""
        lattices, steps = self.lattices, []
        row = self.row_of_chunk[chunk]
        keys, who = self.keys[row], np.arange(len(chunk))
        counter = _counter(2 * pop, chunk - self.chunks_end[row], depth)  # counted from the text's end, the same in any batch
        count = np.zeros(len(chunk), np.int64)
        while True:
            ended = node < 0
            count[who[ended]] = len(steps)
            if len(live := np.flatnonzero(~ended)) < len(node):
                who, node, keys, counter = who[live], node[live], keys[live], counter[live]
            if not len(who):
                break
            edge = lattices.draw(node, uniforms(keys, counter))
            steps.append((who, edge))
            node = lattices.onward[edge]
            counter += 1 << 8
        starts = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int32)
        for who, edge in steps:
            edges[starts[who]] = edge
            starts += 1
        return count, edges

    def _joined(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First steps by row and by chunk, from the chunks' numbers of steps."""
        heads = np.concatenate(([0], np.cumsum(count)))
        return heads[np.concatenate(([0], self.chunks_end))], heads

    def node(self, path: _Paths, steps: np.ndarray) -> np.ndarray:
        """Where the steps begin."""
        chunk = np.searchsorted(path.heads, steps, side="right") - 1
        onward = self.lattices.onward[path.edge[np.maximum(steps - 1, 0)]]
        return np.where(path.heads[chunk] == steps, self.roots[chunk], onward)

    def run(self, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
        rows = len(self.keys)
        frontiers: list[_Frontier] = []
        score, popped = np.zeros((0, rows)), np.zeros((0, rows))
        fixed = np.zeros(rows, np.int64)  # steps that a row's newest path shares with the one it left
        value = -np.log(-np.log(uniforms(self.keys, 0)))
        alive = np.ones(rows, bool)
        count, edge = self._walk(1, np.arange(len(self.roots)), self.roots, 0)
        path = _Paths(*self._joined(count), edge)
        taken = np.full((rows, 0), -1)  # edges taken before at the branching node
        for pop in range(1, k + 1):
            log_p = self.lattices.log_p(path.edge)
            some = np.flatnonzero(np.diff(path.starts))
            whole = np.zeros(rows)
            if len(some):
                whole[some] = np.add.reduceat(log_p, path.starts[some])
            score = np.vstack([score, np.where(alive, whole, -np.inf)])
            popped = np.vstack([popped, np.where(alive, value, -np.inf)])
            frontiers.append(_Frontier(pop, path, log_p, fixed, taken, value, alive))
            chosen, value = self._next(frontiers)
            alive = value > -np.inf
            if pop == k or not alive.any():
                break
            path, taken, fixed = self._branched(pop + 1, frontiers, chosen, alive)
        return self._made([f.path for f in frontiers], score, popped, value)

    def _next(self, frontiers: list[_Frontier]) -> tuple[np.ndarray, np.ndarray]:
        """For each row which frontier has the best entry, the first of equals, and its value."""
        while True:
            tops = np.stack([f.top for f in frontiers])
            best = tops.max(axis=0)
            shut = True
            for f in frontiers:
                if len(rows := np.flatnonzero(f.bound > best)):
                    f.open(rows, self)
                    shut = False
            if shut:
                return tops.argmax(axis=0), best

    def others(self, nodes: np.ndarray, closed: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Edges out of the nodes that are not closed (flat, with the position of their node), and their log mass."""
        degree = self.lattices.draw(nodes, np.ones(len(nodes))) - nodes + 1  # to the last edge, which alone is above one
        edges = _ranges(nodes, degree)
        owner = np.repeat(np.arange(len(nodes)), degree)
        open_ = ~(closed[owner] == edges[:, None]).any(axis=1)
        mass = np.full(len(nodes), -np.inf)
        np.logaddexp.at(mass, owner[open_], self.lattices.log_p(edges[open_]))
        return (edges[open_], owner[open_]), mass

    def _branched(self, pop: int, frontiers: list[_Frontier], chosen: np.ndarray, alive: np.ndarray) -> tuple[_Paths, np.ndarray, np.ndarray]:
        """New paths: each row's best entry opened at its step, drawn freely from there on."""
        rows = len(chosen)
        live = np.flatnonzero(alive)
        step = np.array([f.step for f in frontiers])[chosen, np.arange(rows)]
        node, edge, chunk, depth = (np.zeros(len(live), np.int64) for _ in range(4))
        taken = np.full((rows, pop - 1), -1)
        count = np.zeros(len(self.roots), np.int64)
        for i, f in enumerate(frontiers):
            mine = np.flatnonzero(chosen[live] == i)
            own, of = f.path, live[mine]
            here = own.starts[of] + step[of]
            chunk[mine] = at = np.searchsorted(own.heads, here, side="right") - 1
            node[mine], edge[mine], depth[mine] = self.node(own, here), own.edge[here], here - own.heads[at]
            same = step[of] == self._fixed[i][of]  # the same node is opened once more
            taken[of, : f.taken.shape[1]] = np.where(same[:, None], f.taken[of], -1)
            before = _ranges(self.chunks_start[of], at - self.chunks_start[of])
            count[before] = own.heads[before + 1] - own.heads[before]
            f.take(of)
        taken[live, pop - 2] = edge
        (edges, owner), mass = self.others(node, taken[live])
        weights = np.exp(self.lattices.log_p(edges) - mass[owner])
        sums = np.cumsum(weights)
        starts = np.searchsorted(owner, np.arange(len(live)))
        ends = np.searchsorted(owner, np.arange(len(live)), side="right")
        base = np.concatenate(([0.0], sums))[starts]
        u = uniforms(self.keys[live], 2 * pop)
        pick = np.clip(np.searchsorted(sums, base + u * (sums[ends - 1] - base), side="right"), starts, ends - 1)
        drawn = edges[pick]

        left = self.chunks_end[live] - chunk
        onward = _ranges(chunk, left)  # the rest of the branching chunk and all chunks after it
        at = np.cumsum(left) - left
        nodes, depths = self.roots[onward], np.zeros(len(onward), np.int64)
        nodes[at], depths[at] = self.lattices.onward[drawn], depth + 1
        more, walked = self._walk(pop, onward, nodes, depths)
        count[onward] = more
        count[chunk] += depth + 1
        row_starts, heads = self._joined(count)
        whole = np.empty(heads[-1], np.int32)
        for i, f in enumerate(frontiers):
            of = live[chosen[live] == i]
            whole[_ranges(row_starts[of], step[of])] = f.path.edge[_ranges(f.path.starts[of], step[of])]
        here = row_starts[live] + step[live]
        whole[here] = drawn
        whole[_ranges(here + 1, row_starts[live + 1] - here - 1)] = walked
        self._fixed.append(np.where(alive, step, -1))
        return _Paths(row_starts, heads, whole), taken, np.where(alive, step, 0)

    def _made(self, paths, score, popped, threshold) -> list[list[tuple[np.ndarray, float, float]]]:
        out: list[list] = [[] for _ in range(len(threshold))]
        for own, log_q, value in zip(paths, score, popped):
            ids, starts = self.lattices.ids(own.edge)
            cuts = starts[own.starts].tolist()
            with np.errstate(over="ignore", invalid="ignore"):
                certain = np.where(threshold == -np.inf, 1.0, -np.expm1(-np.exp(np.minimum(log_q - threshold, 700.0))))
            for r in np.flatnonzero(value > -np.inf).tolist():
                out[r].append((ids[cuts[r] : cuts[r + 1]], float(log_q[r]), float(certain[r])))
        return out


class KnownChunks:
    """Lattices and the model's own ids of chunks, kept as long as an expected batch needs them again.

    No piece crosses from one chunk to the next, so the ids of a text are those of its chunks. Beyond
    ``KNOWN_CHUNKS`` the chunks that no batch needs are forgotten, and of the others those that the fewest
    need, until half of that are left; they are made anew when met again.
    """

    def __init__(self, model: str):
        self.own, self.vocabulary = processor(model), vocabulary_of(model)
        self.names = pa.array([], pa.string())  # all numbered chunks
        self.uses = np.zeros(0, np.int32)  # by number: expected batches that have the chunk
        self.place = np.zeros(0, np.int32)  # by number: among the chunks that are kept, or -1
        self.kept = np.zeros(0, np.int64)  # by place: the number
        self.lattices = Lattices([], self.vocabulary)
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def number(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of chunks, in the order in which they are met first."""
        coded = pa.concat_arrays([self.names.cast(chunks.type), chunks]).dictionary_encode()
        numbers = coded.indices.to_numpy()[len(self.names) :]
        more = len(coded.dictionary) - len(self.names)
        self.names = coded.dictionary
        self.uses = np.concatenate((self.uses, np.zeros(more, np.int32)))
        self.place = np.concatenate((self.place, np.full(more, -1, np.int32)))
        return numbers

    def number_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many chunks each text has, and the numbers of all of them; null is like empty."""
        words = pc.split_pattern(texts := pc.fill_null(texts, ""), " ")
        per_text = pc.list_value_length(words).to_numpy().astype(np.int64)
        numbers = self.number(pc.list_flatten(words))
        # an empty word is a space mark that belongs to a word beside it, or an empty text
        odd = pc.or_(pc.equal(pc.binary_length(self.names), 0), pc.match_substring(self.names, SPACE)).to_numpy(zero_copy_only=False)
        if odd.any():
            rows = np.unique(np.repeat(np.arange(len(texts)), per_text)[odd[numbers]])
            split = [chunks_of(texts[i].as_py()) for i in rows.tolist()]
            starts = np.cumsum(per_text) - per_text
            per_text[rows] = sizes = np.fromiter(map(len, split), np.int64, len(split))
            starts[rows] = len(numbers) + np.cumsum(sizes) - sizes
            others = self.number(pa.array(list(chain.from_iterable(split)), texts.type))
            numbers = np.concatenate((numbers, others))[_ranges(starts, per_text)]
        return per_text, numbers

    def expect(self, numbers: np.ndarray) -> None:
        """A batch with these chunks is to come."""
        self.uses[self._distinct(numbers)] += 1

    def know(self, per_text: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Know all chunks of an expected batch: how many each text has, and the places of all of them."""
        if len(self.kept) > KNOWN_CHUNKS:
            self._forget()
        distinct = self._distinct(numbers)
        new = distinct[self.place[distinct] < 0]
        if len(new):
            names = self.names.take(pa.array(new)).to_pylist()
            self.lattices.add(Lattices(names, self.vocabulary))
            # a lone space mark is no text of its own
            encoded = [e if c else [self.own.piece_to_id(SPACE)] for c, e in zip(names, self.own.encode(names, num_threads=1))]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            more = np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))
            self.ends = np.concatenate((self.ends, len(self.ids) + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, more))
            self.place[new] = np.arange(len(self.kept), len(self.kept) + len(new))
            self.kept = np.concatenate((self.kept, new))
        self.uses[distinct] -= 1
        return per_text, self.place[numbers]

    def meet(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Know all chunks of a batch that was not expected."""
        numbers = self.number(pa.array(list(chain.from_iterable(split)), pa.string()))
        self.expect(numbers)
        return self.know(np.fromiter(map(len, split), np.int64, len(split)), numbers)

    def _distinct(self, numbers: np.ndarray) -> np.ndarray:
        met = np.zeros(len(self.uses), bool)
        met[numbers] = True
        return np.flatnonzero(met)

    def encode(self, per_text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's end."""
        sizes = np.diff(self.ends, prepend=0)[places]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(per_text)]
        return self.ids[_ranges(self.ends[places] - sizes, sizes)], ends

    def _forget(self) -> None:
        uses = self.uses[self.kept]
        kept = np.flatnonzero(uses)
        if len(kept) > KNOWN_CHUNKS // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: KNOWN_CHUNKS // 2]])
        sizes = np.diff(self.ends, prepend=0)[kept]
        self.ids = self.ids[_ranges(self.ends[kept] - sizes, sizes)]
        self.ends = np.cumsum(sizes)
        self.lattices.keep(kept)
        self.place[self.kept] = -1
        self.kept = self.kept[kept]
        self.place[self.kept] = np.arange(len(kept))


def known_batches(texts: pa.Array, model: str) -> Iterator[tuple[int, int, KnownChunks, tuple[np.ndarray, np.ndarray]]]:
    """Batches of rows as start and end, with the chunks known to each and what ``know`` tells of them.

    All chunks of ``GROUP_CHARS`` are numbered first, so it is known which of them come again.
    """
    chars = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    for first, last in _cuts(chars, GROUP_CHARS):
        known, batches = KnownChunks(model), []
        per_text, numbers = known.number_texts(texts.slice(first, last - first))
        ends = np.concatenate(([0], np.cumsum(per_text)))
        for start, end in _cuts(chars[first:last], BATCH_CHARS):
            own = numbers[ends[start] : ends[end]]
            known.expect(own)
            batches.append((first + start, first + end, per_text[start:end], own))
        for start, end, *batch in batches:
            yield start, end, known, known.know(*batch)


def sample_segmentations(texts: list[str], k: int, keys: np.ndarray, vocabulary: Vocabulary) -> list[list[tuple[np.ndarray, float, float]]]:
    """Of every text up to ``k`` distinct segmentations, best perturbed value first.

    Each is (piece ids, log probability, probability of being among the k). Fewer come when a lattice
    has fewer paths; then all are certain.
    """
    split = [chunks_of(t) for t in texts]
    place = {chunk: i for i, chunk in enumerate(dict.fromkeys(chain.from_iterable(split)))}
    places = np.array([place[chunk] for chunk in chain.from_iterable(split)], np.int64)
    return _sampled(Lattices(list(place), vocabulary), np.array(list(map(len, split)), np.int64), places, k, keys)


def _sampled(lattices: Lattices, per_text: np.ndarray, places: np.ndarray, k: int, keys: np.ndarray) -> list[list[tuple[np.ndarray, float, float]]]:
    keys = np.asarray(keys, np.int64).view(np.uint64)
    made: list = []
    roots, ends = lattices.heads[places], np.cumsum(per_text)
    for start, end in _cuts(ends, SAMPLER_CHUNKS):
        own = roots[ends[start] - per_text[start] : ends[end - 1]] if end > start else roots[:0]
        made += Sampler(lattices, per_text[start:end], own, keys[start:end]).run(k)
    return made


def _cuts(ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of rows whose ends are in one multiple of the size."""
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(ends)]
    return list(zip(cuts, cuts[1:]))


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first space mark."""
    if not text:
        return []
    if SPACE not in text and "" not in (words := text.split(" ")):
        return words
    return [chunk[1:] for chunk in _CHUNK.findall(marked(text))]


def marked(text: str) -> str:
    """The text as the vocabulary sees it: a space mark in front and for every space."""
    return SPACE + text.replace(" ", SPACE) if text else ""


SAMPLES = T.ArrayType(
    T.StructType([
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()),
        T.StructField("inclusion", T.DoubleType()),
    ])
)


def encode_pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 2, seed: int = 0, model: str = MODEL, decoded: str | None = None) -> DataFrame:
    """``docs`` with ids (the model's own encoding) and samples (k distinct segmentations) of every text.

    A sample has ids, log_prob (of the segmentation among all) and inclusion (its probability of being
    among the k); samples come in the order in which sampling without replacement draws them. Rows are
    seeded by ``seed`` and a hash of their id, so repeated rows get the same samples, and all rows with a
    null id share one seed. Null and empty texts have no ids and one certain sample without ids. A
    literal space mark in a text is encoded like a space, as the model itself does it. ``decoded`` names a
    column for the text that the ids decode to. An empty table gives an empty result. Whole texts are taken:
    a worker holds the numbers of the chunks of ``GROUP_CHARS`` and the lattices of ``KNOWN_CHUNKS`` and of
    a batch, or of one text where that is longer. Columns called ids, samples or like ``decoded`` are
    replaced, all others are kept, whatever their names.
    """
    made = ["ids", "samples", *([decoded] if decoded else [])]
    kept = [c for c in docs.columns if c not in made]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(model)
        kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64())]))

        for frame in frames:
            for start, end, known, met in known_batches(frame.column(frame.num_columns - 1), model):
                part = frame.slice(start, end - start)
                keys = part.column(part.num_columns - 2).to_numpy()
                encoded, stops = known.encode(*met)
                starts = np.concatenate(([0], stops))
                ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(encoded, pa.int32()))
                back = [pa.array(own.decode([encoded[a:b] for a, b in zip(starts, stops)], num_threads=1) if part.num_rows else [], pa.string())] if decoded else []
                del encoded
                samples = _sampled(known.lattices, *met, k, keys)
                flat = [s for row in samples for s in row]
                numbers = np.concatenate([s[0] for s in flat]) if flat else np.zeros(0, np.int32)
                ends = np.cumsum([0, *(len(s[0]) for s in flat)])
                rows = pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32())),
                     pa.array([s[1] for s in flat], pa.float64()), pa.array([s[2] for s in flat], pa.float64())],
                    fields=list(kind.value_type),
                )
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, samples)]), pa.int32()), rows)
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, ids, lists, *back], [*kept, *made])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("samples", SAMPLES)])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    # the last two columns are the key and the text, whatever the others are called
    seeded = docs.select(*kept, F.xxhash64(F.lit(seed), F.col(id)), F.col(text)).toDF(*(f"c{i}" for i in range(len(kept) + 2)))
    return seeded.mapInArrow(tidy(run), schema)


def decode_ids(df: DataFrame, ids: str = "ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text of an array of piece ids; null gives null, an empty array an empty text.

    Ids outside the vocabulary are an error.
    """

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        own = processor(model)
        return pd.Series([None if r is None else own.decode(r.tolist()) for r in rows], dtype=object)

    return df.withColumn(name, run(F.col(ids)))
