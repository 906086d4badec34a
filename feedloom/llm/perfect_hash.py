"""Minimal perfect hashing of 64-bit keys: n keys to the numbers 0 to n - 1, in about four bits a key.

Keys are thrown into a row of places; those that are alone in theirs are settled, the others go on to a
shorter row under another hash, until none is left. A key's number is the number of settled places before
its own. Keys that were not hashed may get a number too, so whoever looks up compares the key stored there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from feedloom.llm.hash_arrays import map_array, mix, write_array

GAMMA = 2.0  #: places per key of a row


class PerfectHash(NamedTuple):
    sizes: np.ndarray  #: places of every row, multiples of 64
    bits: np.ndarray  #: settled places of all rows, 64 in a word
    before: np.ndarray  #: settled places before every word

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; -1 for some keys that were not hashed."""
        out = np.full(len(keys), -1, np.int64)
        todo, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            place = (mix(keys[todo], np.uint64(level)) % np.uint64(size)).astype(np.int64) + start
            word, bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
            own = self.bits[word]
            hit = (own & bit) != 0
            out[todo[hit]] = self.before[word[hit]] + np.bitwise_count(own[hit] & (bit[hit] - np.uint64(1)))
            todo, start = todo[~hit], start + size
        return out


def build(keys: np.ndarray) -> PerfectHash:
    """Hash distinct keys."""
    rest, sizes, rows = np.asarray(keys, np.uint64), [], []
    while len(rest):
        size = max(64, -(-int(GAMMA * len(rest)) // 64) * 64)
        place = (mix(rest, np.uint64(len(sizes))) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        rows.append(alone)
        rest = rest[~alone[place]]
    settled = np.concatenate(rows) if rows else np.zeros(0, bool)
    bits = np.packbits(settled, bitorder="little").view("<u8").astype(np.uint64)
    counts = np.bitwise_count(bits).astype(np.int64)
    return PerfectHash(np.array(sizes, np.int64), bits, np.cumsum(counts) - counts)


def save(folder: str, name: str, keys: np.ndarray) -> None:
    """Hash distinct keys and write the hash and, by number, the keys."""
    made = build(keys)
    ordered = np.zeros(len(keys), np.uint64)
    ordered[made.numbers(keys)] = keys
    for part, array in zip((*made._fields, "keys"), (*made, ordered)):
        write_array(folder, f"{name}-{part}", array)


def load(folder: str, name: str) -> tuple[PerfectHash, np.ndarray] | None:
    """The hash and the keys by number, mapped; None when they were not written."""
    parts = [map_array(folder, f"{name}-{part}") for part in (*PerfectHash._fields, "keys")]
    if any(p is None for p in parts):
        return None
    return PerfectHash(*parts[:3]), parts[3]


def verified(made: PerfectHash, stored: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of keys, -1 for each that is not among the stored ones."""
    at = made.numbers(keys)
    if len(stored):
        at[stored[np.maximum(at, 0)] != keys] = -1
    return at
