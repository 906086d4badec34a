"""Sorted arrays of 64-bit keys in the shared folder: tasks write them, workers map them into memory.

A table is a set of shards, each a few ``.npy`` files. Where the shared folder is a mounted one
(``file:``), workers map the files in place; from any other file system a worker copies a shard to
its own folder when it first needs it and removes the copies when it ends.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import BinaryIO

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)  # the primes of XXH64


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def mix(values: np.ndarray, seeds: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of eight bytes, element by element."""
    with np.errstate(over="ignore"):
        h = (np.asarray(seeds, np.uint64) + _P5 + np.uint64(8)) ^ (_rotate(values * _P2, 31) * _P1)
        h = _rotate(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def row_keys(rows: np.ndarray) -> np.ndarray:
    """One key per row of a matrix of words (columns first)."""
    key = np.full(rows.shape[1], 42, np.uint64)
    for column in rows:
        key = mix(column, key)
    return key


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)).astype(np.int64) * shards) >> 24


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def local_folder(folder: str) -> str | None:
    """The path of a mounted folder, None for any other file system."""
    if folder.startswith("file:"):
        return "/" + folder[len("file:") :].lstrip("/")
    return None if "://" in folder else folder


@contextmanager
def new_file(folder: str, name: str) -> Iterator[BinaryIO]:
    """A file for writing, under another name until it is whole.

    A task that runs again, or twice, leaves one whole file.
    """
    part = f".{name}-{uuid.uuid4().hex}"
    if (path := local_folder(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, part), "wb") as out:
            yield out
        os.replace(os.path.join(path, part), os.path.join(path, name))
        return
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{part}") as out:
        yield out
    files.move(f"{path}/{part}", f"{path}/{name}")


def read_range(uri: str, start: int, size: int) -> bytes:
    """Some bytes of a file."""
    if (path := local_folder(uri)) is not None:
        with open(path, "rb") as source:
            source.seek(start)
            return source.read(size)
    files, path = _filesystem(uri)
    with files.open_input_file(path) as source:
        source.seek(start)
        return source.read(size)


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    data = io.BytesIO()
    np.save(data, array)
    with new_file(folder, f"{name}.npy") as out:
        out.write(data.getbuffer())


@lru_cache(maxsize=1)
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="arrays-")
    atexit.register(shutil.rmtree, made, True)
    return made


def map_array(folder: str, name: str) -> np.ndarray | None:
    """The array as a read-only memory map; None when no task wrote it."""
    if (path := local_folder(folder)) is not None:
        path = os.path.join(path, f"{name}.npy")
        if not os.path.exists(path):
            return None
    else:
        from pyarrow import fs

        files, remote = _filesystem(folder)
        if files.get_file_info(f"{remote}/{name}.npy").type == fs.FileType.NotFound:
            return None
        path = os.path.join(_own_folder(), f"{uuid.uuid4().hex}.npy")
        with files.open_input_stream(f"{remote}/{name}.npy") as source, open(path, "wb") as copy:
            shutil.copyfileobj(source, copy)
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:  # an empty array cannot be mapped
        return np.load(path)


def find(keys: np.ndarray | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted ``wanted`` in sorted ``keys``, and whether each is there."""
    if keys is None or not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted
