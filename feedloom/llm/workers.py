"""What Python workers owe to the stages after them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps


def _give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's generator that hands freed memory back to the system when it ends.

    Spark keeps workers for later tasks; without this each keeps what its largest task ever held, also
    while stages run that need the memory for something else.
    """

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped
