"""What Python workers give back when their part of a job ends."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa


@lru_cache(maxsize=1)
def _trim():
    """malloc_trim of the C library, where it has one."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except (OSError, TypeError):
        return None


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def lean(run):
    """`run`, a function from batches to batches. Spark keeps an idle worker beside the stages that follow, and
    the worker keeps what it freed; after the last batch that goes back to the system."""

    def lean_run(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run
