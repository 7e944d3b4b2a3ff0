"""Python workers that give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def release() -> None:
    """Gives freed memory back to the system. Workers live on between tasks, and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory once its partition is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """A function of a key and its group that releases memory after each group."""

    def wrapped(key, part):
        try:
            return run(key, part)
        finally:
            release()

    return wrapped


def tidy_pair(run: Callable) -> Callable:
    """A function of a key and the groups of two tables that releases memory after each key."""

    def wrapped(key, left, right):
        try:
            return run(key, left, right)
        finally:
            release()

    return wrapped
