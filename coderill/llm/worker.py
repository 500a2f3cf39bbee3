"""Memory of Python workers, which outlive tasks and operators.

A worker keeps the tables of the operator that it ran last, and hands freed memory back at a task's end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_kept: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gave when this worker was first asked for ``key``; what it keeps for other keys goes."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    _kept.clear()


def hand_back() -> None:
    """Give memory that is free to the system, as far as the platform's allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forgetting: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with memory handed back at its end and, before it, what other operators kept."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forgetting:
            forget()
            hand_back()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return tidied
