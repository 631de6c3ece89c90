"""What a Python worker keeps from one task to the next: one thing at a time.

Workers outlive the stage that they began with, and stages of a pipeline share them. Each operator
names what it keeps (or that it keeps nothing) before its first slice, and what a worker kept for
another goes, so that the stages' tables never add up.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_now: tuple[Hashable, object] = (None, None)


def keep(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, made anew only if this worker last kept something else."""
    global _now
    if _now[0] != key:
        drop()
        _now = (key, make())
    return _now[1]


def drop() -> None:
    """Lets go of what the worker keeps, and gives free memory back to the machine, also that of stages that kept nothing."""
    global _now
    _now = (None, None)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
