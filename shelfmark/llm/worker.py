"""What a Python worker keeps between batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

_HELD: list[tuple[Hashable, object]] = []


def resident(key: Hashable, make: Callable[[], object]) -> object:
    """``make()`` of the last key asked for. Another key's is given up first, and its memory given back to the
    system, so that a worker that serves several stages is as large as one model."""
    if not _HELD or _HELD[0][0] != key:
        vacate()
        _HELD.append((key, make()))
    return _HELD[0][1]


def vacate() -> None:
    """Gives up what the worker holds, for stages that need no model: else one lies in memory beside their own work."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Freed memory that the C library still holds, to the system; libraries without the call do nothing."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
