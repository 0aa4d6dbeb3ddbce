"""What a reused Python worker keeps between tasks, and how it lets go of it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import cache

_KEPT: list = []


def kept_by_worker(make: Callable) -> Callable:
    """make's results, kept by the worker for the tasks after this one until release_kept."""
    made = cache(make)
    _KEPT.append(made)
    return made


def release_kept() -> None:
    """Lets go of all that operators keep in this worker, and gives its memory back.

    Workers outlive the stage that filled their memos; an operator that has none calls this as it begins.
    """
    if not any(made.cache_info().currsize for made in _KEPT):
        return
    for made in _KEPT:
        made.cache_clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)
