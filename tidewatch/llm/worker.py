"""What a Python worker keeps between tasks: one thing of one operator.

Workers are reused by whatever runs next, so an automaton, a vocabulary or remembered words of an operator that is
done would otherwise add up with those of the next ones.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict = {}


def held(name, build: Callable):
    """The thing of this name, built at its first use; another one that was held is let go."""
    if name not in _held:
        if _held:
            _held.clear()
            gc.collect()
            give_back()
        _held[name] = build()
    return _held[name]


def give_back() -> None:
    """Hand memory that is free again back to the system, which the allocators else keep for the worker's whole life."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


class Same:
    """A name for one object (and not for its equals)."""

    def __init__(self, kind: str, of):
        self.kind, self.of = kind, of

    def __hash__(self):
        return hash((self.kind, id(self.of)))

    def __eq__(self, other):
        return isinstance(other, Same) and self.kind == other.kind and self.of is other.of
