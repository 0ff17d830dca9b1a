"""What a Python worker remembers between tasks, for one operator at a time.

Spark reuses its Python workers for later stages.  An operator that starts work
takes the memory over: what others remember is forgotten first.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_forget: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def register(name: str, forget: Callable[[], None]) -> None:
    _forget[name] = forget


def use(name: str) -> None:
    global _owner
    if _owner == name:
        return
    for other, forget in _forget.items():
        if other != name:
            forget()
    _owner = name
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc: freed memory stays with the process
        pass
