"""What a Python worker remembers between tasks: the tables of one operator at a time.

Spark uses a worker again for the stages that follow. Tables that each stage had left there would add up.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

_Kept = TypeVar("_Kept")
_HELD: dict[Hashable, object] = {}


def let_go() -> None:
    """Forget what was kept and hand its memory back."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def held(name: Hashable, build: Callable[[], _Kept]) -> _Kept:
    """What ``build`` gives, kept by that name until another one is asked for."""
    if name not in _HELD:
        let_go()
        _HELD[name] = build()
    return _HELD[name]
