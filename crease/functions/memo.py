"""Remembered results of pure functions inside Python workers."""

from __future__ import annotations

from collections.abc import Callable


def memo(limit: int) -> Callable:
    """Remembers up to ``limit`` results, then starts anew.

    A plain closure, so that it travels to a worker by value: a C-level cache object would be pickled by name, and the
    worker would need this package.
    """

    def wrap(f: Callable) -> Callable:
        kept: dict = {}

        def g(*args):
            if args in kept:
                return kept[args]
            if len(kept) >= limit:
                kept.clear()
            value = kept[args] = f(*args)
            return value

        return g

    return wrap
