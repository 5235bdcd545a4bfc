"""Registered queries: name to (function of spark and sf_dir, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def keep(f: Callable) -> Callable:
        REGISTRY[f.__name__] = f, sql
        return f

    return keep
