"""Composed pipelines, registered by name."""

from __future__ import annotations


def all_queries() -> dict:
    import importlib
    for name in ("detection", "pages", "policy", "elements", "sessions", "latency", "streams"):
        try:
            importlib.import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"{__name__}.{name}":
                raise
    from .registry import QUERIES
    return dict(QUERIES)
