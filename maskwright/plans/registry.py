"""Named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

QUERIES: dict = {}


def query(name: str):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        return fn
    return register
