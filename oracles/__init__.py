"""DuckDB statements that state, in SQL, what each registered query must return."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    import importlib
    out: dict[str, str] = {}
    for name in ("detection", "pages", "policy", "elements", "sessions", "latency", "streams"):
        try:
            module = importlib.import_module(f"{__name__}.queries_{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"{__name__}.queries_{name}":
                raise
            continue
        out.update(module.SQL)
    return out
