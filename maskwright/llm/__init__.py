"""Operators for training corpora, their queries and SQL twins.

Each operator lives in a module of its own with a general interface; the
``opN_<name>`` queries below apply it to a whole table with production
parameters. Nothing else in the library imports this subpackage.
"""

from __future__ import annotations


def all_queries() -> dict:
    """Registered queries by name."""
    from . import queries
    return dict(queries.QUERIES)


def all_sql() -> dict[str, str]:
    """DuckDB statements of the queries that SQL can express."""
    from . import sql
    return dict(sql.SQL)
