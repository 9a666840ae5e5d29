"""Small building blocks for array expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A fold copies its whole accumulator after every item. Results are therefore
# gathered in blocks of blocks: each is copied some sixteen times a level, and the
# outermost fold has one item for every BLOCK ** LEVELS.
BLOCK, LEVELS = 32, 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer may copy a projected expression into every place that uses
    it, filters included. A generator row is never copied, which matters when
    the expression is a whole text scan.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(made))


@lru_cache(maxsize=None)
def empty(sql_type: str) -> Column:
    return F.expr(f"cast(array() as array<{sql_type}>)")


def index_range(n: Column) -> Column:
    """``0 .. n-1``, empty for ``n = 0``."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(empty("int"))


def scan_fold(items: Column, state: Column, step: Callable[[Column, Column], Column],
              emit: Callable[[Column, Column], Column], emit_type: str,
              emit_after: bool = False, brief: bool = False) -> Column:
    """Left fold that also yields one output per item.

    ``step(state, item)`` gives the next state, ``emit(state, item)`` the
    output for ``item`` given the state before it, or after it when
    ``emit_after`` is set. ``brief`` is for arrays that mostly hold a few items:
    up to BLOCK of them are folded at once, at the price of a larger expression.
    """
    def cut(xs: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")),
                           lambda b: F.slice(xs, b * size + 1, F.lit(size)))

    def last(xs: Column) -> Column:
        return F.element_at(xs, -1)

    def block(xs: Column, first: Column) -> Column:
        """The states before, between and after a few items, and from them the outputs."""
        return F.aggregate(
            xs, F.array(first), lambda states, x: F.concat(states, F.array(step(last(states), x))),
            lambda states: F.struct(last(states).alias("state"), F.transform(
                xs, lambda x, i: emit(F.get(states, i + 1 if emit_after else i), x).cast(emit_type)).alias("out")))

    def level(xs: Column, first: Column, depth: int) -> Column:
        if depth == 0:
            return block(xs, first)
        start = F.struct(first.alias("state"), empty(emit_type).alias("out"))
        return F.aggregate(
            cut(xs, BLOCK ** depth), F.array(start), lambda done, x: F.concat(done, F.array(level(x, last(done)["state"], depth - 1))),
            lambda done: F.struct(last(done)["state"].alias("state"), F.flatten(F.transform(done, lambda r: r["out"])).alias("out")))

    def run(xs: Column) -> Column:
        short = F.when(F.size(xs).between(1, BLOCK), block(xs, state)["out"]) if brief else F
        return short.when(F.size(xs) > 0, level(xs, state, LEVELS)["out"]).otherwise(empty(emit_type))
    return let(items, run)


def laid_out(found: Column, size: Column, value: Callable[[Column], Column], value_type: str) -> Column:
    """An array of ``size`` with ``value(x)`` at ``x.pos`` of every ``x`` in ``found``, null elsewhere.

    ``found`` is in order of ``pos``, each once. Reading a place of the result
    costs the same however many there are, which testing a list for it does not.
    """
    none = F.lit(None).cast(value_type)

    def gap(length: Column) -> Column:
        return F.array_repeat(none, length.cast("int"))

    def pieces(xs: Column) -> Column:
        placed = F.transform(xs, lambda x, i: F.concat(
            F.array(value(x).cast(value_type)), gap(F.coalesce(F.get(xs, i + 1)["pos"], size) - x["pos"] - 1)))
        return F.flatten(F.concat(F.array(gap(F.coalesce(F.get(xs, F.lit(0))["pos"], size))), placed))
    return let(found, pieces)


def marks(positions: Column, size: Column) -> Column:
    """An array of ``size`` that is true at ``positions``, which may repeat and come in any order, null elsewhere."""
    ordered = F.transform(F.sort_array(F.array_distinct(positions)), lambda p: F.struct(p.alias("pos")))
    return laid_out(ordered, size, lambda x: F.lit(True), "boolean")


def marked(flags: Column, position: Column) -> Column:
    """Is this position one of those given to :func:`marks`?"""
    return F.coalesce(F.get(flags, position), F.lit(False))
