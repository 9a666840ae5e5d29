"""Ordered computations that do not put a whole key into one task.

A plain window sorts all rows of a key in one task. Here every key is cut into
buckets; each bucket is windowed on its own, and what must cross a bucket
border is carried by one row per key and bucket. Those rows are cut into
coarser buckets in turn, as often as ``coarser`` says, so that an order over
all rows meets in one window only with as many rows as there are buckets of
the coarsest kind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

BUCKET, PLACE = "_bucket", "_place"
Coarser = Sequence[Callable[[Column], Column]]


def _outer(keys):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BUCKET)


def _place(keys) -> Column:
    """Key and bucket as one value, in which a null equals a null.

    Rows dealt by it for a window are dealt as the join with their bucket's row
    wants them, so they are shuffled once and not again for the join.
    """
    return F.struct(*[F.col(k) for k in keys], F.col(BUCKET))


def _join(df: DataFrame, small: DataFrame, keys) -> DataFrame:
    """``df`` with the row of its PLACE in ``small``; rows without a bucket get none."""
    s = small.where(F.col(BUCKET).isNotNull()).select(_place(keys).alias("_k"), *[c for c in small.columns if c not in (*keys, BUCKET)])
    return df.join(s, F.col(PLACE) == F.col("_k"), "left").drop("_k", PLACE)


def _carried(rows: DataFrame, keys: list[str], coarser: Coarser, pick: Callable, reduce: Callable,
             join: Callable, backward: bool = False) -> DataFrame:
    """``rows(*keys, BUCKET, _edge)`` with ``_edge`` replaced by what the buckets before it carry.

    ``pick(column)`` reads the rows before one in order (after, if
    ``backward``), ``reduce`` sums up a coarser bucket, ``join(inner, outer)``
    puts both together.
    """
    def ahead(by: list, column: str):
        order = F.desc(column) if backward else F.asc(column)
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if not coarser:
        return rows.withColumn("_edge", pick("_edge").over(ahead(keys or [F.lit(0)], BUCKET)))
    cut = rows.withColumnRenamed(BUCKET, "_fine").withColumn(BUCKET, coarser[0](F.col("_fine")))
    inner = ahead([PLACE], "_fine")
    totals = cut.groupBy(*keys, BUCKET).agg(reduce("_edge", "_fine").alias("_edge"))
    above = _carried(totals, keys, coarser[1:], pick, reduce, join, backward).withColumnRenamed("_edge", "_above")
    out = _join(cut.withColumn(PLACE, _place(keys)).withColumn("_in", pick("_edge").over(inner)), above, keys)
    return out.withColumn("_edge", join(F.col("_in"), F.col("_above"))).drop("_in", "_above", BUCKET) \
        .withColumnRenamed("_fine", BUCKET)


def previous(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column,
             name: str, backward: bool = False) -> DataFrame:
    """``value`` of the row before (after, if ``backward``) in ``order``, within ``keys``."""
    cut = df.withColumn(BUCKET, bucket).withColumn("_v", F.struct(value.alias("v")))
    at = F.struct(*order)
    pick = F.min_by if backward else F.max_by
    step = F.lead if backward else F.lag
    inner = Window.partitionBy(PLACE).orderBy(*order)
    edge = cut.groupBy(*keys, BUCKET).agg(pick(F.col("_v"), at).alias("_edge")).withColumn(
        "_edge", step("_edge").over(_outer(keys)))
    with_inner = cut.withColumn(PLACE, _place(keys)).withColumn("_in", step("_v").over(inner))
    return _join(with_inner, edge, keys).withColumn(
        name, F.coalesce(F.col("_in"), F.col("_edge"))["v"]).drop("_v", "_in", "_edge", BUCKET)


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column,
                name: str, coarser: Coarser = ()) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    cut = df.withColumn(BUCKET, bucket).withColumn("_v", value)
    inner = Window.partitionBy(PLACE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(*keys, BUCKET).agg(F.sum("_v").alias("_edge"))
    edge = _carried(totals, keys, coarser, F.sum, lambda e, _: F.sum(e),
                    lambda i, o: F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0)))
    with_inner = cut.withColumn(PLACE, _place(keys)).withColumn("_in", F.sum("_v").over(inner))
    return _join(with_inner, edge, keys).withColumn(
        name, F.col("_in") + F.coalesce(F.col("_edge"), F.lit(0))).drop("_v", "_in", "_edge", BUCKET)


def latest(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column,
           name: str, following: bool = False, coarser: Coarser = ()) -> DataFrame:
    """Last non-null ``value`` up to each row, or with ``following`` the next one after it.

    Both read running frames; for the next one the order is turned round.
    """
    cut = df.withColumn(BUCKET, bucket).withColumn("_v", F.when(value.isNotNull(), F.struct(value.alias("v"))))
    at = F.struct(*order)
    turn = (lambda c: F.col(c).desc()) if following else F.col
    inner = Window.partitionBy(PLACE).orderBy(*[turn(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, -1 if following else Window.currentRow)
    edge_value = (F.min_by if following else F.max_by)("_v", F.when(F.col("_v").isNotNull(), at))

    def last(column):
        return F.last(column, ignorenulls=True)

    def reduce(edge, fine):
        return (F.min_by if following else F.max_by)(edge, F.when(F.col(edge).isNotNull(), F.col(fine)))
    edges = cut.groupBy(*keys, BUCKET).agg(edge_value.alias("_edge"))
    edge = _carried(edges, keys, coarser, last, reduce, F.coalesce, following)
    with_inner = cut.withColumn(PLACE, _place(keys)).withColumn("_in", last("_v").over(inner))
    return _join(with_inner, edge, keys).withColumn(
        name, F.coalesce(F.col("_in"), F.col("_edge"))["v"]).drop("_v", "_in", "_edge", BUCKET)


def latest_each(df: DataFrame, keys: list[str], bucket: Column, order: list[str], values: dict[str, Column],
                coarser: Coarser = ()) -> DataFrame:
    """Columns with the last non-null of each of ``values`` up to each row, carried in one pass."""
    cut = df.withColumn(BUCKET, bucket).withColumns(
        {f"_v_{n}": F.when(v.isNotNull(), F.struct(v.alias("v"))) for n, v in values.items()})
    at = F.struct(*order)
    inner = Window.partitionBy(PLACE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = cut.groupBy(*keys, BUCKET).agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in values])
    with_inner = cut.withColumn(PLACE, _place(keys)).withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inner) for n in values})
    out = _join(with_inner, _carried_each(edges, keys, list(values), coarser), keys)
    return out.withColumns({n: F.coalesce(f"_i_{n}", f"_e_{n}")["v"] for n in values}).drop(
        BUCKET, *[f"_{x}_{n}" for n in values for x in "vie"])


def _carried_each(rows: DataFrame, keys: list[str], names: list[str], coarser: Coarser) -> DataFrame:
    """What the buckets before each one carry, for every name."""
    def before(by: list, column: str) -> dict[str, Column]:
        ahead = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
        return {n: F.last(f"_e_{n}", ignorenulls=True).over(ahead) for n in names}
    if not coarser:
        return rows.withColumns({f"_e_{n}": v for n, v in before(keys or [F.lit(0)], BUCKET).items()})
    cut = rows.withColumnRenamed(BUCKET, "_fine").withColumn(BUCKET, coarser[0](F.col("_fine")))
    totals = cut.groupBy(*keys, BUCKET).agg(*[
        F.max_by(f"_e_{n}", F.when(F.col(f"_e_{n}").isNotNull(), F.col("_fine"))).alias(f"_e_{n}") for n in names])
    above = _carried_each(totals, keys, names, coarser[1:]).withColumnsRenamed({f"_e_{n}": f"_a_{n}" for n in names})
    within = before([PLACE], "_fine")
    out = _join(cut.withColumn(PLACE, _place(keys)).withColumns({f"_n_{n}": v for n, v in within.items()}), above, keys)
    return out.withColumns({f"_e_{n}": F.coalesce(f"_n_{n}", f"_a_{n}") for n in names}).drop(
        BUCKET, *[f"_{x}_{n}" for n in names for x in "na"]).withColumnRenamed("_fine", BUCKET)


#: Cells that a round of refinement cuts a group into, and the different values that one window may order.
CELLS = 64
MOST_ORDERED = 1_000_000


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                 bound: int = MOST_ORDERED) -> DataFrame:
    """Exact nearest-rank quantiles per key, one column each.

    Equal values are counted together first. Where a key has more than
    ``bound`` different values, a sketch cuts them into cells and only the cells
    that hold a wanted rank go on, as often as it takes; so no window orders
    more than ``bound`` rows, whatever the data. A round costs one job, and a
    cell has about a sixtieth of its group's values.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    counted = v.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    wanted = counted.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*keys, "_n", F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()])).alias("_q")).select(
        *keys, F.col("_q.name").alias("_name"), F.ceil(F.col("_n") * F.col("_q.q")).alias("_rank"))
    hit = _ranked(counted, keys, wanted, bound)
    return hit.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in quantiles])


def _ranked(counted: DataFrame, by: list[str], wanted: DataFrame, bound: int, depth: int = 0) -> DataFrame:
    """``wanted(*by, _name, _rank)`` with the value ``_x`` at that rank of ``counted(*by, _x, _c)``."""
    if (counted.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= bound:
        upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_x"))
        return counted.withColumn("_upto", upto).join(wanted, by).where(
            (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c")))
    counted = materialise(counted, "ranked")
    cuts = counted.groupBy(*by).agg(F.percentile_approx("_x", [i / CELLS for i in range(1, CELLS)], 1000).alias("_cuts"))
    cell = f"_cell{depth}"
    celled = counted.join(cuts, by).withColumn(cell, F.size(F.filter("_cuts", lambda b: b < F.col("_x")))).drop("_cuts")
    sums = celled.groupBy(*by, cell).agg(F.sum("_c").alias("_sum"))
    to = F.sum("_sum").over(Window.partitionBy(*by).orderBy(cell))
    sought = materialise(sums.withColumn("_to", to).join(wanted, by).where(
        (F.col("_rank") <= F.col("_to")) & (F.col("_rank") > F.col("_to") - F.col("_sum"))).select(
        *by, cell, "_name", (F.col("_rank") - (F.col("_to") - F.col("_sum"))).alias("_rank")), "sought")
    inside = celled.join(sought.select(*by, cell).distinct(), [*by, cell], "left_semi")
    return _ranked(inside, [*by, cell], sought, bound, depth + 1)
