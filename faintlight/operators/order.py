"""Ranks and quantiles of whole tables: prefix sums over counts of values, and histograms that close in on order statistics.

Rows of one value never meet in one task, no task or driver holds a table's values, and no plan grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.operators.tables import set_checkpoints, small

#: Distinct values that one task sorts.
PER_TASK = 500_000
#: Cells into which a histogram divides a stretch of values.
CELLS = 1 << 16


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)), F.lit(True))


def cumulated(table: DataFrame, by: str, columns: list[str], within: Sequence[str] = (), descending: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """Adds before_<c> for each column: its sum over the rows that come before in the order of `by`, among equal `within`.

    `within` and `by` together are unique. More than per_task rows are cut into ranges; sums run within a range and start
    from the sums of the ranges before it. Nulls come first, or last if descending.
    """
    set_checkpoints(table.sparkSession)
    table, keys = table.checkpoint(), list(within)
    order, rows = F.desc(by) if descending else F.asc(by), table.count()
    earlier = lambda *over: Window.partitionBy(*over).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    if rows <= per_task:
        return table.withColumns({f"before_{c}": before(c, earlier(*keys).orderBy(order)) for c in columns})
    placed = table.repartitionByRange(math.ceil(rows / per_task), *keys, order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = placed.groupBy(*keys, "__part").agg(*(F.sum(c).alias(c) for c in columns))
    offsets = sums.select(
        F.col("__part").alias("__in"), *(F.col(k).alias(f"__of_{k}") for k in keys), *(before(c, earlier(*keys).orderBy("__part")).alias(f"__offset_{c}") for c in columns)
    )
    joined = placed.join(small(offsets), _same(["__part", *keys], ["__in", *(f"__of_{k}" for k in keys)]))
    found = joined.withColumns({f"before_{c}": F.col(f"__offset_{c}") + before(c, earlier(*keys, "__part").orderBy(order)) for c in columns})
    return found.select(*table.columns, *(f"before_{c}" for c in columns))


def ranked(
    rows: DataFrame, value: str, name: str = "rank", descending: bool = False, average: bool = False, within: Sequence[str] = (), per_task: int = PER_TASK
) -> DataFrame:
    """Adds the rank from 1 over the whole table, or among equal `within`; ties share the first rank, or their mean rank
    with average=True. Null values come first, or last if descending; a column of that name is replaced.

    Values are counted, ranks are prefix sums of the counts, and rows get them back by value: from a broadcast table
    where a count finds it small; else values that more than per_task rows hold are few and are broadcast, so that their
    rows stay where they are, and the rest is joined by shuffle.
    """
    rows, keys = rows.drop(name), [*within, value]
    counts = cumulated(rows.groupBy(*keys).agg(F.count("*").alias("__n")), value, ["__n"], within, descending, per_task)
    place = F.col("before___n") + ((F.col("__n") + 1) / 2 if average else F.lit(1))
    names = [f"__key_{i}" for i in range(len(keys))]
    ranks = counts.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), place.alias(name), "__n").checkpoint()
    parts = [small(ranks)]
    if ranks.count() > per_task and (heavy := ranks.where(F.col("__n") > per_task)).take(1):
        parts = [F.broadcast(heavy), ranks.where(F.col("__n") <= per_task)]
    if len(parts) == 1:
        found = rows.join(parts[0], _same(keys, names))
    else:  # at most one value for each per_task rows is heavy
        found = rows.join(parts[0], _same(keys, names)).unionByName(rows.join(parts[0], _same(keys, names), "left_anti").join(parts[1], _same(keys, names)))
    return found.select(*rows.columns, name)


def _coarse(v: Column) -> Column:
    """A cell for each 32nd of a factor e, of either sign, in the order of the values; infinite values and NaN have cells of their own."""
    size = F.when(v == 0, 0.0).otherwise(F.ln(F.abs(v)) + 746.0)
    return F.when(F.isnan(v), 60_000).when(F.abs(v) == float("inf"), F.signum(v) * 50_000).otherwise(F.floor(F.signum(v) * size * 32)).cast("long")


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, q): the number of non-null values, and an array with the quantile of each share, linear between neighbours.

    Exact, by histograms with the extremes of each cell: the cells that hold a wanted place are divided again, until each
    holds one value; three or four passes do for most data. Each pass counts within tasks and shuffles counts, at most
    CELLS for each cell that is divided, whatever the rows. NaN counts as larger than all. Keys without a value have no row.
    """
    set_checkpoints(rows.sparkSession)
    names = [f"__key_{i}" for i in range(len(keys))]
    data = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    counted = (F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # The places below and above each share, counted from 0.
    places = F.flatten(F.array(*(F.array(f((F.col("all") - 1) * F.lit(float(s))).cast("long")) for s in shares for f in (F.floor, F.ceil))))
    wanted = F.exists(places, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n")))
    one = (F.col("low") == F.col("high")) | F.col("low").isNull()

    cells = data.groupBy(*names, _coarse(F.col("v")).alias("cell")).agg(*counted)
    running = Window.partitionBy(*names).orderBy("cell")
    cells = cells.withColumn("before", F.sum("n").over(running) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*names)))
    cells = cells.where(wanted).select(*names, "all", "before", "n", "low", "high").checkpoint()
    done = cells.where(one)
    while (open_ := cells.where(~one)).take(1):
        parts = open_.select(*(F.col(n).alias(f"{n}_") for n in names), "all", F.col("before").alias("first"), F.col("low").alias("from"), F.col("high").alias("to"))
        inside = _same(names, [f"{n}_" for n in names]) & (F.col("v") >= F.col("from")) & (F.col("v") <= F.col("to"))
        finer = F.floor((F.col("v") / 2 - F.col("from") / 2) / (F.col("to") / 2 - F.col("from") / 2) * CELLS)
        finer = F.when(F.col("to") - F.col("from") < 1e-290, F.when(F.col("v") == F.col("from"), 0).when(F.col("v") == F.col("to"), 2).otherwise(1)).otherwise(finer)
        held = data.join(small(parts), inside).groupBy(*names, "all", "first", finer.alias("cell")).agg(*counted)
        running = Window.partitionBy(*names, "first").orderBy("cell")
        held = held.withColumn("before", F.col("first") + F.sum("n").over(running) - F.col("n"))
        cells = held.where(wanted).select(*names, "all", "before", "n", "low", "high").checkpoint()
        done = done.unionByName(cells.where(one))
    found = done.groupBy(*names, "all").agg(F.collect_list(F.struct("before", "n", "low")).alias("cells"))

    def at(place: Column) -> Column:
        return F.filter("cells", lambda c: (place >= c["before"]) & (place < c["before"] + c["n"]))[0]["low"]

    def quantile(share: float) -> Column:
        spot = (F.col("all") - 1) * F.lit(float(share))
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        return F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)

    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), F.col("all").alias("n"), F.array(*map(quantile, shares)).alias("q"))


def quantiles_of(frame: DataFrame, columns: dict[str, Column], shares: Sequence[float]) -> DataFrame:
    """One row with an array of quantiles for each named column expression (null if it has no value), all found together."""
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), c.cast("double").alias("value")) for name, c in columns.items())))
    found = quantiles(frame.select(values.alias("x")).select("x.*"), "value", shares, ["name"])
    return found.agg(*(F.first(F.when(F.col("name") == name, F.col("q")), ignorenulls=True).alias(name) for name in columns))
