"""Running sums and minima over a whole table in order, without bringing the table into one task.

Rows are dealt by ranges of their order (rows that are equal in the first keys may fall into several ranges), each range is scanned by
itself, and what the ranges before or after it add up to is one number for each range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut

RANGE, PLACE = "_range", "_place"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_range``, which rises with the order, and ``_place``, a row's place in its range from 1 on. Nulls come first.

    There are as many ranges as the session has shuffle partitions. The places are those of the written files' rows, so that they
    hold for whatever reads the table later.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # such a number has the partition in its upper bits and the row's place from 0 in the lower 33
    return cut(x.withColumn(RANGE, F.shiftright("_at", 33).cast("int")).withColumn(PLACE, F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at"), "ranges")


def ranks(df: DataFrame, out: str) -> tuple[DataFrame, int]:
    """Adds each row's place in the whole of a :func:`ranged` table, and gives the number of rows. Nothing is sorted or shuffled for it."""
    counts = _totals(df, F.count("*"))
    each = [counts.get(i, 0) for i in range(max(counts, default=0) + 1)]
    return df.withColumn(out, F.get(F.lit([0, *accumulate(each)]).cast("array<bigint>"), F.col(RANGE)) + F.col(PLACE)), sum(each)


def _totals(df: DataFrame, value: Column) -> dict[int, float]:
    """One number for each range: rows are as many as there are ranges."""
    return {r[0]: r[1] for r in df.groupBy(RANGE).agg(value.alias("v")).collect() if r[1] is not None}


def _looked_up(values: list, kind: str) -> Column:
    return F.get(F.lit(values).cast(f"array<{kind}>"), F.col(RANGE))


def _within(order: tuple[str, ...], backwards: bool) -> Window:
    w = Window.partitionBy(RANGE).orderBy(*(F.desc(c) if backwards else F.asc(c) for c in order))
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(df: DataFrame, value: str, order: tuple[str, ...], out: str, backwards: bool = False) -> tuple[DataFrame, int]:
    """Adds the sum of a whole-number column up to each row of a :func:`ranged` table, and gives the sum of all rows. Nulls count 0.

    ``order`` must tell rows apart; ``backwards`` sums from the last row. An empty table stays empty; its sum is 0.
    """
    totals = _totals(df, F.sum(value))
    each = [totals.get(i, 0) for i in range(max(totals, default=0) + 1)]
    if backwards:
        before = [sum(each) - x for x in accumulate(each)]
    else:
        before = [0, *accumulate(each)][: len(each)]
    own = F.sum(F.coalesce(F.col(value), F.lit(0))).over(_within(order, backwards))
    return df.withColumn(out, F.coalesce(_looked_up(before, "bigint"), F.lit(0 if backwards else sum(each))) + own), sum(each)


def running_min_down(df: DataFrame, value: str, order: tuple[str, ...], out: str) -> DataFrame:
    """Adds the least value of each row and all rows after it in a :func:`ranged` table. Nulls are passed over."""
    least = _totals(df, F.min(value))
    n = max(least, default=0) + 1
    after, low = [None] * n, None
    for i in range(n - 1, -1, -1):
        after[i] = low
        low = least.get(i) if low is None else min(low, least.get(i, low))
    own = F.min(value).over(_within(order, True))
    if all(x is None for x in after):
        return df.withColumn(out, own)
    inf = float("inf")
    return df.withColumn(out, F.least(own, _looked_up([inf if x is None else float(x) for x in after], "double")))
