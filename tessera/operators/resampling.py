"""Bootstrap intervals as one aggregation: each row weighs in each draw by a Poisson number that a hash of row and draw gives."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws that one digest serves.
PER_DIGEST = 4


def poisson_limits(places: int = 12) -> list[str]:
    """Where 32 random bits, as eight hexadecimal figures, reach a Poisson number (mean 1) of 1, 2, ...: its distribution function."""
    below = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(places)]
    return [f"{math.floor(x * 2**32):08x}" for x in below if math.floor(x * 2**32) < 2**32]


def weighted_draws(rows: DataFrame, key: Column, draws: int, seed: int) -> DataFrame:
    """Each row under each draw in which it weighs something: adds ``draw`` and ``weight``. Draw 0 has every row once, as observed.

    The weight depends on key, draw and seed only, not on how rows are dealt to tasks, so that a task that is run again gives the same
    rows. Rows with one key weigh the same; a null key weighs as an empty one.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.col("_block").cast("string")))
    x = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // PER_DIGEST) - 1)))).withColumn("_h", digest)
    part = [F.struct((F.col("_block") * PER_DIGEST + i + 1).alias("draw"), F.substring("_h", 8 * i + 1, 8).alias("bits")) for i in range(PER_DIGEST)]
    x = x.withColumn("_d", F.explode(F.array(*part)))
    weight = sum(((F.col("_d.bits") >= t).cast("int") for t in poisson_limits()), F.lit(0))
    x = x.select(*rows.columns, F.col("_d.draw").alias("draw"), weight.alias("weight")).where((F.col("weight") > 0) & (F.col("draw") <= draws))
    return rows.withColumns({"draw": F.lit(0), "weight": F.lit(1)}).unionByName(x)


def interval(values: str, level: float = 0.95) -> tuple[Column, Column]:
    """Ends of the percentile interval of an aggregated column: places round((n - 1) p) of its sorted values, which are one for each draw."""
    v = F.sort_array(F.collect_list(values))
    at = lambda p: F.get(v, F.round((F.size(v) - 1) * p).cast("int"))
    tail = (1 - level) / 2
    return at(tail), at(1 - tail)


def bootstrap_mean(rows: DataFrame, value: str, key: Column, by: Sequence[str] = (), draws: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """``(by, n, mean, lo, hi)``: the mean of each group with its percentile interval. Null values are left out; groups of nothing else do not appear.

    What is shuffled is two sums for each task, group and draw.
    """
    x = weighted_draws(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), key.alias("_key")), F.col("_key"), draws, seed)
    g = x.groupBy(*by, "draw").agg(F.sum("weight").alias("w"), (F.sum(F.col("weight") * F.col("_v")) / F.sum("weight")).alias("m"))
    g = g.withColumn("_m", F.when(F.col("draw") > 0, F.col("m")))
    lo, hi = interval("_m", level)
    first = F.col("draw") == 0
    out = g.groupBy(*by).agg(F.max(F.when(first, F.col("w"))).alias("n"), F.max(F.when(first, F.col("m"))).alias("mean"), lo.alias("lo"), hi.alias("hi"))
    return out.where("n is not null")
