"""Counters over days, cells and topics; movers with false-discovery control; hot spots; bursts; seasons."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.functions.scalars import ln_gamma, normal_sf
from tessera.operators.ordered import PLACE, RANGE, ranged, ranks, running_min_down

Q_LEVEL = 0.05
#: Days a series needs for a burst, the rate factor and the entry cost of the burst state.
BURST_DAYS, BURST_S, BURST_GAMMA = 7, 2.0, 1.0


def counters(events: DataFrame, *by: str) -> DataFrame:
    """Rows by the given keys, as ``n``."""
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def apply_counters(have: DataFrame, new: DataFrame, by: Sequence[str], most: int = 4294967295) -> DataFrame:
    """Counters after adding others, held at ``most``."""
    return have.unionByName(new).groupBy(*by).agg(F.least(F.sum("n"), F.lit(most)).alias("n"))


def retain(table: DataFrame, day: str, now_day: int, days: int) -> DataFrame:
    """Rows no older than so many days."""
    return table.where(F.col(day) >= now_day - days)


def day_spine(series: DataFrame, unit: str, day: str = "day", n: str = "n") -> DataFrame:
    """Every unit on every day from the first day of any to the last, 0 where nothing was counted."""
    span = series.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(day))
    units = series.select(unit).distinct()
    full = units.crossJoin(F.broadcast(span))  # the spine itself: units by days, each once
    return full.join(series, [unit, day], "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))


def movers(spine: DataFrame, unit: str, day: str = "day", n: str = "n", level: float = Q_LEVEL) -> DataFrame:
    """Empirical-Bayes test of each unit's latest day against its earlier ones.

    Columns: unit, latest, baseline (mean before the latest day), shrunk_rate, z, q_value, significant, noise (more than
    twice the baseline but not significant). Rates share a gamma prior by moments, counts an excess variance pooled over units;
    q-values follow Benjamini and Hochberg, ties in order of the unit.
    """
    last = F.max(day)
    w = Window.partitionBy(unit).orderBy(F.desc(day))
    x = spine.withColumn("_back", F.row_number().over(w) - 1).withColumn(n, F.col(n).cast("double"))
    del last
    u = x.groupBy(unit).agg(F.max(F.when(F.col("_back") == 0, F.col(n))).alias("latest"), F.count_if(F.col("_back") > 0).alias("days"), F.coalesce(F.avg(F.when(F.col("_back") > 0, F.col(n))), F.lit(0.0)).alias("baseline"), F.var_samp(F.when(F.col("_back") > 0, F.col(n))).alias("s2"))
    b = F.col("baseline")
    able = (F.col("days") >= 2) & (b > 0)
    g = u.agg(F.count("*").alias("k"), F.greatest(F.max("days"), F.lit(1)).cast("double").alias("wd"), F.avg("baseline").alias("m"), F.coalesce(F.var_samp("baseline"), F.lit(0.0)).alias("var"), F.sum(F.when(able, F.greatest(F.col("s2") - b, F.lit(0.0))).otherwise(0.0)).alias("on"), F.sum(F.when(able, b * b).otherwise(0.0)).alias("od"))
    g = g.withColumn("inv_r", F.when(F.col("od") > 0, F.col("on") / F.when(F.col("od") > 0, F.col("od"))).otherwise(0.0))
    g = g.withColumn("between", F.greatest(F.col("var") - (F.col("m") + F.col("inv_r") * F.col("m") * F.col("m")) / F.col("wd"), F.lit(1e-6)))
    g = g.withColumn("alpha", F.greatest(F.col("m") * F.col("m") / F.col("between"), F.lit(0.1))).withColumn("beta", F.col("alpha") / F.greatest(F.col("m"), F.lit(1e-9)))
    x = u.join(F.broadcast(g.select("inv_r", "alpha", "beta")))
    wl = F.greatest(F.col("days"), F.lit(1))
    e = F.greatest((F.col("alpha") + b * wl) / (F.col("beta") + wl), F.lit(1e-9))
    x = x.withColumn("_e", e).withColumn("z", (F.col("latest") - F.col("_e")) / F.sqrt(F.col("_e") + F.col("inv_r") * F.col("_e") * F.col("_e")))
    x = x.withColumn("shrunk_rate", (F.col("alpha") + F.col("latest")) / (F.col("beta") + 1)).withColumn("p", normal_sf(F.col("z")))
    x = with_q_values(x, "p", unit)
    x = x.withColumn("significant", F.col("q_value") <= level)
    noise = ~F.col("significant") & (b > 0) & (F.col("latest") / F.greatest(b, F.lit(1e-9)) >= 2)
    return x.select(unit, "latest", "baseline", "shrunk_rate", "z", "q_value", "significant", noise.alias("noise"))


def with_q_values(df: DataFrame, p: str, tie: str, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values: the least of p n / rank from the largest p down, ties in order of ``tie``.

    Ranks and minima are taken by ranges of (p, tie); one count and one minimum for each range pass between them.
    """
    order = (p, tie)
    x, n = ranks(ranged(df, *order), "_r")
    x = x.withColumn("_v", F.least(F.col(p) * n / F.col("_r"), F.lit(1.0)))
    return running_min_down(x, "_v", order, out).drop("_r", "_v", RANGE, PLACE)


def hot_spots(cells: DataFrame, level: float = Q_LEVEL) -> DataFrame:
    """Getis-Ord Gi* of each cell against all that are present, absent neighbours counting 0; fewer than three cells are neutral."""
    g = cells.agg(F.count("*").cast("double").alias("gn"), F.avg(F.col("count").cast("double")).alias("mean"), F.avg(F.col("count").cast("double") * F.col("count")).alias("sq"))
    near = cells.select("cell", F.explode(C.ring(F.col("cell"))).alias("near")).join(cells.select(F.col("cell").alias("near"), F.col("count").alias("c")), "near", "left")
    sums = near.groupBy("cell").agg(F.count("*").cast("double").alias("w"), F.sum(F.coalesce("c", F.lit(0))).cast("double").alias("ring_sum"))
    x = cells.join(sums, "cell").join(F.broadcast(g))
    s = F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(1e-12)))
    spread = F.sqrt(F.greatest((F.col("gn") * F.col("w") - F.col("w") * F.col("w")) / F.greatest(F.col("gn") - 1, F.lit(1.0)), F.lit(1e-12)))
    x = x.withColumn("z", F.when(F.col("gn") < 3, 0.0).otherwise((F.col("ring_sum") - F.col("mean") * F.col("w")) / (s * spread)))
    x = with_q_values(x.withColumn("p", normal_sf(F.col("z"))), "p", "cell")
    x = x.withColumn("q_value", F.when(F.col("gn") < 3, 1.0).otherwise(F.col("q_value")))
    return x.select("cell", "count", "z", "q_value", (F.col("q_value") <= level).alias("significant"))


def log_pmf(x: np.ndarray, rate: float, inv_r: float) -> np.ndarray:
    """Log probability of counts, negative binomial, or Poisson where there is no excess variance."""
    lg = np.vectorize(math.lgamma)
    if inv_r < 1e-9:
        return x * math.log(rate) - rate - lg(x + 1)
    r = 1 / inv_r
    return lg(x + r) - math.lgamma(r) - lg(x + 1) + r * math.log(r / (r + rate)) + x * math.log(rate / (r + rate))


def burst_states(days: np.ndarray, s: float = BURST_S, gamma: float = BURST_GAMMA) -> np.ndarray | None:
    """The likeliest path through a base and a burst state; None for short or empty series.

    The base rate comes from the first three fifths of the days; entering a burst costs gamma ln(days), leaving is free; ties stay, and end in the base state.
    """
    n = len(days)
    if n < BURST_DAYS or not days.any():
        return None
    head = days[: -(-3 * n // 5)].astype(float)
    m = max(head.mean(), 0.1)
    excess = min(max(((head - m) ** 2).sum() / max(len(head) - 1, 1) - m, 0.0) / (m * m), 10.0)
    cost = -np.stack([log_pmf(days.astype(float), m, excess), log_pmf(days.astype(float), s * m, excess)], axis=1)
    enter = gamma * math.log(n)
    best = np.array([cost[0, 0], enter + cost[0, 1]])
    came = np.zeros((n, 2), np.int8)
    for t in range(1, n):
        to_base, to_burst = best[[0, 1]], np.array([best[0] + enter, best[1]])
        came[t] = [int(to_base[1] < to_base[0]), int(to_burst[1] <= to_burst[0])]
        best = np.array([to_base[came[t, 0]], to_burst[came[t, 1]]]) + cost[t]
    path = np.zeros(n, np.int8)
    path[-1] = int(best[1] < best[0])
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path.astype(bool)


def burst_summary(path: np.ndarray | None) -> tuple[bool, int | None, int]:
    """Whether the series ends in a burst, since which day, and for how many."""
    if path is None or not path[-1]:
        return False, None, 0
    calm = np.flatnonzero(~path)
    onset = int(calm[-1]) + 1 if len(calm) else 0
    return True, onset, len(path) - onset


def _parameters(days: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of the base and of the burst state for each unit and day, and which units can be decoded."""
    n = days.shape[1]
    head = days[:, : -(-3 * n // 5)]
    mean = np.maximum(head.mean(axis=1), 0.1)
    excess = np.maximum(((head - mean[:, None]) ** 2).sum(axis=1) / max(head.shape[1] - 1, 1) - mean, 0.0)
    inv_r = np.minimum(excess / (mean * mean), 10.0)[:, None]
    r = 1 / np.maximum(inv_r, 1e-9)
    whole = ln_gamma(days + 1)

    def cost(rate: np.ndarray) -> np.ndarray:
        plain = days * np.log(rate) - rate - whole
        wide = ln_gamma(days + r) - ln_gamma(r) - whole + r * np.log(r / (r + rate)) + days * np.log(rate / (r + rate))
        return -np.where(inv_r < 1e-9, plain, wide)

    return cost(mean[:, None]), cost(s * mean[:, None]), days.any(axis=1)


def burst_paths(days: np.ndarray, s: float = BURST_S, gamma: float = BURST_GAMMA) -> tuple[np.ndarray, np.ndarray]:
    """:func:`burst_states` of many series of one length at once: the paths (units by days), and which units have one."""
    units, n = days.shape
    path = np.zeros((units, n), bool)
    if n < BURST_DAYS or not units:
        return path, np.zeros(units, bool)
    calm, burst, able = _parameters(days.astype(float), s)
    enter = gamma * math.log(n)
    low, high = calm[:, 0].copy(), enter + burst[:, 0]
    left, stayed = np.zeros((units, n), bool), np.zeros((units, n), bool)
    for t in range(1, n):
        left[:, t], stayed[:, t] = high < low, high <= low + enter
        low, high = np.where(left[:, t], high, low) + calm[:, t], np.where(stayed[:, t], high, low + enter) + burst[:, t]
    path[:, -1] = high < low
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = np.where(path[:, t], stayed[:, t], left[:, t])
    return path & able[:, None], able


def _series(spine: DataFrame, unit: str, day: str, n: str) -> DataFrame:
    """One row for each unit: its days in order, and their counts."""
    x = spine.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct(F.col(day).cast("long").alias("d"), F.col(n).cast("double").alias("n")))).alias("_s"))
    return x.select(unit, F.col("_s.d").alias("days"), F.col("_s.n").alias("counts"))


def _by_length(it: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in it:
        for _, part in pdf.groupby(pdf["counts"].map(len)):
            yield part, np.stack(part["counts"].to_list()).astype(float)


def bursts(spine: DataFrame, unit: str, day: str = "day", n: str = "n") -> DataFrame:
    """``(unit, active, onset_day, days_active)`` of every unit with enough days and any counts.

    Units with equally many days are decoded together, a step of the fold for all of them at once.
    """
    kind = spine.schema[unit].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, counts in _by_length(it):
            path, able = burst_paths(counts)
            on = path[:, -1] & able
            length = np.where(on, np.where(path.all(axis=1), path.shape[1], (~path[:, ::-1]).argmax(axis=1)), 0)
            first = [int(d[len(d) - k]) if k else None for d, k in zip(part["days"], length, strict=True)]
            out = pd.DataFrame({unit: part[unit].to_numpy(), "active": on, "onset_day": pd.array(first, "Int64"), "days_active": length})
            yield out[able]

    return _series(spine, unit, day, n).mapInPandas(run, f"{unit} {kind}, active boolean, onset_day long, days_active long")


def burst_detections(spine: DataFrame, unit: str, day: str = "day", n: str = "n") -> DataFrame:
    """``(unit, seen_day, seen_after)``: the first day on which decoding the series up to it ends in a burst, and how many days that prefix has.

    What an observer would have seen day by day: each prefix has its own base rate. Units that no prefix shows in a burst have nulls.
    """
    kind = spine.schema[unit].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, counts in _by_length(it):
            seen = np.zeros(len(part), int)
            for t in range(BURST_DAYS, counts.shape[1] + 1):
                open_ = np.flatnonzero(seen == 0)
                path, _ = burst_paths(counts[open_, :t])
                seen[open_[path[:, -1]]] = t
            day_of = [int(d[k - 1]) if k else None for d, k in zip(part["days"], seen, strict=True)]
            yield pd.DataFrame({unit: part[unit].to_numpy(), "seen_day": pd.array(day_of, "Int64"), "seen_after": pd.array([int(k) or None for k in seen], "Int64")})

    return _series(spine, unit, day, n).mapInPandas(run, f"{unit} {kind}, seen_day long, seen_after long")


def season_index(spine: DataFrame, unit: str, day: str = "day", n: str = "n", strength: float = 8.0, least: int = 21) -> DataFrame:
    """``(unit, dow, season)``: each weekday's rate over the unit's mean without the latest day, shrunk towards 1; 1 below ``least`` days."""
    w = Window.partitionBy(unit)
    x = spine.withColumn("_last", F.max(day).over(w)).where(F.col(day) < F.col("_last"))
    x = x.withColumn("_mean", F.avg(n).over(w)).withColumn("_days", F.count("*").over(w))
    r = F.when(F.col("_mean") > 0, F.col(n) / F.when(F.col("_mean") > 0, F.col("_mean"))).otherwise(1.0)
    g = x.withColumn("dow", F.pmod(F.col(day), F.lit(7)).cast("int")).groupBy(unit, "dow").agg(F.avg(r).alias("_r"), F.count("*").alias("_k"), F.max("_days").alias("_days"))
    return g.select(unit, "dow", F.when(F.col("_days") + 1 < least, 1.0).otherwise((F.col("_k") * F.col("_r") + strength) / (F.col("_k") + strength)).alias("season"))


def deseasonalise(spine: DataFrame, unit: str, day: str = "day", n: str = "n") -> DataFrame:
    """Counts divided by their weekday's index (1e-6 at least)."""
    s = season_index(spine, unit, day, n)
    x = spine.withColumn("dow", F.pmod(F.col(day), F.lit(7)).cast("int")).join(s, [unit, "dow"], "left")
    return x.select(unit, day, (F.col(n) / F.greatest(F.coalesce("season", F.lit(1.0)), F.lit(1e-6))).alias(n))


def trailing_run(spine: DataFrame, unit: str, day: str, holds: Column) -> DataFrame:
    """``(unit, run)``: how many of the last days in a row satisfy a condition."""
    miss = spine.withColumn("_miss", F.when(~holds, F.col(day)))
    g = miss.groupBy(unit).agg(F.max("_miss").alias("_m"), F.max(day).alias("_hi"), F.min(day).alias("_lo"))
    return g.select(unit, (F.col("_hi") - F.coalesce(F.col("_m"), F.col("_lo") - 1)).cast("long").alias("run"))


def clique_edges(rows: DataFrame, by: Sequence[str], node: str, order: Column, most: int = 30) -> DataFrame:
    """``(a, b, w)``: pairs a < b of nodes that appear together, among the first ``most`` of each group, with how often."""
    w = Window.partitionBy(*by).orderBy("_first", node)
    first = rows.groupBy(*by, node).agg(F.min(order).alias("_first")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    x, y = first.select(*by, F.col(node).alias("a")), first.select(*by, F.col(node).alias("b"))
    return x.join(y, list(by)).where("a < b").groupBy("a", "b").agg(F.count("*").alias("w"))


def compact_edges(edges: DataFrame, most: int) -> DataFrame:
    """Edges heavier than 1, then heavier than 2, 4, ... until no more than ``most`` are left (or 1024 is reached)."""
    out, floor = edges.where("w > 1"), 2
    while floor < 1024 and out.count() > most:
        out, floor = edges.where(F.col("w") > floor), floor * 2
    return out


def page_rank(edges: DataFrame, rounds: int = 30, damping: float = 0.85, weighted: bool = False, cut_every: int = 5) -> DataFrame:
    """``(node, rank)`` of an undirected graph, the largest 1; edges of weight 1 and loops are noise and left out."""
    from tessera.plans.lineage import cut_at, delete

    e = edges.where("w >= 2 and a <> b")
    both = e.select(F.col("a").alias("s"), F.col("b").alias("t"), "w").union(e.select("b", "a", "w"))
    both = both.withColumn("w", F.col("w").cast("double") if weighted else F.lit(1.0))
    out = both.groupBy("s").agg(F.sum("w").alias("o"))
    links, lp = cut_at(both.join(out, "s").select("s", "t", (F.col("w") / F.col("o")).alias("p")), "links")
    nodes = links.select(F.col("s").alias("node")).distinct()
    k = nodes.count()
    if not k:
        return nodes.withColumn("rank", F.lit(0.0))
    rank, path = nodes.withColumn("rank", F.lit(1.0 / k)), None
    for i in range(rounds):
        got = links.join(rank.withColumnRenamed("node", "s"), "s").groupBy(F.col("t").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("x"))
        rank = got.select("node", (F.lit((1 - damping) / k) + damping * F.col("x")).alias("rank"))
        if (i + 1) % cut_every == 0:
            nxt, at = cut_at(rank, "rank")
            if path:
                delete(rank.sparkSession, path)
            rank, path = nxt, at
    top = rank.agg(F.max("rank").alias("top"))
    return rank.join(F.broadcast(top)).select("node", (F.col("rank") / F.col("top")).alias("rank"))


def divergence(p: DataFrame, q: DataFrame, key: str, n: str = "n", empty: float | None = None) -> DataFrame:
    """Jensen-Shannon divergence in bits of two distributions given as counts: 0 for equal, 1 for disjoint, both empty 0, one empty 1 (or ``empty``)."""
    side = lambda d, name: d.groupBy(key).agg(F.sum(n).cast("double").alias(name))
    x = side(p, "p").join(side(q, "q"), key, "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    t = p.agg(F.coalesce(F.sum(n), F.lit(0)).cast("double").alias("tp")).join(F.broadcast(q.agg(F.coalesce(F.sum(n), F.lit(0)).cast("double").alias("tq"))))
    x = x.join(F.broadcast(t)).withColumn("p", F.col("p") / F.greatest(F.col("tp"), F.lit(1e-300))).withColumn("q", F.col("q") / F.greatest(F.col("tq"), F.lit(1e-300)))
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(c > 0, c * F.log2(c / F.when(mid > 0, mid))).otherwise(0.0)
    s = x.agg(F.sum(part(F.col("p")) / 2 + part(F.col("q")) / 2).alias("d"))
    one = F.lit(empty).cast("double") if empty is not None else F.lit(1.0)
    return t.join(F.broadcast(s)).select(F.when((F.col("tp") == 0) & (F.col("tq") == 0), F.lit(0.0)).when((F.col("tp") == 0) | (F.col("tq") == 0), one).otherwise(F.least(F.greatest("d", F.lit(0.0)), F.lit(1.0))).alias("jsd"))
