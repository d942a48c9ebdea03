"""Measures of rankings, calibration and clusterings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import ranged, running_sum


def ranking_measures(ranked: DataFrame, judged: DataFrame, k: int = 10, recall_at: int = 100) -> DataFrame:
    """``(qid, ndcg, mrr, recall)`` of ranked rows (qid, doc, rank) against grades (qid, doc, grade); 0 for queries without relevant documents."""
    j = judged.where("grade > 0")
    hit = ranked.join(j, ["qid", "doc"])
    dcg = hit.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1.0))).alias("dcg"), F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"), F.count_if(F.col("rank") <= recall_at).alias("found"))
    best = j.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc")))
    ideal = best.groupBy("qid").agg(F.sum(F.when(F.col("_r") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("_r") + 1.0))).alias("ideal"), F.count("*").alias("relevant"))
    q = judged.select("qid").distinct().join(ideal, "qid", "left").join(dcg, "qid", "left")
    return q.select("qid", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("found") / F.col("relevant"), F.lit(0.0)).alias("recall"))


def alpha_ndcg(order: Sequence[str], topics: dict[str, set[str]], k: int = 10, alpha: float = 0.5) -> float:
    """Gain that falls by ``1 - alpha`` with each earlier document on a subtopic, over that of the greedy order; between 0 and 1."""

    def gains(docs: Sequence[str]) -> float:
        seen: dict[str, int] = {}
        total = 0.0
        for i, d in enumerate(docs[:k]):
            for t in topics.get(d, ()):
                total += (1 - alpha) ** seen.get(t, 0) / np.log2(i + 2)
                seen[t] = seen.get(t, 0) + 1
        return total

    left, best, seen = sorted(topics), [], {}
    while left and len(best) < k:
        d = max(left, key=lambda x: (sum((1 - alpha) ** seen.get(t, 0) for t in topics[x]), [-ord(c) for c in x]))
        best.append(d)
        left.remove(d)
        for t in topics[d]:
            seen[t] = seen.get(t, 0) + 1
    ideal = gains(best)
    return min(max(gains(order) / ideal, 0.0), 1.0) if ideal > 0 else 0.0


def alpha_ndcg_by_query(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """:func:`alpha_ndcg` for each query; judged rows are (qid, doc, grade, subtopic)."""

    def run(key: tuple, r: pd.DataFrame, j: pd.DataFrame) -> pd.DataFrame:
        topics: dict[str, set[str]] = {}
        for d, t in zip(j["doc"].astype(str), j["subtopic"].astype(str), strict=True):
            topics.setdefault(d, set()).add(t)
        order = list(r.sort_values("rank")["doc"].astype(str))
        return pd.DataFrame({"qid": [key[0]], "alpha_ndcg": [alpha_ndcg(order, topics, k)]})

    return ranked.groupBy("qid").cogroup(judged.where("grade > 0").groupBy("qid")).applyInPandas(run, "qid long, alpha_ndcg double")


def average_rank(value: str, by: Sequence[str], n: str) -> Column:
    """Rank from 1 of a row that stands for ``n`` equal ones, equals sharing the mean of their ranks; nulls come first and are equal."""
    w = Window.partitionBy(*by)
    same = F.sum(n).over(Window.partitionBy(*by, value))
    return F.sum(n).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)) - (same - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation of each group; null for fewer than three rows or a constant side.

    Rows are counted by their pair of values before anything is ordered, so that a group costs its distinct pairs.
    """
    g = df.groupBy(*by, F.col(x).alias("_vx"), F.col(y).alias("_vy")).agg(F.count("*").alias("_n"))
    g = g.withColumn("_mean", (F.sum("_n").over(Window.partitionBy(*by)) + 1) / 2)
    g = g.withColumns({"_x": average_rank("_vx", by, "_n") - F.col("_mean"), "_y": average_rank("_vy", by, "_n") - F.col("_mean")})
    s = g.groupBy(*by).agg(F.sum("_n").alias("_rows"), *(F.sum(F.col("_n") * F.col(i) * F.col(j)).alias(i + j) for i, j in (("_x", "_x"), ("_x", "_y"), ("_y", "_y"))))
    able = (F.col("_rows") >= 3) & (F.col("_x_x") > 0) & (F.col("_y_y") > 0)
    return s.select(*by, F.when(able, F.col("_x_y") / F.sqrt(F.col("_x_x") * F.col("_y_y"))).alias("spearman"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of the probability."""
    g = df.withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).groupBy("_b").agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def pair_scores(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision, recall, F1 and false merges of a clustering over pairs of rows, from the counts of its contingency table."""
    pairs = lambda by: df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s"))
    x = pairs([truth, found]).withColumnRenamed("s", "both").join(F.broadcast(pairs([truth]).withColumnRenamed("s", "t"))).join(F.broadcast(pairs([found]).withColumnRenamed("s", "f")))
    safe = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    p, r = safe(F.col("both"), F.col("f")), safe(F.col("both"), F.col("t"))
    return x.select(p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"), (F.col("f") - F.col("both")).cast("long").alias("false_merges"))


def nearest_rank(df: DataFrame, value: str, percents: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Percentiles by nearest rank: the value at place ceil(p n / 100), the first at least. Rows are counted by value before values are ordered."""
    w = Window.partitionBy(*by)
    g = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    g = g.withColumn("_n", F.sum("_k").over(w)).withColumn("_to", F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.greatest(F.ceil(F.lit(p) / 100 * F.col("_n")), F.lit(1))
    here = lambda p: (at(p) <= F.col("_to")) & (at(p) > F.col("_to") - F.col("_k"))
    return g.groupBy(*by).agg(*(F.max(F.when(here(p), F.col(value))).alias(f"p{p:g}".replace(".", "_")) for p in percents))


def conformal_threshold(df: DataFrame, score: str, wrong: str, alpha: float = 0.1, least: int = 20) -> DataFrame:
    """The smallest score from which on (mistakes + 1) / (rows + 1) is at most alpha over at least ``least`` rows; null if there is none.

    Rows are counted by score; running sums go by ranges of scores. Rows without a score are left out.
    """
    g = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("k"), F.sum(F.col(wrong).cast("long")).alias("v"))
    c, _ = running_sum(ranged(g, score), "k", (score,), "n", backwards=True)
    c, _ = running_sum(c, "v", (score,), "e", backwards=True)
    return c.where((F.col("n") >= least) & ((F.col("e") + 1) / (F.col("n") + 1) <= alpha)).agg(F.min(score).alias("threshold"))


def graded_reward(results: DataFrame, by: Sequence[str], rank: str, web: Column) -> DataFrame:
    """Share of the discounted gain of the first ten places that web results hold, in 255ths."""
    ideal = float(sum(1 / np.log2(i + 1) for i in range(1, 11)))
    g = results.where(F.col(rank) <= 10).groupBy(*by).agg((F.sum(F.when(web, 1 / F.log2(F.col(rank) + 1.0)).otherwise(0.0)) / ideal).alias("s"))
    return g.select(*by, F.round(F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias("reward"))
