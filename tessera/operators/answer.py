"""Which pages to open, which passages to show: value of information, passages, scorers and diversity by relevance."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PASSAGE = 40


def reservation_index(gain: Column, cost: Column, p: Column) -> Column:
    return gain - cost / F.greatest(p, F.lit(1e-9))


def page_probability(z: Column) -> Column:
    """Chance that a page is worth opening, from its standardised score."""
    return F.least(F.greatest(0.2 + 0.3 * F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0)), F.lit(0.05)), F.lit(0.95))


def headroom(rank: Column) -> Column:
    """Discounted gain a result could still win by moving to the top; ranks from 0."""
    return 7.0 * (1 - 1 / F.log2(rank + 2.0))


def page_candidates(results: DataFrame, by: Sequence[str], score: str, rank: str, novelty: Column, cost: float, head: int = 20) -> DataFrame:
    """``p``, ``gain`` and ``cost`` of the head of each list; scores are standardised over the head."""
    w = Window.partitionBy(*by)
    x = results.where(F.col(rank) < head)
    z = (F.col(score) - F.avg(score).over(w)) / F.greatest(F.stddev_pop(score).over(w), F.lit(1e-9))
    x = x.withColumn("z", z).withColumn("p", page_probability(F.col("z")))
    return x.withColumn("gain", F.least(F.greatest(novelty, F.lit(0.0)), F.lit(1.0)) * headroom(F.col(rank))).withColumn("cost", F.lit(cost))


def additive_walk(candidates: DataFrame, by: Sequence[str], budget: int, key: str = "id") -> DataFrame:
    """Candidates to open, best expected net gain first: it ends at the first without gain, or when the budget is used up."""
    x = candidates.withColumn("net", F.col("p") * F.col("gain") - F.col("cost"))
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("net"), key)))
    return x.where((F.col("net") > 0) & (F.col("turn") <= budget))


def pandora_walk(ids: Sequence[int], z: Sequence[float], value: dict[int, float], budget: int, best: float = float("-inf")) -> tuple[list[int], float, str]:
    """Opens in order of the reservation index until the best value found is not below the next one; returns what was opened, the best value and why it ended."""
    opened: list[int] = []
    for i in sorted(range(len(ids)), key=lambda i: (-z[i], ids[i])):
        if best >= z[i]:
            return opened, best, "stop"
        if len(opened) >= budget:
            return opened, best, "budget"
        opened.append(ids[i])
        best = max(best, value.get(ids[i], float("-inf")))
    return opened, best, "exhausted"


def pandora(candidates: DataFrame, by: str, budget: int, key: str = "id", value: str = "value") -> DataFrame:
    """:func:`pandora_walk` for each list; ``turn`` is the order of opening."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = (pdf["gain"] - pdf["cost"] / np.maximum(pdf["p"], 1e-9)).tolist()
        got, _, why = pandora_walk(pdf[key].tolist(), z, dict(zip(pdf[key], pdf[value], strict=True)), budget)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(got), key: got, "turn": range(1, len(got) + 1), "ended": [why] * len(got)})

    return candidates.select(by, key, "p", "gain", "cost", value).groupBy(by).applyInPandas(run, f"{by} long, {key} long, turn int, ended string")


def passages(text: str, size: int = 500, most: int | None = None) -> list[str]:
    """Sentences packed greedily into passages of at most ``size`` characters; long sentences are cut; passages under 40 characters are dropped.

    All of a text's passages, or its first ``most``.
    """
    out: list[str] = []
    held = ""

    def close() -> None:
        nonlocal held
        if len(held.strip()) >= LEAST_PASSAGE:
            out.append(held.strip())
        held = ""

    for s in (m[0] for m in re.finditer(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", text or "") if m[0].strip()):
        if held and len(held) + len(s) + 1 > size:
            close()
        if most is not None and len(out) >= most:
            break
        if len(s) > size:
            close()
            out += [p for i in range(0, len(s), size) if len(p := s[i : i + size].strip()) >= LEAST_PASSAGE]
        else:
            held = f"{held} {s.strip()}" if held else s.strip()
    if most is None or len(out) < most:
        close()
    return out[:most]


def passage_table(docs: DataFrame, key: str, text: str, size: int = 500, most: int | None = None) -> DataFrame:
    """``(key, n, passage)`` of every document's passages: all of them, or the first ``most``."""
    split = F.pandas_udf(lambda s: s.map(lambda t: passages(t, size, most)), "array<string>")
    return docs.select(F.col(key), F.posexplode(split(F.col(text))).alias("n", "passage"))


def overlap_score(q: Column, text: Column) -> Column:
    """The stand-in for a cross-encoder where no model is at hand: share of the query's terms in the text, on a scale from -5 to 10."""
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    t = terms(q)
    return F.when(F.size(t) > 0, 15.0 * F.size(F.array_intersect(t, terms(text))) / F.greatest(F.size(t), F.lit(1)) - 5).otherwise(-5.0)


def rerank(results: DataFrame, by: Sequence[str], rank: str, score: Column, head: int = 20) -> DataFrame:
    """Head by score, the rest as it was behind it; rows without a score keep their order behind those with one."""
    x = results.withColumn("ce", F.when(F.col(rank) <= head, score))
    order = [F.col("ce").isNull().cast("int"), F.desc(F.round("ce", 9)), F.col(rank)]
    return x.withColumn("new_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def best_passage(scored: DataFrame, by: Sequence[str], score: str = "ce", threshold: float = 0.0) -> DataFrame:
    """The best passage of each list; withheld and flagged if it scores below the threshold, also where that is 0."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), "key", "n")
    x = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    low = F.col(score) < threshold
    return x.withColumn("passage", F.when(~low, F.col("passage"))).withColumn("degraded", F.when(low, "answer_below_threshold"))


def novelty(most_containment: Column) -> Column:
    return 1 - F.coalesce(most_containment, F.lit(0.0))


def mmr(scores: Sequence[float], texts: Sequence[str], weight: float = 0.7) -> list[int]:
    """Order by relevance less the greatest term overlap with what stands before; one or two results stay as they are."""
    n = len(scores)
    if n <= 2:
        return list(range(n))
    terms = [{t for t in re.split(r"[^\w]+|_", x) if len(t.encode()) > 2} for x in texts]
    low = min(min(scores), 0.0)
    scale = max(max(scores) - low, 1e-9)
    sim: Callable[[int, int], float] = lambda i, j: len(terms[i] & terms[j]) / max(len(terms[i] | terms[j]), 1)
    out, left = [], list(range(n))
    while left:
        best = max(left, key=lambda i: (weight * (scores[i] - low) / scale - (1 - weight) * max((sim(i, j) for j in out), default=0.0), -i))
        out.append(best)
        left.remove(best)
    return out


def mmr_order(results: DataFrame, by: str, pos: str, score: str, text: str, weight: float = 0.7, head: int = 50) -> DataFrame:
    """``(by, pos, slot)``: :func:`mmr` for the first ``head`` results of each list (places from 0), the rest behind them as they were.

    Lists are told apart by ``by``; only their heads are brought together, so that a list of any length is no more work for a task. Null texts have
    no terms, null scores count 0; of equal values the one that came first is taken.
    """
    kinds = {c: results.schema[c].dataType.simpleString() for c in (by, pos)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        order = mmr(pdf[score].fillna(0.0).astype(float).tolist(), pdf[text].fillna("").tolist(), weight)
        return pd.DataFrame({by: pdf[by].to_numpy(), pos: pdf[pos].to_numpy()[order], "slot": np.arange(len(order))})

    first = results.where(F.col(pos) < head).select(by, pos, score, text)
    moved = first.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {pos} {kinds[pos]}, slot long")
    return moved.unionByName(results.where(F.col(pos) >= head).select(by, pos, F.col(pos).cast("long").alias("slot")))
