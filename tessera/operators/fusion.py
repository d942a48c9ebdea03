"""Joining ranked lists, scoring the union, and capping hosts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.lexical import top_k


def rrf(lists: Mapping[str, DataFrame], k: int = 60, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Sum over lists of 1 / (k + rank), ranks from 1, by ``by`` and key; empty lists add nothing."""
    all_ = reduce(DataFrame.unionByName, [d.select(*by, "key", "rank") for d in lists.values()])
    return all_.groupBy(*by, "key").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("rrf"))


def sublist_ranks(web: DataFrame, engine: str, fan: str, by: Sequence[str] = ()) -> DataFrame:
    """Each engine's own ranks, from 1, in the order of the fan-out."""
    return web.withColumn("rank", F.row_number().over(Window.partitionBy(*by, engine).orderBy(fan)))


def merge_sources(local: DataFrame, ann: DataFrame, web: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each key: scores of each source, least web rank, and ``source``.

    ``source`` is local, web, or both; it becomes both whenever a web result meets a key that is there already, a
    second engine's duplicate included. One aggregation over the union of the lists does the work of the outer joins.
    """
    row = lambda d, bm25, ann_, rank, prio: d.select(*by, "key", bm25.cast("double").alias("bm25"), ann_.cast("double").alias("ann"), rank.cast("long").alias("searx_rank"), F.lit(prio).alias("prio"))
    none = F.lit(None)
    all_ = row(local, F.col("score"), none, none, 0).unionByName(row(ann, none, F.col("score"), none, 1)).unionByName(row(web, none, none, F.col("rank"), 2))
    out = all_.groupBy(*by, "key").agg(F.max("bm25").alias("bm25"), F.max("ann").alias("ann"), F.min("searx_rank").alias("searx_rank"), F.min("prio").alias("_lo"), F.max("prio").alias("_hi"), F.count("*").alias("_n"))
    source = F.when(F.col("_lo") == 2, F.when(F.col("_n") > 1, "both").otherwise("web")).otherwise(F.when(F.col("_hi") == 2, "both").otherwise("local"))
    return out.withColumn("source", source).drop("_lo", "_hi", "_n")


#: What ranking can weigh, and what stands for a row that lacks it.
ABSENT: dict[str, float] = {"rrf": 0.0, "bm25": 0.0, "ann": 0.0, "title": 0.0, "source": 0.0, "snippet": 0.0, "freshness": 0.5, "domain": 0.0, "geo": 0.0}


def ltr_features(x: DataFrame, query: Column, now: Column | None = None, km: Column | None = None) -> dict[str, Column]:
    """The nine ranking features of fused results, from those of the columns rrf, bm25, ann, searx_rank, title, snippet, ts and prior that ``x`` has.

    title: share of query terms in the title; source: how many of the three kinds of lists hold the result, over 3; snippet: its
    length; freshness: falling with the age at ``now`` (seconds), one half where the time is unknown; domain: the host's prior; geo: nearness by
    ``km``. A missing column or a null gives the value in :data:`ABSENT`. Do not name a feature ``title`` in the select that computes
    others: Spark resolves names within lambdas to such an alias first.
    """
    have = lambda c: F.col(c) if c in x.columns else F.lit(None)
    kinds = S.source_count(*(have(c) for c in ("bm25", "ann", "searx_rank")))
    found = {
        "rrf": have("rrf"),
        "bm25": have("bm25"),
        "ann": have("ann"),
        "title": S.title_match_ratio(query, have("title").cast("string")),
        "source": kinds / 3.0,
        "snippet": F.when(have("snippet").isNotNull(), S.snippet_norm(have("snippet").cast("string"))),
        "freshness": S.freshness(have("ts").cast("long"), F.lit(0) if now is None else now),
        "domain": have("prior"),
        "geo": F.lit(None) if km is None else 1 / (1 + km),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(ABSENT[k])) for k, v in found.items()}


def linear_ltr(features: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """A weighted sum; without weights the fused score alone."""
    weights = weights or {"rrf": 1.0}
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * features[f] for f, w in weights.items() if w and f in features])


def domain_cap(scored: DataFrame, by: Sequence[str], host: str, order: Sequence[Column], most: int = 3, limit: int = 10) -> DataFrame:
    """The best ``most`` of each host (rows without a host are one host, the empty one), then the best ``limit``."""
    h = scored.withColumn("_h", F.coalesce(F.col(host), F.lit("")))
    capped = top_k(h, [*by, "_h"], order, most, "_within").drop("_h", "_within")
    return top_k(capped, by, order, limit)


def late_materialise(found: DataFrame, have: DataFrame, docs: DataFrame, key: str = "key") -> DataFrame:
    """Documents of keys that only one source found; keys without a document drop out."""
    return found.join(have.select(key), key, "left_anti").join(docs, key)
