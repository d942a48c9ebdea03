"""The search plan: from a batch of queries to ranked, capped, clustered and annotated results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import evidence, fusion, lexical
from tessera.operators.stored_index import StoredIndex
from tessera.plans.config import Config, clamp, validate


@dataclass(frozen=True)
class Request:
    scope: str = "local"
    mode: str = "fast"
    limit: int = 10
    diversify: bool = False
    overrides: tuple[tuple[str, float], ...] = ()


def search(docs: DataFrame, queries: DataFrame, request: Request = Request(), config: Config = Config(), web: DataFrame | None = None, ann: DataFrame | None = None, keep: Column | None = None, priors: DataFrame | None = None, most_terms: int | None = None, index: StoredIndex | None = None, weights: Mapping[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """One plan for a whole batch of queries: (qid, query) against documents (doc_id, text, source).

    Stages: full-text ranking (and vector neighbours ``ann`` and web lists ``web`` where given, as qid, key, rank), fusion by reciprocal
    rank, a linear score of the first hundred, at most so many results of a host, clusters of derived texts, and on request their
    diversification. Texts are ranked as
    they stand, or where ``index`` is given by that stored index of them. Filters (``keep``) apply to local documents before ranking and switch neighbours off. ``weights`` name features of
    :func:`fusion.ltr_features`; without them the fused score alone counts. ``priors`` (host, prior) feed the feature ``domain``.
    Returns results and degradation flags.
    """
    flags = validate(request.scope, request.mode, filtered=keep is not None)
    knob = lambda name, default: int(clamp(name, dict(request.overrides).get(name, default)))
    limit = min(max(request.limit, 1), config.max_limit)
    terms = lexical.query_terms(queries, "qid", F.col("query"), most_terms)
    lists: dict[str, DataFrame] = {}
    if request.scope != "web":
        how = (knob("bm25_top_k", config.bm25_top_k), config.bm25_k1, config.bm25_b, config.title_boost, keep)
        if index is None:
            lists["bm25"] = lexical.bm25(lexical.index_documents(docs), terms, *how)
        else:
            lists["bm25"] = index.bm25(index.query_terms(queries, "qid", F.col("query")), *how)
        if ann is not None and keep is None:
            lists["ann"] = ann
    if request.scope != "local":
        if web is None:
            flags.append("searx_disabled")
        else:
            lists["web"] = web
    if not lists:
        raise ValueError("nothing to search")
    fused = lexical.top_k(fusion.rrf(lists, knob("rrf_k", config.rrf_k)), ["qid"], [F.desc(F.round("rrf", 12)), F.asc("key")], config.ltr_top_k)
    about = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("host"), S.title_of(F.col("text")).alias("title"), S.snippet_of(F.col("text")).alias("snippet"), F.col("text").alias("_text"))
    x = fused.select("qid", "key", "rrf").join(about, "key")
    if priors is not None:
        x = x.join(priors.select("host", "prior"), "host", "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    if weights:
        for name, own, out, best in (("bm25", "bm25", "bm25", F.max), ("ann", "sim", "ann", F.max), ("web", "rank", "searx_rank", F.min)):
            if name in lists and own in lists[name].columns:
                x = x.join(lists[name].groupBy("qid", "key").agg(best(own).alias(out)), ["qid", "key"], "left")
        x = x.join(queries.select("qid", F.col("query").alias("_q")), "qid")
    x = x.withColumn("score", fusion.linear_ltr(fusion.ltr_features(x, F.col("_q")) if weights else {"rrf": F.col("rrf")}, weights))
    top = fusion.domain_cap(x, ["qid"], "host", [F.desc(F.round("score", 12)), F.asc("key")], knob("max_per_domain", config.max_per_domain), limit)
    top = top.withColumn("pos", F.col("rank") - 1).withColumn("_s", evidence.sketch_udf("_text")).withColumns({"shingles": F.col("_s.shingles"), "sig": F.col("_s.sig")}).drop("_s", "_text", "rank")
    out = top.join(evidence.cluster_results(top, ["qid"], config.containment_tau), ["qid", "pos"])
    out = evidence.diversify(out, ["qid"]) if request.diversify else out.withColumn("slot", F.col("pos"))
    return out.select("qid", "slot", "key", "host", "title", "snippet", "score", "cluster", "canonical"), flags
