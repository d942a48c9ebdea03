"""Ranking features with their defaults, priors and weights in a search, passages of whole texts, MMR over lists."""

import pytest
from pyspark.sql import functions as F
from tests.compare import SF

from tessera.operators import answer as W
from tessera.operators import fusion
from tessera.plans import catalog
from tessera.plans.search import Request, search

import __spark_entry__  # noqa: F401, E402  registers the queries

ROW = "key long, rrf double, bm25 double, ann double, searx_rank int, title string, snippet string, ts long, prior double"


def test_features(spark):
    day = 86400
    x = spark.createDataFrame([(1, 0.5, 2.0, 0.1, 3, "Red apple pie", "s" * 120, 100 * day, 0.7), (2, None, None, None, None, None, None, None, None)], ROW)
    f = fusion.ltr_features(x, F.lit("apple tart"), F.lit(143 * day), F.when(F.col("key") == 1, 3.0))
    a, b = x.orderBy("key").select(*(v.alias(k) for k, v in f.items())).collect()
    assert a.asDict() == pytest.approx({"rrf": 0.5, "bm25": 2.0, "ann": 0.1, "title": 0.5, "source": 1.0, "snippet": 0.5, "freshness": 0.36787944, "domain": 0.7, "geo": 0.25})
    assert b.asDict() == fusion.ABSENT
    bare = spark.createDataFrame([(1, 0.5)], "key long, rrf double")
    got = bare.select(*(v.alias(k) for k, v in fusion.ltr_features(bare, F.lit("q")).items())).first()
    assert got.asDict() == fusion.ABSENT | {"rrf": 0.5}


def test_priors_order_a_search(spark):
    docs = spark.createDataFrame([(i, "apple pie recipe of the day", h) for i, h in enumerate("aabbcc")], "doc_id long, text string, source string")
    q = spark.createDataFrame([(1, "apple pie")], "qid long, query string")
    priors = spark.createDataFrame([("c", 0.9), ("b", 0.1)], "host string, prior double")
    plain = [r["key"] for r in search(docs, q, Request())[0].orderBy("slot").collect()]
    same = [r["key"] for r in search(docs, q, Request(), priors=priors, weights={"rrf": 1.0})[0].orderBy("slot").collect()]
    led = search(docs, q, Request(), priors=priors, weights={"rrf": 1.0, "domain": 1.0, "title": 0.5, "source": 0.3})[0].orderBy("slot").collect()
    assert plain == same == [0, 1, 2, 3, 4, 5]
    assert [r["key"] for r in led] == [4, 5, 2, 3, 0, 1]
    assert led[0]["score"] == pytest.approx(1 / 65 + 0.9 + 0.5 + 0.1)


def test_all_passages(spark):
    text = " ".join(f"This is sentence number {i}, and it is long enough to be a passage of its own." for i in range(300))
    every = W.passages(text, 100)
    assert len(every) == 300 and W.passages(text, 100, 8) == every[:8] and "number 299," in every[-1]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    assert W.passage_table(df, "k", "t", 100).count() == 300 and W.passage_table(df, "k", "t", 100, 5).count() == 5


def test_mmr_over_lists(spark):
    rows = [(q, p, 1.0 / (p + 1), t) for q in range(2) for p, t in enumerate(["apple banana cherry", "apple banana cherry", "zebra yak walrus", None, "apple kiwi", "tail one", "tail two"])]
    df = spark.createDataFrame(rows, "q long, p int, s double, t string")
    got = W.mmr_order(df, "q", "p", "s", "t", 0.5, head=5)
    want = W.mmr([r[2] for r in rows[:5]], [r[3] or "" for r in rows[:5]], 0.5) + [5, 6]
    for q in range(2):
        assert [r["p"] for r in got.where(F.col("q") == q).orderBy("slot").collect()] == want
    assert want != list(range(7)) and W.mmr_order(df.limit(0), "q", "p", "s", "t").count() == 0


def test_registered_mmr(spark):
    got = catalog.QUERIES["mmr_results"](spark, SF).toPandas()
    for _, x in got.groupby("qid"):
        assert sorted(x["pos"]) == sorted(x["slot"]) == list(range(len(x)))
