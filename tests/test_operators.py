"""Small cases with known results."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.functions import scalars as S
from tessera.operators import analytics as A
from tessera.operators import answer as W
from tessera.operators import evaluation as M
from tessera.operators import evidence as E
from tessera.operators import fusion, ingest, lexical, routing, vector
from tessera.operators.components import connected_components
from tessera.plans.config import Config, InvalidRequest, validate, with_overrides
from tessera.sources import pages as G
from tessera.sources import readers as R


def test_fused_ranks(spark):
    rows = lambda keys: spark.createDataFrame([(0, k, i + 1) for i, k in enumerate(keys)], "qid int, key long, rank int")
    got = fusion.rrf({"a": rows([1, 7, 3, 4]), "b": rows([2, 7, 5, 6])}).orderBy(F.desc("rrf"), "key").collect()
    assert got[0]["key"] == 7 and got[0]["rrf"] == pytest.approx(2 / 62)
    got = fusion.rrf({"a": rows([9]), "b": rows([4])}).orderBy(F.desc("rrf"), "key").collect()
    assert [r["key"] for r in got] == [4, 9]


def test_days(spark):
    days = ["19700101", "19700102", "20000301", "20260611", "garbage!", "20261401"]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").select("i", S.civil_day(F.col("d")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [0, 1, 11017, 20615, None, None]


def test_domains_and_intents(spark):
    hosts = {"news.example.com": "example.com", "www.bbc.co.uk": "bbc.co.uk", "127.0.0.1": None, "localhost": "localhost"}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", S.registered_domain(F.col("h")).alias("d")).collect()
    assert {r["h"]: r["d"] for r in got} == hosts
    qs = {"how does tcp work": "question", "cheap flights?": "question", "restaurant near me": "geo", "github login": "navigational", "rust borrow checker": "keyword", "": "keyword"}
    got = spark.createDataFrame([(q,) for q in qs], "q string").select("q", S.intent(F.col("q")).alias("i")).collect()
    assert {r["q"]: r["i"] for r in got} == qs


def test_ranking_prefers_titles_and_filters_keep_statistics(spark):
    docs = spark.createDataFrame([(1, "compiler notes", "a compiler turns text"), (2, "gardening", "soil and water"), (3, "cooking", "a compiler of recipes")], "doc_id long, title string, body string")
    ix = lexical.index_documents(docs, title=F.col("title"), body=F.col("body"))
    q = spark.createDataFrame([(0, "compiler")], "qid int, term string")
    got = lexical.bm25(ix, q, 10).orderBy("rank").collect()
    assert [r["key"] for r in got] == [1, 3]
    only = lexical.bm25(ix, q, 10, keep=F.col("key") == 3).collect()
    assert len(only) == 1 and only[0]["bm25"] == pytest.approx(got[1]["bm25"])


def test_sketches():
    a = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest at night"
    n, sig = E.sketch(a)
    assert E.sketch(a.upper().replace(" ", ", ")) == (n, sig)
    assert E.sketch("two words")[0] == 1
    assert E.decode_sketch(E.encode_sketch(n, sig)) == (n, sig) and E.decode_sketch(b"short") is None
    rng = np.random.default_rng(1)
    words = ["w%d" % i for i in range(4000)]
    big = np.frombuffer(E.sketch(" ".join(rng.choice(words, 3000)))[1], np.uint8)
    merged = sum((np.frombuffer(E.sketch(" ".join(rng.choice(words, 8)))[1], np.uint8) == big).sum() >= 15 for _ in range(200))
    assert merged == 0


def test_diversify(spark):
    def order(tags):
        rows = [(0, i, c[0] if c else None, c[1] if c else False) for i, c in enumerate(tags)]
        df = spark.createDataFrame(rows, "qid int, pos int, cluster int, canonical boolean")
        return [r["pos"] for r in E.diversify(df, ["qid"]).orderBy("slot").collect()]

    assert order([(0, False), (0, True), (1, True), None, (0, False)]) == [1, 2, 3, 0, 4]


def test_divergence(spark):
    d = lambda *x: spark.createDataFrame(list(x), "k string, n long")
    same, other, none = d(("a", 1), ("b", 1)), d(("c", 2)), d(("a", 1)).limit(0)
    v = lambda p, q: A.divergence(p, q, "k").first()["jsd"]
    assert v(same, same) == 0 and v(same, other) == pytest.approx(1) and v(none, none) == 0 and v(same, none) == 1


def test_bursts():
    assert A.burst_summary(A.burst_states(np.array([5] * 20 + [8, 11, 14] + [15] * 5)))[0]
    assert not A.burst_summary(A.burst_states(np.array([5] * 14 + [15] + [5] * 13)))[0]
    assert A.burst_states(np.array([5] * 6)) is None and A.burst_states(np.zeros(10, int)) is None
    on, at, days = A.burst_summary(A.burst_states(np.array([2] * 9 + [10] * 5)))
    assert on and 8 <= at <= 10 and days >= 4


def test_movers_and_hot_spots(spark):
    rows = [(u, d, 5) for u in range(19) for d in range(15)] + [(19, d, 2) for d in range(14)] + [(19, 14, 40)]
    got = A.movers(spark.createDataFrame(rows, "u int, day int, n long"), "u").where("significant").collect()
    assert [r["u"] for r in got] == [19]
    centre = C.pack(5, 0, 0)
    cells = [(c, 50) for c in C.disk_of(centre, 1)] + [(C.pack(5, 100 + 3 * i, 50), 2) for i in range(40)]
    hot = A.hot_spots(spark.createDataFrame(cells, "cell long, count long")).where("significant").collect()
    assert centre in [r["cell"] for r in hot] and all(r["count"] == 50 for r in hot)
    assert A.hot_spots(spark.createDataFrame(cells[:2], "cell long, count long")).where("significant").count() == 0


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (1, 4, 5), (2, 3, 2), (8, 9, 1)], "a long, b long, w long")
    rank = {r["node"]: r["rank"] for r in A.page_rank(e).collect()}
    assert rank[1] == pytest.approx(1) and 8 not in rank and rank[4] < rank[1]
    assert A.compact_edges(e, 3).count() <= 3
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, None)], "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43
    assert connected_components(e.select("a", "b").limit(0)).count() == 0


def test_cells(spark):
    a, b = C.cell_at(52.5, 13.4, 7), C.cell_at(52.5, 13.4, 3)
    assert C.parent_of(a, 3) in C.disk_of(b, 2) and len(C.disk_of(a, 1)) == 7 and len(C.disk_of(a, 2)) == 19
    got = spark.createDataFrame([(52.5, 13.4), (91.0, 0.0), (-33.9, 151.2)], "lat double, lon double").select(C.cell_of(F.col("lat"), F.col("lon"), 7).alias("c"), C.parent(C.cell_of(F.col("lat"), F.col("lon"), 7), 3).alias("p")).collect()
    assert got[0]["c"] == a and got[0]["p"] == C.parent_of(a, 3) and got[1]["c"] is None and got[2]["p"] == C.parent_of(C.cell_at(-33.9, 151.2, 7), 3)
    for km, res in ((5, 7), (20, 7), (200, 5)):
        r, cells = C.filter_cells(52.5, 13.4, km)
        assert r == res and C.cell_at(52.5, 13.4, res) in cells
    with pytest.raises(C.CellError):
        C.cell_at(95, 0, 5)


def test_ingest_and_forget(spark):
    batch = spark.createDataFrame([(1, "https://a.example/1", " hello world "), (2, "https://a.example/2", "hello world"), (3, "https://b.example/3", "gone"), (4, "https://b.example/4", "old"), (5, "https://b.example/5", "  "), (6, None, None)], "id int, url string, text string")
    h = lambda *t: spark.createDataFrame([(x,) for x in t], "t string").select(S.content_hash(F.col("t")).alias("hash"))
    got = ingest.ingest(batch, h("old"), h("gone"), order=F.col("id"))
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "accepted", 2: "deduped", 3: "refused", 4: "deduped"}
    left, stones = ingest.forget_one(got, h("gone"), domain="a.example")
    again, same = ingest.forget_one(left, stones, domain="a.example")
    assert left.count() == again.count() == 2 and stones.count() == same.count() == 2
    assert {r["status"] for r in ingest.ingest(batch.where("id = 1"), h(), stones).collect()} == {"refused"}
    with pytest.raises(ValueError):
        ingest.forget_one(got, stones)


def test_off_policy(spark):
    rows = [(0, 0, 0.9, 1.0 if i % 5 == 0 else 0.0) for i in range(9000)] + [(0, 1, 0.1, 0.0 if i % 5 == 0 else 1.0) for i in range(1000)]
    log = spark.createDataFrame(rows, "context int, arm int, propensity double, reward double")
    assert routing.ips(log, F.lit(1)).first()[0] == pytest.approx(0.8, abs=0.01)
    assert routing.doubly_robust(log, F.lit(1)).first()[0] == pytest.approx(0.8, abs=0.01)
    up = routing.uplift(log, F.lit(1), 100).first()
    assert up["lo"] > 0 and up["verdict"] == "pass"
    assert routing.ips(log.limit(0), F.lit(1)).first()[0] is None
    assert routing.verdict(10, 1, 2) == "insufficient" and routing.verdict(10_000, -2, -1) == "negative"


def test_log_and_bandit(spark):
    log = spark.createDataFrame([(0, "c", i) for i in range(7)], "day int, context string, seq int")
    got = routing.anonymise(log, "day", "context", "seq").collect()
    assert sum(r["shown"] is None for r in got) == 4
    stats = spark.createDataFrame([("q", 0, 0.1), ("q", 1, 0.9)], "intent string, arm int, mean double")
    greedy = {r["intent"]: r["greedy"] for r in routing.greedy_arms(stats, spark.createDataFrame([("q",), ("new",)], "intent string")).collect()}
    assert greedy == {"q": 1, "new": 2}
    p = routing.ThompsonPolicy()
    x = np.zeros(26)
    x[0] = 1
    for _ in range(50):
        p.update(1, x, 1.0)
    assert p.greedy(x) == 1 and p.choose(x, 3)[1] >= 1 / 64


def test_measures(spark):
    r = spark.createDataFrame([(0, "t", 1), (0, "x", 2), (1, "x", 1), (1, "y", 2), (1, "t", 3), (2, "x", 1)], "qid int, doc string, rank int")
    j = spark.createDataFrame([(q, "t", 3) for q in range(3)], "qid int, doc string, grade int")
    got = {x["qid"]: x for x in M.ranking_measures(r, j).collect()}
    assert got[0]["ndcg"] == 1 and 0 < got[1]["ndcg"] < 1 and got[2]["ndcg"] == 0 and got[1]["mrr"] == pytest.approx(1 / 3)
    topics = {"a": {"1"}, "a2": {"1"}, "b": {"2"}, "c": {"3"}}
    assert M.alpha_ndcg(["a", "b", "c", "a2"], topics) == pytest.approx(1) and M.alpha_ndcg(["a", "a2", "b", "c"], topics) < 1


def test_walks_and_passages():
    assert W.pandora_walk([1, 2], [0.5, 2.0], {1: 0.1, 2: 0.2}, 5) == ([2, 1], 0.2, "exhausted")
    assert W.pandora_walk([1, 2], [2.0, 0.5], {1: 1.0, 2: 0.2}, 5) == ([1], 1.0, "stop")
    assert W.pandora_walk([1], [0.5], {1: 1.0}, 5, best=0.9)[0] == []
    text = "A first sentence that is long enough to count. " * 6
    got = W.passages(text, 120, 8)
    assert len(got) >= 2 and all(len(p) <= 120 for p in got) and len(W.passages(text, 120, 2)) == 2
    assert len(W.passages("x" * 1500, 500)) == 3 and W.passages("", 500) == []
    assert W.mmr([1.0, 0.99, 0.5], ["apple banana cherry", "apple banana cherry", "zebra yak walrus"], 0.5) == [0, 2, 1]


def test_addresses_and_pages(tmp_path, spark):
    for ip in ("127.0.0.1", "10.1.2.3", "169.254.169.254", "100.64.0.1", "::1", "::ffff:10.0.0.1", "64:ff9b::7f00:1", "2002:7f00:1::"):
        assert G.ip_denied(ip)
    assert not G.ip_denied("93.184.216.34") and not G.ip_denied("2606:2800:220:1::1")
    assert G.check_url("https://example.com/") is None and G.check_url("ftp://example.com/") == "scheme" and G.check_url("http://x.onion/") == "onion" and G.check_url("http://example.com:22/") == "port" and G.check_url("http://127.0.0.1/") == "address" and G.check_url(None) == "invalid"
    assert G.extract("<html><title>T &amp; x</title><body><nav>menu</nav><article><p>One.</p><script>var a</script><p>Two.</p></article></body></html>") == ("T & x", "One.\nTwo.")
    assert G.robots_allow("User-agent: *\nDisallow: /private", 200, "bot", "/private/x") is False and G.robots_allow("", 404, "bot", "/") and not G.robots_allow("", 503, "bot", "/")
    (tmp_path / "q.tsv").write_text("q1\tsome text\nbroken\n")
    (tmp_path / "qrels.txt").write_text("q1 0 d1 3\nq1 0 d2\nq1 0 d3 x\n")
    (tmp_path / "c.jsonl").write_text('{"title": "A b", "body": "%s"}\n{"title": "", "body": "x"}\nnot json\n' % ("y" * 300))
    assert R.read_queries(spark, str(tmp_path / "q.tsv")).count() == 1 and R.read_judgments(spark, str(tmp_path / "qrels.txt")).count() == 1
    assert [r["url"] for r in R.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()] == ["https://corpus.example/wiki/A_b"]
    assert R.latest_slice("1 abc http://x/a.export.CSV.zip\n1 def http://x/b.gkg.csv.zip") == ("abc", "http://x/a.export.CSV.zip")


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 20 = 0")
    exact = vector.knn(df, q, 5)
    assert exact.where("rank = 1").where("qid = key").count() == 10
    assert vector.recall(vector.ann(df, q, 5, lists=8, probes=6), exact).first()["recall"] >= 0.9
    assert vector.knn(df.limit(0), q, 5).count() == 0


def test_configuration():
    c, echo = with_overrides(Config(), {"rrf_k": 5000, "containment_tau": 0.01})
    assert c.rrf_k == 1000 and c.containment_tau == 0.05 and echo == {"rrf_k": 1000, "containment_tau": 0.05}
    assert validate(filtered=True) == ["geo_web_unfiltered"]
    for bad in ({"budget": 2}, {"answer": True}, {"scope": "web", "filtered": True}, {"scope": "local", "compare": True}):
        with pytest.raises(InvalidRequest):
            validate(**bad)


def test_entry_scores_whole_queries(monkeypatch):
    import __spark_entry__ as E

    asked = {}
    monkeypatch.setattr(E.catalog, "table", lambda *_: type("T", (), {"selectExpr": lambda self, *a: self})())
    monkeypatch.setattr(E, "search", lambda *a, **k: asked.update(k) or [None])
    E.entry(None)
    assert asked.get("most_terms") is None


def test_ann_ranks_allowed_keys_only(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(300, 8)))] + [(900, None)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    some = t.where("vec_id % 3 = 0").select("vec_id")
    got = vector.ann(t, t.where("vec_id < 5"), 4, lists=6, probes=6, allowed=some).collect()
    want = vector.knn(t.where("vec_id % 3 = 0"), t.where("vec_id < 5"), 4).collect()
    assert sorted((r["qid"], r["key"], r["rank"]) for r in got) == sorted((r["qid"], r["key"], r["rank"]) for r in want) and len(got) == 20
    assert vector.ann(t.limit(0), t.limit(0), 4).count() == 0


def test_a_cluster_must_name_the_shared_folder(monkeypatch):
    from types import SimpleNamespace as N

    from tessera.plans import lineage

    conf = N(get=lambda *_: None)
    with pytest.raises(ValueError):
        lineage.shared_dir(N(conf=conf, sparkContext=N(getConf=lambda: conf, master="yarn", applicationId="a")))


def test_ranking_in_blocks_of_queries(spark, monkeypatch):
    """Small blocks, slices and buffers give the rows of a count by hand; ties go to the smaller key, null texts match nothing."""
    words = ["ash", "oak", "elm", "fir", "yew"]
    texts = [" ".join(words[(i * j) % 5] for j in range(1 + i % 9)) for i in range(40)] + [None, "", "oak oak", "oak oak"]
    docs = spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    asked = {1: "oak elm", 2: "yew", 3: "pine", 4: "ash oak elm fir yew", 5: None}
    queries = spark.createDataFrame(list(asked.items()), "item long, text string")
    terms = lexical.query_terms(queries, "item", F.col("text"))
    toks = [(t or "").split() for t in texts]
    n, mean = len(toks), sum(map(len, toks)) / len(toks)
    df = {w: sum(w in t for t in toks) for w in words}
    want = []
    for q, text in asked.items():
        got = []
        for i, t in enumerate(toks):
            s = 0.0
            for w in set((text or "").split()) & set(t):
                idf, tf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)), t.count(w)
                s += 3 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            if s > 0 and i % 4:
                got.append((-round(s, 9), f"d{i:02d}"))
        want += [(q, key, rank, round(-s, 6)) for rank, (s, key) in enumerate(sorted(got)[:7], 1)]
    index = lexical.index_documents(docs).withColumn("odd", F.substring("key", 2, 2).cast("int") % 4 != 0)
    for terms_most in (1 << 18, 2):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", terms_most)
        rows = lexical.bm25(index, terms, 7, keep=F.col("odd")).select("qid", "key", "rank", F.round("bm25", 6)).collect()
        assert sorted(map(tuple, rows), key=lambda r: (r[0], r[2])) == want
    assert lexical.bm25(index, terms.limit(0), 7).count() == 0 and lexical.bm25(index.limit(0), terms, 7).count() == 0


def test_best_rows_of_a_task():
    """The kept rows are those of a full sort, however often the buffer is emptied."""
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, (200, 4)).astype(float)
    best = lexical._Best(4, 5)
    best.limit = 16
    for at in range(0, 200, 7):
        part = pa.array(np.arange(200)[::-1]).slice(at, 7)
        best.add(part, scores[at:at + 7])
    got = [tuple(r.values()) for b in best.rows() for r in b.to_pylist()]
    want = [(q, *r[::-1]) for q in range(4) for r in sorted((-scores[199 - key, q], key) for key in range(200))[:5]]
    assert [(q, key, -s) for q, key, s in got] == want


def test_ingest_of_a_hot_text_accepts_its_first_row_alone(spark):
    batch = spark.range(600).selectExpr("600 - id id", "if(id % 3 = 0, concat('text ', id), 'the same text') text").repartition(16)
    none = spark.createDataFrame([], "hash string")
    got = ingest.ingest(batch, none, none, order=F.col("id")).where("status = 'accepted'").select("id", "text").collect()
    assert len(got) == 201
    assert [r["id"] for r in got if r["text"] == "the same text"] == [1]
    equal = spark.createDataFrame([(1, "again")] * 50, "id int, text string").repartition(8)
    stats = ingest.ingest_stats(ingest.ingest(equal, none, none, order=F.col("id"))).first()
    assert (stats["accepted"], stats["deduped"], stats["refused"]) == (1, 49, 0)


def test_ranks_of_counted_values_match_ranks_of_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), None if rng.random() < 0.1 else float(rng.integers(0, 6)), int(rng.integers(0, 4))) for g in rng.integers(0, 3, 200)]
    rows += [(7, 1.0, 1), (7, 2.0, 2), (8, 1.0, 1), (8, 1.0, 2), (8, 1.0, 3)]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"]).fillna({"x": -1.0})
    got = {r["g"]: r["spearman"] for r in M.spearman(df, "x", "y", ["g"]).collect()}
    assert got[7] is None and got[8] is None
    for g in range(3):
        part = pdf[pdf.g == g]
        assert got[g] == pytest.approx(part.x.rank().corr(part.y.rank()))
    for r in M.nearest_rank(df, "x", [1, 50, 95, 100], ["g"]).collect():
        values = sorted(x for g, x, _ in rows if g == r["g"] and x is not None)
        assert [r["p1"], r["p50"], r["p95"], r["p100"]] == [values[max(-(-p * len(values) // 100), 1) - 1] for p in (1, 50, 95, 100)]
    assert M.spearman(df.where("false"), "x", "y", ["g"]).count() == 0


def test_nearest_rows_are_found_in_bounded_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    unit = rng.integers(-2, 3, (700, 6)).astype(float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    keys = rng.permutation(700)
    unit[3] = np.nan  # ranks first, as in SQL
    queries = rng.normal(size=(90, 6))
    monkeypatch.setattr(vector, "TILE", 4096)
    best = vector._Nearest(np.arange(90), queries, 7)
    plain, seen = best._tile, []
    monkeypatch.setattr(best, "_tile", lambda k, r, w: (seen.append(len(k) * len(w)), plain(k, r, w)))
    best.add(keys[:500], unit[:500])
    best.add(keys[500:], unit[500:], np.arange(45))
    assert max(seen) <= 4096
    got = pa.Table.from_batches(best.rows()).to_pydict()
    for q in range(90):
        sim = np.nan_to_num(np.round(unit @ queries[q], 12), nan=np.inf)[: 700 if q < 45 else 500]
        want = keys[np.lexsort((keys[: len(sim)], -sim))[:7]]
        assert got["key"][7 * q : 7 * q + 7] == want.tolist()
    few = vector._Nearest(np.arange(2), queries[:2], 7)
    few.add(keys[:5], unit[:5])
    assert len(pa.Table.from_batches(few.rows())) == 10


def test_sketches_of_many_texts_equal_each_alone():
    """The hash and its bins as a plain procedure over characters."""
    rng = np.random.default_rng(3)
    pool = list("aBcÀİßéΣ漢字𝔸𐐀①Ⅳ٣½") + [" ", " ", ".", "-", "\t"]
    texts = ["", " ", "x" * 3000, *("".join(rng.choice(pool, rng.integers(80))) for _ in range(200))]
    m = (1 << 64) - 1

    def mix(x):
        z = (x + 0x9E3779B97F4A7C15) & m
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
        z = (z ^ z >> 27) * 0x94D049BB133111EB & m
        return z ^ z >> 31

    def plain(text):
        words = []
        for w in "".join(ch.lower()[0] if ch.isalnum() else " " for ch in text).split():
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = (h ^ b) * 0x100000001B3 & m
            words.append(h)
        if len(words) < 4:
            h = 0xCBF29CE484222325
            for x in words:
                h = mix(h ^ x)
            hs = {mix(h)}
        else:
            hs = {mix(mix(mix(words[i] ^ words[i + 1]) ^ words[i + 2]) ^ words[i + 3]) for i in range(len(words) - 3)}
        bins = {}
        for h in hs:
            bins[h % 60] = min(bins.get(h % 60, m), h // 60)
        sig = []
        for i in range(60):
            steps = next(s for s in range(60) if (i + s) % 60 in bins)
            v = bins[(i + steps) % 60]
            sig.append((v if steps == 0 else mix(v ^ steps)) & 0xFF)
        return len(hs), bytes(sig)

    n, sig = E.sketches(texts)
    assert [(int(a), b.tobytes()) for a, b in zip(n, sig, strict=True)] == [plain(t) for t in texts] == [E.sketch(t) for t in texts]


def test_text_minhash_keeps_shingles_in_their_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e a b c d"), (2, "a B"), (3, ""), (4, None), (1, "z y x w v")], "k long, text string")
    got = E.text_minhash(docs, "k", F.col("text"), 3)
    want = E.minhash(E.shingle_sets(docs, "k", F.col("text")), "k", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_few_pages_are_taken_apart_at_a_time(spark, monkeypatch):
    rows = [(i, f"<title>t{i}</title><body><p>{'ab ' * (i % 40)}</p></body>" if i % 7 else None) for i in range(300)]
    monkeypatch.setattr(G, "GROUP", 500)
    got = G.extract_pages(spark.createDataFrame(rows, "id long, html string").coalesce(1)).orderBy("id").collect()
    assert [(r.title, r.text) for r in got] == [G.extract(h) for _, h in rows] and got[0].asDict().keys() == {"id", "html", "title", "text"}
    sizes = spark.createDataFrame(rows, "id long, html string").coalesce(1)
    batches = []
    plain = type(sizes).mapInArrow
    monkeypatch.setattr(type(sizes), "mapInArrow", lambda df, f, schema: (batches.append(f), plain(df, f, schema))[1])
    G.extract_pages(sizes)
    table = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "html": [h for _, h in rows]})
    out = list(batches[0]([table]))
    assert sum(b.num_rows for b in out) == 300 and max(sum(len(h or "") for h in b.column("html").to_pylist()) for b in out) <= 500
