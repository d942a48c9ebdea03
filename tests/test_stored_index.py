"""The stored index and its stems."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tessera.functions import stemming as T
from tessera.operators import lexical
from tessera.operators import stored_index as X
from tessera.plans.lineage import new_path
from tests.compare import SF, connect, plain

#: Words and stems of the published sample vocabulary.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori console consol
consolidating consolid consolingly consol consonant conson consorted consort conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc
knack knack knackeries knackeri knavish knavish kneaded knead knees knee kneeling kneel knightly knight knitted knit knitting knit knives knive knockers knocker skies sky dying die early earli
news news inning inning proceed proceed succeeding succeed generate generat communism communism agreed agre ties tie cries cri by by say say gas gas this this gaps gap kiwis kiwi hopefulness hope
relational relat rational ration apology apolog hopping hop hoping hope luxuriated luxuri controlling control fall fall electricity electr adjustment adjust adoption adopt yellow yellow""".split()


def porter2(w):
    """The same rules as a procedure over characters."""
    vowels = "aeiouy"
    if w in T.OWN:
        return T.OWN[w]
    if len(w) <= 2:
        return w
    c = list(w)
    for i, ch in enumerate(c):
        if ch == "y" and (i == 0 or c[i - 1] in vowels):
            c[i] = "Y"
    w = "".join(c)

    def region(start):
        for i in range(start + 1, len(w)):
            if w[i - 1] in vowels and w[i] not in vowels:
                return i + 1
        return len(w)

    r1 = next((len(b) for b in T.BEGINNINGS if w.startswith(b)), None) or region(0)
    r2 = region(r1)

    def short(x):
        if len(x) == 2:
            return x[0] in vowels and x[1] not in vowels
        return len(x) > 2 and x[-3] not in vowels and x[-2] in vowels and x[-1] not in vowels and x[-1] not in "wxY"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(x in vowels for x in w[:-2]):
        w = w[:-1]
    if w in T.KEPT:
        return w
    for e in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(e):
            if e.startswith("eed"):
                w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
            elif any(x in vowels for x in w[: -len(e)]):
                w = w[: -len(e)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-2:] in T.DOUBLES:
                    w = w[:-1]
                elif short(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    for table, start, cond in ((T.SECOND, r1, {"ogi": lambda x: x[-1:] == "l", "li": lambda x: x[-1:] in tuple("cdeghkmnrt")}), (T.THIRD, r1, {"ative": lambda x: len(x) >= r2}), (dict.fromkeys(T.FOURTH, ""), r2, {"ion": lambda x: x[-1:] in ("s", "t")})):
        for e in sorted(table, key=len, reverse=True):
            if w.endswith(e):
                x = w[: -len(e)]
                if len(x) >= start and cond.get(e, lambda _: True)(x):
                    w = x + table[e]
                break
    if w.endswith("e"):
        x = w[:-1]
        w = x if len(x) >= r2 or (len(x) >= r1 and not short(x)) else w
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def test_published_stems(spark):
    want = dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    got = {r.term: r.stem for r in T.stems(spark.createDataFrame([(w,) for w in [*want, *want]] + [(None,)], "term string")).collect()}
    assert got == want and {w: porter2(w) for w in want} == want


def test_stems_of_made_up_words(spark):
    rnd = random.Random(7)
    ends = [*T.SECOND, *T.THIRD, *T.FOURTH, "s", "ies", "ied", "sses", "us", "ed", "ing", "edly", "ingly", "eed", "eedly", "y", "e", "ll", "ss", ""]
    words = {"".join(rnd.choice("aeiouybcdlmnprstvwxgß5") for _ in range(rnd.randint(0, 6))) + rnd.choice(ends) + rnd.choice(["", "", rnd.choice(ends)]) for _ in range(6000)} - {""}
    words |= {b + e for b in T.BEGINNINGS for e in ends} | set(T.OWN) | set(T.KEPT)
    got = {r.term: r.stem for r in T.stems(spark.createDataFrame([(w,) for w in words], "term string")).where("stem is not null").collect()}
    assert got == {w: porter2(w) for w in words}


DOCS = [(1, "h1", "Rust engines", "systems programming is running fast"), (2, "h2", "Cooking", "a run of rusted pans, and recipes"), (3, "h1", "Gardens", "growing plants in gardens; gardening runs deep"), (4, "h3", None, None), (5, "h3", "Engine", "the the the engine")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "key long, host string, title string, text string")


def build(spark, rows=DOCS, stem=True, path=None, **how):
    index = X.StoredIndex.open_or_create(spark, path or new_path(spark, "test-index"), stem)
    index.add(docs(spark, rows), title=F.col("title"), body=F.col("text"), store=["host", "title"], **how)
    index.commit()
    return index


def ask(spark, index, *queries, **how):
    q = spark.createDataFrame(list(enumerate(queries)), "qid int, q string")
    got = index.bm25(index.query_terms(q, "qid", F.col("q")), 10, **how).orderBy("qid", "rank").collect()
    return [[r.key for r in got if r.qid == i] for i in range(len(queries))]


def test_round_trip_with_title_boost_and_stems(spark):
    index = build(spark)
    engines, runs, none, garden = ask(spark, index, "engine", "RUNNING", "absent", "gardened")
    assert set(engines) == {1, 5} and set(runs) == {1, 2, 3} and none == [] and garden == [3]
    assert ask(spark, index, "rust")[0] == [1, 2]  # the title counts twice
    plain = build(spark, stem=False)
    assert ask(spark, plain, "runs", "running") == [[3], [1]]


@pytest.mark.parametrize("stem", [False, True])
def test_scores_equal_a_scan(spark, stem):
    rnd = random.Random(2)
    words = ["run", "running", "runs", "cat", "cats", "dog", "garden", "gardens", "über", "x1"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, n)))
    rows = [(i, f"h{i % 3}", text(4), text(30)) for i in range(120)]
    index = build(spark, rows, stem, shard_docs=7)
    q = spark.createDataFrame([(i, text(5)) for i in range(20)], "qid int, q string")
    scan = lexical.index_documents(docs(spark, rows), "key", F.col("title"), F.col("text"))
    terms = lexical.query_terms(q, "qid", F.col("q"))
    if stem:
        stems = {w: porter2(w) for w in words}
        mapped = F.create_map(*[F.lit(x) for p in stems.items() for x in p])
        scan = scan.withColumns({c: F.transform(c, lambda t: mapped[t]) for c in ("title_tokens", "body_tokens")})
        terms = terms.select("qid", mapped[F.col("term")].alias("term")).distinct()
    rounded = lambda df: sorted((r.qid, r.key, round(r.bm25, 9), r.rank) for r in df.collect())
    assert rounded(index.bm25(index.query_terms(q, "qid", F.col("q")), 9)) == rounded(lexical.bm25(scan, terms, 9))


def test_filter_keeps_statistics(spark):
    index = build(spark)
    terms = index.query_terms(spark.createDataFrame([(0, "run engine")], "qid int, q string"), "qid", F.col("q"))
    every = {r.key: r.bm25 for r in index.bm25(terms).collect()}
    some = {r.key: r.bm25 for r in index.bm25(terms, keep=F.col("host") == "h1").collect()}
    assert some == {k: v for k, v in every.items() if k in (1, 3)}


def test_commit_makes_visible_and_reopen_preserves(spark):
    path = new_path(spark, "test-index")
    index = build(spark, DOCS[:2], path=path)
    index.add(docs(spark, DOCS[2:]), title=F.col("title"), body=F.col("text"), store=["host", "title"])
    assert index.count() == 2 and X.StoredIndex.open_or_create(spark, path).count() == 2
    index.commit()
    again = X.StoredIndex.open_or_create(spark, path)
    assert again.count() == 5 and ask(spark, again, "engine") == ask(spark, index, "engine")
    assert {(r.key, r.host) for r in again.lookup(spark.createDataFrame([(3,), (3,), (99,)], "key long")).collect()} == {(3, "h1")}


def test_schema_and_tokenizer_are_checked(spark, monkeypatch):
    path = new_path(spark, "test-index")
    build(spark, path=path)
    with pytest.raises(X.IndexRefused):
        X.StoredIndex.open_or_create(spark, path, stem=False)
    monkeypatch.setattr(X, "SCHEMA_VERSION", 2)
    with pytest.raises(X.IndexRefused):
        X.StoredIndex.open_or_create(spark, path)


def test_two_writers_do_not_overwrite(spark):
    path = new_path(spark, "test-index")
    build(spark, DOCS[:1], path=path)
    a, b = (X.StoredIndex.open_or_create(spark, path) for _ in "ab")
    for w in (a, b):
        w.remove(spark.createDataFrame([(1,)], "key long"))
    a.commit()
    with pytest.raises(X.IndexRefused):
        b.commit()


def test_remove_merge_and_vacuum(spark):
    path = new_path(spark, "test-index")
    index = build(spark, DOCS[:3], path=path, shard_docs=2)
    index.add(docs(spark, DOCS[3:] + [(6, None, "Engine of six", "runs")]), title=F.col("title"), body=F.col("text"), store=["host", "title"])
    index.remove(spark.createDataFrame([(1,), (77,), (None,)], "key long"))
    index.commit()
    assert index.count() == 5 and set(ask(spark, index, "engine")[0]) == {5, 6}
    before = index.totals()
    index.merge()
    assert before[0] == 6 and index.totals()[0] == 5 and len(index.manifest["segments"]) == 1 and not index.manifest["tombstones"]
    assert set(ask(spark, index, "engine", "run")[0]) == {5, 6}
    index.vacuum()
    again = X.StoredIndex.open_or_create(spark, path)
    assert again.count() == 5 and set(ask(spark, again, "running")[0]) == {2, 3, 6}
    again.remove(again.documents().select("key"))
    again.commit()
    again.merge()
    assert again.count() == 0 and ask(spark, again, "run") == [[]]


def test_merge_where_all_segments_are_large(spark):
    index = build(spark, DOCS[:3])
    index.add(docs(spark, DOCS[3:]), title=F.col("title"), body=F.col("text"), store=["host", "title"])
    index.remove(spark.createDataFrame([(1,)], "key long"))
    index.commit()
    index.remove(spark.createDataFrame([(5,)], "key long"))
    index.commit()
    index.merge(most=1)
    assert index.totals()[0] == index.count() == 3 and not index.manifest["tombstones"]
    assert [set(keys) for keys in ask(spark, index, "engine", "run")] == [set(), {2, 3}]
    empty = X.StoredIndex.open_or_create(spark, new_path(spark, "test-index"))
    empty.remove(spark.createDataFrame([(1,)], "key long"))
    empty.commit()
    empty.merge()
    assert empty.count() == 0


def test_empty_index(spark):
    index = X.StoredIndex.open_or_create(spark, new_path(spark, "test-index"))
    index.add(docs(spark, []), title=F.col("title"), body=F.col("text"))
    index.commit()
    assert index.count() == 0 and ask(spark, index, "run") == [[]]


def test_texts_are_not_shuffled_and_shards_are_bounded(spark, monkeypatch):
    rows = [(i, f"h{i % 3}", f"t{i % 5}", "word " * (i % 9) + f"own{i}") for i in range(100)]
    monkeypatch.setattr(X, "SHARD_TOKENS", 40)
    plans, cut_at = [], X.cut_at
    monkeypatch.setattr(X, "cut_at", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), cut_at(df, tag))[1])
    index = build(spark, rows, stem=False, shard_docs=10)
    assert "Exchange" not in dict(plans)["staged"]
    made = spark.read.parquet(f"{index.path}/{index.manifest['segments'][0]['path']}/docs")
    per = made.groupBy("_shard").agg(F.count("*").alias("n"), F.count_distinct("_slot").alias("slots"), F.sum(F.col("_title_len") + F.col("_body_len")).alias("tokens")).collect()
    assert sorted(r._shard for r in per) == list(range(index.manifest["segments"][0]["shards"]))
    assert all(r.n == r.slots <= 10 and r.tokens <= 40 for r in per) and sum(r.n for r in per) == 100
    assert ask(spark, index, "own37", "own99") == [[37], [99]]
    index.remove(index.documents().where("key % 2 = 1"))
    index.commit()
    index.merge()
    assert ask(spark, index, "own37", "own98") == [[], [98]] and index.count() == 50
    slots = spark.read.parquet(f"{index.path}/{index.manifest['segments'][0]['path']}/postings").select(F.sum(F.size("slots"))).first()[0]
    assert slots == sum(1 + (i % 9 > 0) + 1 for i in range(0, 100, 2))


@pytest.mark.parametrize("large", ["none", "english", "all"])
def test_statistics_after_forgetting_do_not_depend_on_sizes(spark, monkeypatch, large):
    name = "index_after_forgetting"
    con = connect()
    en, other = con.sql("SELECT count(*) FILTER (lang = 'en'), count(*) FILTER (lang IS DISTINCT FROM 'en') FROM documents").fetchall()[0]
    assert 1 < other < en
    most = {"none": en + 1, "english": en, "all": 1}[large]
    monkeypatch.setattr(X.StoredIndex.merge, "__defaults__", (most,))
    assert plain(queries()[name](spark, SF).toPandas()) == plain(con.sql(oracle_sql()[name]).df())
