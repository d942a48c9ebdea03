"""Text, ranking and fusion."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import stemming
from tessera.operators import fusion, lexical
from tessera.operators.stored_index import IndexRefused, StoredIndex
from tessera.plans.catalog import query, table
from tessera.plans.lineage import new_path, shared_dir

TOK = r"regexp_extract_all(lower({c}), '([\p{{L}}\p{{N}}]+)', 1)"
KEY = "('0x' || substr(md5({c}), 1, 15))::BIGINT"
HOST = "lower(regexp_extract({c}, '^[a-z]+://([^/?#:]+)', 1))"
DOMAIN = "CASE WHEN regexp_matches({h}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN NULL WHEN len(string_split({h}, '.')) <= 2 THEN {h} WHEN string_split({h}, '.')[-2] IN ('co', 'com', 'net', 'org', 'ac', 'gov', 'edu') THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"
URL = "'https://' || source || '.example/' || doc_id"

INDEX_SQL = f"""
    ix AS (SELECT doc_id AS key, {TOK.format(c="substr(text, 1, 80)")} AS tt, {TOK.format(c="text")} AS bt FROM documents),
    st AS (SELECT count(*) AS n, avg(len(tt)) AS mt, avg(len(bt)) AS mb FROM ix),
    qt AS (SELECT DISTINCT item_id AS qid, unnest({TOK.format(c="text")}) AS term FROM benchmark),
    tm AS (SELECT DISTINCT term FROM qt),
    tf AS (SELECT key, term, sum(t) AS t, sum(b) AS b, any_value(tl) AS tl, any_value(bl) AS bl FROM
           (SELECT key, len(tt) AS tl, len(bt) AS bl, unnest(tt) AS term, 1 AS t, 0 AS b FROM ix UNION ALL SELECT key, len(tt), len(bt), unnest(bt), 0, 1 FROM ix)
           SEMI JOIN tm USING (term) GROUP BY key, term),
    df AS (SELECT term, count(*) FILTER (WHERE t > 0) AS dt, count(*) FILTER (WHERE b > 0) AS db FROM tf GROUP BY term),
    ts AS (SELECT key, term,
           CASE WHEN t > 0 THEN ln(1 + (n - dt + 0.5) / (dt + 0.5)) * t * 2.2 / (t + 1.2 * (1 - 0.75 + 0.75 * tl / mt)) ELSE 0 END AS s_title,
           CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (1 - 0.75 + 0.75 * bl / mb)) ELSE 0 END AS s_body
           FROM tf JOIN df USING (term), st)"""
def bm25_sql(k: int) -> str:
    return INDEX_SQL + f""",
    sc AS (SELECT qid, key, sum(2.0 * s_title + s_body) AS bm25 FROM ts JOIN qt USING (term) GROUP BY qid, key),
    top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, key) AS rank FROM sc QUALIFY rank <= {k})"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.index_documents(table(spark, sf_dir, "documents"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every benchmark item, by all of its tokens."""
    return lexical.query_terms(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))


def _with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").withColumns({"title": S.title_of(t), "snippet": S.snippet_of(t)})


STORED = ("source", "lang", "n_chars", "title", "snippet")


def stored(spark: SparkSession, sf_dir: str, stem: bool = False) -> StoredIndex:
    """The index of ``documents`` in the shared folder, built by the first query that asks for it and opened by all others.

    It is named after the table's files, their sizes and times, so that a table that has changed gets another one.
    """
    docs = table(spark, sf_dir, "documents")
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    about = []
    for f in sorted(docs.inputFiles()):
        s = path(f).getFileSystem(conf).getFileStatus(path(f))
        about.append(f"{f} {s.getLen()} {s.getModificationTime()}")
    name = hashlib.sha256("\n".join(about).encode()).hexdigest()[:24]
    at = f"{shared_dir(spark)}/tessera-index-{name}-{'stems' if stem else 'words'}"
    index = StoredIndex.open_or_create(spark, at, stem)
    if not index.manifest["number"]:
        index.add(_with_texts(spark, sf_dir), "doc_id", store=STORED)
        try:
            index.commit()
        except IndexRefused:  # another session was quicker
            index = StoredIndex.open_or_create(spark, at, stem)
    return index


def ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return stored(spark, sf_dir).bm25(_terms(spark, sf_dir), k)


@query(f"SELECT page_id, {KEY.format(c='url')} AS url_key, {HOST.format(c='url')} AS host, {KEY.format(c=HOST.format(c='url'))} AS domain_hash, {DOMAIN.format(h=HOST.format(c='url'))} AS domain FROM pages")
def url_keys_and_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = S.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", S.key60(F.col("url")).alias("url_key"), h.alias("host"), S.key60(h).alias("domain_hash"), S.registered_domain(h).alias("domain"))


@query(f"""SELECT doc_id, {KEY.format(c=URL)} AS url_key, substr(text, 1, 80) AS title, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS snippet,
    lang, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_hash, 0.0::DOUBLE AS quality FROM documents""")
def build_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id")
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.key60(url).alias("url_key"), S.title_of(t).alias("title"), S.snippet_of(t).alias("snippet"), "lang", S.content_hash(t).alias("content_hash"), F.lit(0.0).alias("quality"))


@query(f"""SELECT doc_id AS key, term, sum(t)::BIGINT AS tf_title, sum(b)::BIGINT AS tf_body FROM
    (SELECT doc_id, unnest({TOK.format(c="substr(text, 1, 80)")}) AS term, 1 AS t, 0 AS b FROM documents UNION ALL SELECT doc_id, unnest({TOK.format(c="text")}), 0, 1 FROM documents) GROUP BY doc_id, term""")
def postings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(_index(spark, sf_dir))


@query(f"WITH {INDEX_SQL} SELECT term, n, dt AS df_title, db AS df_body, round(mt, 6) AS avg_title, round(mb, 6) AS avg_body FROM df, st")
def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix, q = _index(spark, sf_dir), _terms(spark, sf_dir)
    p = lexical.postings(ix).join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count_if(F.expr("tf_title > 0")).alias("df_title"), F.count_if(F.expr("tf_body > 0")).alias("df_body"))
    st = ix.agg(F.count("*").alias("n"), F.round(F.avg("title_len"), 6).alias("avg_title"), F.round(F.avg("body_len"), 6).alias("avg_body"))
    return p.join(F.broadcast(st)).select("term", "n", "df_title", "df_body", "avg_title", "avg_body")


@query(f"WITH {bm25_sql(100)} SELECT qid, key, round(bm25, 6) AS bm25, rank::INT AS rank FROM top")
def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, 100).select("qid", "key", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"""WITH terms AS (SELECT DISTINCT unnest({TOK.format(c="text")}) AS term FROM documents),
    {stemming.stems_sql("terms")}
    SELECT term, stem FROM stems""")
def stem_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return stemming.stems(d.select(F.explode(S.tokens(F.col("text"))).alias("term")))


#: The ranking of INDEX_SQL with stems in place of tokens.
STEM_INDEX_SQL = INDEX_SQL.replace("qt AS (SELECT DISTINCT item_id AS qid, unnest(", "qw AS (SELECT DISTINCT item_id AS qid, unnest(").replace("AS term FROM benchmark)", "AS term FROM benchmark), qt AS (SELECT DISTINCT qid, stem AS term FROM qw JOIN stems USING (term))").replace(
    "SEMI JOIN tm USING (term) GROUP BY key, term)", "x JOIN stems USING (term) SEMI JOIN tm ON tm.term = stems.stem GROUP BY key, stems.stem)").replace("tf AS (SELECT key, term, sum(t)", "tf AS (SELECT key, stems.stem AS term, sum(t)")


@query(f"""WITH words AS (SELECT DISTINCT term FROM (SELECT unnest({TOK.format(c="text")}) AS term FROM documents UNION ALL SELECT unnest({TOK.format(c="substr(text, 1, 80)")}) FROM documents UNION ALL SELECT unnest({TOK.format(c="text")}) FROM benchmark)),
    {stemming.stems_sql("words")}, {STEM_INDEX_SQL},
    sc AS (SELECT qid, key, sum(2.0 * s_title + s_body) AS bm25 FROM ts JOIN qt USING (term) GROUP BY qid, key)
    SELECT qid, key, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, key)::INT AS rank FROM sc QUALIFY rank <= 100""")
def stemmed_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(spark, sf_dir, stem=True)
    terms = index.query_terms(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return index.bm25(terms, 100).select("qid", "key", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"""WITH {INDEX_SQL.replace("FROM documents),", "FROM documents WHERE source IS DISTINCT FROM 'src0' OR source IS NULL),", 1)}
    SELECT term, n, dt AS df_title, db AS df_body, round(mt, 6) AS avg_title, round(mb, 6) AS avg_body FROM df, st""")
def index_after_forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments are committed, a host's documents are removed by key, and the segments are merged: statistics are those of what is left."""
    docs = table(spark, sf_dir, "documents")
    index = StoredIndex.open_or_create(spark, new_path(spark, "index"), stem=False)
    for part in ("lang = 'en'", "lang IS DISTINCT FROM 'en'"):
        index.add(docs.where(part), "doc_id", store=["source"])
        index.commit()
    index.remove(index.documents().where("source = 'src0'"))
    index.commit()
    index.merge()
    index.vacuum()
    n, title, body = index.totals()
    df = index.statistics(_terms(spark, sf_dir))
    return df.select("term", F.lit(n).alias("n"), "df_title", "df_body", F.round(F.lit(title), 6).alias("avg_title"), F.round(F.lit(body), 6).alias("avg_body"))


@query(f"""WITH {INDEX_SQL}, sc AS (SELECT qid, key, sum(2.0 * s_title + s_body) AS bm25 FROM ts JOIN qt USING (term) JOIN documents d ON d.doc_id = key WHERE d.lang = 'en' AND d.n_chars BETWEEN 500 AND 5000 GROUP BY qid, key)
    SELECT qid, key, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, key)::INT AS rank FROM sc QUALIFY rank <= 50""")
def filtered_bm25_global_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored(spark, sf_dir).bm25(_terms(spark, sf_dir), 50, keep=(F.col("lang") == "en") & F.col("n_chars").between(500, 5000))
    return out.select("qid", "key", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"""WITH {INDEX_SQL},
    a AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY round(sum(s_title), 9) DESC, key) AS rank FROM ts JOIN qt USING (term) WHERE s_title > 0 GROUP BY qid, key QUALIFY rank <= 200),
    b AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY round(sum(s_body), 9) DESC, key) AS rank FROM ts JOIN qt USING (term) WHERE s_body > 0 GROUP BY qid, key QUALIFY rank <= 200),
    r AS (SELECT qid, key, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY qid, key)
    SELECT qid, key, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, key)::INT AS rank FROM r QUALIFY rank <= 20""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = stored(spark, sf_dir), _terms(spark, sf_dir)
    title, body = index.bm25(q, 200, boost=1.0, body=0.0), index.bm25(q, 200, boost=0.0)
    fused = fusion.rrf({"title": title, "body": body})
    return lexical.top_k(fused, ["qid"], [F.desc(F.round("rrf", 12)), F.asc("key")], 20).select("qid", "key", F.round("rrf", 9).alias("rrf"), "rank")


#: Web lists: for each of three engines all pages whose hash falls in its share, in order of another hash.
WEB_SQL = f"""web AS (SELECT engine, url, row_number() OVER (PARTITION BY engine ORDER BY md5(engine || url), url) AS fan FROM pages, (SELECT unnest(['alpha', 'beta', 'gamma']) AS engine)
    WHERE {KEY.format(c="url || engine")} % 3 < 2)"""


def web_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url", F.explode(F.array(*map(F.lit, ("alpha", "beta", "gamma")))).alias("engine"))
    pages = pages.where(S.key60(F.concat("url", "engine")) % 3 < 2)
    return pages.withColumn("fan", F.row_number().over(Window.partitionBy("engine").orderBy(F.md5(F.concat("engine", "url").cast("binary")), "url")))


@query(f"WITH {WEB_SQL} SELECT engine, url, fan::INT AS rank, count(*) OVER (PARTITION BY engine)::BIGINT AS results, round(1.0 / (60 + fan), 9) AS part FROM web")
def engine_sublist_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = web_lists(spark, sf_dir)
    ranked_ = fusion.sublist_ranks(w, "engine", "fan")
    n = w.groupBy("engine").agg(F.count("*").alias("results"))
    return ranked_.join(n, "engine").select("engine", "url", "rank", "results", F.round(1 / (60 + F.col("rank")), 9).alias("part"))


@query(f"""WITH {WEB_SQL}, l AS (SELECT page_id, url, row_number() OVER (ORDER BY md5('local' || url), page_id) AS rank FROM pages),
    a AS (SELECT page_id, url, row_number() OVER (ORDER BY md5('ann' || url), page_id) AS rank FROM pages),
    u AS (SELECT url, 1.0 / rank AS bm25, NULL AS ann, NULL AS web, 0 AS prio FROM l WHERE rank <= 100 UNION ALL SELECT url, NULL, 1.0 / rank, NULL, 1 FROM a WHERE rank <= 60 UNION ALL SELECT url, NULL, NULL, fan, 2 FROM web WHERE fan <= 40)
    SELECT url, round(max(bm25), 9) AS bm25, round(max(ann), 9) AS ann, min(web)::INT AS searx_rank, CASE min(prio) WHEN 2 THEN CASE WHEN count(*) > 1 THEN 'both' ELSE 'web' END ELSE CASE WHEN max(prio) = 2 THEN 'both' ELSE 'local' END END AS source
    FROM u GROUP BY url""")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    local = lexical.top_k(pages.withColumn("g", F.lit(0)), ["g"], [F.md5(F.concat(F.lit("local"), "url").cast("binary")), F.col("page_id")], 100).select(F.col("url").alias("key"), (1 / F.col("rank")).alias("score"))
    ann = lexical.top_k(pages.withColumn("g", F.lit(0)), ["g"], [F.md5(F.concat(F.lit("ann"), "url").cast("binary")), F.col("page_id")], 60).select(F.col("url").alias("key"), (1 / F.col("rank")).alias("score"))
    web = web_lists(spark, sf_dir).where("fan <= 40").select(F.col("url").alias("key"), "engine", F.col("fan").alias("rank"))
    out = fusion.merge_sources(local, ann, web)
    return out.select(F.col("key").alias("url"), F.round("bm25", 9).alias("bm25"), F.round("ann", 9).alias("ann"), F.col("searx_rank").cast("int").alias("searx_rank"), "source")


#: Weights of the registered ranking by all features: the fused score leads, the others order what is near.
WEIGHTS = {"rrf": 1.0, "bm25": 0.0005, "title": 0.004, "source": 0.003, "snippet": 0.001, "freshness": 0.001, "domain": 0.002, "geo": 0.001}
_TERMS = "list_distinct(list_filter(regexp_split_to_array(trim(q, ' \n\t'), '\\s+'), lambda x: octet_length(encode(x)) >= 2))"


@query(f"""WITH {bm25_sql(100)}, pr AS (SELECT source, count(*) / max(count(*)) OVER () AS prior FROM documents WHERE source <> (SELECT min(source) FROM documents) GROUP BY source),
    f AS (SELECT top.*, d.source, d.text, b.text AS q FROM top JOIN documents d ON d.doc_id = key JOIN benchmark b ON b.item_id = qid),
    s AS (SELECT qid, key, f.source AS host, 1.0 / (60 + rank) AS rrf, bm25, coalesce(len(list_filter({_TERMS}, lambda x: contains(lower(substr(text, 1, 80)), lower(x)))) / nullif(len({_TERMS}), 0), 0) AS title,
      least(octet_length(encode(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240))) / 240.0, 1.0) AS snippet, coalesce(prior, 0) AS domain FROM f LEFT JOIN pr ON pr.source = f.source)
    SELECT qid, key, host, round(title, 9) AS title, round(domain, 9) AS domain, round(rrf + 0.0005 * bm25 + 0.004 * title + 0.003 / 3 + 0.001 * snippet + 0.0005 + 0.002 * domain, 9) AS score FROM s""")
def ltr_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the first hundred results; hosts' priors by their documents, one host without a prior."""
    docs = stored(spark, sf_dir).documents().select("key", F.col("source").alias("host"), "title", "snippet")
    d = table(spark, sf_dir, "documents")
    n = d.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"))
    some = n.join(F.broadcast(n.agg(F.min("host").alias("none"))), F.col("host") != F.col("none"))
    priors = some.join(F.broadcast(some.agg(F.max("n").alias("most")))).select("host", (F.col("n") / F.col("most")).alias("prior"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    r = ranked(spark, sf_dir, 100).select("qid", "key", "bm25", (1 / (60 + F.col("rank"))).alias("rrf"))
    x = r.join(docs, "key").join(b, "qid").join(priors, "host", "left")
    f = fusion.ltr_features(x, F.col("q"))
    # under other names first: a lambda would take the title for a column of that name in the same select
    y = x.withColumns({"_title": F.round(f["title"], 9), "_domain": F.round(f["domain"], 9), "score": F.round(fusion.linear_ltr(f, WEIGHTS), 9)})
    return y.select("qid", "key", "host", F.col("_title").alias("title"), F.col("_domain").alias("domain"), "score")


@query(f"""WITH {bm25_sql(100)}, f AS (SELECT top.*, d.source, d.text, b.text AS q FROM top JOIN documents d ON d.doc_id = key JOIN benchmark b ON b.item_id = qid),
    s AS (SELECT qid, key, source, 1.0 / (60 + rank) AS rrf, least(octet_length(encode(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240))) / 240.0, 1.0) AS norm FROM f),
    c AS (SELECT *, 1.0 * rrf + 0.001 * norm AS ltr FROM s),
    d AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY round(ltr, 12) DESC, key) AS within FROM c)
    SELECT qid, key, source AS host, round(ltr, 9) AS ltr, row_number() OVER (PARTITION BY qid ORDER BY round(ltr, 12) DESC, key)::INT AS rank FROM d WHERE within <= 3 QUALIFY rank <= 10""")
def ltr_and_domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(spark, sf_dir).documents().select("key", F.col("source").alias("host"), "snippet")
    f = ranked(spark, sf_dir, 100).select("qid", "key", (1 / (60 + F.col("rank"))).alias("rrf")).join(docs, "key")
    scored = f.withColumn("ltr", fusion.linear_ltr({"rrf": F.col("rrf"), "snippet": S.snippet_norm(F.col("snippet"))}, {"rrf": 1.0, "snippet": 0.001}))
    return fusion.domain_cap(scored, ["qid"], "host", [F.desc(F.round("ltr", 12)), F.asc("key")], 3, 10).select("qid", "key", "host", F.round("ltr", 9).alias("ltr"), "rank")


@query(f"""SELECT item_id, CASE WHEN len(w) = 0 THEN 'keyword' WHEN regexp_matches(l, 'login|sign in|homepage|website|www\\.|\\.com|\\.org') THEN 'navigational'
      WHEN l LIKE '%?' OR w[1] IN ('how', 'what', 'why', 'when', 'where', 'who', 'which', 'is', 'are', 'can', 'does') THEN 'question'
      WHEN list_has_any(w, ['near', 'nearby', 'in', 'around', 'city', 'town', 'country', 'map', 'directions', 'weather', 'restaurant', 'hotel', 'airport']) THEN 'geo' ELSE 'keyword' END AS intent,
    CASE WHEN length(text) <= 20 THEN 0 WHEN length(text) <= 40 THEN 1 WHEN length(text) <= 80 THEN 2 ELSE 3 END AS len_bucket
    FROM (SELECT item_id, text, lower(text) AS l, list_filter(regexp_split_to_array(trim(lower(text), ' \n\t'), '\\s+'), lambda x: x <> '') AS w FROM
      (SELECT item_id, text FROM benchmark UNION ALL SELECT 100000 + conv_id * 100 + turn, text FROM conversations WHERE role = 'user'))""")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", "text").union(table(spark, sf_dir, "conversations").where("role = 'user'").select(100000 + F.col("conv_id") * 100 + F.col("turn"), "text"))
    return q.select("item_id", S.intent(F.col("text")).alias("intent"), S.length_bucket(F.col("text")).alias("len_bucket"))


@query(f"""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(trim(text, ' \n\t'), '\\s+'), lambda x: octet_length(encode(x)) >= 2))[1:12] AS ts, text FROM benchmark)
    SELECT item_id, doc_id, round(len(list_filter(list_distinct(list_filter(regexp_split_to_array(trim(q.text, ' \n\t'), '\\s+'), lambda x: octet_length(encode(x)) >= 2)), lambda x: contains(lower(substr(d.text, 1, 80)), lower(x))))
      / len(list_distinct(list_filter(regexp_split_to_array(trim(q.text, ' \n\t'), '\\s+'), lambda x: octet_length(encode(x)) >= 2))), 9) AS ratio
    FROM documents d JOIN q ON q.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    d = table(spark, sf_dir, "documents").join(F.broadcast(b.agg(F.count("*").alias("n")))).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), S.title_of(F.col("text")).alias("title"))
    return d.join(b, "item_id").select("item_id", "doc_id", F.round(S.title_match_ratio(F.col("q"), F.col("title")), 9).alias("ratio"))


@query("""SELECT doc_id, len(p)::INT AS n_sentences, sum_len::INT AS sentence_chars FROM (SELECT doc_id, p, list_sum(list_transform(p, lambda x: length(x))) AS sum_len FROM
    (SELECT doc_id, list_filter(regexp_extract_all(text, '([^.!?\n]*[.!?\n]|[^.!?\n]+$)', 1), lambda x: trim(x) <> '') AS p FROM documents))""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", S.sentences(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").alias("n_sentences"), F.aggregate(F.transform("p", lambda s: F.length(s)), F.lit(0), lambda a, x: a + x).alias("sentence_chars"))
