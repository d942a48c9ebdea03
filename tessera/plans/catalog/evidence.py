"""Sketches, clusters, confidence, ingest and forgetting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import evidence as E
from tessera.operators import ingest as I
from tessera.plans.catalog import lexical as L
from tessera.plans.catalog import query, table
from tessera.plans.lineage import cut

HASH = "md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"
SHINGLES = f"""tk AS (SELECT doc_id, {L.TOK.format(c='text')} AS t FROM documents), sh AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(t) < 4 THEN t ELSE t[i:i + 3] END, ' ') AS sh
    FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS i FROM tk WHERE len(t) > 0))"""


def result_lists(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The best documents of every benchmark query, with sketch, host and snippet."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("host"), S.snippet_of(F.col("text")).alias("snippet"), "text")
    r = cut(L.ranked(spark, sf_dir, k), "ranked")
    # a document is sketched once, however many lists it is in
    hit = docs.join(r.select("key").distinct(), "key", "left_semi").withColumn("sk", E.sketch_udf("text"))
    hit = hit.select("key", "host", "snippet", F.col("sk.shingles").alias("shingles"), F.col("sk.sig").alias("sig"))
    return r.join(hit, "key").select("qid", "key", (F.col("rank") - 1).alias("pos"), "bm25", "host", "snippet", "shingles", "sig")


@query()
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", E.sketch_udf("text").alias("s"))
    return d.select("doc_id", "s.shingles", F.md5(F.array_join("s.sig", ",").cast("binary")).alias("sig_md5"))


@query(f"WITH {SHINGLES} SELECT doc_id, count(*) AS shingles FROM sh GROUP BY doc_id")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).groupBy("doc_id").agg(F.count("*").alias("shingles"))


@query(f"WITH {SHINGLES} SELECT doc_id, min({L.KEY.format(c=chr(39) + '0:' + chr(39) + ' || sh')}) AS h0, min({L.KEY.format(c=chr(39) + '1:' + chr(39) + ' || sh')}) AS h1 FROM sh GROUP BY doc_id")
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.text_minhash(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 2)


@query(f"""WITH {L.bm25_sql(10)}, {SHINGLES}, p AS (SELECT DISTINCT least(a.key, b.key) AS a, greatest(a.key, b.key) AS b FROM top a JOIN top b USING (qid) WHERE a.rank < b.rank),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), c AS (SELECT a, b, count(*) AS c FROM p JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.sh = x.sh GROUP BY a, b)
    SELECT p.a, p.b, round(coalesce(c, 0) / least(x.n, y.n), 9) AS containment FROM p LEFT JOIN c USING (a, b) JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b""")
def exact_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = L.ranked(spark, sf_dir, 10).select("qid", "key", "rank")
    p = top.alias("x").join(top.alias("y"), "qid").where("x.rank < y.rank").select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    p = cut(p, "pairs")
    asked = p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # only texts that are in a pair are taken apart
    sh = cut(E.shingle_sets(table(spark, sf_dir, "documents").join(asked, "doc_id", "left_semi"), "doc_id", F.col("text")), "shingles")
    return E.exact_containment(p, sh, "a", "b", "doc_id").select("a", "b", F.round("containment", 9).alias("containment"))


@query(f"""WITH t AS (SELECT doc_id, unnest({L.TOK.format(c='text')}) AS t FROM documents), h AS (SELECT doc_id, {L.KEY.format(c='t')} AS h FROM t),
    b AS (SELECT doc_id, i, sum(((h >> i) & 1) * 2 - 1) AS s FROM h, (SELECT unnest(range(0, 60)) AS i) GROUP BY doc_id, i)
    SELECT doc_id, sum(CASE WHEN s > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS simhash FROM b GROUP BY doc_id""")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.simhash(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query()
def sketch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = result_lists(spark, sf_dir, 10)
    x, y = r.select("qid", *(F.col(c).alias(f"{c}_a") for c in ("key", "pos", "shingles", "sig"))), r.select("qid", *(F.col(c).alias(f"{c}_b") for c in ("key", "pos", "shingles", "sig")))
    j = E.jaccard_estimate(F.col("sig_a"), F.col("sig_b"))
    return x.join(y, "qid").where("pos_a < pos_b").select("qid", "key_a", "key_b", F.round(j, 6).alias("jaccard"), F.round(E.containment(F.col("shingles_a"), F.col("shingles_b"), j), 6).alias("containment"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = result_lists(spark, sf_dir)
    return r.join(E.cluster_results(r, ["qid"]), ["qid", "pos"])


@query()
def evidence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir).select("qid", "key", "pos", "cluster", "canonical")


@query()
def evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    per, total = E.evidence_block(clustered(spark, sf_dir), ["qid"])
    return per.join(total, "qid")


@query()
def diversified_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.diversify(clustered(spark, sf_dir), ["qid"]).select("qid", "key", "pos", "cluster", "slot")


@query()
def corroboration_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corroboration_candidates(clustered(spark, sf_dir), ["qid"], F.lit(0)).select("qid", "key", "cluster")


@query(f"""WITH {L.bm25_sql(50)}, r AS (SELECT top.*, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS snippet FROM top JOIN documents ON doc_id = key),
    g AS (SELECT qid, stddev_pop(bm25) FILTER (WHERE rank <= 10) / greatest(abs(avg(bm25)), 1e-6) AS nqc FROM r GROUP BY qid),
    t AS (SELECT qid, rank <= 10 AS top, unnest(regexp_split_to_array(snippet, '[^\\p{{L}}\\p{{N}}]+')) AS t FROM r),
    c AS (SELECT qid, lower(t) AS t, count(*) FILTER (WHERE top) AS a, count(*) AS n FROM t WHERE octet_length(encode(t)) > 2 GROUP BY qid, lower(t)),
    s AS (SELECT qid, sum(a) AS sa, sum(n) AS sn, count(*) AS v FROM c GROUP BY qid),
    k AS (SELECT qid, greatest(sum(a / sa * ln((a / sa) / ((n + 1) / (sn + v)))), 0) AS clarity FROM c JOIN s USING (qid) WHERE a > 0 GROUP BY qid)
    SELECT qid, round(nqc, 6) AS nqc, round(clarity, 6) AS clarity, round(least(greatest(0.5 * (1 - exp(-2 * nqc)) + 0.5 * (1 - exp(-0.7 * clarity)), 0), 1), 6) AS confidence FROM g JOIN k USING (qid)""")
def query_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), S.snippet_of(F.col("text")).alias("snippet"))
    r = L.ranked(spark, sf_dir, 50).join(docs, "key")
    return E.query_confidence(r, ["qid"], "bm25", "rank", "snippet").select("qid", *(F.round(c, 6).alias(c) for c in ("nqc", "clarity", "confidence")))


_INGEST = f"""b AS (SELECT *, {HASH} AS hash FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''), gone AS (SELECT hash FROM b WHERE doc_id % 17 = 0), seen AS (SELECT hash FROM b WHERE doc_id % 5 = 0),
    st AS (SELECT doc_id, hash, CASE WHEN hash IN (SELECT hash FROM gone) THEN 'refused' WHEN hash IN (SELECT hash FROM seen) OR row_number() OVER (PARTITION BY hash ORDER BY doc_id) > 1 THEN 'deduped' ELSE 'accepted' END AS status FROM b)"""


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = docs.select("doc_id", S.content_hash(F.col("text")).alias("hash"))
    return I.ingest(docs, h.where("doc_id % 5 = 0"), h.where("doc_id % 17 = 0"), order=F.col("doc_id"))


@query(f"WITH {_INGEST} SELECT doc_id, hash, status FROM st")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir).select("doc_id", "hash", "status")


@query(f"WITH {_INGEST} SELECT count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'deduped') AS deduped, count(*) FILTER (WHERE status = 'refused') AS refused FROM st")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ingest_stats(ingested(spark, sf_dir))


@query(f"SELECT (SELECT count(*) FROM documents WHERE source <> 'src3') AS kept, (SELECT count(DISTINCT {HASH}) FROM documents WHERE source = 'src3') AS tombstones")
def forget_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("hash", S.content_hash(F.col("text")))
    left, gone = I.forget(docs, docs.limit(0).select("hash"), F.col("source") == "src3")
    left, gone = I.forget(left, gone, F.col("source") == "src3")  # forgetting again changes nothing
    return left.agg(F.count("*").alias("kept")).join(gone.agg(F.count("*").alias("tombstones")))


@query(f"WITH g AS (SELECT DISTINCT {HASH} AS hash FROM documents WHERE doc_id % 10 = 3) SELECT doc_id FROM documents WHERE {HASH} NOT IN (SELECT hash FROM g)")
def forget_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("hash", S.content_hash(F.col("text")))
    left, _ = I.forget_hash(docs, docs.limit(0).select("hash"), docs.where("doc_id % 10 = 3").select("hash"))
    return left.select("doc_id")
