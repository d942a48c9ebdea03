"""Decision logs, policies, evaluation, value of information and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import answer as W
from tessera.operators import evaluation as M
from tessera.operators import routing as R
from tessera.operators.resampling import PER_DIGEST, bootstrap_mean, poisson_limits
from tessera.plans.catalog import lexical as L
from tessera.plans.catalog import query, table
from tessera.plans.lineage import cut

#: A decision log from events: intent by type, arm by id, reward for large values, context in buckets.
LOG = """log AS (SELECT event_id, (ts::DATE - DATE '1970-01-01')::INT AS day, (user_id % 4 | ((user_id // 4 % 2) << 2))::INT AS context, (event_id % 10 < 8)::INT * 2 * (event_id % 3 <> 1)::INT + (event_id % 3 = 1)::INT AS arm, (value > 50)::INT::DOUBLE AS reward FROM events),
    lg AS (SELECT *, CASE WHEN arm = 2 THEN 0.6 WHEN arm = 1 THEN 0.3 ELSE 0.1 END AS propensity FROM log)"""
POLICY = "(context % 3)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    x = table(spark, sf_dir, "events").select("event_id", F.unix_date(F.to_date("ts")).alias("day"), (u % 4).bitwiseOR(F.shiftleft((F.floor(u / 4) % 2).cast("long"), 2)).cast("int").alias("context"), F.expr("cast(event_id % 10 < 8 as int) * 2 * cast(event_id % 3 <> 1 as int) + cast(event_id % 3 = 1 as int)").alias("arm"), F.expr("cast(cast(value > 50 as int) as double)").alias("reward"))
    return x.withColumn("propensity", F.when(F.col("arm") == 2, 0.6).when(F.col("arm") == 1, 0.3).otherwise(0.1))


@query(f"WITH {LOG} SELECT context % 4 AS intent, arm, count(*) AS pulls, sum(reward)::BIGINT AS reward_sum, round(avg(reward), 9) AS mean FROM lg GROUP BY ALL")
def bandit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.arm_stats(log(spark, sf_dir).withColumn("intent", F.col("context") % 4), ["intent"], "arm", "reward")
    return s.select("intent", "arm", "pulls", "reward_sum", F.round("mean", 9).alias("mean"))


@query(f"""WITH {LOG}, s AS (SELECT context % 4 AS intent, arm, avg(reward) AS mean FROM lg WHERE arm < 2 GROUP BY ALL), g AS (SELECT i.intent, a.arm, coalesce(mean, 0.5) AS mean FROM (SELECT DISTINCT context % 4 AS intent FROM lg) i, (SELECT unnest([0, 1, 2]) AS arm) a LEFT JOIN s ON s.intent = i.intent AND s.arm = a.arm),
    b AS (SELECT intent, arm AS greedy FROM g QUALIFY row_number() OVER (PARTITION BY intent ORDER BY mean DESC, arm DESC) = 1),
    c AS (SELECT event_id, greedy, CASE WHEN (event_id * 7919 % 1000003) / 1000003.0 < 0.1 THEN (event_id * 7919 % 3)::INT ELSE greedy END AS arm FROM lg JOIN b ON b.intent = context % 4)
    SELECT event_id, arm, round(CASE WHEN arm = greedy THEN 0.9 + 0.1 / 3 ELSE 0.1 / 3 END, 9) AS propensity FROM c""")
def bandit_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = log(spark, sf_dir).withColumn("intent", F.col("context") % 4)
    g = R.greedy_arms(R.arm_stats(x.where("arm < 2"), ["intent"], "arm", "reward"), x)
    out = R.choose(x.drop("arm", "propensity").join(g, "intent"), F.col("event_id") * 7919, F.col("greedy"))
    return out.select("event_id", "arm", F.round("propensity", 9).alias("propensity"))


@query(f"WITH {LOG} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY day, context ORDER BY event_id) >= 5 THEN context END AS shown FROM lg")
def anonymised_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.anonymise(log(spark, sf_dir), "day", "context", "event_id").select("event_id", "shown")


@query(f"WITH {LOG}, d AS (SELECT day, count(*) * 60 AS b FROM lg GROUP BY day), c AS (SELECT day, sum(b) OVER (ORDER BY day DESC) AS c FROM d) SELECT day, count(*) AS n, count(*) * 60 AS bytes FROM lg WHERE day IN (SELECT day FROM c WHERE c <= 300000 OR day >= 19752) GROUP BY day")
def log_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sweep(log(spark, sf_dir), 19752, most_bytes=300_000).groupBy("day").agg(F.count("*").alias("n"), (F.count("*") * 60).alias("bytes"))


@query(f"WITH {LOG} SELECT context, arm, round((sum(reward) + 0.5) / (count(*) + 1), 9) AS q FROM lg GROUP BY ALL")
def reward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reward_model(log(spark, sf_dir)).select("context", "arm", F.round("q", 9).alias("q"))


@query(f"""WITH {LOG}, m AS (SELECT context, arm, (sum(reward) + 0.5) / (count(*) + 1) AS q FROM lg GROUP BY ALL)
    SELECT round(avg(CASE WHEN lg.arm = {POLICY.replace('context', 'lg.context')} THEN 1 / propensity * reward ELSE 0 END), 6) AS ips, round(avg(CASE WHEN lg.arm = lg.context % 3 THEN least(1 / propensity, 5) * reward ELSE 0 END), 6) AS ips_clipped,
      round(avg(coalesce(q, 0.5) + CASE WHEN lg.arm = lg.context % 3 THEN (reward - coalesce(q, 0.5)) / propensity ELSE 0 END), 6) AS dr FROM lg LEFT JOIN m ON m.context = lg.context AND m.arm = lg.context % 3""")
def off_policy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, pi = log(spark, sf_dir), F.col("context") % 3
    a = R.ips(x, pi).join(R.ips(x, pi, 5.0).withColumnRenamed("ips", "ips_clipped")).join(R.doubly_robust(x, pi))
    return a.select(*(F.round(c, 6).alias(c) for c in ("ips", "ips_clipped", "dr")))


def _draws_sql(rows: str, key: str, draws: int = 200, seed: int = 7) -> str:
    """Rows with draws and Poisson weights, from the same digests of row and draw."""
    weight = " + ".join(f"(bits >= '{t}')::INT" for t in poisson_limits())
    blocks = -(-draws // PER_DIGEST)
    return f"""bl AS (SELECT unnest(range(0, {blocks})) AS block), pt AS (SELECT unnest(range(0, {PER_DIGEST})) AS part),
    dg AS (SELECT r.*, block, md5('{seed}:' || {key} || ':' || block) AS h FROM {rows} r, bl),
    wt AS (SELECT dg.* EXCLUDE (block, h), block * {PER_DIGEST} + part + 1 AS draw, substr(h, (8 * part + 1)::BIGINT, 8) AS bits FROM dg, pt),
    dr AS (SELECT * EXCLUDE (bits), {weight} AS weight FROM wt WHERE draw <= {draws} UNION ALL SELECT *, 0 AS draw, 1 AS weight FROM {rows})"""


_ENDS = "max(u) FILTER (WHERE k = round((c - 1) * 0.025)) AS lo, max(u) FILTER (WHERE k = round((c - 1) * 0.975)) AS hi"


@query(f"""WITH {LOG}, {_draws_sql('lg', 'event_id')}, m AS (SELECT draw, context, arm, (sum(weight * reward) + 0.5) / (sum(weight) + 1) AS q FROM dr GROUP BY ALL),
    t AS (SELECT dr.*, coalesce(q, 0.5) AS q FROM dr LEFT JOIN m ON m.draw = dr.draw AND m.context = dr.context AND m.arm = dr.context % 3),
    e AS (SELECT draw, sum(weight)::BIGINT AS n, sum(weight * reward) / sum(weight) AS inc, sum(weight * (q + CASE WHEN arm = context % 3 THEN (reward - q) / propensity ELSE 0 END)) / sum(weight) AS d FROM t GROUP BY draw),
    o AS (SELECT d - inc AS u, row_number() OVER (ORDER BY d - inc) - 1 AS k, count(*) OVER () AS c FROM e WHERE draw > 0), i AS (SELECT {_ENDS} FROM o)
    SELECT n, round(inc, 6) AS incumbent, round(d, 6) AS dr, round(d - inc, 6) AS uplift, round(lo, 6) AS lo, round(hi, 6) AS hi,
      CASE WHEN n < 10000 THEN 'insufficient' WHEN lo > 0 THEN 'pass' WHEN hi < 0 THEN 'negative' ELSE 'inconclusive' END AS verdict FROM e, i WHERE draw = 0""")
def off_policy_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = R.uplift(log(spark, sf_dir), F.col("context") % 3, key=F.col("event_id"))
    return u.select("n", *(F.round(c, 6).alias(c) for c in ("incumbent", "dr", "uplift", "lo", "hi")), "verdict")


@query(f"""WITH ev AS (SELECT event_type, value, event_id FROM events), {_draws_sql('ev', 'event_id')},
    e AS (SELECT event_type, draw, sum(weight)::BIGINT AS n, sum(weight * value) / sum(weight) AS u FROM dr GROUP BY ALL),
    o AS (SELECT event_type, u, row_number() OVER (PARTITION BY event_type ORDER BY u) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS c FROM e WHERE draw > 0),
    i AS (SELECT event_type, {_ENDS} FROM o GROUP BY event_type)
    SELECT event_type, n, round(u, 5) AS mean, round(lo, 5) AS lo, round(hi, 5) AS hi FROM e JOIN i USING (event_type) WHERE draw = 0""")
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bootstrap_mean(table(spark, sf_dir, "events"), "value", F.col("event_id"), ["event_type"])
    return b.select("event_type", "n", *(F.round(c, 5).alias(c) for c in ("mean", "lo", "hi")))


def designs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    c = F.col("context")
    x = S.context_features(c.bitwiseAND(3), F.shiftright(c, 2).bitwiseAND(3), F.lit(0), F.lit(0), F.lit(False))
    return R.anonymise(log(spark, sf_dir), "day", "context", "event_id").drop("context").withColumnRenamed("shown", "context"), x


SHOWN = f"{LOG}, sh AS (SELECT arm, reward, context FROM lg QUALIFY row_number() OVER (PARTITION BY day, context ORDER BY event_id) >= 5)"


@query(f"""WITH {SHOWN}, a AS (SELECT unnest([0, 1, 2]) AS arm)
    SELECT (SELECT count(*) FROM lg) AS seen, a.arm, 26.0::DOUBLE + 5 * count(sh.arm) AS precision, 5 * coalesce(sum(reward), 0) AS moment FROM a LEFT JOIN sh USING (arm) GROUP BY a.arm""")
def thompson_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.ThompsonPolicy.replay(*designs(spark, sf_dir))
    return spark.createDataFrame([(p.seen, arm, float(p.a[arm].trace()), float(p.b[arm].sum())) for arm in range(3)], "seen long, arm int, precision double, moment double")


@query(f"""WITH {SHOWN}, x AS (SELECT arm, reward, [0, 1 + (context & 3), 5 + ((context >> 2) & 3), 9, 17] AS ones FROM sh),
    p AS (SELECT arm, reward, ones, unnest(ones) AS i FROM x), q AS (SELECT arm, i, unnest(ones) AS j FROM p)
    SELECT arm, i::INT AS i, j::INT AS j, count(*)::DOUBLE AS s FROM q WHERE j >= i GROUP BY ALL UNION ALL SELECT arm, i::INT, NULL, sum(reward)::DOUBLE FROM p GROUP BY ALL
    UNION ALL SELECT arm, NULL, NULL, count(*)::DOUBLE FROM lg GROUP BY ALL""")
def thompson_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.posterior_sums(*designs(spark, sf_dir))


@query(f"WITH {LOG}, c AS (SELECT event_id, context & 3 AS i, (context >> 2) & 3 AS l FROM lg) SELECT event_id, (i | (l << 2) | (5 << 4) | (3 << 8) | (1 << 11))::INT AS bucket, i::INT AS intent, l::INT AS len_bucket FROM c")
def context_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("context")
    x = log(spark, sf_dir).withColumn("bucket", S.bucket_id(c.bitwiseAND(3), F.shiftright(c, 2).bitwiseAND(3), F.lit(5), F.lit(3), F.lit(1)))
    back = S.from_bucket_id(F.col("bucket"))
    return x.select("event_id", "bucket", back["intent"].alias("intent"), back["len_bucket"].alias("len_bucket"))


@query(f"""WITH {L.bm25_sql(100)}, j AS (SELECT item_id AS qid, doc_id AS doc, 1 + quality::INT AS grade FROM labels l JOIN benchmark b ON l.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
    h AS (SELECT top.qid, rank, grade FROM top JOIN j ON j.qid = top.qid AND j.doc = top.key),
    d AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) END) AS dcg, min(rank) FILTER (WHERE rank <= 10) AS first, count(*) AS found FROM h GROUP BY qid),
    i AS (SELECT qid, sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) END) AS ideal, count(*) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc) AS r FROM j) GROUP BY qid)
    SELECT qid, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(found / rel, 0), 6) AS recall FROM i LEFT JOIN d USING (qid)""")
def ranking_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    j = table(spark, sf_dir, "labels").join(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("qid"), F.col("doc_id").alias("doc"), (1 + F.col("quality")).alias("grade"))
    got = M.ranking_measures(L.ranked(spark, sf_dir, 100).withColumnRenamed("key", "doc"), j)
    return got.select("qid", *(F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall")))


@query()
def diversity_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("subtopic"))
    top = L.ranked(spark, sf_dir, 20).select("qid", F.col("key").alias("doc"), "rank")
    return M.alpha_ndcg_by_query(top, top.join(docs, "doc").select("qid", "doc", F.lit(1).alias("grade"), "subtopic").toDF("qid", "doc", "grade", "subtopic"))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS x, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS y FROM events)
    SELECT event_type, round(corr(x, y), 6) AS spearman FROM r GROUP BY event_type""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spearman(table(spark, sf_dir, "events"), "value", "user_id", ["event_type"]).select("event_type", F.round("spearman", 6).alias("spearman"))


@query("""WITH g AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM (SELECT (user_id % 101) / 101.0::DOUBLE AS p, (value > 50)::INT::DOUBLE AS y FROM events) GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM g""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(((F.col("user_id") % 101) / 101.0).alias("p"), (F.col("value") > 50).alias("y"))
    return M.calibration_error(e.withColumn("y", F.col("y").cast("int")), "p", "y").select(F.round("ece", 6).alias("ece"))


@query("""WITH c AS (SELECT lang AS t, source AS f, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM c), t AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY t)), f AS (SELECT sum(n * (n - 1) / 2) AS f FROM (SELECT sum(n) AS n FROM c GROUP BY f))
    SELECT round(b / f, 9) AS precision, round(b / t, 9) AS recall, round(2 * (b / f) * (b / t) / (b / f + b / t), 9) AS f1, (f - b)::BIGINT AS false_merges FROM b, t, f""")
def clustering_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pair_scores(table(spark, sf_dir, "documents"), "lang", "source").select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "false_merges")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (WHERE r = greatest(ceil(0.5 * n), 1)) AS p50, max(value) FILTER (WHERE r = greatest(ceil(0.95 * n), 1)) AS p95 FROM r GROUP BY event_type""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_rank(table(spark, sf_dir, "events"), "value", [50, 95], ["event_type"])


@query("""WITH g AS (SELECT user_id % 40 AS s, count(*) AS k, sum((value > 90)::INT) AS v FROM events GROUP BY 1), c AS (SELECT s, sum(k) OVER (ORDER BY s DESC) AS n, sum(v) OVER (ORDER BY s DESC) AS e FROM g) SELECT min(s) AS threshold FROM c WHERE n >= 20 AND (e + 1) / (n + 1) <= 0.1""")
def conformal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("s"), (F.col("value") > 90).alias("wrong"))
    return M.conformal_threshold(e, "s", "wrong")


@query(f"WITH {L.bm25_sql(20)} SELECT qid, round(least(greatest(sum(CASE WHEN key % 2 = 0 THEN 1 / log2(rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i)), 0), 1) * 255)::INT AS reward FROM top WHERE rank <= 10 GROUP BY qid")
def graded_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.graded_reward(L.ranked(spark, sf_dir, 20), ["qid"], "rank", F.col("key") % 2 == 0)


_CAND = f"""{L.bm25_sql(20)}, z AS (SELECT qid, key, rank - 1 AS pos, (bm25 - avg(bm25) OVER (PARTITION BY qid)) / greatest(stddev_pop(bm25) OVER (PARTITION BY qid), 1e-9) AS z FROM top),
    c AS (SELECT qid, key, pos, least(greatest(0.2 + 0.3 * least(greatest(z, -3), 3), 0.05), 0.95) AS p, (1 - (key % 5) / 10.0) * 7.0 * (1 - 1 / log2(pos + 2)) AS gain, 0.3 AS cost FROM z)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.ranked(spark, sf_dir, 20).withColumn("pos", F.col("rank") - 1)
    return W.page_candidates(r, ["qid"], "bm25", "pos", 1 - (F.col("key") % 5) / 10.0, 0.3)


@query(f"WITH {_CAND} SELECT qid, key, round(p, 5) AS p, round(gain, 6) AS gain, round(gain - cost / greatest(p, 1e-9), 4) AS z FROM c")
def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("qid", "key", F.round("p", 5).alias("p"), F.round("gain", 6).alias("gain"), F.round(W.reservation_index(F.col("gain"), F.col("cost"), F.col("p")), 4).alias("z"))


@query(f"WITH {_CAND}, n AS (SELECT *, round(p * gain - cost, 9) AS net, row_number() OVER (PARTITION BY qid ORDER BY p * gain - cost DESC, key) AS turn FROM c) SELECT qid, key, turn::INT AS turn FROM n WHERE net > 0 AND turn <= 5")
def additive_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.additive_walk(candidates(spark, sf_dir), ["qid"], 5, "key").select("qid", "key", "turn")


@query()
def pandora_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("value", (F.col("key") % 7) / 2.0)
    return W.pandora(c, "qid", 5, "key")


@query()
def passage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.passage_table(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n", F.length("passage").alias("chars"))


@query()
def mmr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), S.snippet_of(F.col("text")).alias("snippet"))
    r = L.ranked(spark, sf_dir, 20).join(docs, "key").withColumn("pos", F.col("rank") - 1)
    return W.mmr_order(r, "qid", "pos", "bm25", "snippet").join(r.select("qid", "pos", "key"), ["qid", "pos"])


@query()
def deep_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat_ws(" ", S.title_of(F.col("text")), S.snippet_of(F.col("text"))).alias("pair"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    r = L.ranked(spark, sf_dir, 30).join(docs, "key").join(b, "qid")
    return W.rerank(r, ["qid"], "rank", W.overlap_score(F.col("q"), F.col("pair"))).select("qid", "key", "rank", "new_rank", F.round("ce", 6).alias("ce"))


@query()
def best_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    top = cut(L.ranked(spark, sf_dir, 3).select("qid", "key", "rank"), "ranked")
    p = W.passage_table(docs.join(top.select("key").distinct(), "key", "left_semi"), "key", "text")
    scored = top.join(p, "key").join(b, "qid").withColumn("ce", W.overlap_score(F.col("q"), F.col("passage")))
    return W.best_passage(scored, ["qid"]).select("qid", "key", "n", F.round("ce", 6).alias("ce"), "passage", "degraded")
