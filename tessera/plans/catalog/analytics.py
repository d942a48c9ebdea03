"""Counters, trends, movers, hot spots, bursts, graphs and divergence over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import NORMAL_SF_SQL
from tessera.operators import analytics as A
from tessera.operators.components import connected_components
from tessera.plans.catalog import query, table
from tessera.plans.catalog import vectors as V

DAY = "(ts::DATE - DATE '1970-01-01')::INT"
USERS = f"SELECT user_id, {DAY} AS day, count(*) AS n FROM events GROUP BY ALL"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.unix_date(F.to_date("ts")))


def spine_sql(src: str, unit: str) -> str:
    return f"""ser AS ({src}), sp AS (SELECT u.{unit}, d.day, coalesce(n, 0) AS n FROM (SELECT DISTINCT {unit} FROM ser) u
        CROSS JOIN (SELECT unnest(range((SELECT min(day) FROM ser), (SELECT max(day) FROM ser) + 1))::INT AS day) d LEFT JOIN ser USING ({unit}, day))"""


def movers_sql(src: str, unit: str, spine: str | None = None) -> str:
    return f"""WITH {spine or spine_sql(src, unit)},
    u AS (SELECT {unit}, arg_max(n, day)::DOUBLE AS latest, count(*) - 1 AS days, coalesce(avg(n) FILTER (WHERE day < mx), 0)::DOUBLE AS baseline, var_samp(n) FILTER (WHERE day < mx) AS s2
          FROM sp, (SELECT max(day) AS mx FROM sp) GROUP BY {unit}),
    g AS (SELECT greatest(max(days), 1)::DOUBLE AS wd, avg(baseline) AS m, coalesce(var_samp(baseline), 0) AS v,
          sum(CASE WHEN days >= 2 AND baseline > 0 THEN greatest(s2 - baseline, 0) ELSE 0 END) AS o, sum(CASE WHEN days >= 2 AND baseline > 0 THEN baseline * baseline ELSE 0 END) AS od FROM u),
    h AS (SELECT *, CASE WHEN od > 0 THEN o / od ELSE 0 END AS inv_r FROM g), i AS (SELECT *, greatest(v - (m + inv_r * m * m) / wd, 1e-6) AS bt FROM h),
    j AS (SELECT inv_r, greatest(m * m / bt, 0.1) AS alpha, greatest(m * m / bt, 0.1) / greatest(m, 1e-9) AS beta FROM i),
    k AS (SELECT u.*, inv_r, alpha, beta, greatest((alpha + baseline * greatest(days, 1)) / (beta + greatest(days, 1)), 1e-9) AS e FROM u, j),
    z AS (SELECT *, (latest - e) / sqrt(e + inv_r * e * e) AS z, (alpha + latest) / (beta + 1) AS shrunk_rate FROM k),
    p AS (SELECT *, {NORMAL_SF_SQL.format(z='z')} AS p FROM z),
    r AS (SELECT *, row_number() OVER (ORDER BY p, {unit}) AS r, count(*) OVER () AS cnt FROM p),
    q AS (SELECT *, min(least(p * cnt / r, 1.0)) OVER (ORDER BY p DESC, {unit} DESC ROWS UNBOUNDED PRECEDING) AS q_value FROM r)
    SELECT {unit}, latest, round(baseline, 6) AS baseline, round(shrunk_rate, 5) AS shrunk_rate, round(z, 5) AS z, round(q_value, 5) AS q_value, q_value <= 0.05 AS significant,
      NOT q_value <= 0.05 AND baseline > 0 AND latest / greatest(baseline, 1e-9) >= 2 AS noise FROM q"""


def rounded_movers(m: DataFrame, unit: str) -> DataFrame:
    return m.select(unit, "latest", F.round("baseline", 6).alias("baseline"), *(F.round(c, 5).alias(c) for c in ("shrunk_rate", "z", "q_value")), "significant", "noise")


@query(f"SELECT {DAY} AS day, user_id AS cell, event_type AS root, count(*) AS n FROM events GROUP BY ALL")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counters(daily(spark, sf_dir).select("day", F.col("user_id").alias("cell"), F.col("event_type").alias("root")), "day", "cell", "root")


@query(f"SELECT event_type AS root, {DAY} AS day, count(*) AS n FROM events GROUP BY event_type, {DAY} UNION ALL SELECT NULL, {DAY}, count(*) FROM events GROUP BY {DAY}")
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).groupingSets([["event_type", "day"], ["day"]], "event_type", "day").agg(F.count("*").alias("n")).select(F.col("event_type").alias("root"), "day", "n")


@query(f"SELECT root, day, n FROM (SELECT {DAY} AS day, user_id AS cell, event_type AS root, least(2 * count(*), 4294967295)::BIGINT AS n FROM events GROUP BY ALL) WHERE day >= (SELECT max({DAY}) FROM events) - 7 AND cell % 2 = 0")
def counter_upsert_and_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = daily(spark, sf_dir).select("day", F.col("user_id").alias("cell"), F.col("event_type").alias("root"))
    c = A.counters(e, "day", "cell", "root")
    now = e.agg(F.max("day")).first()[0]
    return A.retain(A.apply_counters(c, c, ["day", "cell", "root"]), "day", now, 7).where("cell % 2 = 0").select("root", "day", "n")


@query(f"WITH {spine_sql(USERS, 'user_id')} SELECT user_id, day, n::BIGINT AS n FROM sp")
def zero_filled_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.day_spine(A.counters(daily(spark, sf_dir), "user_id", "day"), "user_id")


@query(movers_sql(USERS, "user_id"))
def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_movers(A.movers(zero_filled_spine(spark, sf_dir), "user_id"), "user_id")


@query(movers_sql(f"SELECT event_type AS root, {DAY} AS day, count(*) AS n FROM events GROUP BY ALL", "root") + " ORDER BY q.z DESC, root LIMIT 10")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.day_spine(A.counters(daily(spark, sf_dir).withColumnRenamed("event_type", "root"), "root", "day"), "root")
    return rounded_movers(A.movers(s, "root").orderBy(F.desc("z"), "root").limit(10), "root")


@query(f"""WITH {spine_sql(USERS, 'user_id')}, b AS (SELECT *, max(day) OVER () AS mx FROM sp), c AS (SELECT *, avg(n) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS days FROM b WHERE day < mx)
    SELECT user_id, (day % 7)::INT AS dow, round(CASE WHEN max(days) + 1 < 21 THEN 1.0 ELSE (count(*) * avg(CASE WHEN m > 0 THEN n / m ELSE 1 END) + 8) / (count(*) + 8) END, 6) AS season FROM c GROUP BY user_id, day % 7""")
def weekday_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.season_index(zero_filled_spine(spark, sf_dir), "user_id").select("user_id", "dow", F.round("season", 6).alias("season"))


#: The spine with counts divided by their weekday's index.
SEASONAL = f"""{spine_sql(USERS, 'user_id').replace('sp AS (', 'raw AS (')}, sb AS (SELECT *, max(day) OVER () AS mx FROM raw),
    sc AS (SELECT *, avg(n) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS days FROM sb WHERE day < mx),
    se AS (SELECT user_id, day % 7 AS dow, CASE WHEN max(days) + 1 < 21 THEN 1.0 ELSE (count(*) * avg(CASE WHEN m > 0 THEN n / m ELSE 1 END) + 8) / (count(*) + 8) END AS season FROM sc GROUP BY ALL),
    sp AS (SELECT raw.user_id, day, n / greatest(coalesce(season, 1.0), 1e-6) AS n FROM raw LEFT JOIN se ON se.user_id = raw.user_id AND dow = day % 7)"""


@query(movers_sql(USERS, "user_id", SEASONAL))
def seasonal_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_movers(A.movers(A.deseasonalise(zero_filled_spine(spark, sf_dir), "user_id"), "user_id"), "user_id")


@query()
def burst_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bursts(zero_filled_spine(spark, sf_dir), "user_id")


@query()
def burst_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.burst_detections(zero_filled_spine(spark, sf_dir), "user_id")


@query(f"WITH {spine_sql(USERS, 'user_id')} SELECT user_id, (max(day) - coalesce(max(day) FILTER (WHERE n < 1), min(day) - 1))::BIGINT AS run FROM sp GROUP BY user_id")
def trailing_active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trailing_run(zero_filled_spine(spark, sf_dir), "user_id", "day", F.col("n") >= 1)


_RING = " UNION ALL ".join(f"SELECT cell, cell + ({q}) * 268435456 + ({r}) AS near FROM c" for q, r in ((0, 0), (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)))


@query(f"""WITH c AS (SELECT cell, count(*) AS count FROM (SELECT {V._cell_sql(2)} AS cell FROM events) GROUP BY cell),
    g AS (SELECT count(*)::DOUBLE AS n, avg(count) AS m, avg(count * count) AS sq FROM c),
    w AS (SELECT x.cell, count(*)::DOUBLE AS w, sum(coalesce(c.count, 0))::DOUBLE AS s FROM ({_RING}) x LEFT JOIN c ON c.cell = near GROUP BY x.cell),
    z AS (SELECT c.cell, c.count, (s - m * w) / (sqrt(greatest(sq - m * m, 1e-12)) * sqrt(greatest((n * w - w * w) / (n - 1), 1e-12))) AS z FROM c JOIN w USING (cell), g),
    p AS (SELECT *, {NORMAL_SF_SQL.format(z='z')} AS p FROM z), r AS (SELECT *, row_number() OVER (ORDER BY p, cell) AS r, count(*) OVER () AS n FROM p),
    q AS (SELECT *, min(least(p * n / r, 1.0)) OVER (ORDER BY p DESC, cell DESC ROWS UNBOUNDED PRECEDING) AS q FROM r)
    SELECT cell, count, round(z, 5) AS z, round(q, 5) AS q_value, q <= 0.05 AS significant FROM q""")
def hot_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.event_cells(spark, sf_dir, 2).groupBy("cell").agg(F.count("*").alias("count"))
    return A.hot_spots(c).select("cell", "count", F.round("z", 5).alias("z"), F.round("q_value", 5).alias("q_value"), "significant")


EDGES_SQL = f"""f AS (SELECT {DAY} AS day, event_type, user_id, min(event_id) AS f FROM events GROUP BY ALL),
    k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY day, event_type ORDER BY f, user_id) <= 30),
    e AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS w FROM k x JOIN k y USING (day, event_type) WHERE x.user_id < y.user_id GROUP BY ALL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clique_edges(daily(spark, sf_dir), ["day", "event_type"], "user_id", F.col("event_id"))


@query(f"WITH {EDGES_SQL} SELECT a, b, w FROM e")
def clique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(f"""WITH {EDGES_SQL}, t AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) AS floor), n AS (SELECT floor, (SELECT count(*) FROM e WHERE w > floor) AS c FROM t)
    SELECT a, b, w FROM e WHERE w > coalesce((SELECT min(floor) FROM n WHERE c <= 2000), 512)""")
def edge_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compact_edges(edges(spark, sf_dir), 2000)


def _rank_sql(weight: str) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT a AS s, b AS t, {weight} AS w FROM e WHERE w >= 2 UNION ALL SELECT b, a, {weight} FROM e WHERE w >= 2),
    o AS (SELECT s, sum(w) AS o FROM b GROUP BY s), l AS (SELECT b.s, t, w / o AS p FROM b JOIN o USING (s)), kn AS (SELECT count(*) AS k FROM o),
    r AS (SELECT 0 AS i, s AS node, 1.0::DOUBLE / k AS rank FROM o, kn UNION ALL
          SELECT i + 1, node, rank FROM (SELECT r.i, l.t AS node, 0.15 / any_value(k) + 0.85 * sum(r.rank * l.p) AS rank FROM r JOIN l ON l.s = r.node, kn WHERE r.i < 30 GROUP BY r.i, l.t))
    SELECT node, round(rank / max(rank) OVER (), 6) AS rank FROM r WHERE i = 30"""


@query(_rank_sql("1.0"))
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_rank(edges(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


@query(_rank_sql("w::DOUBLE"))
def page_rank_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_rank(edges(spark, sf_dir), weighted=True).select("node", F.round("rank", 6).alias("rank"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, 1000000 + l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 49 AND l_discount >= 0.09),
    f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM f UNION SELECT f.b, r.root FROM r JOIN f ON f.a = r.node WHERE r.root < f.b)
    SELECT node, min(root) AS component FROM r GROUP BY node""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    e = o.join(li.where("l_quantity >= 49 and l_discount >= 0.09"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), (1000000 + F.col("l_suppkey")).alias("b"))
    return connected_components(e)


DIST = "SELECT source AS k, count(*) AS n FROM documents WHERE {w} GROUP BY source"


def _jsd_sql(p: str, q: str) -> str:
    return f"""WITH a AS ({p}), b AS ({q}), x AS (SELECT coalesce(a.n / (SELECT sum(n) FROM a), 0) AS p, coalesce(b.n / (SELECT sum(n) FROM b), 0) AS q FROM a FULL JOIN b USING (k))
    SELECT round(least(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0), 1), 6) AS jsd FROM x"""


@query(_jsd_sql(DIST.format(w="lang = 'en'"), DIST.format(w="lang <> 'en'")))
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    side = lambda w: d.where(w).groupBy("source").agg(F.count("*").alias("n"))
    return A.divergence(side("lang = 'en'"), side("lang <> 'en'"), "source").select(F.round("jsd", 6).alias("jsd"))


@query("SELECT event_type AS root, count(*) AS results, count(*) FILTER (WHERE value > 50) AS responses, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def engine_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("root")).agg(F.count("*").alias("results"), F.count_if(F.col("value") > 50).alias("responses"), F.round(F.avg("value"), 6).alias("mean"))
