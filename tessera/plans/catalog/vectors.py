"""Vector search and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.functions import scalars as S
from tessera.operators import lexical, vector
from tessera.plans.catalog import query, table

COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / greatest(sqrt(list_sum(list_transform({a}, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda z: z::DOUBLE * z::DOUBLE))), 1e-9)"
Q8 = "list_transform({a}, lambda x: greatest(least(floor(x::DOUBLE * 127.0 + 0.5), 127), -127)::INT)"
#: Place of an event: a fixed rule that spreads users over the map.
LAT, LON = "CAST(user_id * 37 % 1200 AS DOUBLE) / 10.0 - 60.0", "CAST(user_id * 91 % 3400 AS DOUBLE) / 10.0 - 170.0"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _knn_sql(a: str, b: str, where: str, k: int) -> str:
    return f"""SELECT q.vec_id AS qid, r.vec_id AS key, round({COS.format(a=a, b=b)}, 5) AS sim,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a=a, b=b)}, 12) DESC, r.vec_id)::INT AS rank
        FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 {where} QUALIFY rank <= {k}"""


@query(_knn_sql("q.embedding", "r.embedding", "", 10))
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return vector.knn(e, vector.ids_divisible(e, "vec_id"), 10).select("qid", "key", F.round("sim", 5).alias("sim"), "rank")


@query(_knn_sql(Q8.format(a="q.embedding"), Q8.format(a="r.embedding"), "AND r.label % 2 = 0", 10))
def vector_int8_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return vector.int8_scan(e, vector.ids_divisible(e, "vec_id"), e.where("label % 2 = 0"), 10).select("qid", "key", F.round("sim", 5).alias("sim"), "rank")


@query()
def vector_ann_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return vector.ann(e, vector.ids_divisible(e, "vec_id"), 10)


@query()
def vector_ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    q = vector.ids_divisible(e, "vec_id")
    return vector.recall(vector.ann(e, q, 10), vector.knn(e, q, 10))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def vector_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return embeddings(spark, sf_dir).select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.get(S.l2_normalize(v), F.lit(0)), 6).alias("first"))


@query("SELECT vec_id, label + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS label FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 3 = 0")
def vector_upsert_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).select("vec_id", "label")
    left = e.join(e.where("vec_id % 7 = 0").select("vec_id"), "vec_id", "left_anti")
    return vector.upsert(left, e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label")), "vec_id")


CELL = f"(({{res}}::BIGINT << 56) + ((round(({LON}) / {{step}} - round(({LAT}) / {{step}}) / 2.0)::BIGINT + 134217728) << 28) + round(({LAT}) / {{step}})::BIGINT + 134217728)"


def _cell_sql(res: int) -> str:
    return CELL.format(res=res, step=C.SPACING / (1 << res))


def event_cells(spark: SparkSession, sf_dir: str, res: int = 7) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("cell", C.cell_of(F.expr(LAT), F.expr(LON), res))


@query(f"SELECT cell, count(*) AS count FROM (SELECT {_cell_sql(5)} AS cell FROM events) GROUP BY cell")
def heatmap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.heatmap(event_cells(spark, sf_dir, 5), F.col("cell"))


@query(f"""SELECT (3::BIGINT << 56) + ((floor((((c >> 28) & 268435455) - 134217728) / 16.0)::BIGINT + 134217728) << 28) + (floor(((c & 268435455) - 134217728) / 16.0)::BIGINT + 134217728) AS cell, count(*) AS count
    FROM (SELECT {_cell_sql(7)} AS c, ts FROM events) WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def heatmap_parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_cells(spark, sf_dir, 7)
    return lexical.heatmap(e, F.col("cell"), F.col("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), C.parent(F.col("cell"), 3))


@query(f"SELECT event_id, c AS cell, round(((c & 268435455) - 134217728) * {C.SPACING / 128}, 6) AS lat, round(((((c >> 28) & 268435455) - 134217728) + ((c & 268435455) - 134217728) / 2.0) * {C.SPACING / 128}, 6) AS lon FROM (SELECT event_id, {_cell_sql(7)} AS c FROM events)")
def cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = C.centre(F.col("cell"))
    return event_cells(spark, sf_dir, 7).select("event_id", "cell", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"SELECT user_id, round(2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(52.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52.5)) * pow(sin(radians(13.4 - lon) / 2), 2), 1.0))), 4) AS km FROM (SELECT DISTINCT user_id, {LAT} AS lat, {LON} AS lon FROM events)")
def distances_and_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id", F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon")).distinct()
    return u.select("user_id", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(52.5), F.lit(13.4)), 4).alias("km"))


#: The cells of a circle, a fixed list of at most a few hundred, and their resolution.
CIRCLE_RES, CIRCLE = C.filter_cells(-50.0, 60.0, 250.0)


@query(f"SELECT cell, count(*) AS n FROM (SELECT {_cell_sql(CIRCLE_RES)} AS cell FROM events) WHERE cell IN ({', '.join(map(str, CIRCLE))}) GROUP BY cell")
def circle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, allowed = C.filter_cells(-50.0, 60.0, 250.0)
    e = event_cells(spark, sf_dir, res)
    return e.where(lexical.compose_filter(F.col("cell"), allowed)).groupBy("cell").agg(F.count("*").alias("n"))
