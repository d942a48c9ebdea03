"""The event feed as a stream: day counters with late data, deduplication, and routing counters, each in step with its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.plans.lineage import new_path


def event_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as they come; the checkpoint remembers each, so that none counts twice."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def day_counts(events: DataFrame, ts: str, *by: str, late: str = "90 days") -> DataFrame:
    """Counts by day of the event and keys; late events count as long as their day is kept."""
    t = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    g = t.groupBy(F.window("_t", "1 day").alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.unix_date(F.to_date("w.start")).alias("day"), *by, "n")


def distinct_documents(docs: DataFrame, tombstones: DataFrame, text: str = "text") -> DataFrame:
    """Documents not seen before, by content, without those that were forgotten."""
    x = docs.withColumn("hash", S.content_hash(F.col(text)))
    return x.join(tombstones.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs over all that is there and gives the result as a table in memory (tests, small results)."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def upsert_counters(stream: DataFrame, path: str, by: list[str], checkpoint: str):
    """Adds each batch's counts to a table of parts: a part is named by its batch, so that a repeated batch replaces its own part. Readers sum the parts."""

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counters(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*by).agg(F.least(F.sum("n"), F.lit(4294967295)).alias("n"))
