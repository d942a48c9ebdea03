"""Ingest with history and tombstones, and forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def ingest(batch: DataFrame, seen: DataFrame, tombstones: DataFrame, text: str = "text", order: Column | None = None) -> DataFrame:
    """The batch with ``hash`` and ``status``: refused (a tombstone), deduped (seen before, or earlier in the batch) or accepted, in that order of precedence.

    Rows that are null or blank are left out. ``seen`` and ``tombstones`` have a column ``hash``. Of rows that tie in ``order`` any one is the first.
    """
    x = batch.withColumn("hash", S.content_hash(F.col(text))).where(F.col(text).isNotNull() & (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))
    mark = lambda d, c: d.select("hash").distinct().withColumn(c, F.lit(True))
    order = order if order is not None else F.monotonically_increasing_id()
    # the earliest of a hash in each task of the input first, then the earliest of those: the copies of a common text stay spread
    x = x.withColumns({"_o": order, "_p": F.spark_partition_id()})
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("hash", "_p").orderBy("_o")))
    x = x.withColumn("_p", F.when(F.col("_r") == 1, -1).otherwise(F.col("_p")))
    x = x.withColumn("_r", F.when(F.col("_p") == -1, F.row_number().over(Window.partitionBy("hash", "_p").orderBy("_o"))).otherwise(2))
    x = x.join(mark(tombstones, "_gone"), "hash", "left").join(mark(seen, "_seen"), "hash", "left")
    status = F.when(F.col("_gone"), "refused").when(F.col("_seen") | (F.col("_r") > 1), "deduped").otherwise("accepted")
    return x.withColumn("status", status).drop("_gone", "_seen", "_o", "_p", "_r")


def ingest_stats(ingested: DataFrame) -> DataFrame:
    return ingested.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "deduped", "refused")))


def forget(docs: DataFrame, tombstones: DataFrame, which: Column, hash_col: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Documents without those that ``which`` selects, and tombstones with theirs added: idempotent, one pass however many there are."""
    which = F.coalesce(which, F.lit(False))
    gone = docs.where(which).select(F.col(hash_col).alias("hash"))
    return docs.where(~which), tombstones.select("hash").union(gone).distinct()


def forget_hash(docs: DataFrame, tombstones: DataFrame, hashes: DataFrame, hash_col: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Forgets by content; the tombstone is put even where nothing matches."""
    left = docs.join(hashes.select(F.col("hash").alias(hash_col)), hash_col, "left_anti")
    return left, tombstones.select("hash").union(hashes.select("hash")).distinct()


def forget_one(docs: DataFrame, tombstones: DataFrame, url: str | None = None, domain: str | None = None, content: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exactly one selector."""
    if sum(x is not None for x in (url, domain, content)) != 1:
        raise ValueError("one of url, domain and content")
    if content is not None:
        return forget(docs, tombstones, F.col("hash") == content)
    return forget(docs, tombstones, F.col("url") == url if url is not None else S.host(F.col("url")) == domain.lower())
