"""From documents to token ids: drop toxic texts, near copies, repeated passages and benchmark leaks, then encode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_decode
from tessera.llm.decontaminate import leaks
from tessera.llm.jaccard_join import jaccard_groups
from tessera.llm.queries import word_tokenizer
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.toxicity import score_toxicity
from tessera.plans.lineage import cut

#: Columns of documents; any others are dropped.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Repeated passages of so many words are cut out.
WORDS = 51


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; it is fitted on the labelled ones among ``docs``. All others stay as they are."""
    return score_toxicity(docs, _table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def _row_key() -> Column:
    """Tells rows apart that share an id or have none: a hash of the id and the text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle overlap one stays: the one with the smallest id, rows without an id coming last.

    Rows are told apart by id and text: an unrelated text under the id of a copy stays, and of rows that repeat with id and text one
    stays. Documents without words are linked with nothing; they stay, one of each that repeats.
    """
    mine = docs.select(*COLUMNS).withColumn("row_key", _row_key())
    # the operator's ids are the rows' places in order of id and key, so that a component is named after the row that stays
    named = mine.select("doc_id", "row_key", "text").withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    groups = cut(jaccard_groups(named.withColumn("key", F.col("row_key")), id_col="key").where("n_shingles > 0").select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("component")).distinct(), "groups")
    first = groups.join(named.select("row_key", "place"), "row_key").groupBy("component").agg(F.min("place").alias("place"), F.count_distinct("row_key").alias("n")).where("n > 1")
    gone = cut(groups.join(first, "component").where("row_key <> place.row_key").select("row_key"), "copies")
    return mine.join(gone, "row_key", "left_anti").dropDuplicates(["row_key"]).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat are cut out, as are those of 400 bytes or more; a character that a cut divides goes with it.

    Every document keeps its row, its text empty if nothing is left. Rows with equal texts of that length are passages of one another.
    """
    out = remove_repeats(docs, keep=COLUMNS, words=WORDS, whole_characters=True)
    some = F.size("spans") > 0
    out = out.withColumn("text", F.when(some, F.col("kept").cast("string")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go; all others stay as they are, those without an id or under the id of one that goes among them."""
    mine = docs.select(*COLUMNS).withColumn("row_key", _row_key())
    found = cut(leaks(mine, _table(spark, sf_dir, "benchmark"), keep=["row_key"]).select("row_key").distinct(), "leaks")
    return mine.join(found, "row_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining text, with their number and a digest of the text that they decode to."""
    out = encode_decode(docs, word_tokenizer(), keep=["doc_id", "lang", "source"])
    sha = F.sha2(F.encode("decoded", "utf-8"), 256)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", sha.alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("suffix_dedup", drop_repeats), ("decontaminate", drop_leaks), ("bpe", encode)]

#: The stages are beyond SQL (a fitted model, merged transforms, alignments); tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
