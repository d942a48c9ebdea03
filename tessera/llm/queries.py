"""Queries of this subpackage: thin digests of its operators over whole tables, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_digest
from tessera.llm.decontaminate import leaks
from tessera.llm.jaccard_join import jaccard_groups
from tessera.llm.language import identify, learn_likelihood
from tessera.llm.licenses import oracle_sql as licenses_sql
from tessera.llm.licenses import scan_licenses
from tessera.llm.order import materialise
from tessera.llm.periodic import periodic_runs, run_digest
from tessera.llm.quality import COUNTS, quality
from tessera.llm.simhash_join import simhash_groups
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.token_align import align_tokenizers
from tessera.llm.toxicity import score_toxicity
from tessera.llm.warc import archive

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document begins in the order, with the shard's digest; the shards are written on the way."""
    import public_tokenizers

    per_shard, length = 4096, 2048
    made, where, _ = materialise(_table(spark, sf_dir, "documents"), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), length=length, per_shard=per_shard)
    shard = F.floor(F.col("first_slot") / per_shard)
    return where.withColumn("shard", shard).join(made, "shard").select("doc_id", "n_tokens", "first_token", "first_slot", "shard", ((F.col("first_slot") - F.col("shard") * per_shard) * length * F.col("bytes") / (F.col("sequences") * length)).cast("long").alias("byte_offset"), F.col("sha256").alias("shard_sha256"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("sentence_ids", "rules", "licenses")))


def word_tokenizer() -> str:
    """The path of the tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(_table(spark, sf_dir, "documents"), word_tokenizer())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(_table(spark, sf_dir, "pages"), docs, learn_likelihood(docs))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(_table(spark, sf_dir, "pages"))[0]


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document whose id's checksum is divisible by ten, with a tail that repeats; those of others as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(_table(spark, sf_dir, "documents"), edit=periodic_tail))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as T

    return align_tokenizers(_table(spark, sf_dir, "documents"), T.path("byte_bpe_50k.json"), T.PATTERN, T.path("piece_bpe_32k.model"))


def op13_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_training_order": op3_training_order,
    "op4_host_quality": op4_host_quality,
    "op5_license_scan": op5_license_scan,
    "op6_bpe": op6_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_align": op12_token_align,
    "op13_simhash_join": op13_simhash_join,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END, ' ')) AS sh
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM r WHERE r.node = w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id)""",
    "op4_host_quality": r"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        t AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n
              FROM (SELECT r, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))),
        p AS (SELECT r, count(DISTINCT i + d) AS n_repeat FROM t, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY r),
        l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        c AS (SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
              FROM w LEFT JOIN p USING (r) LEFT JOIN l USING (r)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
        h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
        m AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) ** 2 AS v FROM h),
        s AS (SELECT m, CASE WHEN v <= 1e-12 OR m <= 0 OR m >= 1 THEN 1e6 ELSE least(greatest(m * (1 - m) / v - 1, 1), 1e6) END AS k FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce((h.f + m * k) / (h.n + k) < 0.6, true) AS kept
        FROM b LEFT JOIN h USING (source), s""",
    "op5_license_scan": licenses_sql(),
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
        t AS (SELECT digest, max(page_id) AS target FROM p WHERE n >= 1000 GROUP BY digest)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND target <> page_id THEN target END AS refers_to
        FROM p LEFT JOIN t USING (digest)""",
}
