"""Near-duplicate sketches, clusters of derived texts, and confidence signals of result lists."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalars as S

BINS, SHINGLE, LEAST_MATCHES = 60, 4, 5
#: Chance that two unrelated bytes agree.
CHANCE = 1 / 256
_M = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The mixing step of a well-known 64-bit generator."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: What each character met so far is in a word, its first lower-case character; 0 for what stands in none, -1 for one not yet met.
_LETTER = np.full(0x110000, -1, np.int32)
_FNV, _PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Characters that are sketched at a time.
GROUP = 1 << 20


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a of each run of letters and figures, each lowered to its first lower-case character, and where each text's begin."""
    chars = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    for c in np.unique(chars[_LETTER[chars] < 0]).tolist():
        ch = chr(c)
        _LETTER[c] = ord(ch.lower()[0]) if ch.isalnum() or unicodedata.category(ch) in ("Nd", "Nl", "No") else 0
    low = _LETTER[chars]
    part = low > 0
    first = np.flatnonzero(part & ~np.r_[False, part[:-1]])
    begin = np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    size = 1 + (low >= 0x80) + (low >= 0x800) + (low >= 0x10000)
    at = np.cumsum(size * part) - size * part
    raw = np.zeros(int((size * part).sum()), np.uint64)
    for n in range(1, 5):
        some = part & (size == n)
        x, to = low[some].astype(np.uint64), at[some]
        for i in range(n):
            v = x >> np.uint64(6 * (n - 1 - i))
            raw[to + i] = v if n == 1 else (v | np.uint64((0xF00 >> n) & 0xFF) if i == 0 else v & np.uint64(0x3F) | np.uint64(0x80))
    start = at[first]
    length = np.diff(np.r_[start, len(raw)])
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    h, pos = np.full(len(order), _FNV, np.uint64), 0
    while (active := int(np.searchsorted(-length, -pos, "left"))) > 8:
        h[:active] = (h[:active] ^ raw[start[:active] + pos]) * np.uint64(_PRIME)
        pos += 1
    for i in range(active):  # the last few long ones
        v = int(h[i])
        for b in raw[start[i] + pos : start[i] + length[i]].tolist():
            v = (v ^ b) * _PRIME & _M
        h[i] = v
    out = np.empty_like(h)
    out[order] = h
    return out, begin


def sketches(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its distinct word shingles, and one byte for each of 60 bins of a one-permutation hash; empty bins borrow from the right."""
    w, begin = word_hashes(texts)
    n = np.diff(begin)
    own = np.repeat(np.arange(len(texts)), n)
    h = w[: max(0, len(w) - SHINGLE + 1)]
    for i in range(1, SHINGLE):
        h = splitmix(h ^ w[i : i + len(h)])
    whole = own[: len(h)] == own[SHINGLE - 1 :]
    few = np.flatnonzero(n < SHINGLE)
    x = np.full(len(few), _FNV, np.uint64)
    for i in range(SHINGLE - 1):
        more = n[few] > i
        x[more] = splitmix(x[more] ^ w[begin[few][more] + i])
    h, own = h[whole], own[: len(whole)][whole]
    edge = np.searchsorted(own, np.arange(len(texts) + 1))
    for a, z in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        h[a:z].sort()
    new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])][: len(h)]
    h, own = np.r_[h[new], splitmix(x)], np.r_[own[new], few]
    least = np.full(len(texts) * BINS, _M, np.uint64)
    np.minimum.at(least, own * BINS + (h % np.uint64(BINS)).astype(np.int64), h // np.uint64(BINS))
    least = least.reshape(-1, BINS)
    sig, empty = least.copy(), least == np.uint64(_M)
    for steps in range(1, BINS):
        if not empty.any():
            break
        near = np.roll(least, -steps, axis=1)
        take = empty & (near != np.uint64(_M))
        sig[take] = splitmix(near[take] ^ np.uint64(steps))
        empty &= ~take
    return np.bincount(own, minlength=len(texts)), (sig & np.uint64(0xFF)).astype(np.uint8)


def sketch(text: str) -> tuple[int, bytes]:
    """:func:`sketches` of one text."""
    n, sig = sketches([text])
    return int(n[0]), sig[0].tobytes()


def encode_sketch(shingles: int, sig: bytes) -> bytes:
    return shingles.to_bytes(4, "little") + sig


def decode_sketch(raw: bytes) -> tuple[int, bytes] | None:
    return (int.from_bytes(raw[:4], "little"), raw[4:]) if len(raw) == 4 + BINS else None


@F.pandas_udf(T.StructType([T.StructField("shingles", T.IntegerType()), T.StructField("sig", T.ArrayType(T.IntegerType()))]))
def sketch_udf(text: pd.Series) -> pd.DataFrame:
    texts = [t or "" for t in text]
    group = np.cumsum([0, *map(len, texts)])[:-1] // GROUP
    edge = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(texts)].tolist()
    got = [sketches(texts[a:z]) for a, z in zip(edge, edge[1:], strict=False)]
    return pd.DataFrame({"shingles": [x for n, _ in got for x in n.tolist()], "sig": [x for _, sig in got for x in sig.astype(np.int32)]})


def jaccard_estimate(a: Column, b: Column) -> Column:
    """From two signatures: 0 below five matches, else the share of matches less what chance gives."""
    m = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] == z["y"]))
    j = F.least(F.greatest((m / BINS - CHANCE) / (1 - CHANCE), F.lit(0.0)), F.lit(1.0))
    return F.when(m < LEAST_MATCHES, 0.0).otherwise(j)


def containment(na: Column, nb: Column, j: Column) -> Column:
    """Share of the smaller set that the larger one holds, from a Jaccard value and both sizes."""
    inter = j * (na + nb) / (1 + j)
    return F.when((na <= 0) | (nb <= 0), 0.0).otherwise(F.least(F.greatest(inter / F.greatest(F.least(na, nb), F.lit(1)), F.lit(0.0)), F.lit(1.0)))


def cluster_results(results: DataFrame, by: Sequence[str], tau: float = 0.3, pos: str = "pos") -> DataFrame:
    """Results (bounded lists, at most fifty rows for each ``by``) with ``cluster`` and ``canonical``.

    Rows with a sketch that contain one another to ``tau`` are connected; clusters are numbered by first appearance; the canonical
    member has most shingles, the first of equals. Rows without a sketch get no cluster.
    """
    names = [*by, pos, "shingles", "sig"]
    schema = results.select(*by, pos).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", cluster int, canonical boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos).reset_index(drop=True)
        has = np.flatnonzero(pdf["shingles"].notna())
        up = {int(i): int(i) for i in has}

        def find(i: int) -> int:
            while up[i] != i:
                i = up[i]
            return i

        sig = {int(i): np.asarray(pdf["sig"][i]) for i in has}
        size = {int(i): float(pdf["shingles"][i]) for i in has}
        for x, i in enumerate(has):
            for j in has[x + 1 :]:
                m = int((sig[i] == sig[j]).sum())
                jac = 0.0 if m < LEAST_MATCHES else min(max((m / BINS - CHANCE) / (1 - CHANCE), 0.0), 1.0)
                inter = jac * (size[i] + size[j]) / (1 + jac)
                if min(size[i], size[j]) > 0 and inter / min(size[i], size[j]) >= tau:
                    a, b = find(int(i)), find(int(j))
                    up[max(a, b)] = min(a, b)
        ids: dict[int, int] = {}
        out, best = [None] * len(pdf), {}
        for i in map(int, has):
            c = ids.setdefault(find(i), len(ids))
            out[i] = c
            if c not in best or size[i] > size[best[c]]:
                best[c] = i
        res = pdf[[*by, pos]].copy()
        res["cluster"] = pd.array(out, "Int32")
        res["canonical"] = [out[i] is not None and best[out[i]] == i for i in range(len(pdf))]
        return res

    return results.select(*names).groupBy(*by).applyInPandas(run, ddl)


def evidence_block(clustered: DataFrame, by: Sequence[str], host: str = "host") -> tuple[DataFrame, DataFrame]:
    """Members and distinct hosts of each cluster; independent, apparent and sketched counts of each list."""
    per = clustered.where("cluster is not null").groupBy(*by, "cluster").agg(F.count("*").alias("members"), F.count_distinct(host).alias("domains"))
    total = clustered.groupBy(*by).agg(F.count_distinct("cluster").alias("independent"), F.count("*").alias("apparent"), F.count("cluster").alias("sketched"))
    return per, total


def diversify(clustered: DataFrame, by: Sequence[str], pos: str = "pos") -> DataFrame:
    """Adds ``slot``, the new order: a cluster's canonical member (else its first) takes the cluster's first place, the others go to the end in their order."""
    c = Window.partitionBy(*by, "cluster")
    x = clustered.withColumn("_first", F.min(pos).over(c)).withColumn("_lead", F.coalesce(F.max(F.when(F.col("canonical"), F.col(pos))).over(c), F.col("_first")))
    lead = F.col("cluster").isNull() | (F.col(pos) == F.col("_lead"))
    x = x.withColumn("_key", F.when(F.col("cluster").isNull(), F.col(pos)).when(lead, F.col("_first")).otherwise(F.col(pos))).withColumn("_late", (~lead).cast("int"))
    return x.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("_late", "_key")) - 1).drop("_first", "_lead", "_key", "_late")


def corroboration_candidates(clustered: DataFrame, by: Sequence[str], winner: Column, pos: str = "pos") -> DataFrame:
    """One representative of each cluster but the winner's: the canonical member, else the first."""
    w = Window.partitionBy(*by, "cluster").orderBy(F.desc(F.col("canonical").cast("int")), pos)
    return clustered.where(F.col("cluster").isNotNull() & (F.col("cluster") != winner)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def shingle_sets(docs: DataFrame, key: str, text: Column, k: int = SHINGLE) -> DataFrame:
    """``(key, sh)``: distinct word shingles as text, or all words as one where there are fewer."""
    t = S.tokens(text)
    n = F.size("_t")
    many = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(F.col("_t"), i, k), " "))
    return docs.select(F.col(key), t.alias("_t")).where(n > 0).select(key, F.explode(F.array_distinct(F.when(n >= k, many).otherwise(F.array(F.array_join("_t", " "))))).alias("sh"))


def exact_containment(pairs: DataFrame, shingles: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Containment of the given pairs, from whole shingle sets."""
    n = shingles.groupBy(key).agg(F.count("*").alias("n"))
    x = pairs.join(shingles.withColumnRenamed(key, a), a).join(shingles.withColumnRenamed(key, b), [b, "sh"]).groupBy(a, b).agg(F.count("*").alias("common"))
    x = pairs.join(x, [a, b], "left").join(n.withColumnRenamed(key, a).withColumnRenamed("n", "na"), a).join(n.withColumnRenamed(key, b).withColumnRenamed("n", "nb"), b)
    return x.select(a, b, (F.coalesce("common", F.lit(0)) / F.least("na", "nb")).alias("containment"))


def minhash(shingles: DataFrame, key: str, perms: int = 16) -> DataFrame:
    """Least hashes of each set, one for each of several seeds."""
    return shingles.groupBy(key).agg(*(F.min(S.key60(F.concat(F.lit(f"{i}:"), "sh"))).alias(f"h{i}") for i in range(perms)))


def text_minhash(docs: DataFrame, key: str, text: Column, perms: int = 16, k: int = SHINGLE) -> DataFrame:
    """:func:`minhash` of the word shingles of texts: a task hashes the shingles of one text at a time, and only their least hashes leave it.

    A key is the first 60 bits of a digest, so that the least digest has the least key.
    """
    rows = docs.select(F.col(key), S.tokens(text).alias("_t")).where(F.size("_t") > 0)
    seeds = [f"{i}:".encode() for i in range(perms)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                lists = part.column("_t")
                flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
                ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
                for t in (flat[a:z] for a, z in zip([0, *ends], ends, strict=False)):
                    some = {" ".join(t[i : i + k]).encode() for i in range(max(1, len(t) - k + 1))}
                    out.append([int.from_bytes(min([hashlib.md5(s + x, usedforsecurity=False).digest() for x in some])[:8], "big") >> 4 for s in seeds])
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array([o[i] for o in out], pa.int64()) for i in range(perms))], names)

    names = [key, *(f"h{i}" for i in range(perms))]
    kinds = ", ".join([f"{key} {rows.schema[key].dataType.simpleString()}", *(f"h{i} long" for i in range(perms))])
    return rows.mapInArrow(run, kinds).groupBy(key).agg(*(F.min(f"h{i}").alias(f"h{i}") for i in range(perms)))


def simhash(docs: DataFrame, key: str, text: Column, bits: int = 60) -> DataFrame:
    """``(key, simhash)``: bits that most tokens of a text have set."""
    t = docs.select(key, F.explode(S.tokens(text)).alias("t")).select(key, S.key60(F.col("t")).alias("h"))
    sums = t.groupBy(key).agg(F.array(*(F.sum(F.shiftright("h", i).bitwiseAND(1) * 2 - 1) for i in range(bits))).alias("s"))
    return sums.select(key, F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1) + F.when(F.get("s", bits - 1 - i) > 0, 1).otherwise(0)).alias("simhash"))


def query_confidence(results: DataFrame, by: Sequence[str], score: str, rank: str, snippet: str, head: int = 10) -> DataFrame:
    """``nqc``, ``clarity`` and ``confidence`` of each list: spread of the head's scores over the mean of all, and divergence of the head's terms from all terms."""
    top = F.col(rank) <= head
    g = results.groupBy(*by).agg((F.stddev_pop(F.when(top, F.col(score))) / F.greatest(F.abs(F.avg(score)), F.lit(1e-6))).alias("nqc"))
    terms = results.select(*by, top.alias("top"), F.explode(F.filter(F.split(F.col(snippet), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 2)).alias("t")).select(*by, "top", F.lower("t").alias("t"))
    c = terms.groupBy(*by, "t").agg(F.count_if("top").alias("n_top"), F.count("*").alias("n"))
    tot = c.groupBy(*by).agg(F.sum("n_top").alias("s_top"), F.sum("n").alias("s"), F.count("*").alias("v"))
    x = c.join(tot, list(by)).where("n_top > 0")
    p, q = F.col("n_top") / F.col("s_top"), (F.col("n") + 1) / (F.col("s") + F.col("v"))
    cl = x.groupBy(*by).agg(F.greatest(F.sum(p * F.log(p / q)), F.lit(0.0)).alias("clarity"))
    out = g.join(cl, list(by), "left").withColumn("clarity", F.coalesce("clarity", F.lit(0.0)))
    conf = 0.5 * (1 - F.exp(-2 * F.col("nqc"))) + 0.5 * (1 - F.exp(-0.7 * F.col("clarity")))
    return out.withColumn("confidence", F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)))
