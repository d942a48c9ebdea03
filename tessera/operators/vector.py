"""Nearest neighbours by cosine: exact scans, scans over candidates with small numbers, and an index of lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lexical import top_k
from tessera.plans.lineage import cut

#: Bytes of query vectors that one pass takes along.
BLOCK_BYTES = 64 << 20
#: Similarities that a task holds at a time, and rows of the first tile, after which most others are known to be worse.
TILE, FIRST_ROWS = 1 << 20, 64
#: Stands behind every key.
_LAST = np.iinfo(np.int64).max
_FOUND = "qid long, key long, sim double"


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)


def _batch(batch: pa.RecordBatch, key: str, vec: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows that have a vector, their keys and their unit vectors."""
    batch = batch.filter(pc.is_valid(batch.column(vec)))
    if not batch.num_rows:
        return batch, np.zeros(0, np.int64), np.zeros((0, 0))
    size = pc.list_value_length(batch.column(vec)).to_numpy()
    if (size != size[0]).any():
        raise ValueError("vectors differ in their number of components")
    flat = batch.column(vec).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch, pc.fill_null(batch.column(key).cast(pa.int64()), _LAST - 1).to_numpy(), _unit(flat.reshape(batch.num_rows, size[0]))


class _Nearest:
    """The k nearest rows of each query so far, whatever the number of rows that come by: ``k`` places a query and one tile of similarities."""

    def __init__(self, qid: np.ndarray, unit: np.ndarray, k: int, digits: int = 12):
        self.qid, self.unit, self.k, self.digits = qid, unit, k, digits
        self.sim, self.key = np.full((len(qid), k), -np.inf), np.full((len(qid), k), _LAST)
        self.slack = 2.0 * 10.0**-digits

    def add(self, keys: np.ndarray, rows: np.ndarray, who: np.ndarray | None = None) -> None:
        """Compares rows with all queries, or with those at the places ``who``."""
        who = np.arange(len(self.qid)) if who is None else who
        # rows after the first few are compared once most of them are known to be too far
        edge = [0]
        while edge[-1] < len(keys):
            edge.append(min(len(keys), max(FIRST_ROWS, 2 * edge[-1]), edge[-1] + 2048))
        wide = max(1, TILE // min(2048, max(len(keys), 1)))
        for i in range(0, len(who), wide):
            for a, z in zip(edge, edge[1:], strict=False):
                self._tile(keys[a:z], rows[a:z], who[i : i + wide])

    def _tile(self, keys: np.ndarray, rows: np.ndarray, who: np.ndarray) -> None:
        sim = rows @ self.unit[who].T
        least, last = self.sim[who, -1], self.key[who, -1]
        row, col = np.nonzero(~(sim < least - self.slack))
        # what is no number ranks first, as it does in SQL
        s = np.nan_to_num(np.round(sim[row, col], self.digits), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        better = (s > least[col]) | ((s == least[col]) & (keys[row] < last[col]))
        row, col, s = row[better], col[better], s[better]
        if not len(row):
            return
        met = np.unique(col)
        q = np.concatenate([np.repeat(met, self.k), col])
        s = np.concatenate([self.sim[who[met]].ravel(), s])
        key = np.concatenate([self.key[who[met]].ravel(), keys[row]])
        order = np.lexsort((key, -s, q))
        q, s, key = q[order], s[order], key[order]
        stay = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.sim[who[met]], self.key[who[met]] = s[stay].reshape(-1, self.k), key[stay].reshape(-1, self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 16) // self.k)
        for i in range(0, len(self.qid), step):
            sim, key = self.sim[i : i + step].ravel(), self.key[i : i + step].ravel()
            some = key < _LAST
            sim, key = sim[some], key[some]
            qid = np.repeat(self.qid[i : i + step], self.k)[some]
            yield pa.RecordBatch.from_arrays([pa.array(qid.astype(np.int64)), pa.array(key, mask=key == _LAST - 1), pa.array(np.where(sim == np.inf, np.nan, sim))], ["qid", "key", "sim"])


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over a number of tasks that does not grow with them: each task gives k rows a query."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["qid"], [F.desc("sim"), F.asc_nulls_last("key")], k)


def query_blocks(queries: DataFrame, key: str, vec: str, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stated queries in blocks of at most ``size`` bytes."""
    ids: list[int] = []
    vecs: list[np.ndarray] = []
    held = 0
    for r in queries.select(key, vec).where(F.col(vec).isNotNull()).toLocalIterator():
        ids.append(r[0])
        vecs.append(np.asarray(r[1], np.float64))
        held += vecs[-1].nbytes
        if held >= size:
            yield np.array(ids), np.stack(vecs)
            ids, vecs, held = [], [], 0
    if ids:
        yield np.array(ids), np.stack(vecs)


def knn(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", digits: int = 12) -> DataFrame:
    """``(qid, key, sim, rank)``: the k most similar rows of each query, all compared; ties go to the smaller key.

    Rows meet a block of queries in tiles of bounded size; a task keeps k rows a query and gives them once it has seen all of its own. A
    window finds the k best of those.
    """
    out = None
    spark = rows.sparkSession
    for ids, q in query_blocks(queries, key, vec):
        shared = spark.sparkContext.broadcast((ids, _unit(q)))

        def scan(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Nearest(*shared.value, k, digits)
            for batch in it:
                _, keys, unit = _batch(batch, key, vec)
                if len(keys):
                    best.add(keys, unit)
            yield from best.rows()

        got = _spread(rows.select(key, vec)).mapInArrow(scan, _FOUND)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], _FOUND)
    return _nearest(out, k)


def quantise(v: Column) -> Column:
    """Components of a unit vector as whole numbers from -127 to 127."""
    return F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 127.0 + 0.5), F.lit(127)), F.lit(-127)).cast("int"))


def int8_scan(rows: DataFrame, queries: DataFrame, candidates: DataFrame | None, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """As :func:`knn` on quantised vectors and over ``candidates`` only, a table of keys; keys without a vector drop out."""
    some = rows if candidates is None else rows.join(candidates.select(key).distinct(), key, "left_semi")
    return knn(some.select(key, quantise(F.col(vec)).alias(vec)), queries.select(key, quantise(F.col(vec)).alias(vec)), k, key, vec)


def centroids(rows: DataFrame, lists: int, sample: int = 20_000, rounds: int = 8, key: str = "vec_id", vec: str = "embedding") -> np.ndarray:
    """Middles of lists by spherical k-means on at most ``sample`` rows, the first in order of a hash of their keys."""
    given = rows.where(F.col(vec).isNotNull())
    # tasks give up only hashes that can be among the first, so that the sample's size is all that one task meets
    share = min(1.0, (1.2 * sample + 1000) / max(given.count(), 1))
    most = F.lit(min(int(-(2.0**63) + share * 2.0**64), (1 << 63) - 1))
    some = given.where(F.xxhash64(key) <= most).orderBy(F.xxhash64(key), key).limit(sample).select(vec).collect()
    if not some:
        return np.zeros((0, 0))
    m = _unit(np.array([r[0] for r in some], np.float64))
    c = m[np.linspace(0, len(m) - 1, min(lists, len(m))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(m[x : x + 1024] @ c.T).argmax(axis=1) for x in range(0, len(m), 1024)])
        for i in range(len(c)):
            if (near == i).any():
                c[i] = m[near == i].sum(axis=0)
        c = _unit(c)
    return c


def assign(rows: DataFrame, middles: np.ndarray, probes: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(key, vec, list)``: each row with its nearest lists, as many as ``probes``."""
    shared = rows.sparkSession.sparkContext.broadcast(middles)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middles = shared.value
        step = max(1, TILE // len(middles))
        for batch in it:
            batch, _, unit = _batch(batch, key, vec)
            for i in range(0, batch.num_rows, step):
                sim = unit[i : i + step] @ middles.T
                near = sim.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-sim, axis=1, kind="stable")[:, :probes]
                part = batch.slice(i, step)
                each = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(key).take(each), part.column(vec).take(each), pa.array(near.ravel().astype(np.int64))], [key, vec, "list"])

    return rows.select(F.col(key).cast("long").alias(key), F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, f"{key} long, {vec} array<double>, list long")


def nearest_lists(rows: DataFrame, middles: np.ndarray, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(qid, lists)``: all lists in order of nearness, one row a query."""
    shared = rows.sparkSession.sparkContext.broadcast(middles)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch, _, unit = _batch(batch, key, vec)
            if batch.num_rows:
                near = [np.argsort(-(u @ shared.value.T), kind="stable") for u in unit]
                yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array(near, pa.list_(pa.int64()))], ["qid", "lists"])

    return rows.select(key, vec).mapInArrow(run, "qid long, lists array<long>")


def list_count(n: int) -> int:
    """Lists for so many rows: the square root, 4096 at most, so that the middles stay small."""
    return max(1, min(round(n**0.5), 4096))


def probes_for(rows: DataFrame, middles: np.ndarray, k: int, target: float, key: str, vec: str, most: int = 100, homes: DataFrame | None = None) -> int:
    """The least number of lists that finds ``target`` of the true neighbours of at most ``most`` rows, the first in order of a hash other than the sample's.

    The neighbours are found by comparing these rows with all others. ``homes`` is a table of all rows with their lists, where one is at hand.
    """
    asked = cut(rows.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit("probe")), key).limit(most).select(key, vec), "asked")
    truth = cut(knn(rows, asked, k, key, vec).select("qid", "key"), "truth")
    homes = assign(rows, middles, 1, key, vec) if homes is None else homes
    homes = homes.select(F.col(key).alias("key"), "list")
    near = nearest_lists(asked, middles, key, vec)
    depth = homes.join(F.broadcast(truth), "key").join(near, "qid").select(F.array_position("lists", F.col("list")).alias("d")).groupBy("d").count().orderBy("d").collect()
    total, have = sum(r["count"] for r in depth), 0
    for r in depth:
        have += r["count"]
        if have >= target * total:
            return int(r["d"])
    return len(middles)


def ann(rows: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None, key: str = "vec_id", vec: str = "embedding", allowed: DataFrame | None = None, target: float = 0.97) -> DataFrame:
    """Approximate neighbours ``(qid, key, sim, rank)``: each row stands in one list, queries look into their nearest ``probes``.

    All rows are indexed. Without ``lists`` their number follows the table's; without ``probes`` it is measured, so that ``target`` of the
    true neighbours of some rows are found. ``allowed`` is a table of keys: only these are ranked, by the same index. The rows are written
    once in order of their lists, so that a task compares each list of its own with the queries that look into it, tile by tile; k rows a
    query stay. A long list is divided among tasks.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).cast("long").alias(key), F.transform(vec, lambda x: x.cast("double")).alias(vec))
    queries = queries.select(key, F.transform(vec, lambda x: x.cast("double")).alias(vec))
    none = spark.createDataFrame([], _FOUND)
    c = centroids(rows, lists or list_count(rows.where(F.col(vec).isNotNull()).count()), key=key, vec=vec)
    if not len(c):
        return none.withColumn("rank", F.lit(1))
    homes = cut(assign(_spread(rows), c, 1, key, vec).repartitionByRange(2 * spark.sparkContext.defaultParallelism, "list", key).sortWithinPartitions("list"), "lists")
    probes = probes or probes_for(rows, c, k, target, key, vec, homes=homes)
    ranked = homes if allowed is None else homes.join(allowed.select(key).distinct(), key, "left_semi").sortWithinPartitions("list")
    out = none
    for ids, q in query_blocks(queries, key, vec):
        unit = _unit(q)
        shared = spark.sparkContext.broadcast((ids, unit, _looks(unit, c, probes)))

        def scan(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, unit, looks = shared.value
            best = _Nearest(ids, unit, k)
            for batch in it:
                batch, keys, m = _batch(batch, key, vec)
                home = batch.column("list").to_numpy()
                edge = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
                for a, z in zip(edge, edge[1:], strict=False):
                    best.add(keys[a:z], m[a:z], np.flatnonzero(np.unpackbits(looks[home[a]], count=len(ids))))
            yield from best.rows()

        out = out.unionByName(ranked.mapInArrow(scan, _FOUND))
    return _nearest(out, k)


def _looks(unit: np.ndarray, middles: np.ndarray, probes: int) -> np.ndarray:
    """For each list one bit a query: whether it is among the query's nearest ``probes``."""
    out = np.zeros((len(middles), -(-len(unit) // 8)), np.uint8)
    for i in range(0, len(unit), 1024):
        near = np.argsort(-(unit[i : i + 1024] @ middles.T), axis=1, kind="stable")[:, :probes]
        part = np.zeros((len(middles), len(near)), bool)
        part[near, np.arange(len(near))[:, None]] = True
        out[:, i // 8 : i // 8 + -(-len(near) // 8)] = np.packbits(part, axis=1)
    return out


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with rows of ``changes`` added or put in place of those with their key; repeated keys in ``changes`` must not occur."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def check_dimension(rows: DataFrame, vec: str, size: int) -> DataFrame:
    """Raises while running if a vector has another dimension."""
    return rows.withColumn(vec, F.when(F.size(vec) == size, F.col(vec)).otherwise(F.raise_error(F.lit(f"vectors have {size} components"))))


def ids_divisible(df: DataFrame, key: str, by: int = 20) -> DataFrame:
    """The stated query set of searches."""
    return df.where(F.col(key) % by == 0)


def recall(found: DataFrame, truth: DataFrame, by: Sequence[str] = ("qid", "key")) -> DataFrame:
    """Share of the true rows that were found."""
    hit = truth.select(*by).join(found.select(*by).withColumn("hit", F.lit(1)), list(by), "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
