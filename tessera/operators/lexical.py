"""Full-text ranking over an inverted index kept as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.plans.lineage import cut

#: Terms of queries that one pass over the documents takes along, and rows that a task keeps in it.
BLOCK_TERMS, BLOCK_ROWS = 1 << 18, 1 << 21
_NONE = object()


@dataclass(frozen=True)
class Block:
    """Some queries: their ids, their terms, and for each term the queries (by place) that ask for it, ``owner[starts[t]:starts[t + 1]]``."""

    qids: list[Any]
    terms: list[str]
    starts: np.ndarray
    owner: np.ndarray

    def spread(self, row: np.ndarray, term: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of a rows-by-queries matrix and what is added there: each row's term counts for every query that asks for it."""
        times = np.diff(self.starts)[term]
        each = np.repeat(np.arange(len(term)), times)
        owner = self.owner[self.starts[term][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
        return row[each] * len(self.qids) + owner, s[each]


def index_documents(docs: DataFrame, key: str = "doc_id", title: Column | None = None, body: Column | None = None) -> DataFrame:
    """``(key, title_tokens, body_tokens, title_len, body_len)``: the documents as the ranking sees them."""
    body = F.col("text") if body is None else body
    title = S.title_of(body) if title is None else title
    out = docs.select(F.col(key).alias("key"), S.tokens(F.coalesce(title, F.lit(""))).alias("title_tokens"), S.tokens(F.coalesce(body, F.lit(""))).alias("body_tokens"))
    return out.withColumns({"title_len": F.size("title_tokens"), "body_len": F.size("body_tokens")})


def postings(index: DataFrame) -> DataFrame:
    """``(term, key, tf_title, tf_body)``, one row for each term of a document."""
    each = index.select("key", F.explode(F.concat(F.transform("title_tokens", lambda t: F.struct(t.alias("term"), F.lit(1).alias("t"), F.lit(0).alias("b"))), F.transform("body_tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("t"), F.lit(1).alias("b"))))).alias("x"))
    return each.groupBy(F.col("x.term").alias("term"), "key").agg(F.sum("x.t").alias("tf_title"), F.sum("x.b").alias("tf_body"))


def query_terms(queries: DataFrame, qid: str, text: Column, most: int | None = None) -> DataFrame:
    """Distinct terms of each query; ``most`` keeps the first few tokens of the query."""
    toks = S.tokens(text)
    toks = F.slice(toks, 1, most) if most else toks
    return queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(toks)).alias("term"))


def term_blocks(qterms: DataFrame, k: int) -> Iterator[Block]:
    """The stated queries in blocks that a task can hold: at most ``BLOCK_TERMS`` terms and ``BLOCK_ROWS`` kept rows, or one query."""
    qids: list[Any] = []
    terms: list[str] = []
    owner: list[int] = []
    last: Any = _NONE
    for qid, term in qterms.select("qid", "term").where("term is not null").distinct().orderBy("qid").toLocalIterator():
        if last is _NONE or qid != last:
            if qids and (len(terms) >= BLOCK_TERMS or (len(qids) + 1) * k > BLOCK_ROWS):
                yield _block(qids, terms, owner)
                qids, terms, owner = [], [], []
            qids.append(qid)
            last = qid
        terms.append(term)
        owner.append(len(qids) - 1)
    if qids:
        yield _block(qids, terms, owner)


def _block(qids: list[Any], terms: list[str], owner: list[int]) -> Block:
    vocabulary, ids = np.unique(np.array(terms, dtype=object), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(vocabulary)))])
    return Block(qids, list(vocabulary), starts, np.asarray(owner, np.int64)[order])


def _rows(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())


def _term_counts(index: DataFrame, terms: list[str]) -> DataFrame:
    """``(key, kept, title_len, body_len, terms, tt, tb)``: of each document only the counts of terms that are asked for, as numbers."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, size = pa.array(shared.value, pa.string()), len(shared.value)
        for batch in it:
            cells, fields = [], []
            for f, c in enumerate(("title_tokens", "body_tokens")):
                ids = pc.fill_null(pc.index_in(batch.column(c).flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                cells.append((_rows(batch.column(c)).astype(np.int64) * size + ids)[ids >= 0])
                fields.append(np.full(len(cells[-1]), f))
            pairs, at = np.unique(np.concatenate(cells), return_inverse=True)
            tb = np.bincount(at, weights=np.concatenate(fields), minlength=len(pairs)).astype(np.int32)
            tt = np.bincount(at, minlength=len(pairs)).astype(np.int32) - tb
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((pairs % size).astype(np.int32), tt, tb)]
            lengths = [pc.list_value_length(batch.column(c)) for c in ("title_tokens", "body_tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("kept"), *lengths, *lists], ["key", "kept", "title_len", "body_len", "terms", "tt", "tb"])

    kind = dict(index.dtypes)["key"]
    return index.mapInArrow(count, f"key {kind}, kept boolean, title_len int, body_len int, terms array<int>, tt array<int>, tb array<int>")


def bm25(index: DataFrame, qterms: DataFrame, k: int = 1000, k1: float = 1.2, b: float = 0.75, boost: float = 2.0, keep: Column | None = None) -> DataFrame:
    """``(qid, key, bm25, rank)``: the k best documents of each query, any term sufficing, title matches counting ``boost`` times.

    Collection statistics are those of the whole index, also when ``keep`` (a condition on columns of ``index``)
    filters what is ranked. The texts are read once for a block of the stated queries: what stays of a document is its
    counts of the block's terms, written to the shared folder. From there come the statistics, one row a term, and the scores: each
    document meets the whole block where it is read, and neither postings nor (term, document, query) rows are shuffled. A task
    keeps k rows of a query, ties going to the smaller key, and a window finds the k best of those. Queries without
    terms and documents without any of a query's terms give no rows.
    """
    spark = index.sparkSession
    key, qid = dict(index.dtypes)["key"], dict(qterms.dtypes)["qid"]
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    out = None
    for block in term_blocks(qterms, k):
        counted = cut(_term_counts(index.select("key", kept.alias("kept"), "title_tokens", "body_tokens"), block.terms), "term-counts")
        n, *means = counted.agg(F.count("*"), F.avg("title_len"), F.avg("body_len")).first()
        seen = np.zeros((2, len(block.terms)))
        each = counted.select(F.explode(F.arrays_zip("terms", "tt", "tb")).alias("x")).groupBy("x.terms")
        for t, dt, db in each.agg(F.count_if(F.expr("x.tt > 0")), F.count_if(F.expr("x.tb > 0"))).toLocalIterator():
            seen[:, t] = dt, db
        weights = np.array([[boost], [1.0]]) * np.log(1 + (n - seen + 0.5) / (seen + 0.5)) * (k1 + 1)
        shared = spark.sparkContext.broadcast((block, weights, [m or 1.0 for m in means]))

        def scan(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, weights, means = shared.value
            best = _Best(len(block.qids), k)
            step = max(1, min((1 << 20) // len(block.qids), (1 << 22) // len(block.owner)))
            for batch in it:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    row, term = _rows(part.column("terms")), part.column("terms").flatten().to_numpy()
                    s = np.zeros(len(row))
                    for f, (c, length) in enumerate((("tt", "title_len"), ("tb", "body_len"))):
                        tf = part.column(c).flatten().to_numpy().astype(np.float64)
                        norm = k1 * (1 - b + b * part.column(length).to_numpy() / means[f])
                        s += weights[f, term] * np.divide(tf, tf + norm[row], out=np.zeros(len(row)), where=tf > 0)
                    cell, s = block.spread(row, term, s)
                    scores = np.bincount(cell, weights=s, minlength=part.num_rows * len(block.qids))
                    best.add(part.column("key"), scores.reshape(part.num_rows, -1))
            yield from best.rows()

        got = counted.where("kept").select("key", "title_len", "body_len", "terms", "tt", "tb").mapInArrow(scan, f"q int, key {key}, bm25 double")
        names = spark.createDataFrame(list(enumerate(block.qids)), f"q int, qid {qid}")
        got = got.join(F.broadcast(names), "q").select("qid", "key", "bm25")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], f"qid {qid}, key {key}, bm25 double")
    return top_k(out, ["qid"], [F.desc(F.round("bm25", 9)), F.asc("key")], k)


class _Best:
    """The k best rows of each query so far; what cannot come among them any more is not taken up."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.held, self.parts = k, np.zeros(queries), 0, []
        self.limit = max(1 << 20, 2 * queries * k)

    def add(self, keys: pa.Array, scores: np.ndarray) -> None:
        row, q = np.nonzero((scores > 0) & (np.round(scores, 9) >= self.least))
        if len(row):
            self.parts.append(pa.table({"q": pa.array(q.astype(np.int32)), "key": keys.take(pa.array(row)), "bm25": pa.array(scores[row, q])}))
            self.held += len(row)
            if self.held > self.limit:
                self._shrink()

    def _shrink(self) -> None:
        rows = pa.concat_tables(self.parts)
        ranked = rows.append_column("s", pa.array(np.round(rows["bm25"].to_numpy(), 9)))
        order = [("q", "ascending"), ("s", "descending"), ("key", "ascending")]
        ranked = ranked.take(pc.sort_indices(ranked, sort_keys=order, null_placement="at_start"))
        q = ranked["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == self.k - 1
        self.least[q[full]] = ranked["s"].to_numpy()[full]
        self.parts = [ranked.filter(pa.array(place < self.k)).drop_columns(["s"]).combine_chunks()]
        self.held = self.parts[0].num_rows

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._shrink()
            yield from self.parts[0].to_batches(max_chunksize=1 << 16)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; each task keeps k rows of a group at most before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rare_filter(cells: Column, allowed: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose cell is among the allowed ones."""
    return docs.withColumn("_cell", cells).join(allowed.select(F.col("cell").alias("_cell")).distinct(), "_cell", "left_semi").drop("_cell")


def compose_filter(cell: Column | None = None, cells: Sequence[int] | None = None, ts: Column | None = None, after: int | None = None, before: int | None = None) -> Column:
    """Place and time: inclusive window; untagged rows never match a place."""
    out = F.lit(True)
    if cells is not None:
        out = out & F.coalesce(cell.isin(*cells) & (cell != 0), F.lit(False))
    if after is not None:
        out = out & F.coalesce(ts >= after, F.lit(False))
    if before is not None:
        out = out & F.coalesce(ts <= before, F.lit(False))
    return out


def heatmap(rows: DataFrame, cell: Column, ts: Column | None = None, after: int | None = None, parent: Column | None = None) -> DataFrame:
    """``(cell, count)``, most first: rows by cell or its parent; untagged and malformed cells are left out."""
    out = rows.where(cell.isNotNull() & (cell != 0))
    if after is not None:
        out = out.where(ts >= after)
    return out.groupBy((cell if parent is None else parent).alias("cell")).agg(F.count("*").alias("count")).where("cell is not null").orderBy(F.desc("count"), "cell")
