"""An inverted index kept as files: segments of postings, tombstones and a manifest that is published atomically.

Documents stand in shards of some thousand, formed where the documents are read: no text is shuffled; a shard's postings of a term are one row, as packed arrays of places, counts and the
largest count (rows are sorted by term within their files, so that row groups without an asked term are skipped). A batch of queries
meets each shard in one task, which gives its best rows, so that what is shuffled are the asked terms' arrays and k rows for each query
and shard; neither texts nor (query, term, document) rows are. Statistics of the collection stand in the manifest.

Additions and deletions are staged and become visible together with the next commit, which writes the next manifest under a temporary name and
renames it; a manifest of that number already there means that another writer came first. Readers hold the manifest that they opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import scalars as S
from tessera.functions.stemming import stems
from tessera.operators import lexical
from tessera.plans.lineage import cut_at, delete

#: Goes up with any change of the files; an index of another version is refused.
SCHEMA_VERSION = 1
#: Documents of a shard, about, and of a segment from which merging leaves it alone unless documents were removed from it.
SHARD_DOCS, MERGE_DOCS = 2048, 500_000
#: Tokens with which a shard is closed at the latest, so that a task can hold it.
SHARD_TOKENS = 4 << 20
_OWN = ("_shard", "_slot", "_title_len", "_body_len")
_POSTINGS = "shard int, term string, slots array<int>, title array<int>, body array<int>"


class IndexRefused(ValueError):
    """The index on disk cannot be used as asked."""


def _ragged(lists: Sequence[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if len(lists) else np.zeros(0, np.int32), pa.int32()))


def _posting_rows(shard: int, terms: pa.Array, term: np.ndarray, slot: np.ndarray, title: np.ndarray, body: np.ndarray) -> pa.Table:
    """One row for each term, in order of terms, with the summed counts of each slot."""
    rank = np.empty(len(terms), np.int64)
    order = pc.array_sort_indices(terms).to_numpy()
    rank[order] = np.arange(len(terms))
    cell, at = np.unique(rank[term] << 32 | slot.astype(np.int64), return_inverse=True)
    tt, tb = (np.bincount(at, weights=x, minlength=len(cell)).astype(np.int32) for x in (title, body))
    edge = np.flatnonzero(np.r_[True, cell[1:] >> 32 != cell[:-1] >> 32][: len(cell)])
    ends = pa.array(np.r_[edge, len(cell)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cell & 0xFFFFFFFF).astype(np.int32), tt, tb)]
    named = terms.take(pa.array(order)).take(pa.array(cell[edge] >> 32))
    return pa.table([pa.array(np.full(len(edge), shard, np.int32)), named, *lists], ["shard", "term", "slots", "title", "body"])


def _write(postings: DataFrame, path: str) -> None:
    some = lambda c: F.size(F.filter(c, lambda x: x > 0))
    postings = postings.withColumns({"max_title": F.array_max("title"), "max_body": F.array_max("body"), "df_title": some("title"), "df_body": some("body")})
    postings.sortWithinPartitions("term", "shard").write.option("parquet.block.size", 8 << 20).parquet(path)


def _gather(title: pa.ListArray, body: pa.ListArray) -> pa.Table:
    """The postings of a shard's documents, whose slots are their places."""
    lists = (title, body)
    words = pa.concat_arrays([pc.list_flatten(c).cast(pa.large_string()) for c in lists])
    slot = np.concatenate([np.repeat(np.arange(len(c)), pc.fill_null(pc.list_value_length(c), 0).to_numpy()) for c in lists])
    coded = pc.dictionary_encode(words)
    in_body = np.arange(len(slot)) >= len(slot) - len(pc.list_flatten(body))
    return _posting_rows(0, coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), slot, (~in_body).astype(float), in_body.astype(float))


def _shards(kept: Sequence[str], schema: pa.Schema, size: int):
    """Turns a partition's documents into shards of ``size`` documents, fewer where they are long: a row for each document and one for each term."""

    def rows(t: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
        own = {c: t.column(c) for c in (*kept, "_title_len", "_body_len")}
        own |= {"_slot": pa.array(np.arange(t.num_rows, dtype=np.int32)), "_shard": pa.array(np.full(t.num_rows, shard))}
        posts = _gather(*(t.column(c).combine_chunks() for c in ("title_tokens", "body_tokens")))
        posts = {c: posts.column(c) for c in ("term", "slots", "title", "body")} | {"_shard": pa.array(np.full(posts.num_rows, shard))}
        for part in (own, posts):
            n = len(part["_shard"])
            yield from pa.table([part[f"{f.name}"].cast(f.type) if f.name in part else pa.nulls(n, f.type) for f in schema], schema=schema).to_batches(max_chunksize=1 << 14)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, long = TaskContext.get().partitionId() << 32, [], 0
        for batch in it:
            while batch.num_rows:
                some = batch.slice(0, size - sum(b.num_rows for b in held))
                length = np.cumsum(pc.add(some.column("_title_len"), some.column("_body_len")).to_numpy())
                some = some.slice(0, max(1, int(np.searchsorted(length, SHARD_TOKENS - long, "right"))))
                held.append(some)
                long += int(length[some.num_rows - 1])
                batch = batch.slice(some.num_rows)
                if long >= SHARD_TOKENS or sum(b.num_rows for b in held) >= size or batch.num_rows:
                    yield from rows(pa.Table.from_batches(held), first)
                    first, held, long = first + 1, [], 0
        if held:
            yield from rows(pa.Table.from_batches(held), first)

    return run


def _restem(key: tuple, t: pa.Table) -> pa.Table:
    """A shard's postings by stem: the lists of terms with one stem become one."""
    n = pc.list_value_length(t.column("slots").combine_chunks()).to_numpy()
    coded = pc.dictionary_encode(t.column("stem").combine_chunks())
    term = np.repeat(coded.indices.to_numpy().astype(np.int64), n)
    return _posting_rows(key[0].as_py(), coded.dictionary, term, *(pc.list_flatten(t.column(c).combine_chunks()).to_numpy() for c in ("slots", "title", "body")))


def _flags(key: tuple, t: pa.Table) -> pa.Table:
    """For each slot of a shard whether its document is there."""
    slot = t.column("slot").to_numpy()
    live = np.zeros(slot.max() + 1, bool)
    live[slot] = True
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([live], pa.list_(pa.bool_()))], ["shard", "live"])


class StoredIndex:
    """One index under a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest
        self._staged: list[dict] = []
        self._tombs: list[str] = []

    # -- files ---------------------------------------------------------------------------------------------------------

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, stem: bool = True) -> StoredIndex:
        """The index with its last manifest; an empty one where there is none. One of another schema version or tokenizer is refused."""
        own = cls(spark, path.rstrip("/"), {"schema": SCHEMA_VERSION, "number": 0, "stem": stem, "segments": [], "tombstones": []})
        fs, folder = own._fs(), own._at("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        names = sorted(n for n in names if n.startswith("m-"))
        if not names:
            return own
        own.manifest = json.loads(spark.read.text(f"{own.path}/manifests/{names[-1]}", wholetext=True).first()[0])
        if own.manifest["schema"] != SCHEMA_VERSION:
            raise IndexRefused(f"index schema {own.manifest['schema']}, but {SCHEMA_VERSION} is read here: index the documents again")
        if own.manifest["stem"] != stem:
            raise IndexRefused("the index was built with another tokenizer")
        return own

    # -- writing -------------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, key: str = "key", title: Column | None = None, body: Column | None = None, store: Sequence[str] = (), shard_docs: int = SHARD_DOCS) -> None:
        """Stages documents, visible after the next commit. ``store`` names columns that are kept for results and filters; texts are not kept.

        Null titles and bodies are empty. Keys should be unique; repeated ones are separate documents. No documents stage nothing.
        """
        body = F.col("text") if body is None else body
        title = S.title_of(body) if title is None else title
        toks = [S.tokens(F.coalesce(c, F.lit(""))).alias(a) for c, a in ((title, "title_tokens"), (body, "body_tokens"))]
        own = docs.select(F.col(key).alias("key"), *(c for c in store if c != "key"), *toks).withColumns({"_title_len": F.size("title_tokens"), "_body_len": F.size("body_tokens")})
        kept = [c for c in own.columns if c not in ("title_tokens", "body_tokens", "_title_len", "_body_len")]
        row = T.StructType([*(T.StructField(c, own.schema[c].dataType) for c in kept), *(T.StructField(c, T.IntegerType()) for c in ("_title_len", "_body_len", "_slot")), T.StructField("_shard", T.LongType()), T.StructField("term", T.StringType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("slots", "title", "body"))])
        # stored columns may have the names of the postings' own
        names = {c: f"_kept{i}" for i, c in enumerate(kept)}
        row = T.StructType([T.StructField(names.get(f.name, f.name) if i < len(kept) else f.name, f.dataType) for i, f in enumerate(row)])
        own = own.withColumnsRenamed(names)
        staged, spath = cut_at(own.mapInArrow(_shards(list(names.values()), to_arrow_schema(row), shard_docs), row), "staged")
        one = staged.where("_slot is not null")
        n, title_sum, body_sum = one.agg(F.count("*"), F.sum("_title_len"), F.sum("_body_len")).first()
        if not n:
            delete(self.spark, spath)
            return
        # shards are numbered without gaps: one number for each goes through the driver
        found = [r[0] for r in one.select("_shard").distinct().orderBy("_shard").collect()]
        numbers = F.broadcast(self.spark.createDataFrame(list(enumerate(found)), "shard int, _shard long"))
        at = f"{self.path}/segments/{uuid.uuid4().hex}"
        one.join(numbers, "_shard").select(*(F.col(v).alias(k) for k, v in names.items()), "_title_len", "_body_len", F.col("shard").alias("_shard"), "_slot").write.parquet(f"{at}/docs")
        raw = staged.where("_slot is null").join(numbers, "_shard").select("shard", "term", "slots", "title", "body")
        paths = [spath]
        if self.manifest["stem"]:
            # the cascade runs once for each distinct term, and its stems are joined back
            stem, rpath = cut_at(stems(raw), "stems")
            paths.append(rpath)
            raw = raw.join(stem, "term").drop("term").groupBy("shard").applyInArrow(_restem, _POSTINGS)
        _write(raw, f"{at}/postings")
        delete(self.spark, *paths)
        self._staged.append({"path": at[len(self.path) + 1 :], "docs": n, "shards": len(found), "title": int(title_sum), "body": int(body_sum)})

    def remove(self, keys: DataFrame, key: str = "key") -> None:
        """Stages deletions by key: of all documents with the key that the next commit's predecessor has. Unknown keys do no harm."""
        at = f"{self.path}/tombstones/{uuid.uuid4().hex}"
        keys.select(F.col(key).alias("key")).where("key is not null").distinct().write.parquet(at)
        self._tombs.append(at[len(self.path) + 1 :])

    def commit(self) -> None:
        """Publishes what is staged, and reads it from now on. A document added and removed by key in one commit stays."""
        new = dict(self.manifest, number=self.manifest["number"] + 1)
        old = [s["path"] for s in self.manifest["segments"]]
        new["segments"] = [*self.manifest["segments"], *self._staged]
        new["tombstones"] = [*self.manifest["tombstones"], *({"path": t, "segments": old} for t in self._tombs)]
        self._publish(new)
        self._staged, self._tombs = [], []

    def _publish(self, new: dict) -> None:
        fs = self._fs()
        final, tmp = self._at("manifests", f"m-{new['number']:09d}.json"), self._at("manifests", f"tmp-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise IndexRefused(f"another writer has published manifest {new['number']}: open the index again")
        self.manifest = new

    def merge(self, most: int = MERGE_DOCS) -> None:
        """Joins segments of fewer than ``most`` documents, and those of any size that a tombstone names, into one without their removed documents.

        The result is published at once. No removed document is left, so that ``most`` decides on files only, not on statistics.
        """
        removed = {p for t in self.manifest["tombstones"] for p in t["segments"]}
        joined = [s for s in self.manifest["segments"] if s["docs"] < most or s["path"] in removed]
        if len(joined) < 2 and not removed:
            return
        paths = [s["path"] for s in joined]
        at, base = f"{self.path}/segments/{uuid.uuid4().hex}", 0
        docs, posts = [], []
        for s in joined:
            live = self._live([s]).withColumn("_shard", F.col("_shard") + base).drop("_segment")
            docs.append(live)
            posts.append(self.spark.read.parquet(f"{self.path}/{s['path']}/postings").withColumn("shard", F.col("shard") + base))
            base += s["shards"]
        kept, kpath = cut_at(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), docs), "kept")
        kept.write.parquet(f"{at}/docs")
        # a flag for each slot, looked up by place, in a small table that every task can hold
        flags, fpath = cut_at(kept.select(F.col("_shard").alias("shard"), F.col("_slot").alias("slot")).groupBy("shard").applyInArrow(_flags, "shard int, live array<boolean>"), "flags")
        keep = reduce(DataFrame.unionByName, posts).join(flags, "shard")
        x = F.arrays_zip("slots", "title", "body")
        keep = keep.withColumn("x", F.filter(x, lambda x: F.coalesce(F.get("live", x["slots"]), F.lit(False))) if removed else x)
        keep = keep.where(F.size("x") > 0).select("shard", "term", *(F.col(f"x.{c}").alias(c) for c in ("slots", "title", "body")))
        _write(keep, f"{at}/postings")
        delete(self.spark, fpath)
        n, title, body = kept.agg(F.count("*"), F.sum("_title_len"), F.sum("_body_len")).first()
        delete(self.spark, kpath)
        new = dict(self.manifest, number=self.manifest["number"] + 1)
        new["segments"] = [s for s in self.manifest["segments"] if s["path"] not in paths]
        if n:
            new["segments"].append({"path": at[len(self.path) + 1 :], "docs": n, "shards": base, "title": int(title), "body": int(body)})
        left = [{"path": t["path"], "segments": [p for p in t["segments"] if p not in paths]} for t in self.manifest["tombstones"]]
        new["tombstones"] = [t for t in left if t["segments"]]
        self._publish(new)

    def vacuum(self) -> None:
        """Deletes the files of segments and tombstones that the last manifest does not name; readers of earlier ones lose them."""
        named = {s["path"] for s in self.manifest["segments"]} | {t["path"] for t in self.manifest["tombstones"]}
        fs = self._fs()
        for top in ("segments", "tombstones"):
            if fs.exists(self._at(top)):
                delete(self.spark, *(f"{self.path}/{top}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(self._at(top))) if f"{top}/{n}" not in named))

    # -- reading -------------------------------------------------------------------------------------------------------

    def _live(self, segments: Sequence[dict]) -> DataFrame:
        """The documents of segments that no tombstone takes away, with their segment's place in the manifest."""
        out = []
        order = [s["path"] for s in self.manifest["segments"]]
        for s in segments:
            docs = self.spark.read.parquet(f"{self.path}/{s['path']}/docs").withColumn("_segment", F.lit(order.index(s["path"])))
            for t in self.manifest["tombstones"]:
                if s["path"] in t["segments"]:
                    docs = docs.join(self.spark.read.parquet(f"{self.path}/{t['path']}"), "key", "left_anti")
            out.append(docs)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)

    def documents(self) -> DataFrame:
        """The stored columns of all documents that are visible."""
        if not self.manifest["segments"]:
            raise IndexRefused("the index has no documents")
        return self._live(self.manifest["segments"]).drop("_segment", *_OWN)

    def lookup(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """The stored columns of the documents with these keys; unknown and removed ones give no rows."""
        return self.documents().join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi")

    def count(self) -> int:
        """Visible documents."""
        return self.documents().count() if self.manifest["segments"] else 0

    def totals(self) -> tuple[int, float, float]:
        """Documents and mean lengths as the scores use them: removed ones count until they are merged away."""
        n, title, body = (sum(s[c] for s in self.manifest["segments"]) for c in ("docs", "title", "body"))
        return n, title / n if n else 0.0, body / n if n else 0.0

    def postings(self) -> DataFrame:
        """``(segment, shard, term, slots, title, body, max_title, max_body, df_title, df_body)`` of all segments."""
        each = [self.spark.read.parquet(f"{self.path}/{s['path']}/postings").withColumn("segment", F.lit(i)) for i, s in enumerate(self.manifest["segments"])]
        return reduce(DataFrame.unionByName, each)

    def query_terms(self, queries: DataFrame, qid: str, text: Column) -> DataFrame:
        """Distinct terms of each query as the index has them."""
        terms = lexical.query_terms(queries, qid, text)
        return terms.join(stems(terms), "term").select("qid", F.col("stem").alias("term")).distinct() if self.manifest["stem"] else terms

    def statistics(self, terms: DataFrame) -> DataFrame:
        """``(term, df_title, df_body)`` of terms that some document has."""
        found = self.postings().join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        return found.groupBy("term").agg(F.sum("df_title").alias("df_title"), F.sum("df_body").alias("df_body"))

    def bm25(self, qterms: DataFrame, k: int = 1000, k1: float = 1.2, b: float = 0.75, boost: float = 2.0, keep: Column | None = None, body: float = 1.0) -> DataFrame:
        """``(qid, key, bm25, rank)``: the k best documents of each query, any term sufficing, ties going to the smaller key.

        ``boost`` and ``body`` weigh the two fields; a field of weight 0 finds nothing. Statistics are those of the whole index, also when ``keep``, a
        condition on stored columns, filters what is ranked. Queries come in blocks (see :func:`lexical.term_blocks`); a query without
        terms gives no rows. A term whose largest possible part of a score is 0 is not read.
        """
        spark, schema = self.spark, dict(qterms.dtypes)
        empty = f"qid {schema['qid']}, key long, bm25 double, rank int"
        if not self.manifest["segments"]:
            return spark.createDataFrame([], empty)
        live = self._live(self.manifest["segments"])
        key = dict(live.dtypes)["key"]
        if keep is not None:
            live = live.where(keep)
        cols = {c: F.collect_list(c) for c in ("_slot", "key", "_title_len", "_body_len")}
        lens = live.groupBy(F.col("_segment").alias("segment"), F.col("_shard").alias("shard")).agg(*(v.alias(c) for c, v in cols.items()))
        n, *means = self.totals()
        every, out = self.postings(), None
        for block in lexical.term_blocks(qterms, k):
            asked = spark.createDataFrame(pa.table({"t": pa.array(np.arange(len(block.terms), dtype=np.int32)), "term": pa.array(block.terms, pa.string())}))
            found = every.where((F.col("max_title") * boost > 0) | (F.col("max_body") * body > 0)).join(F.broadcast(asked), "term")
            seen = np.zeros((2, len(block.terms)))
            for t, dt, db in found.groupBy("t").agg(F.sum("df_title"), F.sum("df_body")).toLocalIterator():
                seen[:, t] = dt, db
            weights = np.array([[boost], [body]]) * np.log(1 + (n - seen + 0.5) / (seen + 0.5)) * (k1 + 1)
            shared = spark.sparkContext.broadcast((block, weights, [m or 1.0 for m in means]))
            score = _scorer(shared, k, k1, b)
            pairs = found.select("segment", "shard", "t", "slots", "title", "body").groupBy("segment", "shard").cogroup(lens.groupBy("segment", "shard"))
            got = pairs.applyInArrow(score, f"q int, key {key}, bm25 double")
            names = spark.createDataFrame(list(enumerate(block.qids)), f"q int, qid {schema['qid']}")
            got = got.join(F.broadcast(names), "q").select("qid", "key", "bm25")
            out = got if out is None else out.unionByName(got)
        if out is None:
            return spark.createDataFrame([], empty)
        return lexical.top_k(out, ["qid"], [F.desc(F.round("bm25", 9)), F.asc("key")], k)


def _scorer(shared, k: int, k1: float, b: float):
    """Scores of a shard: its asked postings against its documents' keys and lengths."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, weights, means = shared.value
        best = lexical._Best(len(block.qids), k)
        if left.num_rows and right.num_rows:
            own = {c: pc.list_flatten(right.column(c).combine_chunks()) for c in ("_slot", "key", "_title_len", "_body_len")}
            slots = own["_slot"].to_numpy()
            place = np.full(int(slots.max()) + 1, -1)
            place[slots] = np.arange(len(slots))
            lists = left.column("slots").combine_chunks()
            slot = pc.list_flatten(lists).to_numpy()
            known = slot < len(place)
            row = np.where(known, place[np.minimum(slot, len(place) - 1)], -1)
            term = np.repeat(left.column("t").to_numpy(), pc.list_value_length(lists).to_numpy())
            s = np.zeros(len(row))
            for f, (c, length) in enumerate((("title", "_title_len"), ("body", "_body_len"))):
                tf = pc.list_flatten(left.column(c).combine_chunks()).to_numpy().astype(np.float64)
                norm = k1 * (1 - b + b * own[length].to_numpy() / means[f])
                s += weights[f, term] * np.divide(tf, tf + norm[row], out=np.zeros(len(row)), where=tf > 0)
            at = np.flatnonzero((row >= 0) & (s > 0))
            at = at[np.argsort(row[at], kind="stable")]
            row, term, s = row[at], term[at], s[at]
            step = max(1, min((1 << 20) // len(block.qids), (1 << 22) // len(block.owner)))
            for i in range(0, len(slots), step):
                x, y = np.searchsorted(row, [i, i + step])
                if x < y:
                    m = min(step, len(slots) - i)
                    cell, part = block.spread(row[x:y] - i, term[x:y], s[x:y])
                    best.add(own["key"].slice(i, m), np.bincount(cell, weights=part, minlength=m * len(block.qids)).reshape(m, -1))
        rows = list(best.rows())
        if rows:
            return pa.Table.from_batches(rows)
        return pa.table({"q": pa.array([], pa.int32()), "key": pa.array([], right.schema.field("key").type.value_type), "bm25": pa.array([], pa.float64())})

    return score
