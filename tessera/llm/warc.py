"""Web archives: writing records, an index in order of address and time, and reading back by it.

Each task writes one archive and a *run*: its captures sorted by address key and time. Runs are dealt out by
ranges of the key; in each range a loser tree merges them, so that the ranges, one after another, are the
capture histories of all addresses in order. Reading goes by the merged index.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import storage
from tessera.plans.lineage import cut_at, new_path

#: Payloads of fewer bytes are stored each time.
LEAST_REVISIT = 1000
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def url_key(url: str | None) -> str:
    """Address for sorting: host labels from the last to the first, then port and path; no scheme, fragment or leading ``www``."""
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url or "")
    if not m:
        return ")" + (url or "")
    labels = m[1].lower().split(".")
    if labels[0] == "www":
        labels = labels[1:]
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return ",".join(reversed(labels)) + port + ")" + (m[3].lower() or "/")


def record(kind: str, rid: str, url: str | None, when: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One archive record; a revisit has the response's headers without its body."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {when}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the response in it, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    if fields["WARC-Type"] == "response" and len(payload) != int(inner["Content-Length"]):
        raise ValueError("payload cut short")
    return fields, inner, payload


def record_id(page_id: int | None) -> str:
    return f"urn:capture:page:{'none' if page_id is None else page_id}"


def page_of(rid: str) -> int | None:
    tail = rid.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


class LoserTree:
    """Merges sorted iterators with one comparison per level and item."""

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self.runs = list(runs)
        self.k = max(1, len(self.runs))
        self.head: list[tuple | None] = [next(r, None) for r in self.runs] + [None] * (self.k - len(self.runs))
        self.tree = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while (item := self.head[self.winner]) is not None:
            yield item
            w = self.winner
            self.head[w] = next(self.runs[w], None)
            node = (w + self.k) >> 1
            while node:
                if self._before(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node >>= 1
            self.winner = w


_INDEX = pa.schema([("key", pa.string()), ("ts", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
_INDEX_DDL = "key string, ts long, seq long, file string, start long, size long"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", time_col: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each row and returns the runs' entries: key, ts, seq (place in the run), file, start, size.

    Of rows with equal payloads of ``least`` bytes or more, the one with the largest id is a response, and the others are revisits of it.
    A row that repeats with this id is a response each time; rows with a null id revisit it; if all ids are null, all are responses.
    Null bodies are empty payloads. Without ``time_col`` (seconds) captures are dated by their id.
    """
    when = F.col(time_col).cast("long") if time_col else F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), when.alias("ts"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary").alias("body")).withColumn("digest", F.sha1("body"))
    large = F.octet_length("body") >= least
    target = src.where(large).groupBy("digest").agg(F.max("page_id").alias("target"))
    rows = src.join(target, "digest", "left").withColumn("refers", F.when(large & F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("page_id")), F.col("target")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = storage.at(folder)
        name = f"capture-{uuid.uuid4().hex}.warc.gz"
        entries, start, out = [], 0, None
        for b in it:
            ids, urls, times, digests, refers = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "ts", "digest", "refers"))
            for r, body in enumerate(P.raws(b, "body")):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/.{name}", compression=None)
                stamp = (EPOCH + dt.timedelta(seconds=(times[r] or 0) % 10**10)).strftime("%Y-%m-%dT%H:%M:%SZ")
                kind = "response" if refers[r] is None else "revisit"
                raw = gzip.compress(record(kind, record_id(ids[r]), urls[r], stamp, digests[r], body, record_id(refers[r])), 6, mtime=0)
                out.write(raw)
                entries.append((url_key(urls[r]), times[r] or 0, start, len(raw)))
                start += len(raw)
        if out is not None:
            out.close()
            storage.publish(fs, f"{base}/.{name}", f"{base}/{name}")
            entries.sort()
            for i in range(0, len(entries), 10_000):
                k, t, s, n = zip(*entries[i : i + 10_000], strict=True)
                yield P.batch(_INDEX, list(k), list(t), list(range(i, i + len(k))), [name] * len(k), list(s), list(n))

    return P.arrow(rows.select("page_id", "url", "ts", "body", "digest", "refers"), run, _INDEX_DDL)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Entries of all runs in order of key and time: ranges of the key, numbered ``part``, each merged from the runs' slices, with ``seq`` the place in it."""
    merged = pa.schema([pa.field("part", pa.int64()), *_INDEX])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for b in it:
            for key, ts, seq, file, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                slices.setdefault(file, []).append((seq, key, ts, file, start, size))
        # blocks of a run may arrive in any order; its own sequence restores them, without comparing keys
        ordered = [iter([x[1:] for x in sorted(v, key=lambda x: x[0])]) for _, v in sorted(slices.items())]
        held, part = [], TaskContext.get().partitionId()
        for seq, (key, ts, file, start, size) in enumerate(LoserTree(ordered)):
            held.append((part, key, ts, seq, file, start, size))
            if len(held) >= 10_000:
                yield P.batch(merged, *map(list, zip(*held, strict=True)))
                held = []
        if held:
            yield P.batch(merged, *map(list, zip(*held, strict=True)))

    # equal keys may be many: the time and place divide them
    return P.arrow(runs.repartitionByRange(P.partitions(runs.sparkSession), "key", "ts", "start"), run, "part long, " + _INDEX_DDL)


def read_archives(index: DataFrame, folder: str, ddl: str, schema: pa.Schema, make: Callable[[dict[str, str], dict[str, str], bytes], tuple]) -> DataFrame:
    """Reads the records that an index names; each task reads its files from front to back."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = storage.at(folder)
        name, f, held = None, None, []
        for b in it:
            for file, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    name, f = file, fs.open_input_file(f"{base}/{file}")
                f.seek(start)
                held.append(make(*parse(gzip.decompress(f.read(size)))))
                if len(held) >= 2_000:
                    yield P.batch(schema, *map(list, zip(*held, strict=True)))
                    held = []
        if held:
            yield P.batch(schema, *map(list, zip(*held, strict=True)))

    # stretches of a file, so that a large one is read by several tasks
    stretch = (F.col("start") / (32 << 20)).cast("long")
    dealt = index.select("file", "start", "size").repartition(P.partitions(index.sparkSession), "file", stretch).sortWithinPartitions("file", "start")
    return P.arrow(dealt, run, ddl)


_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _page(fields: dict[str, str], inner: dict[str, str], payload: bytes) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("digest differs")
    refers = fields.get("WARC-Refers-To")
    return page_of(fields["WARC-Record-ID"]), int(inner["Content-Length"]), digest, fields["WARC-Type"], page_of(refers) if refers else None


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Writes archives of pages, merges their index and reads them back.

    Returns the records as read (``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``), the merged index
    (capture histories), and the folder with the archives. Rules for nulls and repeats: :func:`write_archives`. An empty
    table gives empty results and no files.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or new_path(spark, "archives")
    runs, _ = cut_at(write_archives(pages, folder), "runs")
    index, _ = cut_at(merge_runs(runs), "index")
    back = read_archives(index, folder, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", _PAGE, _page)
    return back, index, folder
