"""Training order: fixed-length token sequences in keyed random order, as fixed-stride binary shards."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import storage
from tessera.plans.lineage import cut_at, delete, new_path

U = np.uint64
ROUNDS = 6


def _round_keys(key: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([r]), key=key[:64], digest_size=8).digest() for r in range(ROUNDS)), U)


def _scramble(x: np.ndarray, k: np.uint64) -> np.ndarray:
    x = (x + k) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _network(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    half = U(bits // 2)
    mask = (U(1) << half) - U(1)
    left, right = x >> half, x & mask
    for k in keys:
        left, right = right, left ^ (_scramble(right, k) & mask)
    return (left << half) | right


def slots(index: np.ndarray, n: int, key: bytes) -> np.ndarray:
    """The slot of each sequence number below ``n``: a permutation of 0..n-1 that depends on the key alone.

    A balanced Feistel network permutes the least even-width power of two that covers n; a value that falls beyond n
    walks on along its cycle until it is below.
    """
    if n <= 1:
        return np.zeros(len(index), U)
    bits = max(2, (n - 1).bit_length())
    bits += bits % 2
    keys = _round_keys(key)
    x = _network(index.astype(U), bits, keys)
    out = np.flatnonzero(x >= n)
    while len(out):
        x[out] = _network(x[out], bits, keys)
        out = out[x[out] >= n]
    return x


class RankTokens:
    """A byte-level tokenizer from a file of ranks; one id beyond its own ends each text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1

    def encode(self, text: str) -> np.ndarray:
        return np.array([*self.coder.encode_ordinary(text), self.end], np.uint16 if self.end < 1 << 16 else np.uint32)


_SHARD = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("sequences", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_DOC = pa.schema([("doc_id", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("first_slot", pa.int64())])


def materialise(docs: DataFrame, tokens: tuple[str, str], key: bytes = b"epoch-0", length: int = 2048, per_shard: int = 4096, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Tokens of all texts, cut into sequences of ``length`` ids, in a keyed order on disk.

    ``tokens`` is the path of a rank file on every machine and its splitting pattern. Each text's ids and an end
    mark follow one another in a stream (task by task, text after text); sequence i is ids ``i * length`` up to the
    next; the last is filled with end marks. ``slots`` places it: in shard ``slot // per_shard``, at
    ``slot % per_shard`` strides of ``length`` ids in a file of little-endian ids (two bytes each, four for large
    vocabularies). A reader resumes at any slot by seeking; only the last shard is shorter.

    Returns shards (``shard``, ``file``, ``sequences``, ``bytes``, ``sha256``), documents (``doc_id``, ``first_token`` in
    the stream, ``n_tokens`` with the end mark, ``first_slot`` of the sequence in which it begins) and the folder. Null and
    empty texts are one end mark; repeated rows and null ids each have their place; an empty table makes no shard.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "order")
    path, pattern = tokens
    end = RankTokens(path, pattern).end
    dtype = np.dtype(np.uint16 if end < 1 << 16 else np.uint32)
    parts = P.partitions(spark)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, squeeze = RankTokens(path, pattern), zstandard.ZstdCompressor(level=3)
        task, before = TaskContext.get().partitionId(), 0
        for b in it:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                got, size, j = [], 0, i
                while j < len(texts) and size < 1 << 20:
                    got.append(coder.encode(texts[j] or ""))
                    size += len(got[-1])
                    j += 1
                sizes = np.array([len(x) for x in got], np.int64)
                rows = P.pack(np.array([x is None for x in ids[i:j]]), np.array([x or 0 for x in ids[i:j]], np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([before]), pa.array([size]), pa.array([rows], pa.binary()), pa.array([squeeze.compress(np.concatenate(got).tobytes())], pa.binary())], names=["task", "before", "n", "rows", "block"])
                i, before = j, before + size

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks, bpath = cut_at(P.arrow(src, encode, "task long, before long, n long, rows binary, block binary"), "tokens")
    # where each task's part of the stream begins: one number for each task
    start, total = {}, 0
    for task, n in blocks.groupBy("task").agg(F.sum("n")).orderBy("task").collect():
        start[task] = total
        total += n
    n = -(-total // length)
    shards = -(-n // per_shard)
    base = spark.sparkContext.broadcast(start)

    def locate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for task, before, raw in zip(P.ints(b, "task"), P.ints(b, "before"), P.raws(b, "rows"), strict=True):
                none, ids, sizes = P.unpack(raw)
                first = base.value[int(task)] + int(before) + np.cumsum(sizes) - sizes
                yield P.batch(_DOC, pa.array(ids, pa.int64(), mask=none), first, sizes, slots(first // length, n, key).astype(np.int64))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for b in it:
            out: list[tuple[int, int, bytes]] = []
            for task, before, raw in zip(P.ints(b, "task"), P.ints(b, "before"), P.raws(b, "block"), strict=True):
                ids = np.frombuffer(open_.decompress(raw), dtype)
                first = base.value[int(task)] + int(before)
                cuts = np.arange(first // length, (first + len(ids) - 1) // length + 1)
                held: dict[int, list[tuple[int, int, np.ndarray]]] = {}
                for q, s in zip(cuts.tolist(), slots(cuts, n, key).tolist(), strict=True):
                    a, z = max(q * length, first), min((q + 1) * length, first + len(ids))
                    held.setdefault(s // per_shard, []).append((s, a - q * length, ids[a - first : z - first]))
                for shard, got in held.items():
                    head = P.pack(np.array([[s, a, len(x)] for s, a, x in got], np.int64).ravel())
                    out.append((shard * parts // shards, shard, head + squeeze.compress(np.concatenate([x for _, _, x in got]).tobytes())))
            if out:
                r, s, x = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(s, pa.int64()), pa.array(x, pa.binary())], names=["range", "shard", "ids"])

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage.at(folder)
        open_ = zstandard.ZstdDecompressor()
        shard, out = None, None

        def finish() -> pa.RecordBatch:
            name, raw = f"shard-{shard:08d}.bin", out.tobytes()
            fs.create_dir(root, recursive=True)
            temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary, compression=None) as f:
                f.write(raw)
            storage.publish(fs, temporary, f"{root}/{name}")
            return P.batch(_SHARD, [shard], [name], [len(out) // length], [len(raw)], [hashlib.sha256(raw).hexdigest()])

        for b in it:
            for s, raw in zip(P.ints(b, "shard"), P.raws(b, "ids"), strict=True):
                if int(s) != shard:
                    if out is not None:
                        yield finish()
                    shard = int(s)
                    out = np.full((min((shard + 1) * per_shard, n) - shard * per_shard) * length, end, dtype)
                head = P.unpack(raw)[0]
                ids = np.frombuffer(open_.decompress(raw[24 + 8 * len(head) :]), dtype)
                x = 0
                for slot, a, m in head.reshape(-1, 3).tolist():
                    at = (slot - shard * per_shard) * length + a
                    out[at : at + m] = ids[x : x + m]
                    x += m
        if out is not None:
            yield finish()

    where, _ = cut_at(P.arrow(blocks, locate, "doc_id long, first_token long, n_tokens long, first_slot long"), "places")
    dealt = P.arrow(blocks.select("task", "before", "block"), deal, "range int, shard long, ids binary")
    dealt = dealt.repartitionById(parts, "range").sortWithinPartitions("shard")  # a range of shards to each task
    made, _ = cut_at(P.arrow(dealt.select("shard", "ids"), write, "shard long, file string, sequences long, bytes long, sha256 string"), "shards")
    delete(spark, bpath)
    return made, where, folder


def read_slots(folder: str, first: int, count: int, length: int = 2048, per_shard: int = 4096, dtype: type = np.uint16) -> Iterator[np.ndarray]:
    """Sequences from a slot on, read front to back; this is how a reader resumes."""
    fs, root = storage.at(folder)
    size = length * np.dtype(dtype).itemsize
    slot = first
    while slot < first + count:
        shard = slot // per_shard
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek((slot % per_shard) * size)
            while slot < first + count and slot // per_shard == shard:
                raw = f.read(size)
                if len(raw) < size:
                    return
                yield np.frombuffer(raw, dtype)
                slot += 1
