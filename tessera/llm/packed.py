"""Moving many small records through a shuffle as a few packed blocks, and small helpers around that."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import text

BLOCK = pa.schema([("bucket", pa.int32()), ("block", pa.large_binary())])
BLOCK_DDL = "bucket int, block binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of fixed-width numbers as one byte string: for each its type and length, then its bytes."""
    head = [len(arrays)]
    for a in arrays:
        head += [ord(a.dtype.char), len(a)]
    return np.array(head, np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for kind, size in zip(head[::2], head[1::2], strict=True):
        t = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, t, int(size), at))
        at += int(size) * t.itemsize
    return out


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(bucket, positions)`` of the records whose key falls there."""
    b = (keys % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    at = np.argsort(b, kind="stable")
    b = b[at]
    edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
    for i, j in zip(edge, np.r_[edge[1:], len(b)][: len(edge)], strict=True):
        yield int(b[i]), at[i:j]


def blocks(rows: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.large_binary())], schema=BLOCK)


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def ints(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def raws(b: pa.RecordBatch, name: str) -> list[bytes]:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose worker gives its memory back when a task ends: workers live on, and others need the room."""

    def tidy(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            text.forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without the call keeps its free pages
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def dealt(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """Deals rows out by bucket, one bucket to a task, and runs ``run`` on each."""
    return arrow(df.repartitionById(partitions(df.sparkSession), "bucket"), run, ddl)


def gather(df: DataFrame, reduce: Callable[[list[bytes]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """Deals blocks out by bucket and gives all blocks of a bucket to ``reduce``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in it for x in raws(b, "block")]
        if got:
            yield from reduce(got)

    return dealt(df, run, ddl)


def bitmap(keys: DataFrame, col: str, bits: int = 1 << 23) -> np.ndarray:
    """A one-hash Bloom filter of a long column. Its size is fixed, so that it may go to the driver and to all tasks: a word at most for each 64 bits, however many keys there are. False hits cost work, never rows."""
    at = F.pmod(F.col(col), F.lit(bits))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({col}, 64L) as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    out = np.zeros(bits >> 6, np.int64)
    for w, m in words:
        out[w] = m
    return out.view(np.uint64)


def hits(bm: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = len(bm) << 6
    k = np.mod(keys, bits)
    return (bm[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) != 0
