"""Byte-level text primitives that work on whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are taken in groups of about so many bytes, which bounds the arrays beside them.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        p, q = np.full(size, _BASE, U), np.full(size, pow(_BASE, -1, 1 << 64), U)
        p[0] = q[0] = 1
        _powers["p"], _powers["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers["p"], _powers["q"]


def forget() -> None:
    """Drops the powers held; they are made again when asked for."""
    _powers.clear()


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after another, and where each row begins; null counts as empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and len(off) and off[-1] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, off - off[0] if len(off) else np.zeros(1, np.int64)


def chunks(off: np.ndarray, limit: int = CHUNK, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + limit, "right")) - 1, i + 1), i + rows, n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[0] = edge[n] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~word[:-1] | edge[1:n]
    after[:-1] = ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums whose differences give the hash of any stretch in constant time (see :func:`stretch`)."""
    p, _ = powers(len(data) + 1)
    c = np.empty(len(data) + 1, U)
    c[0] = 0
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=c[1:])
    return c


def stretch(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]``, equal for equal contents and lengths wherever they stand."""
    _, q = powers(len(c))
    return mix((c[ends] - c[starts]) * q[starts] + U(0x632BE59BD9B4E019) * (ends - starts).astype(U))


def shingles(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of each row's distinct word shingles, sorted by row and hash.

    A row with fewer than ``k`` words has its whole sequence as one shingle; one without words has none.
    """
    starts, ends, row = word_spans(data, off)
    h = stretch(prefix_hash(data), starts, ends)
    rows = len(off) - 1
    n = np.bincount(row, minlength=rows)
    acc = np.full(len(h), k, U)
    full = np.zeros(len(h), bool)
    if len(h) >= k:
        full[: len(h) - k + 1] = row[: len(h) - k + 1] == row[k - 1 :]
        m = len(h) - k + 1
        for i in range(k):
            acc[:m] = mix(acc[:m] * U(0xD6E8FEB86659FD93) + h[i : i + m])
    out_row, out_hash = [row[full]], [acc[full]]
    first = np.cumsum(n) - n
    for r in range(1, k):
        short = np.flatnonzero(n == r)
        a = np.full(len(short), r, U)
        for i in range(r):
            a = mix(a * U(0xD6E8FEB86659FD93) + h[first[short] + i])
        out_row.append(short)
        out_hash.append(a)
    row, h = np.concatenate(out_row), np.concatenate(out_hash)
    at = np.argsort(h)
    at = at[np.argsort(row[at].astype(np.uint16), kind="stable")]
    row, h = row[at], h[at]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
