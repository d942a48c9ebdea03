"""Benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X

U = X.U
#: Item characters that one pass over the documents takes along; more items make more passes.
BLOCK_CHARS = 8_000_000


def normal(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with each run of white space as one blank, and where each text begins."""
    low = [" ".join((t or "").lower().split()) for t in texts]
    off = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=off[1:])
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), off


class Items:
    """The q-grams of a block of items, with what the lemma asks of each item."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str], q: int, percent: int):
        self.ids, self.q = list(ids), q
        self.data, self.off = normal(texts)
        m = np.diff(self.off)
        #: Edits allowed: so many hundredths of the length. ``q`` is such that the lemma still asks for a q-gram (see :func:`gram_size`).
        self.budget = m * percent // 100
        self.need = m - q + 1 - q * self.budget
        c = X.prefix_hash(self.data)
        at = np.arange(max(len(self.data) - q + 1, 0))
        item = np.searchsorted(self.off, at, "right") - 1
        ok = at + q <= self.off[np.minimum(item + 1, len(self.off) - 1)]
        at, item = at[ok], item[ok]
        h = X.stretch(c, at, at + q)
        order = np.argsort(h, kind="stable")
        self.gram, first = np.unique(h[order], return_index=True)
        self.first = np.r_[first, len(h)]
        self.item, self.pos = item[order], (at - self.off[item])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.gram >> U(44)] = True
        self.short = [i for i in range(len(m)) if 0 < m[i] < q]  # these are too short for an edit

    def text(self, i: int) -> np.ndarray:
        return self.data[self.off[i] : self.off[i + 1]]


def gram_size(text: str, q: int, percent: int) -> int:
    """The largest q up to the given one with which an item of this length shares a q-gram with every match in its budget.

    With e edits on m characters at least ``m - q + 1 - q e`` q-grams stay. Items too short for an edit keep ``q``.
    """
    m = len(" ".join(text.lower().split()))
    e = m * percent // 100
    return q if not e else max(1, min(q, m // (e + 1)))


def edits(item: np.ndarray, doc: np.ndarray, low: int, high: int, most: int) -> int:
    """The least edits that turn the item into a stretch of doc, on the diagonals low..high; most + 1 if there are more."""
    width = high - low + 1
    k = np.arange(width)
    j = low + k
    row = np.where((j >= 0) & (j <= len(doc)), 0, most + 1)
    for i in range(1, len(item) + 1):
        j = i + low + k
        inside = (j >= 1) & (j <= len(doc))
        differs = np.ones(width, np.int64)
        differs[inside] = doc[j[inside] - 1] != item[i - 1]
        new = np.where(inside, row + differs, most + 1)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((j < 0) | (j > len(doc)), most + 1, new)
        new = np.minimum.accumulate(new - k) + k
        row = np.minimum(np.where((j < 0) | (j > len(doc)), most + 1, new), most + 1)
        if row.min() > most:
            return most + 1
    return int(row.min())


def matches(items: Items, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(row, item, diagonal, edits)``: the best match of each item in each text, if its budget allows it."""
    q, found = items.q, {}
    rows = len(off) - 1
    n = len(data)
    if n >= q and len(items.gram):
        c = X.prefix_hash(data)
        at = np.arange(n - q + 1)
        h = X.stretch(c, at, at + q)
        at = at[items.seen[h >> U(44)]]
        h = h[at]
        g = np.minimum(np.searchsorted(items.gram, h), len(items.gram) - 1)
        ok = items.gram[g] == h
        at, g = at[ok], g[ok]
        row = np.searchsorted(off, at, "right") - 1
        ok = at + q <= off[row + 1]
        at, g, row = at[ok], g[ok], row[ok]
        times = items.first[g + 1] - items.first[g]
        x = np.repeat(items.first[g], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at, row = np.repeat(at, times), np.repeat(row, times)
        item = items.item[x]
        # the diagonals of a match with e edits span at most e + 1; bands of twice that, one every e + 1, hold any such span
        diag = at - off[row] - items.pos[x]
        step = items.budget[item] + 1
        band = np.floor_divide(diag, step)
        band, row, item = np.r_[band, band - 1], np.r_[row, row], np.r_[item, item]
        order = np.lexsort((band, item, row))
        band, row, item = band[order], row[order], item[order]
        new = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (item[1:] != item[:-1]) | (row[1:] != row[:-1])]) if len(band) else np.zeros(0, np.int64)
        size = np.diff(np.r_[new, len(band)])
        keep = new[size >= items.need[item[new]]]
        keep = keep[np.argsort(-size[np.searchsorted(new, keep)], kind="stable")]
        for b, r, i in zip(band[keep].tolist(), row[keep].tolist(), item[keep].tolist(), strict=True):
            best = found.get((r, i))
            if best and best[1] == 0:
                continue
            most = int(items.budget[i]) if best is None else best[1] - 1
            step_i, doc, pat = int(items.budget[i]) + 1, data[off[r] : off[r + 1]], items.text(i)
            low, high = b * step_i, b * step_i + 2 * step_i - 1
            exact = doc[max(low, 0) : high + len(pat)].tobytes().find(pat.tobytes())
            while exact > 0 and exact % 4:
                exact = doc[max(low, 0) : high + len(pat)].tobytes().find(pat.tobytes(), exact + 1)
            e = 0 if exact >= 0 else edits(pat, doc, low, high, most)
            if e <= most:
                found[r, i] = (max(low, 0) + exact // 4 if exact >= 0 else low, e)
    for i in items.short:
        pat = items.text(i).tobytes()
        for r in range(rows):
            doc = data[off[r] : off[r + 1]].tobytes()
            at = doc.find(pat)
            while at > 0 and at % 4:
                at = doc.find(pat, at + 1)
            if at >= 0:
                found[r, i] = (at // 4, 0)
    return [(r, i, d, e) for (r, i), (d, e) in sorted(found.items())]


def leaks(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 10, percent: int = 8) -> DataFrame:
    """One row for each document and benchmark item that stands in it: the columns of ``keep``, ``item_id`` and ``edits``.

    Texts are compared as code points, lower-cased, with each run of white space as one blank and none at the ends. An item stands in a
    document if it can be turned into a stretch of it with at most ``percent`` hundredths of its length in edits.
    Such a stretch shares at least ``m - q + 1 - q e`` q-grams with the item in a band of e + 1 diagonals, so that bands with
    fewer are dropped without loss; the rest are aligned within their band. Items so short that their budget would ask for none have
    shorter q-grams; those too short for an edit must occur exactly.

    Items are the stated query set: they go to all tasks in blocks of at most BLOCK_CHARS characters, with one pass over the documents for each. Null or
    blank items match nothing; null or empty documents hold nothing. Repeated documents or items each give their own
    rows. Empty tables give an empty result. Only the columns named are read.
    """
    spark = docs.sparkSession
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    ddl = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in names), "item_id long", "edits long"])
    out = None
    for ids, texts in _blocks(items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))):
        index = spark.sparkContext.broadcast((ids, texts))
        got = P.arrow(src, _search(index, names, q, percent), ddl)
        out = got if out is None else out.union(got)
    if out is None:
        out = spark.createDataFrame([], ddl)
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), "item_id", "edits")


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    for i, t in items.where("trim(t) <> ''").toLocalIterator():
        ids.append(i)
        texts.append(t)
        if sum(map(len, texts[-1:])) and len(texts) % 64 == 0 and sum(map(len, texts)) > BLOCK_CHARS:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def _search(index, names, q, percent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[tuple[int, str]]] = {}
        for i, t in zip(*index.value, strict=True):
            by_size.setdefault(gram_size(t, q, percent), []).append((i, t))
        groups = [Items(*zip(*x, strict=True), size, percent) for size, x in sorted(by_size.items())]
        for b in it:
            text = b.column(b.schema.get_field_index("text"))
            sizes = np.r_[0, np.cumsum([len(t) if t else 0 for t in text.to_pylist()])]
            for i, j in X.chunks(sizes):
                data, off = normal(text.slice(i, j - i).to_pylist())
                got = [(r, items.ids[k], e) for items in groups for r, k, _, e in matches(items, data, off)]
                if got:
                    at = pa.array([i + r for r, *_ in got])
                    kept = [b.column(b.schema.get_field_index(c)).take(at) for c in names]
                    found = [pa.array([x[k] for x in got], pa.int64()) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([*kept, *found], names=[*names, "item_id", "edits"])

    return run
