"""Rule-based quality of documents, and host verdicts from shrunken failure rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X
from tessera.plans.lineage import cut_at

U = X.U
#: Characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host whose shrunken failure rate reaches this is rejected with all its documents.
HOST_LIMIT = 0.6


def _repeats(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash elsewhere in their row."""
    at = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    same[1:] = (row[at][1:] == row[at][:-1]) & (h[at][1:] == h[at][:-1])
    same[:-1] |= same[1:]
    out = np.zeros(len(h), bool)
    out[at] = same
    return out


def counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The figures named in COUNTS for each row."""
    rows = len(off) - 1
    starts, ends, row = X.word_spans(data, off)
    n_words = np.bincount(row, minlength=rows)
    c = X.prefix_hash(data)
    lead = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~X.SPACE[data])])
    chars = lead[off[1:]] - lead[off[:-1]]
    sym = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    symbols = sym[off[1:]] - sym[off[:-1]]
    # lines
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[np.flatnonzero(data == 10) + 1] = True
    begin = np.flatnonzero(edge[:n])
    end = np.r_[begin[1:], n] if len(begin) else begin
    end = end - (data[end - 1] == 10) if len(begin) else end
    words_to = np.concatenate([[0], np.cumsum(~X.SPACE[data])])
    has = words_to[end] > words_to[begin]
    begin, end = begin[has], end[has]
    lrow = np.searchsorted(off, begin, "right") - 1
    lh = X.stretch(c, begin, end)
    at = np.lexsort((lh, lrow))
    new = np.ones(len(at), bool)
    new[1:] = (lrow[at][1:] != lrow[at][:-1]) | (lh[at][1:] != lh[at][:-1])
    dup_lines = np.bincount(lrow, minlength=rows) - np.bincount(lrow[at][new], minlength=rows)
    # windows of three words
    h = X.stretch(c, starts, ends)
    hit = np.zeros(len(h), bool)
    if len(h) >= 3:
        ok = np.flatnonzero(row[:-2] == row[2:])
        w = X.mix(X.mix(X.mix(h[ok]) + h[ok + 1]) + h[ok + 2])
        twice = ok[_repeats(row[ok], w)]
        for i in range(3):
            hit[twice + i] = True
    return [n_words, chars, symbols, dup_lines, np.bincount(row[hit], minlength=rows)]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, base verdict and final verdict of every row.

    Columns: the id as ``doc_id``; ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of
    the whole text; ``base_failed`` (fewer than 50 words, or more than half of the words in repeated windows of
    three); ``host_rate``; ``kept``. Failures are aggregated by host; each host's rate is shrunk towards the
    rate of all hosts with a beta prior whose strength comes from the spread of the hosts' rates (by moments, each host weighted by its
    documents). A host whose shrunken rate is ``host_limit`` or more takes all of its documents with it.

    A null text counts as empty: no words, base failed. A null host has no host verdict (``host_rate`` null): the base
    verdict stands. Repeated rows count as rows; null ids are carried through. One host, or hosts without spread: the rate of
    all. An empty table gives an empty result. Lines and windows are compared by 64-bit hashes.
    """
    src = docs.select(F.col(id_col).alias("k0"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = X.column(b, "text")
            got = [counts(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in X.chunks(off)]
            if got:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.concatenate(x), pa.int64()) for x in zip(*got, strict=True))], names=["k0", "host", *COUNTS])

    ddl = f"k0 {src.schema['k0'].dataType.simpleString()}, host string, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = P.arrow(src, run, ddl).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    rows, _ = cut_at(rows, "quality")
    hosts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("f")).withColumn("r", F.col("f") / F.col("n"))
    # written, so that its size is known before the join: while it is small, the rows of a large host stay where they are read
    hosts, _ = cut_at(hosts, "hosts")
    prior = hosts.agg((F.sum("f") / F.sum("n")).alias("m"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("s2")).first()
    rate, strength = prior_of(prior["m"], prior["n"], prior["s2"])
    hosts = hosts.select("host", ((F.col("f") + F.lit(rate * strength)) / (F.col("n") + F.lit(strength))).alias("host_rate"))
    out = rows.join(hosts, "host", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("host_rate") < host_limit, F.lit(True))
    return out.select(F.col("k0").alias("doc_id"), *COUNTS, "base_failed", "host_rate", kept.alias("kept"))


def prior_of(mean: float | None, n: int | None, squares: float | None) -> tuple[float, float]:
    """Mean and strength (a + b) of the beta prior, by moments; the strength lies between 1 and a million."""
    if not n:
        return 0.0, 1.0
    spread = max(squares / n - mean * mean, 0.0)
    if spread <= 1e-12 or not 0 < mean < 1:
        return mean, 1e6
    return mean, min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
