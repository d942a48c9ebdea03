"""Runs of periodic words, from the branching tandem repeats of each text's suffix tree.

The tree stands as a suffix array with its longest common prefixes: an inner node is an interval of suffixes that share ``depth``
words. For each node the leaves of all children but the largest are looked at (smaller half, which makes ``n log n`` looks in
all): where the leaf ``depth`` words before or after is in the node too and the two part right after their ``depth`` words, a square
begins that branches. Turning such a square to the left, word by word while it stays one, gives the others of its run; squares with one
end are one run if the smaller period divides the larger, so that they merge into maximal runs with their smallest periods.

The texts of a chunk share the arrays: each text has symbols of its own, so that no node spans two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X

#: Bytes of text whose arrays are held together, and leaves or symbols compared at a time.
GROUP, AT_ONCE = 1 << 20, 1 << 20

#: Given a row's first kept column and its words, the words to use in their place.
Edit = Callable[[object, list[bytes]], list[bytes]]


def suffix_array(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, ranks and common prefixes of the suffixes of ``sym``, whose last symbol stands nowhere else.

    By doubling: only suffixes that still tie are sorted again. ``lcp[i]`` belongs to the suffixes at ``i - 1`` and ``i``.
    """
    n = len(sym)
    sa = np.argsort(sym, kind="stable")
    new = np.r_[True, sym[sa][1:] != sym[sa][:-1]]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    rank[sa] = first[np.cumsum(new) - 1]
    levels, step = [rank.copy()], 1
    size = np.diff(np.r_[first, n])
    at = np.flatnonzero(np.repeat(size > 1, size))
    while len(at):
        s = sa[at]
        key = rank[s].astype(np.int64) * n + rank[s + step]
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[at] = s
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        rank[s] = at[first][np.cumsum(new) - 1]
        levels.append(rank.copy())
        size = np.diff(np.r_[first, len(at)])
        at = at[np.repeat(size > 1, size)]
        step *= 2
    lcp = np.zeros(n, np.int64)
    tie = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, got = sa[tie - 1], sa[tie], np.zeros(len(tie), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        got += (levels[k][a + got] == levels[k][b + got]).astype(np.int64) << k
    lcp[tie] = got
    return sa, rank, lcp


def smaller_before(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of ``at`` the nearest one before it with a smaller value, which has to exist."""
    tower = [x]
    while len(tower[-1]) > 1:
        low = tower[-1]
        if len(low) & 1:
            low = np.r_[low, low[-1:]]
        tower.append(np.minimum(low[0::2], low[1::2]))
    v, block, level = x[at], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    todo, end, k = np.arange(len(at)), at.astype(np.int64), 0
    while len(todo):  # upwards: the block that ends here, wherever the end is odd
        odd = (end & 1) == 1
        hit = odd.copy()
        hit[odd] = tower[k][end[odd] - 1] < v[todo[odd]]
        block[todo[hit]], level[todo[hit]] = end[hit] - 1, k
        todo, end = todo[~hit], end[~hit] >> 1
        k += 1
    for k in range(int(level.max(initial=0)), 0, -1):  # downwards: the later half, if it has a smaller value
        here = np.flatnonzero(level == k)
        right = 2 * block[here] + 1
        low = tower[k - 1]
        later = np.zeros(len(here), bool)
        inside = right < len(low)
        later[inside] = low[right[inside]] < v[here[inside]]
        block[here], level[here] = np.where(later, right, right - 1), k - 1
    return block


def nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first child, depth, start, end)`` of the inner nodes below the root, and starts and ends of all children, node by node."""
    n = len(lcp)
    at = np.flatnonzero(lcp > 0)
    low = smaller_before(lcp, at)
    high = n - smaller_before(np.r_[0, lcp[::-1]], n - at)  # with a smaller value after the last one
    order = np.argsort(low * (lcp.max(initial=0) + 1) + lcp[at], kind="stable")
    at, low, high = at[order], low[order], high[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (lcp[at][1:] != lcp[at][:-1])][: len(at)]
    head = np.flatnonzero(new)
    # a node's children begin at its start and at its splits; each ends where the next begins
    child = np.insert(at, head, low[head])
    first = head + np.arange(len(head))
    ends = np.empty(len(child), np.int64)
    ends[:-1] = child[1:]
    ends[np.r_[first[1:], len(child)][: len(first)] - 1] = high[head]
    return np.stack([first, lcp[at[head]], low[head], high[head]]), child, ends, np.diff(np.r_[first, len(child)])


def _spread(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(k, x)`` for all x from starts[k] up to ends[k], a bounded number at a time but for one wide k."""
    cnt = ends - starts
    total = np.concatenate([[0], np.cumsum(cnt)])
    i = 0
    while i < len(cnt):
        j = max(int(np.searchsorted(total, total[i] + AT_ONCE, "right")) - 1, i + 1)
        k = np.repeat(np.arange(i, j), cnt[i:j])
        yield k, starts[k] + np.arange(len(k)) - (total[k] - total[i])
        i = j


def branching_squares(sym: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """``(end, half)`` of the squares that branch and have ``times - 2`` more halves before them at least."""
    sa, rank, lcp = suffix_array(sym)
    node, child, ends, count = nodes(lcp)
    n, size = len(sym), ends - child
    of = np.repeat(np.arange(node.shape[1]), count)
    most = np.maximum.reduceat(size, node[0]) if node.shape[1] else size[:0]
    largest = np.flatnonzero(size == most[of])
    largest = largest[np.r_[True, of[largest][1:] != of[largest][:-1]][: len(largest)]]
    look = (node[3] - node[2] >= times)[of]  # so many halves are so many leaves
    look[largest] = False
    look = np.flatnonzero(look)
    depth, low, high = node[1][of[look]], node[2][of[look]], node[3][of[look]]
    found = [np.zeros((2, 0), np.int64)]
    for k, x in _spread(child[look], ends[look]):
        j, d = sa[x], depth[k]
        start = np.r_[j, j - d]
        other = np.r_[j + d, j - d]
        d, k = np.r_[d, d], np.r_[k, k]
        for back in range(times - 1):  # the other leaf, then those before the square
            if back:
                other = start - back * d
            good = (other >= 0) & (other < n)
            r = rank[other[good]]
            good[good] = (r >= low[k[good]]) & (r < high[k[good]])
            start, other, d, k = start[good], other[good], d[good], k[good]
        good = sym[start + d] != sym[start + 2 * d]
        found.append(np.stack([start[good] + 2 * d[good], d[good]]))
    got = np.unique(np.concatenate(found, axis=1), axis=1)
    return got[0], got[1]


def turned(sym: np.ndarray, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Where the squares at ``start`` come to when they are turned to the left as far as they stay squares."""
    out, todo, wide = start.copy(), np.arange(len(start)), 16
    while len(todo):
        nxt = []
        for part in np.array_split(todo, max(1, -(-len(todo) * wide // AT_ONCE))):
            at = out[part][:, None] - 1 - np.arange(wide)
            on = np.maximum(at, 0)
            same = (at >= 0) & (sym[on] == sym[on + half[part][:, None]])
            n = np.where(same.all(axis=1), wide, same.argmin(axis=1))
            out[part] -= n
            nxt.append(part[n == wide])
        todo, wide = np.concatenate(nxt), min(wide * 4, 1 << 14)
    return out


def maximal_runs(sym: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs of ``least`` symbols and ``times`` periods or more, by start, then period."""
    end, half = branching_squares(sym, times)
    runs = [np.zeros((3, 0), np.int64)]
    while len(end):  # of the squares with one end the smallest makes a run; those that are in it with a multiple of its period go
        head = np.r_[True, end[1:] != end[:-1]]
        e, q = end[head], half[head]
        s = turned(sym, e - 2 * q, q)
        runs.append(np.stack([s, e, q]))
        own = np.cumsum(head) - 1
        rest = ~head & ~((half % q[own] == 0) & (e[own] - s[own] >= 2 * half))
        end, half = end[rest], half[rest]
    s, e, q = np.concatenate(runs, axis=1)
    good = e - s >= np.maximum(least, times * q)
    s, e, q = s[good], e[good], q[good]
    at = np.lexsort((q, s))
    return s[at], e[at], q[at]


def _numbered(texts: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers of their text's own, each text closed by a number that stands nowhere else; where texts begin."""
    parts, base = [], 0
    for ws in texts:
        names = dict.fromkeys(ws)
        for i, w in enumerate(names, base):
            names[w] = i
        base += len(names) + 1
        parts.append(np.fromiter(map(names.__getitem__, ws), np.int64, len(ws)))
        parts.append(np.array([base - 1], np.int64))
    off = np.cumsum([0, *(len(ws) + 1 for ws in texts)])
    return np.concatenate(parts), off


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", least: int = 24, times: int = 3, edit: Edit | None = None) -> DataFrame:
    """The columns of ``keep`` with ``n_words``, ``runs`` (array of start, length, period) and ``collapsed`` for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared byte by byte. A run is a stretch of words with smallest period
    ``q`` and at least ``least`` words and ``times >= 2`` periods that no neighbouring word extends with that period; runs come by start, then
    period, and start counts words from 0. ``collapsed`` holds the words that no run contains after its first ``q``, joined by one blank.
    ``edit`` may put other words in a row's place before the search; it is given the first column of ``keep``.

    Null, empty and blank texts: no words, no runs, an empty ``collapsed``. A very long text is searched whole, by itself, with some
    hundred bytes of memory for each word. Rows are handled one by one, so repeated rows, ties and an empty table need no rule; column names cannot
    clash, as only those named are read.
    """
    if times < 2 or least < 0:
        raise ValueError("a run has two periods at least")
    src = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(part: pa.RecordBatch) -> list[pa.Array]:
        words = [(t or "").encode().split() for t in P.raws(part, "text")]
        if edit:
            words = [edit(k, ws) for k, ws in zip(part.column(0).to_pylist(), words, strict=True)]
        sym, off = _numbered(words)
        s, e, q = maximal_runs(sym, least, times)
        row = np.searchsorted(off, s, "right") - 1
        steps = np.zeros(len(sym) + 1, np.int64)
        np.add.at(steps, s + q, 1)
        np.add.at(steps, e, -1)
        gone = np.cumsum(steps) > 0
        texts = []
        for ws, x, hit in zip(words, off.tolist(), np.bincount(row, minlength=len(words)).tolist(), strict=False):
            if hit:
                ws = [ws[i] for i in np.flatnonzero(~gone[x : x + len(ws)]).tolist()]
            texts.append(b" ".join(ws))
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(words)))]
        runs = pa.StructArray.from_arrays([pa.array(s - off[row]), pa.array(e - s), pa.array(q)], fields=list(run_type.value_type))
        return [pa.array(np.diff(off) - 1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(texts, pa.binary()).cast(pa.string())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            _, off = X.column(b, "text")
            for i, j in X.chunks(off, GROUP):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), *search(part)], names=[*names, "n_words", "runs", "collapsed"])

    ddl = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in names), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])
    out = P.arrow(src, run, ddl)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "runs", "collapsed")


#: Of two runs the one with more periods comes first, then the one that starts first, then that with the smaller period.
_FIRST = """array_sort(runs, (x, y) -> CASE
    WHEN x.length * y.period <> y.length * x.period THEN IF(x.length * y.period > y.length * x.period, -1, 1)
    WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1)
    WHEN x.period <> y.period THEN IF(x.period < y.period, -1, 1) ELSE 0 END)[0]"""


def run_digest(found: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Of :func:`periodic_runs`: how many runs, the one with the most periods, and digests of all runs and of the collapsed text."""
    best = found.withColumn("best", F.expr(f"if(size(runs) > 0, {_FIRST}, null)"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return best.select(
        *keep,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
