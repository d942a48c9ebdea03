"""Removal of long byte strings that occur more than once, by merging Burrows-Wheeler transforms of shards.

A repeat of ``length`` bytes is first localised: the smallest hash among its ``gram``-byte substrings stands at the
same place in all its occurrences, so each window of ``length`` bytes belongs to one *anchor*, and consecutive
windows with one anchor form a *piece* of text around it. Pieces with equal content collapse into one with a
weight; a piece of weight two is a repeat from end to end. Only where one anchor has several different pieces is
there anything left to sort. Each task builds the transform of its own pieces, column by column around the
anchor (a positional transform: as equal strings align at their anchors, a suffix is compared with suffixes of
the same column only). The shards' transforms are then merged: the interleave of the shards at one column
follows from the interleave at the next by one stable partition on the shards' symbols, which also yields the
common-prefix lengths; the texts are not read and no suffix is sorted again. Intervals with a common prefix of at least
``length`` are the repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X
from tessera.plans.lineage import cut_at, delete

U = X.U
#: A byte that UTF-8 never has stands for what lies outside a piece.
OUTSIDE = 0xFF
#: Texts beyond this many bytes are cut into stretches that overlap by a window less one byte.
LONG = 4 << 20
SHARD_ROWS, MERGE_ROWS = 8_000, 20_000
#: Letters that stand for a word where words are compared, six bits of its hash each.
CODE = 8
_POS = U((1 << 24) - 1)


def pieces(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(row, a, b, p, h, content)`` of every piece: windows that start at a..b have their anchor, with hash h, at p."""
    n, w = len(data), length - gram + 1
    size = np.diff(off)
    z = np.zeros(0, np.int64)
    if n < length or not (size >= length).any():
        return z, z, z, z, z.view(U), z.view(U)
    c = X.prefix_hash(data)
    at = np.arange(n - gram + 1)
    g = X.stretch(c, at, at + gram)
    key = (g & ~_POS) | at.astype(U)
    full = np.full(-(-len(key) // w) * w, ~U(0), U)
    full[: len(key)] = key
    tiles = full.reshape(-1, w)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    low = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    anchor = (low & _POS).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)[:starts]
    ok = np.arange(starts) + length <= off[row + 1]
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
    a = np.flatnonzero(new & ok)
    last = np.ones(starts, bool)
    last[:-1] = new[1:] | ~ok[1:]
    b = np.flatnonzero(last & ok)
    p, row = anchor[a], row[a]
    content = X.stretch(c, a, b + length)
    base = off[row]
    return row, a - base, b - base, p - base, g[p], content


def _pieces_of(data, off, length, gram):
    """All pieces of a batch, whatever the length of its texts."""
    out = []
    for i, j in X.chunks(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(d) <= LONG:
            row, *rest = pieces(d, o, length, gram)
            out.append((row + i, *rest))
            continue
        for x in range(0, len(d), LONG):  # one long text, in stretches; a piece that a cut divides is two pieces
            part = d[x : x + LONG + length - 1]
            row, a, b, p, *rest = pieces(part, np.array([0, len(part)]), length, gram)
            out.append((row + i, a + x, b + x, p + x, *rest))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 2


def word_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(data, off, start, end)``: texts with CODE letters for each word and nothing between, and where in its text each word stands."""
    shift = np.arange(CODE, dtype=U) * U(6)
    codes, count, start, end = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in X.chunks(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, row = X.word_spans(d, o)
        h = X.stretch(X.prefix_hash(d), s, e)
        codes.append((((h[:, None] >> shift) & U(63)).astype(np.uint8) + np.uint8(48)).ravel())
        count.append(np.bincount(row, minlength=j - i))
        start.append(s - o[row])
        end.append(e - o[row])
    return np.concatenate(codes), np.r_[0, np.cumsum(np.concatenate(count))].astype(np.int64) * CODE, np.concatenate(start), np.concatenate(end)


def _column(batch: pa.RecordBatch, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch, or their words' codes."""
    got = X.column(batch, "text")
    return word_codes(*got)[:2] if words else got


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (first one first), and in it where each group begins."""
    at = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = np.logical_or.reduce([k[at][1:] != k[at][:-1] for k in keys])
    return at, np.flatnonzero(new)


def _spans(rk: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """Joined stretches of each text, packed, by its key."""
    if not len(rk):
        return []
    at = np.lexsort((start, rk))
    rk, start, end = rk[at], start[at], end[at]
    out = []
    edge = np.flatnonzero(np.r_[True, rk[1:] != rk[:-1]])
    for i, j in zip(edge, [*edge[1:], len(rk)], strict=True):
        s, e = joined(start[i:j], end[i:j])
        out.append((int(rk[i]), P.pack(s, e)))
    return out


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches as disjoint ones that do not touch."""
    at = np.argsort(start, kind="stable")
    start, end = start[at], np.maximum.accumulate(end[at])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    i = np.flatnonzero(new)
    return start[i], end[np.r_[i[1:] - 1, len(start) - 1]] if len(i) else end[:0]


def _cut_pieces(length, gram, buckets, words=False):
    """Blocks of pieces by anchor. Equal pieces of a batch are repeats already: their stretches go out, and one of them stays."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rk = P.ints(batch, "rk")
            row, a, b, p, h, content = _pieces_of(*_column(batch, words), length, gram)
            if not len(row):
                continue
            at, first = _groups(h, content)
            size = np.diff(np.r_[first, len(at)])
            twice = at[np.repeat(size > 1, size)]
            weight = np.minimum(size, 2).astype(np.uint8)
            lead = at[first]
            rows = [(k % buckets, P.pack(np.array([k]), np.frombuffer(x, np.uint8))) for k, x in _spans(rk[row[twice]], a[twice], b[twice] + length)]
            for bucket, i in P.by_bucket(h[lead] >> U(8), buckets):
                q = lead[i]
                rows.append((bucket, P.pack(h[q], content[q], rk[row[q]], a[q].astype(np.int32), b[q].astype(np.int32), p[q].astype(np.int32), weight[i])))
            yield P.blocks(rows)

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("rk", pa.int64()), ("block", pa.large_binary())])
_FOUND_DDL = "kind int, rk long, block binary"
SPANS, WANTED = 1, 2


def _found(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return P.batch(_FOUND, *(map(list, zip(*rows, strict=True)) if rows else ([], [], [])))


def _compare_pieces(length):
    """Per anchor: equal pieces are repeats; where pieces differ, one of each content is wanted for the merge."""

    def run(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        got, ready = [], []
        for x in raw:
            y = P.unpack(x)
            (ready if len(y) == 2 else got).append(y)
        out = [(SPANS, int(k[0]), s.tobytes()) for k, s in ready]
        if got:
            h, content, rk, a, b, p, weight = (np.concatenate(x) for x in zip(*got, strict=True))
            at, first = _groups(h, content)
            size = np.diff(np.r_[first, len(at)])
            total = np.add.reduceat(weight[at].astype(np.int64), first)
            full = at[np.repeat(total > 1, size)]
            out += [(SPANS, k, s) for k, s in _spans(rk[full], a[full].astype(np.int64), b[full].astype(np.int64) + length)]
            lead = at[first]
            hl = h[lead]
            edge = np.flatnonzero(np.r_[True, hl[1:] != hl[:-1]])
            kinds = np.diff(np.r_[edge, len(hl)])
            alone = np.add.reduceat((total < 2).astype(np.int64), edge)
            need = np.repeat((kinds > 1) & (alone > 0), kinds)
            lead, once = lead[need], (total < 2)[need].astype(np.uint8)
            order = np.argsort(rk[lead], kind="stable")
            lead, once = lead[order], once[order]
            k = rk[lead]
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
            for i, j in zip(cut, np.r_[cut[1:], len(k)][: len(cut)], strict=True):
                q = lead[i:j]
                out.append((WANTED, int(k[i]), P.pack(h[q], a[q], b[q], p[q], once[i:j])))
        yield _found(out)

    return run


def _stable(sym: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A stable order by group, then symbol, in two counting sorts."""
    one = np.argsort(sym, kind="stable")
    return one[np.argsort(group[one], kind="stable")]


def transform(texts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The positional Burrows-Wheeler transform of aligned rows, which stand in order of their group.

    ``out[j]`` has, for the rows in order of (group, what follows column j), the symbol in column j.
    """
    n, width = texts.shape
    out = np.empty((width, n), np.uint8)
    order = np.arange(n)
    group = group.astype(np.uint16)
    for j in range(width - 1, -1, -1):
        out[j] = texts[order, j]
        order = order[_stable(out[j], group)]
    return out


def merge(shards: Sequence[np.ndarray], groups: Sequence[np.ndarray], length: int, columns: int) -> np.ndarray:
    """Merges shards' transforms by refining their interleave, and finds what repeats.

    ``groups`` has each shard's groups of rows, ascending. Returns for each row (shard after shard) and each of
    the first ``columns`` columns whether the ``length`` symbols from there on occur in another row of its group.
    """
    every = np.concatenate(groups)
    symbols = np.concatenate(shards, axis=1)
    width, n = symbols.shape
    row = np.argsort(every, kind="stable")
    group = np.unique(every[row], return_inverse=True)[1].astype(np.uint16)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint32), [len(g) for g in groups])[row]
    start = np.r_[True, group[1:] != group[:-1]]
    common = np.zeros(n + 1, np.int32)  # with the entry before; 0 where a group begins
    common[1:n][~start[1:]] = 0
    marked = np.zeros((n, columns), bool)
    sym = np.empty(n, np.uint8)
    for j in range(width - 1, -1, -1):
        # every shard's own order is kept in the interleave, so its symbols are taken one after another
        sym[np.argsort(shard, kind="stable")] = symbols[j]
        order = _stable(sym, group)
        row, shard, s = row[order], shard[order], sym[order]
        follows = np.flatnonzero((s[1:] == s[:-1]) & ~start[1:] & (s[1:] != OUTSIDE)) + 1
        new = np.zeros(n + 1, np.int32)
        if len(follows):
            at = np.empty(2 * len(follows), np.int64)
            at[::2], at[1::2] = order[follows - 1] + 1, order[follows] + 1
            new[follows] = np.minimum.reduceat(common, at)[::2] + 1
        common = new
        if j < columns:
            hit = common[:n] >= length
            hit[:-1] |= hit[1:]
            marked[row[hit], j] = True
    return marked


def _shards(length, gram, buckets, words=False):
    """Transforms of the wanted pieces of a task, in blocks by anchor."""
    left = length - gram

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = _column(batch, words)
            keys, wanted = P.ints(batch, "rk"), P.raws(batch, "wanted")
            held: list[tuple] = []
            for r, blocks in enumerate(wanted):
                for raw in blocks:
                    h, a, b, p, once = P.unpack(raw)
                    held += [(int(hh), r, int(x), int(y), int(z), int(o)) for hh, x, y, z, o in zip(h, a, b, p, once, strict=True)]
            for i in range(0, len(held), SHARD_ROWS):
                rec = np.array([((x[0] >> 8) % buckets, x[0] & 0xFFFFFFFF, x[0] >> 32, *x[1:]) for x in held[i : i + SHARD_ROWS]], np.int64)
                rec = rec[np.lexsort((rec[:, 1], rec[:, 2], rec[:, 0]))]
                h = (rec[:, 2].astype(U) << U(32)) | rec[:, 1].astype(U)
                _, r, a, b, p, once = rec[:, 0], *rec[:, 3:].T
                texts = np.full((len(rec), left + length), OUTSIDE, np.uint8)
                for x in range(len(rec)):
                    texts[x, left + a[x] - p[x] : left + b[x] + length - p[x]] = data[off[r[x]] + a[x] : off[r[x]] + b[x] + length]
                group = np.cumsum(np.r_[0, (h[1:] != h[:-1]).astype(np.int64)])
                bwt = transform(texts, group)
                rows = []
                edge = np.flatnonzero(np.r_[True, rec[1:, 0] != rec[:-1, 0]])
                for x, y in zip(edge, [*edge[1:], len(rec)], strict=True):
                    rows.append((int(rec[x, 0]), P.pack(h[x:y], keys[r[x:y]], p[x:y].astype(np.int32), once[x:y].astype(np.uint8), bwt[:, x:y].ravel())))
                yield P.blocks(rows)

    return run


def _merge_shards(length, gram):
    left = length - gram

    def run(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        shards = [P.unpack(x) for x in raw]
        for s in shards:  # rows of one bucket stand in order of their high and low halves, that is of h
            s[4] = s[4].reshape(left + length, len(s[0]))
        every, count = np.unique(np.concatenate([s[0] for s in shards]), return_counts=True)
        total = np.cumsum(count)
        i = 0
        while i < len(every):
            j = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + MERGE_ROWS, "right")), i + 1)
            low, high = every[i], every[j - 1]
            i = j
            part = []
            for s in shards:
                x, y = np.searchsorted(s[0], low, "left"), np.searchsorted(s[0], high, "right")
                if y > x:
                    part.append([s[0][x:y], s[1][x:y], s[2][x:y], s[3][x:y], s[4][:, x:y]])
            marked = merge([s[4] for s in part], [s[0] for s in part], length, left + 1)
            rk, p, once = (np.concatenate([s[k] for s in part]) for k in (1, 2, 3))
            marked &= once[:, None] > 0
            edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            r, a = np.nonzero(edge == 1)
            _, b = np.nonzero(edge == -1)
            base = p[r].astype(np.int64) - left
            out = [(SPANS, k, x) for k, x in _spans(rk[r], base + a, base + b - 1 + length)]
            if out:
                yield _found(out)

    return run


def _find(plain: DataFrame, n: int, length: int, gram: int, words: bool) -> tuple[DataFrame, tuple[str, str]]:
    """``(rk, block, words)``: the repeated stretches of each text, in bytes or in letters of its words' codes, and the files they are in."""
    spark = plain.sparkSession
    found, fpath = cut_at(P.gather(P.arrow(plain, _cut_pieces(length, gram, n, words), P.BLOCK_DDL), _compare_pieces(length), _FOUND_DDL), "pieces")

    wanted = found.where(F.col("kind") == WANTED)
    bm = spark.sparkContext.broadcast(P.bitmap(wanted, "rk"))

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in it:
            rk = P.ints(b, "rk")
            at = [i for i in np.flatnonzero(P.hits(bm.value, rk)) if int(rk[i]) not in seen and not seen.add(int(rk[i]))]
            if at:
                yield b.take(pa.array(at))

    sources = P.arrow(plain, pick, plain.schema).join(wanted.groupBy("rk").agg(F.collect_list("block").alias("wanted")), "rk")
    merged, mpath = cut_at(P.gather(P.arrow(sources, _shards(length, gram, n, words), P.BLOCK_DDL), _merge_shards(length, gram), _FOUND_DDL), "merged")
    return found.where(F.col("kind") == SPANS).union(merged).select("rk", "block", F.lit(words).alias("words")), (fpath, mpath)


def _of_words(raw: Sequence[bytes], text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a text's codes as bytes of the text. A code of which a stretch has a part only is not one of its words."""
    got = [P.unpack(x) for x in raw]
    s, e = joined(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
    s, e = -(-s // CODE), e // CODE
    ok = e - s >= words
    _, _, start, end = word_codes(text, np.array([0, len(text)]))
    return start[s[ok]], end[e[ok] - 1]


def _to_characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a text in UTF-8 as the least ones around them that divide no character."""
    first = np.flatnonzero(np.r_[(data & 0xC0) != 0x80, True])  # where characters begin, and the end of the text
    return first[np.searchsorted(first, start, "right") - 1], first[np.searchsorted(first, end, "left")]


def remove_repeats(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", length: int = 400, gram: int = 128, words: int | None = None, whole_characters: bool = False) -> DataFrame:
    """The rows of ``docs`` without the bytes of strings of ``length`` bytes that start anywhere else too.

    With ``words``, passages of that many words (of other than white space) that stand anywhere else too go as well, from their
    first byte to their last, however short they are and whatever white space is between the words; both are judged on the input.
    White space between two words that go goes too. Words are then told apart by 48-bit hashes, passages by all of their words.

    Returns the columns of ``keep`` and ``n_bytes`` (of the whole text as UTF-8), ``spans`` (removed stretches as
    ``start`` and ``end``, disjoint and in order, none touching another) and ``kept`` (remaining bytes as binary, which may break a
    character at a removed edge; with ``whole_characters`` the rest of a character that an edge divides goes too). A byte goes if any ``length``-byte string over it also starts elsewhere, in the same
    or in another row; all occurrences go, judged on the input.

    A null text is an empty one; texts shorter than ``length`` stay whole. Repeated rows are copies of each other,
    so that texts of ``length`` bytes or more which stand in two rows are removed entirely. Ids play no part; nulls and repeats among them
    do no harm. An empty table gives an empty result. Anchors, contents and texts are told apart by 64-bit hashes
    (anchor and content together by 128 bits).
    """
    spark = docs.sparkSession
    n = P.partitions(spark)
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    keyed = docs.select(*kept, F.col(text_col).cast("string").alias("text")).withColumn("rk", F.xxhash64("text"))
    plain = keyed.select("rk", "text")
    got, paths = zip(*(_find(plain, n, *how) for how in [(length, gram, False), *([(words * CODE, min(gram, words * CODE), True)] if words else [])]), strict=True)
    spans = reduce(DataFrame.union, got).groupBy("rk").agg(F.collect_list(F.when(~F.col("words"), F.col("block"))).alias("blocks"), F.collect_list(F.when(F.col("words"), F.col("block"))).alias("coded"))
    spans, _ = cut_at(spans, "spans")
    delete(spark, *(p for x in paths for p in x))
    sm = spark.sparkContext.broadcast(P.bitmap(spans, "rk"))

    def split(hit: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                at = np.flatnonzero(P.hits(sm.value, P.ints(b, "rk")) == hit)
                if len(at):
                    yield b.take(pa.array(at))

        return P.arrow(keyed, run, keyed.schema)

    span_type = "array<struct<start:bigint,end:bigint>>"
    names = [f"k{i}" for i in range(len(keep))]
    whole = split(False).select(*names, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.array().cast(span_type).alias("spans"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("kept"))

    head = [keyed.schema[c] for c in names]
    out_ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in head), "n_bytes long", f"spans {span_type}", "kept binary"])

    def erase(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in it:
            data, off = X.column(b, "text")
            sizes, cut, left, coded = [], [], [], P.raws(b, "coded")
            for r, raw in enumerate(P.raws(b, "blocks")):
                d = data[off[r] : off[r + 1]]
                got = [P.unpack(x) for x in raw or []] + ([_of_words(coded[r], d, words)] if coded[r] else [])
                s, e = joined(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (off[:0], off[:0])
                if whole_characters and len(s):
                    s, e = joined(*_to_characters(d, s, e))
                sizes.append(len(d))
                cut.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                left.append(b"".join(d[x:y].tobytes() for x, y in zip([0, *e], [*s, len(d)], strict=True)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(sizes, pa.int64()), pa.array(cut, pa.list_(struct)), pa.array(left, pa.binary())], names=[*names, "n_bytes", "spans", "kept"])

    some = P.arrow(split(True).join(spans, "rk", "left").select(*names, "text", "blocks", "coded"), erase, out_ddl)
    out = whole.unionByName(some)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "spans", "kept")


def remove_repeats_plainly(texts: Sequence[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    """Brute force for tests: ``(n_bytes, n_removed, n_spans, sha256 of the rest)`` of each text."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in raw:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in raw:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        body = gone[1:-1]
        out.append((len(d), int(body.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~body].tobytes()).hexdigest()))
    return out
