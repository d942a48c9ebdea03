"""Exact Jaccard join of documents on word shingles: pivots, their Voronoi cells, windows at the borders, recursion.

``1 - J`` is a metric, but nearly all distances in a corpus are exactly 1: cells of a few pivots over a whole corpus would
each hold everything, as windows of the triangle inequality exclude nothing between equal distances. So the space is first cut
into *regions* in which distances differ: the shingles' hash space has so many parts that two sets that link, which differ in at
most ``e`` shingles, agree entirely on one (more parts than ``e``, parts without shingles discounted), and a set is
replicated to the region of each of its parts' contents.

Sets that are alike share most of their parts, and so have many regions with the same members. A region is therefore named after its
members, so that those regions are one, and dealt out by its smallest member, so that a pair's regions meet in few tasks, however many there are.

Within a region the join is by pivots. Its metric is the Hamming distance of parity bitmaps, never more than the number of shingles
in which two sets differ. A set within ``e`` of a pivot is at home in the cell of its nearest one, and every other set within ``2 e`` of that
pivot is replicated to the cell: no set further away can link with one at home there. What is at home in no cell is divided again by
pivots of its own, and so on until few are left or pivots find nobody but themselves. In a cell
the sets are ordered by distance to its pivot, and only those whose distances differ by ``e`` at most are compared (the triangle
inequality again). What the bitmaps leave is verified on whole sets.

Pivots find nothing among many unrelated sets that share a region for a common line or passage. Such an undivided region shows which
shingles are common, and its sets are dealt out to regions anew by their other shingles, in which linked sets differ no more than in all.

Linked sets become one *class*, and only sets of different classes are compared, so that a group of near copies costs a few
distances for each member: a cell with many more open pairs than members gives links to a few pivots, and is joined again once its
classes are contracted. None of this loses a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X
from tessera.operators.components import connected_components
from tessera.plans.lineage import cut_at, delete

U = X.U
#: Rounds in which crowded cells may give links to pivots only; in the one after them every cell gives all its open pairs.
PIVOT_ROUNDS = 4
#: Regions of at most so many sets have no pivots; so many are not divided; of more classes than so many that pivots do not divide the
#: common shingles are set aside.
FEW, SMALL, MUCH = 4, 12, 1024
#: Regions of at most so many sets are named after them, are not divided, and are compared many at a time; so many of a region's sets are
#: its pivots.
TOGETHER, LEADS = 64, 16
#: Rounds of pivots in a row that find hardly anybody, after which a region counts as undivided.
POOR = 4
#: Pivots that divide a cell, and in a crowded cell pivots that sets are linked to and sets tried for each.
PIVOTS, COVERS, TRIED = 8, 4, 12
#: A cell with more open pairs than this many times the sets at home there is crowded.
CROWD = 4
#: Bitmaps are first compared folded to one part in so many of their width.
BRIEF = 4
#: Words of bitmaps that are compared at once, and words from which a bitmap is wide.
WORDS_AT_ONCE, WIDE = 1 << 20, 16
#: Parity bits of a set: the next power of two of so many times its size, within these bounds.
BITS_EACH, BITS_LEAST, BITS_MOST = 4, 64, 65536
_STATS = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n", pa.int64()), ("setid", pa.int64()), ("bits", pa.binary())])
PAIR, MEMBER, CROWDED, UNDIVIDED = 1, 2, 3, 4
#: The lower half of a region's name; by the upper one regions are dealt out.
LOWER_HALF = U(0xFFFFFFFF)
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("sigs", pa.binary())])
_FOUND_DDL = "kind int, a long, b long, sigs binary"
_SIGNED = pa.schema([("setid", pa.int64()), ("sigs", pa.list_(pa.binary()))])
_ONE = pa.schema([("h", pa.int64())])
_AB = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(data, off, k):
    """Per row: size, identity, and where its shingles begin; the shingles."""
    row, h = X.shingles(X.LOWER[data], off, k)
    n = np.bincount(row, minlength=len(off) - 1)
    return n, np.cumsum(n) - n, row, h


def _identity(n, first, h):
    out = np.zeros(len(n), U)
    if len(h):
        out[n > 0] = np.add.reduceat(X.mix(h ^ U(0xA54FF53A5F1D36F1)), first[n > 0])
    return X.signed(X.mix(out + n.astype(U)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and texts, with a hash of both; of equal sets the row with the smallest one stands for all."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.withColumn("rk", F.xxhash64("text", "doc_id"))


def _stats(k):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = X.column(b, "text")
            ns, ids, bits = [], [], []
            for i, j in X.chunks(off):
                n, first, _, h = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                ns.append(n)
                ids.append(_identity(n, first, h))
                bits += [parity(h[f : f + m]) for f, m in zip(first, n, strict=True)]
            if ns:
                yield P.batch(_STATS, b.column(0), b.column(2), np.concatenate(ns), np.concatenate(ids), bits)

    return run


def width_of(n: int) -> int:
    return min(max(1 << max(BITS_EACH * n - 1, 0).bit_length(), BITS_LEAST), BITS_MOST)


def parity(h: np.ndarray) -> bytes:
    """For each slot whether an odd number of the set's shingles falls there; two sets' bitmaps differ in no more bits than the sets in shingles."""
    if not len(h):
        return b""
    w = width_of(len(h))
    odd = np.bincount((h >> U(13)).astype(np.int64) & (w - 1), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def size_class(n: np.ndarray, t: int) -> np.ndarray:
    """Classes of sizes whose bounds grow by 100 / t: sets that link are in the same or in neighbouring classes."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / t) + 1e-9).astype(np.int64) if t < 100 else n


@cache
def parts_of(cls: int, t: int) -> tuple[int, int]:
    """Parts for pairs whose larger set is in a size class, and how many parts without shingles they make up for."""
    if t >= 100:
        return 1, 0
    largest = int(np.ceil((100 / t) ** (cls + 1)))
    e = 2 * largest * (100 - t) // (100 + t)
    least = max(1.0, (100 / t) ** (cls - 1))
    spare = 0
    while True:  # as many spare parts as sets of the smallest size leave empty, but for rare ones
        m = e + 1 + spare
        empty = m * np.exp(-least / m)
        want = int(np.ceil(empty + 3 * np.sqrt(empty)))
        if want <= spare or spare > e + 8:
            return m, spare
        spare += 1


def _parted(n: np.ndarray, row: np.ndarray, h: np.ndarray, t: int, turn: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(part of each shingle, set and signature of each part, parts to be used)``, once for each set's own size class and once for the next larger one."""
    own = size_class(n, t)
    spread = X.mix(h + U(0x2545F4914F6CDD1D))
    for step in (0, 1):
        cls = own + step
        m, spare = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
        for c in np.unique(cls[n > 0]):
            m[cls == c], spare[cls == c] = parts_of(int(c), t)
        m[n == 0] = 0
        base = np.cumsum(m) - m
        at = base[row] + (h % m[row].astype(U)).astype(np.int64)
        total = np.zeros(int(m.sum()), U)
        np.add.at(total, at, spread)
        count = np.bincount(at, minlength=len(total))
        who = np.repeat(np.arange(len(n)), m)
        part = np.arange(len(total)) - base[who]
        empty = np.bincount(who[count == 0], minlength=len(n))
        sig = X.mix(total + X.mix((U(turn) << U(48)) + (part.astype(U) << U(16)) + cls[who].astype(U) + U(1)))
        yield at, who, sig, (count > 0) | (empty > spare)[who]


def signatures(n: np.ndarray, row: np.ndarray, h: np.ndarray, t: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(row, signature)`` of the parts of each set. ``n`` has the sizes of whole sets, of which ``row`` and ``h`` may be a part."""
    if not n.any():
        return np.zeros(0, np.int64), np.zeros(0, U)
    made = [(who[keep], sig[keep]) for _, who, sig, keep in _parted(n, row, h, t, turn)]
    return np.concatenate([x[0] for x in made]), np.concatenate([x[1] for x in made])


def _regions(k, t, buckets, common=None, turn=0):
    """Blocks of signatures with their sets, each set once for each batch; shingles in the broadcast bitmap ``common`` are left out."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = X.column(b, "text")
            seen: set[int] = set()
            rows = []
            for i, j in X.chunks(off):
                n, first, row, h = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                ids = _identity(n, first, h)
                new = np.array([m > 0 and s not in seen and not seen.add(s) for m, s in zip(n.tolist(), ids.tolist(), strict=True)], bool)
                keep = new[row]
                if not keep.any():
                    continue
                if common is not None:
                    keep &= ~P.hits(common.value, X.signed(h))
                who, sig = signatures(np.where(new, n, 0), row[keep], h[keep], t, turn)
                rows += [(bucket, P.pack(sig[at], ids[who[at]])) for bucket, at in P.by_bucket(sig >> U(8), buckets)]
            if rows:
                yield P.blocks(rows)

    return run


def _in_common(k, t, undivided, common=None, turn=0):
    """The shingles by which sets came to undivided regions."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = X.column(b, "text")
            for i, j in X.chunks(off):
                n, _, row, h = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                if common is not None:
                    keep = ~P.hits(common.value, X.signed(h))
                    row, h = row[keep], h[keep]
                got = [h[P.hits(undivided.value, X.signed(sig))[at]] for at, _, sig, _ in _parted(n, row, h, t, turn)]
                yield P.batch(_ONE, X.signed(np.unique(np.concatenate(got))))

    return run


def _ranges(low: np.ndarray, high: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(i, j)`` for all j from low[i] up to high[i], a bounded number at a time."""
    cnt = np.maximum(high - low, 0)
    total = np.concatenate([[0], np.cumsum(cnt)])
    x = 0
    while x < len(cnt):
        y = max(int(np.searchsorted(total, total[x] + most, "right")) - 1, x + 1)
        c = cnt[x:y]
        i = np.repeat(np.arange(x, y), c)
        yield i, low[i] + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        x = y


def _ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, each with the smaller one first."""
    x = np.stack([np.minimum(a, b), np.maximum(a, b)])
    x = x[:, np.lexsort((x[1], x[0]))]
    return x[:, np.r_[True, (x[:, 1:] != x[:, :-1]).any(axis=0)]] if x.shape[1] else x


def _pairs(x: np.ndarray) -> pa.RecordBatch:
    n = x.shape[1]
    return P.batch(_FOUND, np.full(n, PAIR), x[0], x[1], pa.nulls(n, pa.binary()))


def _members(sig: np.ndarray, sid: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sets and signatures, packed for the task that is to collect a set's."""
    rows = [(bucket, P.pack(sid[at], sig[at])) for bucket, at in P.by_bucket(X.mix(sid.view(U)), buckets)]
    return P.batch(_FOUND, np.full(len(rows), MEMBER), [r[0] for r in rows], np.zeros(len(rows), np.int64), [r[1] for r in rows])


def _collected(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Each set with the names of all its regions, each once."""
    got = [P.unpack(x) for x in raw]
    sid, sig = (np.concatenate([g[i] for g in got]) for i in range(2))
    sid, sig = _each_once(sig, sid)[::-1]
    start, end = _stretches(sid)
    for i in range(0, len(start), 1 << 14):
        x, y = start[i : i + (1 << 14)], end[i : i + (1 << 14)]
        yield P.batch(_SIGNED, sid[x], [[sig[u:v].tobytes()] for u, v in zip(x, y, strict=True)])


def _stretches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    return start, np.r_[start[1:], len(x)][: len(start)]


def _each_once(sig: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signatures of sets, in order of set and signature."""
    at = np.lexsort((sig, sid))
    sig, sid = sig[at], sid[at]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])][: len(sig)]
    return sig[keep], sid[keep]


def _names(sig: np.ndarray, sid: np.ndarray, start: np.ndarray, end: np.ndarray, turn: int) -> np.ndarray:
    """Names of the regions ``sid[start:end]``, whose sets are in order: those of few sets have one name if they have the same sets.

    The upper half comes from the smallest set. The lower one is the signature's where there are many sets: by it a region that
    turns out to be undivided is found again in its sets. Regions whose names happen to be equal are compared as one, which loses no pair.
    """
    if not len(start):
        return sig
    scrambled = X.mix(sid.view(U) + U(turn))
    alike = X.mix(np.add.reduceat(scrambled, start))
    lower = np.where(end - start <= min(TOGETHER, MUCH), alike, sig[start]) & LOWER_HALF
    return np.repeat((X.mix(scrambled[start]) & ~LOWER_HALF) | lower, end - start)


def _meet(buckets, turn=0):
    """The sets of each region that more than one is in, with its name."""

    def run(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [P.unpack(x) for x in raw]
        sig, sid = (np.concatenate([p[i] for p in parts]) for i in range(2))
        del parts
        at = np.argsort(sig)
        same = np.r_[False, sig[at][1:] == sig[at][:-1]]
        at = at[same | np.r_[same[1:], False]]
        sid, sig = _each_once(sid[at], sig[at])  # a set that came from several tasks counts once
        start, end = _stretches(sig)
        shared = np.repeat(end - start > 1, end - start)
        sig, sid = sig[shared], sid[shared]
        sig, sid = _each_once(_names(sig, sid, *_stretches(sig), turn), sid)
        if len(sig):
            yield _members(sig, sid, buckets)

    return run


def _deal_members(buckets, again=None, turn=0):
    """Members with class, size and bitmap, dealt out by signature: all of this turn, and of earlier ones those in a broadcast bitmap."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sid, comp, n, made = (P.ints(b, c) for c in ("setid", "comp", "n", "turn"))
            sigs, bits = [b"".join(x) for x in P.raws(b, "sigs")], P.raws(b, "bits")
            sig = np.frombuffer(b"".join(sigs), U)
            doc = np.repeat(np.arange(len(sid)), [len(x) >> 3 for x in sigs])
            if again is not None:
                keep = P.hits(again.value, X.signed(sig)) | (made == turn)[doc]
                sig, doc = sig[keep], doc[keep]
            rows = []
            for bucket, at in P.by_bucket(sig >> U(32), buckets):
                d, ix = np.unique(doc[at], return_inverse=True)
                maps = np.frombuffer(b"".join(bits[x] for x in d), np.uint8)
                rows.append((bucket, P.pack(sid[d], comp[d], n[d], sig[at], ix.astype(np.uint32), maps)))
            if rows:
                yield P.blocks(rows)

    return run


def _members_of(regions):
    """Sets that are in one of the regions of a broadcast bitmap."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sigs = [b"".join(x) for x in P.raws(b, "sigs")]
            doc = np.repeat(np.arange(b.num_rows), [len(x) >> 3 for x in sigs])
            at = np.unique(doc[P.hits(regions.value, X.signed(np.frombuffer(b"".join(sigs), U)))])
            yield P.batch(pa.schema([("setid", pa.int64())]), P.ints(b, "setid")[at])

    return run


def _named(sets):
    """Rows of the sets in a broadcast bitmap that have shingles."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = np.flatnonzero(P.hits(sets.value, P.ints(b, "setid")) & (P.ints(b, "n") > 0))
            if len(at):
                yield b.take(pa.array(at))

    return run


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at half its width or less."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _apart(held: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which bitmaps differ, a bounded number of words at a time. Wide ones belong to sets of many regions, so a pair often comes again: it is compared once."""
    again = None
    if held.shape[1] >= WIDE:
        pairs, again = np.unique(i * len(held) + j, return_inverse=True)
        i, j = np.divmod(pairs, len(held))
    out, step = np.zeros(len(i), np.int64), max(WORDS_AT_ONCE // held.shape[1], 1)
    for x in range(0, len(i), step):
        out[x : x + step] = np.bitwise_count(held[i[x : x + step]] ^ held[j[x : x + step]]).sum(axis=1)
    return out if again is None else out[again]


class Cells:
    """The sets of a task: cells of pivots, and the pairs within them that sizes, classes and bitmaps allow to link."""

    def __init__(self, sid: np.ndarray, comp: np.ndarray, size: np.ndarray, bits: list[bytes], t: int):
        self.sid, self.comp, self.size, self.t = sid, comp, size, t
        maps = [np.frombuffer(x, np.uint64) for x in bits]
        self.words = np.array([len(x) for x in maps])
        self.tables: dict[int, np.ndarray] = {}
        self.brief: dict[int, np.ndarray] = {}
        span = 2 * int(np.ceil((100 / t) ** 2))  # sizes in a region differ by no more, so wider sets are never folded to this width
        for w in np.unique(self.words):
            self.tables[int(w)] = held = np.zeros((len(sid), w), np.uint64)
            at = np.flatnonzero((self.words >= w) & (self.words <= span * w))
            for i in at:
                held[i] = _fold(maps[i], w)
            if w >= BRIEF:
                self.brief[int(w)] = less = np.zeros((len(sid), w // BRIEF), np.uint64)
                less[at] = np.bitwise_xor.reduce(held[at].reshape(len(at), BRIEF, -1), axis=1)

    def reach(self, x: np.ndarray) -> int:
        """The most shingles in which two of these sets may differ and link."""
        return int(2 * self.size[x].max() * (100 - self.t) // (100 + self.t))

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, m = self.size[i], self.size[j]
        good = (self.comp[i] != self.comp[j]) & (i != j) & (np.minimum(n, m) * 100 >= self.t * np.maximum(n, m))
        at = np.flatnonzero(good)
        i, j = i[at], j[at]
        most = (self.size[i] + self.size[j]) * (100 - self.t) // (100 + self.t)
        narrow = np.minimum(self.words[i], self.words[j])
        for w in np.unique(narrow):
            x = np.flatnonzero(narrow == w)
            for held in (self.brief.get(int(w)), self.tables[int(w)]):
                if held is not None:
                    ok = _apart(held, i[x], j[x]) <= most[x]
                    good[at[x[~ok]]] = False
                    x = x[ok]
        return good

    def divide(self, members: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(home, guests, distances)`` of the cells: sets at home there, those replicated to it, and how far all are from its pivot.

        Every two sets at most ``reach`` apart are both at home in one cell, or one is and the other is its guest. The last cell holds
        what no pivot has come near to.
        """
        held = self.tables[int(self.words[members].min())]
        away = lambda p, x: _apart(held, x, np.full(len(x), p))
        rest, poor = members, 0
        while len(rest) > SMALL and poor < POOR:
            # pivots are further apart than reach; the smallest identities, which are hashes, come first: a crowd has its share, and its regions agree
            free, pivots, d = np.ones(len(rest), bool), [], []
            for p in np.argsort(self.sid[rest])[: 4 * PIVOTS].tolist():
                if free[p] and len(pivots) < PIVOTS:
                    pivots.append(p)
                    d.append(away(rest[p], rest))
                    free &= d[-1] > reach
            d = np.stack(d)
            own, inside = d.argmin(axis=0), d.min(axis=0) <= reach
            poor = poor + 1 if inside.sum() < 2 * len(pivots) else 0
            for c in range(len(pivots)):
                home = inside & (own == c)
                # of two sets that are at home in different cells, the one in the later cell is the guest
                guest = (d[c] <= 2 * reach) & ~home & ~(inside & (own < c))
                if home.sum() > 1 or (home.any() and guest.any()):
                    yield rest[home], rest[guest], np.r_[d[c, home], d[c, guest]]
            rest = rest[~inside]
        if len(rest) > 1:
            yield rest, rest[:0], away(rest[0], rest)

    def open_pairs(self, home: np.ndarray, guest: np.ndarray, d: np.ndarray, reach: int, whole: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """Pairs of a cell that may link, and whether these are all of them; a crowded cell gives pairs with a few pivots."""
        every = np.r_[home, guest]
        at = np.argsort(d, kind="stable")
        x, d, mine = every[at], d[at], at < len(home)
        left, right, n = [x[:0]], [x[:0]], 0
        for i, j in _ranges(np.arange(len(x)) + 1, np.searchsorted(d, d + reach, "right")):
            i, j = (z[mine[i] | mine[j]] for z in (i, j))
            i, j = x[i], x[j]
            ok = self.may_link(i, j)
            left.append(i[ok])
            right.append(j[ok])
            n += int(ok.sum())
            if n > CROWD * len(home) and not whole:
                return *self.covered(home), False
        return np.concatenate(left), np.concatenate(right), True

    def together(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray, whole: bool, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Undivided regions ``doc[start:end]``, many at a time: pairs that may link, and which regions are crowded and gave a few pivots' only."""
        size = end - start
        total = np.concatenate([[0], np.cumsum(size * (size - 1) // 2)])
        r = 0
        while r < len(size):
            q = max(int(np.searchsorted(total, total[r] + most, "right")) - 1, r + 1)
            held, base = size[r:q], np.cumsum(size[r:q]) - size[r:q]
            x = doc[np.repeat(start[r:q] - base, held) + np.arange(held.sum())]
            # no region of a group is so large that its pairs come in two pieces, and a group is one piece
            i, j = next(_ranges(np.arange(len(x)) + 1, np.repeat(base + held, held), 2 * most), (np.zeros(0, np.int64),) * 2)
            # the first sets of each region are its pivots: within reach of one, and windows on the distance to the first, as in a cell
            d, reach = np.zeros((LEADS, len(x)), np.int64), np.repeat(2 * np.maximum.reduceat(self.size[x], base) * (100 - self.t) // (100 + self.t), held)
            first, width = np.repeat(base, held), np.repeat(np.minimum.reduceat(self.words[x], base), held)
            for w in np.unique(width):
                table = self.tables[int(w)]
                for p in range(LEADS):
                    at = np.flatnonzero((width == w) & (np.arange(len(x)) - first >= p))
                    d[p, at] = _apart(table, x[at], x[first[at] + p])
            p = i - first[i]
            ok = (np.abs(d[0, i] - d[0, j]) <= reach[i]) & ((p >= LEADS) | (d[np.minimum(p, LEADS - 1), j] <= reach[i]))
            i, j = i[ok], j[ok]
            ok = self.may_link(x[i], x[j])
            i, j = i[ok], j[ok]
            of = np.searchsorted(base, i, "right") - 1
            n = np.bincount(of, minlength=len(held))
            crowded = np.flatnonzero(n > CROWD * held) if not whole else np.zeros(0, np.int64)
            keep = ~np.isin(of, crowded)
            left, right = [x[i[keep]]], [x[j[keep]]]
            edge = np.searchsorted(of, np.stack([crowded, crowded + 1]))
            for c, u, v in zip(crowded.tolist(), *edge.tolist(), strict=True):
                b, g = int(base[c]), int(held[c])
                near = np.zeros((g, g), bool)
                near[i[u:v] - b, j[u:v] - b] = near[j[u:v] - b, i[u:v] - b] = True
                mine = x[b : b + g]
                order = np.argsort(mine)
                at = lambda y, m=mine, o=order: o[np.searchsorted(m, y, sorter=o)]
                p, z = self.covered(mine, lambda some, rest, near=near, at=at: near[np.ix_(at(some), at(rest))])
                left.append(p)
                right.append(z)
            yield np.concatenate(left), np.concatenate(right), r + crowded
            r = q

    def covered(self, left: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with a few pivots; those that may link to one are not compared with the next. ``near`` says which may link where that is known."""
        near = near or (lambda some, rest: self.may_link(np.repeat(some, len(rest)), np.tile(rest, len(some))).reshape(len(some), -1))
        ends, pivots = [left[:0]], [left[:0]]
        for _ in range(COVERS):
            if len(left) < 2:
                break
            spread = np.linspace(0, len(left) - 1, min(len(left), TRIED)).astype(int)
            some = left[np.unique(np.r_[spread, np.argsort(self.sid[left])[: 2 * TRIED]])]
            ok = near(some, left)
            able = ok.sum(axis=1)
            good = np.flatnonzero(able >= 0.5 * able.max())  # of these the smallest identity, so that a group's regions agree
            best = int(good[np.argmin(self.sid[some[good]])])
            if not ok[best].any():
                break
            ends.append(left[ok[best]])
            pivots.append(np.full(len(ends[-1]), some[best]))
            left = left[~ok[best] & (left != some[best])]
        return np.concatenate(pivots), np.concatenate(ends)


def _join_regions(t, whole):
    """Pairs of different classes that may link in each region, and the signatures of regions that gave a part only or are undivided."""

    def run(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [P.unpack(x) for x in raw]
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        sid, comp, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
        sig = np.concatenate([p[3] for p in parts])
        doc = np.concatenate([p[4].astype(np.int64) + o for p, o in zip(parts, base, strict=False)])
        maps = np.concatenate([p[5] for p in parts]).tobytes()
        del parts
        ends = np.cumsum([width_of(int(n)) >> 3 for n in size]).tolist()
        cells = Cells(sid, comp, size, [maps[x:y] for x, y in zip([0, *ends], ends, strict=False)], t)
        del maps
        at = np.argsort(sig, kind="stable")
        sig, doc = sig[at], doc[at]
        found, held, crowded, undivided = [np.zeros((2, 0), np.int64)], 0, set(), set()

        def note(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal found, held
            found.append(_ordered(sid[i], sid[j]))
            held += found[-1].shape[1]
            if held > 2_000_000:
                found, held = [_ordered(*np.concatenate(found, axis=1))], 0

        start, end = _stretches(sig)
        tiny = end - start <= FEW
        x = doc[np.repeat(tiny, end - start)]
        for i, j in _ranges(np.arange(len(x)) + 1, np.repeat(np.cumsum((end - start)[tiny]), (end - start)[tiny])):
            ok = cells.may_link(x[i], x[j])
            note(x[i[ok]], x[j[ok]])
        start, end = start[~tiny], end[~tiny]
        small = end - start <= min(TOGETHER, MUCH)
        for i, j, part in cells.together(doc, start[small], end[small], whole):
            note(i, j)
            crowded.update(start[small][part].tolist())
        for a, z in zip(start[~small], end[~small], strict=True):
            x = doc[a:z]
            if (comp[x] == comp[x[0]]).all():
                continue
            reach = cells.reach(x)
            for home, guest, d in cells.divide(np.unique(x), reach):
                if not whole and t < 100 and not len(guest) and d.max() > reach and len(np.unique(comp[home])) > MUCH:
                    undivided.add(int(a))
                    continue
                i, j, all_ = cells.open_pairs(home, guest, d, reach, whole)
                if not all_:
                    crowded.add(int(a))
                note(i, j)
        pairs = _ordered(*np.concatenate(found, axis=1))
        if pairs.shape[1]:
            yield _pairs(pairs)
        for kind, some in ((CROWDED, crowded), (UNDIVIDED, undivided)):
            at = sorted(some)
            if at:
                yield P.batch(_FOUND, np.full(len(at), kind), X.signed(sig[at]), np.zeros(len(at), np.int64), pa.nulls(len(at), pa.binary()))

    return run


def _texts(keyed: DataFrame, about: DataFrame, ids: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``(setid, text)``: one text with each of the sets named.

    The texts are picked out by a filter of fixed size while the documents are read, so that only they are shuffled.
    """
    spark = keyed.sparkSession
    want, wat = cut_at(about.join(ids, "setid").select("setid", "rk"), "want")
    bm = spark.sparkContext.broadcast(P.bitmap(want, "rk"))

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = np.flatnonzero(P.hits(bm.value, P.ints(b, "rk")))
            if len(at):
                yield b.take(pa.array(at))

    picked = P.arrow(keyed.select("rk", "text"), pick, "rk long, text string")
    out = cut_at(picked.join(want, "rk").select("setid", "text").dropDuplicates(["setid"]), tag)
    delete(spark, wat)
    return out


def _verify(texts: DataFrame, pairs: DataFrame, k: int, tag: str) -> tuple[DataFrame, str]:
    """``(a, b, common, na, nb)`` of pairs of set identities, on whole sets, which take less room as texts."""
    left, right = (texts.select(F.col("setid").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    outs = pa.schema([(c, pa.int64()) for c in ("a", "b", "common", "na", "nb")])

    def sets(b: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
        data, off = X.column(b, name)
        for i, j in X.chunks(off):
            n, first, _, h = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
            for f, m in zip(first, n, strict=True):
                yield h[f : f + m]

    def common(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(sets(b, "ta"), sets(b, "tb"), strict=True)]
            if got:
                yield P.batch(outs, P.ints(b, "a"), P.ints(b, "b"), *map(list, zip(*got, strict=True)))

    return cut_at(P.arrow(both, common, "a long, b long, common long, na long, nb long"), tag)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_verified)`` for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text after lower-casing A-Z; the set is that of the distinct
    ``k``-word shingles, or the whole sequence as one where there are fewer words. Rows link when
    ``100 * |common| >= percent * |union|``; ``component_id`` is the smallest id reachable by links, the own one
    included. ``n_verified`` counts the links verified of the row's shingle set to other sets: links to pivots
    and links between classes, not all pairs.

    Null or wordless texts: size 0, linked with nothing, ``component_id`` their own id. A null id stays null, and
    such rows never name a component unless all of its rows have null ids. Rows with equal sets are one class, so repeated rows keep one row each.
    A very long text is one set like any other, held whole by one task at a time. An empty table gives an empty result. Other
    columns are ignored, whatever they are called. Sets are told apart by a 64-bit hash of their content and shingles by one of their words.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    cols = ", ".join(f"{f.name} {'binary' if f.name == 'bits' else 'long'}" for f in _STATS)
    stats, spath = cut_at(P.arrow(keyed, _stats(k), cols), "sets")
    linked = F.expr(f"common * {100 + percent} >= {percent} * (na + nb)")
    parts = P.partitions(spark)
    met, mpath = cut_at(P.gather(P.arrow(keyed.select("text"), _regions(k, percent, parts), P.BLOCK_DDL), _meet(parts), _FOUND_DDL), "regions")
    paths = [mpath]

    # what is known of the sets that share a region with another one: size, bitmap, and the row whose text stands for it
    def collect(met: DataFrame, turn: int) -> DataFrame:
        blocks = met.where(F.col("kind") == MEMBER).select(F.col("a").cast("int").alias("bucket"), F.col("sigs").alias("block"))
        out, at = cut_at(P.gather(blocks, _collected, "setid long, sigs array<binary>"), f"signed-{turn}")
        paths.append(at)
        return out

    signed = collect(met, 0)
    bm = spark.sparkContext.broadcast(P.bitmap(signed, "setid"))

    brief = P.arrow(stats.select("setid", "n", "rk", "bits"), _named(bm), "setid long, n long, rk long, bits binary")
    about, apath = cut_at(brief.groupBy("setid").agg(F.min("n").alias("n"), F.min("rk").alias("rk"), F.min("bits").alias("bits")), "about")
    paths.append(apath)

    def dealt_in(signed: DataFrame, turn: int, about: DataFrame) -> DataFrame:
        """The members of regions; ``about`` has the sets that are dealt out in this turn."""
        out, at = cut_at(signed.join(about.select("setid", "n", "bits"), "setid").withColumn("turn", F.lit(turn).cast("long")), f"members-{turn}")
        paths.append(at)
        return out

    members = dealt_in(signed, 0, about)
    texts: list[DataFrame] = []
    seen: list[DataFrame] = []
    classes = again = common = None
    last = False

    def fetch(need: DataFrame, tag: str) -> None:
        """Texts of sets that are not at hand yet."""
        need, at = cut_at(need.distinct().join(_union(texts).select("setid"), "setid", "left_anti") if texts else need.distinct(), "need")
        paths.append(at)
        if not texts or not need.isEmpty():
            got, at = _texts(keyed, about, need, tag)
            texts.append(got)
            paths.append(at)

    for r in range(PIVOT_ROUNDS + 1):
        if r:
            comp = classes.select(F.col("node").alias("setid"), F.col("component").alias("comp"))
            rows = members.join(comp, "setid", "left").withColumn("comp", F.coalesce("comp", "setid"))
            only = spark.sparkContext.broadcast(P.bitmap(again, "a"))
        else:
            rows, only = members.withColumn("comp", F.col("setid")), None
        blocks = P.arrow(rows.select("setid", "comp", "n", "turn", "sigs", "bits"), _deal_members(parts, only, r), P.BLOCK_DDL)
        done = last or r == PIVOT_ROUNDS
        joined, gat = cut_at(P.gather(blocks, _join_regions(percent, done), _FOUND_DDL), f"cells-{r}")
        paths.append(gat)
        found, again, undivided = (joined.where(F.col("kind") == kind).select("a", "b") for kind in (PAIR, CROWDED, UNDIVIDED))
        found = found.distinct().join(_union(seen).select("a", "b"), ["a", "b"], "left_anti") if seen else found.distinct()
        cand, at = cut_at(found, f"pairs-{r}")
        paths.append(at)
        fresh = not cand.isEmpty()
        if not seen or fresh:
            fetch(cand.select(F.col("a").alias("setid")).union(cand.select("b")), f"texts-{r}")
            got, vat = _verify(_union(texts), cand, k, f"distances-{r}")
            seen.append(got)
            links = _union(seen).where(linked).select("a", "b")
            classes, cat = cut_at(connected_components(links), f"classes-{r}")
            paths += [vat, cat]
        if not undivided.isEmpty():
            # the sets of undivided regions are dealt out again, without the shingles that brought them there
            only = spark.sparkContext.broadcast(P.bitmap(undivided, "a"))
            theirs, tat = cut_at(P.arrow(members.select("setid", "sigs"), _members_of(only), "setid long").distinct(), "undivided")
            fetch(theirs, f"texts-{r}-undivided")
            mine, mat = cut_at(_union(texts).join(theirs, "setid", "left_semi").select("text"), "anew")
            before = common
            shown, sat = cut_at(P.arrow(mine, _in_common(k, percent, only, before, r), "h long").distinct(), "common")
            more = P.bitmap(shown, "h")
            if before is not None and not (more & ~before.value).any():  # nothing left to set aside: the next round compares all that is open
                again, last = again.unionByName(undivided), True
                paths += [tat, mat, sat]
                continue
            common = spark.sparkContext.broadcast(more if before is None else more | before.value)
            met, at = cut_at(P.gather(P.arrow(mine, _regions(k, percent, parts, common, r + 1), P.BLOCK_DDL), _meet(parts, r + 1), _FOUND_DDL), f"regions-{r + 1}")
            paths += [tat, mat, sat, at]
            dealt = spark.sparkContext.broadcast(P.bitmap(theirs, "setid"))
            new = P.arrow(about.select("setid", "n", "bits"), _named(dealt), "setid long, n long, bits binary")
            members = members.unionByName(dealt_in(collect(met, r + 1), r + 1, new))
        elif again.isEmpty() or done:
            break
        else:  # where nothing new was found, no class is contracted and crowded cells stay as they are: the next round takes them whole
            last = not fresh

    label = classes.select(F.col("node").alias("setid"), F.col("component").alias("label"))
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_verified")).withColumnRenamed("a", "setid")
    least = stats.where("n > 0").groupBy("setid").agg(F.min("doc_id").alias("least"))
    of_set = least.join(label, "setid", "left").withColumn("label", F.coalesce("label", "setid")).join(degree, "setid", "left")
    of_label = of_set.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set, _ = cut_at(of_set.join(of_label, "label").select("setid", "component_id", F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified")), "labels")
    delete(spark, *paths)
    out = stats.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("setid")).alias("setid")).join(of_set, "setid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"))
