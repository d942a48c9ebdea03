"""Near duplicates by 64-bit SimHash fingerprints and multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints at most three bits apart, one segment differs in one bit at
most. So a table for each segment holds every fingerprint under its own value there, and each fingerprint looks up the ball of
radius one around that value; of two values that differ in a bit only the one without it looks for the other. What is found
under one value is compared over all 64 bits. Equal fingerprints are one entry, however many texts have them.

A value that very many fingerprints hold is refined by each byte of the other segment: three bits spoil three of four bytes at most, so
that no pair is lost, and an entry of that table has 24 free bits, which bounds it. Larger entries give a spanning forest of their pairs
instead of all of them: each fingerprint reached is compared with those not yet reached, which are few in a crowd of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X
from tessera.operators.components import connected_components
from tessera.plans.lineage import cut_at, delete

U = X.U
#: Bits in which two fingerprints may differ. The segments below follow from it.
RADIUS = 3
SEGMENT = 32
#: Fingerprints under one segment value from which it is refined, and those of an entry from which it gives a spanning forest.
HOT, MANY = 4096, 8
#: Shingles hashed at a time, and pairs compared at a time.
AT_ONCE = 1 << 18
SEED = 42
_LOWER = X.LOWER.tobytes()
_AB = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprints(texts: Sequence[bytes], k: int = 3) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if set in more than half of the hashes of its ``k``-word shingles, repeats counted."""
    hashes: list[int] = []
    ends, out = [0], [np.zeros(0, U)]
    digest = xxhash.xxh64_intdigest

    def majority() -> np.ndarray:
        off = np.array(ends)
        n = np.diff(off)
        got = np.zeros((len(n), 64), np.int64)
        if len(hashes):
            bits = np.unpackbits(np.array(hashes, U).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            got[n > 0] = np.add.reduceat(bits, off[:-1][n > 0], axis=0, dtype=np.int64)
        return np.packbits(2 * got > n[:, None], axis=1, bitorder="little").view(U).ravel()

    for raw in texts:
        words = raw.translate(_LOWER).split()
        line = b" ".join(words)
        if len(words) > k:
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            start = np.r_[0, end[:-1] + 1]
            hashes += [digest(line[x:y], SEED) for x, y in zip(start.tolist(), end[k - 1 :].tolist(), strict=False)]
        elif words:
            hashes.append(digest(line, SEED))
        ends.append(len(hashes))
        if len(hashes) > AT_ONCE:
            out.append(majority())
            hashes, ends = [], [0]
    out.append(majority())
    return np.concatenate(out)


def _fingerprint(k: int):
    outs = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            _, off = X.column(b, "text")
            for i, j in X.chunks(off):
                part = b.slice(i, j - i)
                yield P.batch(outs, part.column(0), X.signed(fingerprints([(t or "").encode() for t in P.raws(part, "text")], k)))

    return run


def lookups(fp: np.ndarray, hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(entry, place in fp, own)``: the entries of the tables under which fingerprints stand (own) and those that they look up.

    ``hot`` tells which segment values are refined.
    """
    entry, place, own = [], [], []
    bits = U(1) << np.arange(SEGMENT, dtype=U)
    for s in (0, 1):
        mine, other = (fp >> U(SEGMENT * x) & U((1 << SEGMENT) - 1) for x in (s, 1 - s))
        unset = (mine[:, None] & bits) == 0
        at, bit = np.nonzero(unset)
        value = np.r_[mine, mine[at] | bits[bit]] | U(s << SEGMENT)
        who, has = np.r_[np.arange(len(fp)), at], np.arange(len(value)) < len(fp)
        fine = hot(value)
        entry.append(value[~fine])
        place.append(who[~fine])
        own.append(has[~fine])
        if fine.any():
            value, who, has = value[fine], who[fine], has[fine]
            for j in range(RADIUS + 1):
                byte = other[who] >> U(8 * j) & U(255)
                entry.append(U(1 << 44) | U(j << 42) | byte << U(34) | value)
                place.append(who)
                own.append(has)
    return np.concatenate(entry), np.concatenate(place), np.concatenate(own)


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at most ``RADIUS`` bits apart that connect all that such pairs connect, one less than each component has members."""
    left, right, rest = [], [], np.arange(len(fp))
    ready: list[int] = []
    while len(rest):
        if not ready:
            ready, rest = [int(rest[0])], rest[1:]
        x = ready.pop()
        near = np.bitwise_count(fp[rest] ^ fp[x]) <= RADIUS
        hit = rest[near]
        if len(hit):
            left.append(np.full(len(hit), x))
            right.append(hit)
            ready += hit.tolist()
            rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def entry_pairs(entry: np.ndarray, fp: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Pairs within ``RADIUS`` that meet under one entry: all those with an own one for a small entry, a forest for a larger one."""
    at = np.lexsort((~own, entry))
    entry, fp, own = entry[at], fp[at], own[at]
    start = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]][: len(entry)])
    size = np.diff(np.r_[start, len(entry)])
    owners = np.add.reduceat(own.astype(np.int64), start) if len(start) else size
    found = [np.zeros((2, 0), U)]
    for s, n in zip(start[(size > MANY) & (owners > 0)].tolist(), size[(size > MANY) & (owners > 0)].tolist(), strict=True):
        same = np.unique(fp[s : s + n])
        i, j = forest(same)
        found.append(np.stack([same[i], same[j]]))
    few = np.repeat((size <= MANY) & (size > 1) & (owners > 0), size) & own
    i = np.flatnonzero(few)
    last = np.repeat(start + size, size)[i]
    for step in range(1, MANY):
        i, last = i[i + step < last], last[i + step < last]
        ok = np.bitwise_count(fp[i] ^ fp[i + step]) <= RADIUS
        found.append(np.stack([fp[i[ok]], fp[i[ok] + step]]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return np.unique(np.sort(pairs, axis=0), axis=1)


def near_links(distinct: DataFrame, col: str = "fp") -> DataFrame:
    """``(a, b)``: pairs of a table's distinct 64-bit fingerprints within ``RADIUS`` bits that connect all that such pairs connect."""
    spark = distinct.sparkSession
    parts = P.partitions(spark)
    values = F.array(F.expr(f"{col} & {(1 << SEGMENT) - 1}L"), F.expr(f"shiftrightunsigned({col}, {SEGMENT}) | {1 << SEGMENT}L"))
    crowded = distinct.select(F.explode(values).alias("value")).groupBy("value").count().where(F.col("count") > HOT)
    hot = spark.sparkContext.broadcast(P.bitmap(crowded, "value"))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            every = P.ints(b, "fp").view(U)
            for i in range(0, len(every), AT_ONCE >> 4):
                fp = every[i : i + (AT_ONCE >> 4)]
                entry, place, own = lookups(fp, lambda v: P.hits(hot.value, X.signed(v)))
                rows = [(bucket, P.pack(entry[at], fp[place[at]], own[at])) for bucket, at in P.by_bucket(X.mix(entry), parts)]
                if rows:
                    yield P.blocks(rows)

    def meet(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [P.unpack(x) for x in raw]
        pairs = entry_pairs(*(np.concatenate([g[i] for g in got]) for i in range(3)))
        if pairs.shape[1]:
            yield P.batch(_AB, X.signed(pairs[0]), X.signed(pairs[1]))

    return P.gather(P.arrow(distinct.select(F.col(col).alias("fp")), deal, P.BLOCK_DDL), meet, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id, n_links)`` for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text after lower-casing A-Z; shingles are ``k`` words joined by blanks, or the whole
    sequence where there are fewer, hashed as XXH64 with seed 42. Fingerprints (``fp`` as a signed number, ``fingerprint`` as 16 digits) link
    when they differ in three bits or fewer; ``component_id`` is the smallest id reachable, the own one included. ``n_links`` counts
    the links to other fingerprints that were needed, not all there are.

    Null or wordless texts have the fingerprint zero and are linked like any other. A null id stays null, and names no component unless
    all of its rows have null ids. Repeated rows keep one row each; ties do not arise. A very long text is hashed whole in one task. An
    empty table gives an empty result. Other columns are ignored, whatever they are called.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, _ = cut_at(P.arrow(mine, _fingerprint(k), "doc_id long, fp long"), "fingerprints")
    distinct, dat = cut_at(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links, lat = cut_at(near_links(distinct).distinct(), "links")
    classes, cat = cut_at(connected_components(links), "classes")
    label = classes.select(F.col("node").alias("fp"), F.col("component").alias("label"))
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "fp")
    linked = distinct.join(label, "fp").join(degree, "fp")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    # only fingerprints with links need a name of their component; all others are named after their own smallest id
    named = distinct.join(linked.join(least, "label").select("fp", "component_id", "n_links"), "fp", "left")
    named, _ = cut_at(named.select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "names")
    delete(spark, dat, lat, cat)
    return rows.join(named, "fp", "left").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
