"""Alignment of two tokenizers over a corpus, with counts of all pairs of ids that overlap.

A text's two token sequences spell the same bytes. Places where tokens of both end cut them into groups, and every stretch between
two neighbouring ends of either sequence is one link: the overlap of one token of each. A link is a packed 64-bit key, the second
tokenizer's id above the first one's. Each task counts the keys of its part (``np.unique``); a global sort by ranges of keys brings equal ones
together, where their runs are summed; each range becomes a shard, sorted keys and their counts, in the shared folder. Lookups
map the shards into memory and search them by bisection, so that no task holds the table.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import tempfile
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import storage
from tessera.llm.bpe import byte_letters
from tessera.plans.lineage import cut_at, delete, new_path

#: Keys of a task that are held before they are counted, and distinct ones before they are handed on.
HELD, DISTINCT = 1 << 21, 1 << 22
LOW = (1 << 32) - 1
_COUNT = pa.schema([("key", pa.int64()), ("n", pa.int64())])
_SHARD = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("size", pa.int64()), ("best", pa.binary())])


class BytePairs:
    """The byte-level tokenizer of one file. Strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.spelt = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for raw, i in vocab.items():
            self.spelt[i] = raw
        merged = [(vocab[bytes(map(byte.__getitem__, a + b))]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        if merged != sorted(merged):
            raise ValueError("ids are not in the order of merges")
        self.coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class Pieces:
    """The piece tokenizer of one file, which puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.spelt = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text), np.int64)


class Spelling:
    """Byte strings of numbered things, one after another."""

    def __init__(self, strings: Sequence[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The strings of these, joined."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the strings that stand for tokens in a listing of groups."""

    def __init__(self, a: str, pattern: str, b: str):
        self.a, self.b = BytePairs(a, pattern), Pieces(b)
        self.spelt_a, self.spelt_b = Spelling(self.a.spelt), Spelling(self.b.spelt)
        self.listed = Spelling([b"%d" % i + end for t, ends in ((self.a, (b",", b"|")), (self.b, (b",", b";"))) for end in ends for i in range(len(t.spelt))])

    def align(self, text: str) -> tuple[int, int, int, np.ndarray, np.ndarray, bytes] | None:
        """Tokens of either, groups, distinct keys with their numbers, and the listing; nothing if the tokens do not spell the text."""
        if not text:
            return None
        line = " " + text
        raw = np.frombuffer(line.encode(), np.uint8)
        a, b = self.a.encode(line), self.b.encode(text)
        if not all(np.array_equal(s.of(ids), raw) for s, ids in ((self.spelt_a, a), (self.spelt_b, b))):
            return None
        end_a, end_b = np.cumsum(self.spelt_a.size[a]), np.cumsum(self.spelt_b.size[b])
        sides = np.zeros(len(raw) + 1, np.uint8)
        sides[end_a] = 1
        sides[end_b] |= 2
        ends, both = np.flatnonzero(sides), np.flatnonzero(sides == 3)
        at_a, at_b = (np.cumsum(sides[ends] & side > 0) - (sides[ends] & side > 0) for side in (1, 2))
        key = b[at_b] << 32 | a[at_a]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        # a token stands after all tokens of earlier groups and, if it is of the second kind, those of the first kind in its own
        done_a, done_b = np.searchsorted(end_a, both, "right"), np.searchsorted(end_b, both, "right")
        na, nb = len(self.spelt_a.size), len(self.spelt_b.size)
        listed = np.empty(len(a) + len(b), np.int64)
        listed[np.arange(len(a)) + np.r_[0, done_b][group_a]] = a + na * (both[group_a] == end_a)
        listed[np.arange(len(b)) + done_a[group_b]] = 2 * na + b + nb * (both[group_b] == end_b)
        return len(a), len(b), len(both), *np.unique(key, return_counts=True), self.listed.of(listed)[:-1].tobytes()


@lru_cache(maxsize=1)
def load(a: str, pattern: str, b: str) -> Aligner:
    return Aligner(a, pattern, b)


def squeeze(key: np.ndarray, n: np.ndarray) -> bytes:
    """Distinct keys in order with their numbers, in few bytes."""
    high = np.diff(key >> 32, prepend=0)
    fit = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return zstandard.compress(P.pack(fit(high), fit(key & LOW), fit(n)), 3)


def expand(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    high, low, n = (x.astype(np.int64) for x in P.unpack(zstandard.decompress(raw)))
    return np.cumsum(high) << 32 | low, n


def run_sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys each once, with the sum of its numbers."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[start], np.add.reduceat(n, start) if len(start) else n


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.argsort(key, kind="stable")
    return run_sums(key[at], n[at])


def _aligned(src: DataFrame, names: Sequence[str], files: tuple[str, str, str]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*files)
        try:
            for b in it:
                for i in range(0, b.num_rows, 256):
                    part, rows = b.slice(i, 256), []
                    for t in P.raws(part, "text"):
                        got = both.align(t or "")
                        if got is None:
                            rows.append((0, 0, 0, 0, "", squeeze(np.zeros(0, np.int64), np.zeros(0, np.int64))))
                        else:
                            na, nb, groups, key, n, listing = got
                            rows.append((na, nb, groups, int(n.sum()), hashlib.sha256(listing).hexdigest(), squeeze(key, n)))
                    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                    made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), *made], names=[*names, *_MADE])
        finally:  # a worker lives on after its task
            load.cache_clear()

    ddl = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in names), "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"])
    return P.arrow(src, run, ddl)


_MADE = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]


def partial_counts(pairs: DataFrame) -> DataFrame:
    """``(key, n)`` of the packed ``pairs``, each key once for a task, or a few times where a task has very many."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, ns, held = [], [], 0
        for b in it:
            for raw in P.raws(b, "pairs"):
                k, m = expand(raw)
                keys.append(k)
                ns.append(m)
                held += len(k)
                if held > HELD:
                    key, n = _summed(np.concatenate([key, *keys]), np.concatenate([n, *ns]))
                    keys, ns, held = [], [], 0
                    if len(key) > DISTINCT:
                        yield P.batch(_COUNT, key, n)
                        key, n = key[:0], n[:0]
        key, n = _summed(np.concatenate([key, *keys]), np.concatenate([n, *ns]))
        for i in range(0, len(key), 1 << 16):
            yield P.batch(_COUNT, key[i : i + (1 << 16)], n[i : i + (1 << 16)])

    return P.arrow(pairs.select("pairs"), run, "key long, n long")


def write_shards(partial: DataFrame, folder: str) -> DataFrame:
    """Sorts counts by ranges of keys, sums equal keys and writes a shard for each range: all keys in order, then their counts.

    Gives ``(shard, first, size, best)``: the smallest key, how many, and for each high half the largest count.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns = [], []
        last: tuple[np.ndarray, np.ndarray] | None = None
        for b in it:
            k, n = P.ints(b, "key"), P.ints(b, "n")
            if last is not None:
                k, n = np.r_[last[0], k], np.r_[last[1], n]
            k, n = run_sums(k, n)
            last = (k[-1:], n[-1:])  # its run may go on in the next batch
            keys.append(k[:-1])
            ns.append(n[:-1])
        if last is None:
            return
        key, n = np.concatenate([*keys, last[0]]), np.concatenate([*ns, last[1]])
        del keys, ns
        shard = TaskContext.get().partitionId()
        fs, at = storage.at(folder)
        fs.create_dir(at, recursive=True)
        tmp, final = f"{at}/tmp-{shard}-{TaskContext.get().taskAttemptId()}", f"{at}/shard-{shard}"
        with fs.open_output_stream(tmp) as f:
            f.write(key)
            f.write(n)
        storage.publish(fs, tmp, final)
        start = np.flatnonzero(np.r_[True, key[1:] >> 32 != key[:-1] >> 32])
        best = P.pack(key[start] >> 32, np.maximum.reduceat(n, start))
        yield P.batch(_SHARD, [shard], key[:1], [len(key)], [best])

    ranges = partial.repartitionByRange(P.partitions(partial.sparkSession), "key").sortWithinPartitions("key")
    return P.arrow(ranges, run, "shard int, first long, size long, best binary")


def mapped(folder: str, shard: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard, mapped into memory; of one in a remote store a copy without a name is mapped."""
    fs, at = storage.at(folder)
    path = f"{at}/shard-{shard}"
    if isinstance(fs, pafs.LocalFileSystem):
        both = np.memmap(path, np.int64, "r", shape=(2, size))
    else:
        with fs.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:
            shutil.copyfileobj(f, copy, 1 << 20)
            copy.flush()
            both = np.memmap(copy, np.int64, "r", shape=(2, size))
    return both[0], both[1]


class Counts:
    """Counts of keys, looked up in mapped shards."""

    def __init__(self, folder: str, shards: Sequence[tuple[int, int, int]]):
        self.folder, self.shards = folder, sorted(shards, key=lambda s: s[1])
        self.first = np.array([s[1] for s in self.shards], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, key: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, each of which some shard has."""
        out = np.zeros(len(key), np.int64)
        of = np.searchsorted(self.first, key, "right") - 1
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
        for x, y in zip(edge, np.r_[edge[1:], len(key)][: len(edge)], strict=True):
            s = int(of[x])
            if s not in self.open:
                shard, _, size = self.shards[s]
                self.open[s] = mapped(self.folder, shard, size)
            keys, n = self.open[s]
            out[x:y] = n[np.searchsorted(keys, key[x:y])]
        return out


def align_tokenizers(docs: DataFrame, a: str, pattern: str, b: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``a`` is the path of a byte-level tokenizer file with its ``pattern``, given a blank and the text; ``b`` that of a piece model,
    given the text. Strings of special tokens are plain text. A link's count is how many links of the whole corpus have its pair of ids;
    ``n_best`` counts links whose count is the highest of their second id, ties included, and ``count_sum`` adds counts over links.
    ``groups_sha256`` digests ``a1,a2|b1;a3|b2,b3``, the ids of each group in order.

    Null and empty texts, and texts whose tokens of either kind do not spell a blank and the text, have zeros and an empty digest.
    A very long text is aligned whole in one task. Repeated rows count once each; an empty table gives an empty
    result; column names cannot clash, as only those named are read. What is broadcast is one number for each id of ``b`` and three for each
    shard. The count table has at most one entry for each pair of ids.
    """
    spark = docs.sparkSession
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep, strict=True)), F.col(text_col).cast("string").alias("text"))
    pairs, pat = cut_at(_aligned(src, names, (a, pattern, b)), "pairs")
    partial, cat = cut_at(partial_counts(pairs), "partial")
    folder = new_path(spark, "counts")
    # one row for a shard, and in all of them one number for each id and one more for each border between shards
    made = write_shards(partial, folder).collect()
    shards = [(r.shard, r.first, r.size) for r in made]
    tops = [P.unpack(r.best) for r in made]
    best = np.zeros(1 + max((int(t[0].max()) for t in tops), default=0), np.int64)
    for ids, n in tops:
        best[ids] = np.maximum(best[ids], n)
    top = spark.sparkContext.broadcast(best)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(folder, shards)
        for batch in it:
            n_best, total = [], []
            for raw in P.raws(batch, "pairs"):
                key, n = expand(raw)
                c = counts.of(key)
                n_best.append(int(n[c == top.value[key >> 32]].sum()) if len(key) else 0)
                total.append(int((c * n).sum()))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in [*names, *_MADE[:-1]]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=[*names, *_MADE[:-1], "n_best", "count_sum"])

    ddl = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in names), "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"])
    out, _ = cut_at(P.arrow(pairs, score, ddl), "aligned")
    delete(spark, pat, cat, folder)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
