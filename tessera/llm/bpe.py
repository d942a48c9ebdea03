"""Byte-pair encoding with a pair occurrence index, and decoding, for tokenizer files with word ends.

A partition's distinct words are encoded together. An index maps each pair of neighbouring symbols to all its
positions in these words; a heap gives the active pairs in ascending order of rank. Applying a pair
joins it at all its positions, left to right, and moves the neighbouring positions to the lists of the pairs that come to be.
Words not yet met in the partition are encoded batch by batch, and their ids are kept for it in one packed array.
Decoding reads ids alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X

#: White space as the tokenizer's own expression engine sees it.
BLANK = r"\t-\r \x85\xa0  -     　"
#: Kept words at most, and their bytes; beyond that all go, which costs time only.
WORDS_KEPT, BYTES_KEPT = 200_000, 4 << 20
#: Bytes of text encoded at a time.
GROUP = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in own else chr(256 + extra)
        extra += b not in own
    return out


class WordBpe:
    """The tokenizer of one file: composes, lower-cases, splits into words, and merges pairs by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["decoder"] is not None or spec["post_processor"] is not None or model["unk_token"] is not None or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("another kind of tokenizer file")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        #: The same by place, unless an id is missing.
        self.table = np.array([self.names.get(i) for i in range(max(self.names) + 1)], object)
        self.whole = len(self.names) == len(self.table)
        self.end = model["end_of_word_suffix"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        #: Pairs as numbers in ascending order, their ranks, and the pairs by rank.
        self.pairs = {r: p for p, (r, _) in self.rank.items()}
        numbers = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(numbers)
        self.pair_numbers, self.pair_ranks = numbers[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"^\s", "^" + BLANK))
        self.letters = byte_letters()
        self.first = [self.vocab.get(c) for c in self.letters]
        self.last = [self.vocab.get(c + self.end) for c in self.letters]
        self.symbols = np.array([[-1 if i is None else i for i in x] for x in (self.first, self.last)])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.forget()

    def forget(self) -> None:
        """Drops the words encoded so far."""
        #: The place of each known word; its ids stand from ``starts[place]`` up to the next start.
        self.known: dict[str, int] = {w: k for k, w in enumerate(self.special)}
        self.ids = array("i", self.special.values())
        self.starts = array("q", range(len(self.special) + 1))
        self.size = 0

    def words(self, text: str) -> list[str]:
        """Words of a whole text in order; the strings of special tokens are words of their own."""
        if "<|" in text and self.cut.search(text):
            out: list[str] = []
            for part in self.cut.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one at a time, so that no sigma is a final one
        return self.split.findall(text.lower())

    def merge_all(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of each word."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([0, *map(len, raw)])
        at_end = np.zeros(ends[-1], np.int64)
        at_end[ends[1:][np.diff(ends) > 0] - 1] = 1
        found = self.symbols[at_end, np.frombuffer(b"".join(raw), np.uint8)]
        has = found >= 0
        bounds = np.concatenate([[0], np.cumsum(has)])[ends].tolist()
        found = found[has]
        n = len(found)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for x in bounds:
            if x < n:
                prv[x] = -1
            if x:
                nxt[x - 1] = -1
        rank = self.rank
        sym = found.tolist()
        index = self._index(found, np.array(nxt) >= 0)
        heap = [(rank[p][0], p) for p in index]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            places = index.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            new = rank[pair][1]
            places.sort()
            for i in places:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if j < 0 or sym[j] != b:
                    continue
                k = nxt[j]
                sym[i], sym[j], nxt[i] = new, -1, k
                if k >= 0:
                    prv[k] = i
                    p = (new, sym[k])
                    if p in index:
                        index[p].append(i)
                    elif p in rank:
                        index[p] = [i]
                        heapq.heappush(heap, (rank[p][0], p))
                h = prv[i]
                if h >= 0:
                    p = (sym[h], new)
                    if p in index:
                        index[p].append(h)
                    elif p in rank:
                        index[p] = [h]
                        heapq.heappush(heap, (rank[p][0], p))
        return [[s for s in sym[x:y] if s >= 0] for x, y in zip(bounds, bounds[1:], strict=False)]

    def _index(self, sym: np.ndarray, more: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """The positions of each pair that has a rank, where ``more`` says that a symbol has a neighbour."""
        place = np.flatnonzero(more)
        if not len(place) or not len(self.pair_numbers):
            return {}
        number = sym[place] << 32 | sym[place + 1]
        at = np.minimum(np.searchsorted(self.pair_numbers, number), len(self.pair_numbers) - 1)
        known = self.pair_numbers[at] == number
        place, ranks = place[known], self.pair_ranks[at[known]]
        order = np.argsort(ranks, kind="stable")
        place, ranks = place[order].tolist(), ranks[order]
        edge = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
        return {self.pairs[int(ranks[x])]: place[x:y] for x, y in zip(edge, edge[1:], strict=False)}

    def learn(self, words: Sequence[str]) -> None:
        """Encodes words not yet known."""
        for w, ids in zip(words, self.merge_all(words), strict=True):
            self.known[w] = len(self.starts) - 1
            self.ids.extend(ids)
            self.starts.append(len(self.ids))
            self.size += len(w)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and where each text's begin."""
        split = [self.words(t) for t in texts]
        if len(self.known) > WORDS_KEPT or self.size > BYTES_KEPT:
            self.forget()
        new = {w for ws in split for w in ws if w not in self.known}
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        word = np.fromiter((k for ws in split for k in map(get, ws)), np.int64, sum(map(len, split)))
        count = np.cumsum([0, *map(len, split)])
        del split
        starts, ids = np.array(self.starts), np.array(self.ids, np.int32)
        n = starts[word + 1] - starts[word]
        end = np.concatenate([[0], np.cumsum(n)])
        flat = np.repeat(starts[word] - end[:-1], n) + np.arange(end[-1])
        return ids[flat], end[count]

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The text of ids. The file names no decoder, so that tokens are joined by blanks; unknown ids have none."""
        if self.whole and isinstance(ids, np.ndarray) and len(ids) and ids.min() >= 0 and ids.max() < len(self.table):
            return " ".join(self.table[ids].tolist())
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` with ``ids`` (token ids of the whole text) and ``decoded`` (the text that these ids decode to).

    ``tokenizer`` is the path of a tokenizer file on every machine. Null texts are empty: no ids, an empty decoded text. No special
    tokens are added; their strings in a text are those tokens. A very long text is encoded by itself. Rows are handled one by one, so
    repeats and an empty table need no rule; column names cannot clash, as only those named are read.
    """

    def form(bpe: WordBpe, ids: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        decoded = [bpe.decode(ids[a:z]) for a, z in zip(off, off[1:], strict=False)]
        return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]

    return _run(docs, tokenizer, keep, text_col, "ids array<int>, decoded string", form)


def encode_digest(docs: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """As :func:`encode_decode`, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead of the ids and the decoded text."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def form(bpe: WordBpe, ids: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        each = [ids[a:z] for a, z in zip(off, off[1:], strict=False)]
        return [pa.array(np.diff(off), pa.int64()), pa.array([sha(" ".join(map(str, x.tolist()))) for x in each], pa.string()), pa.array([sha(bpe.decode(x)) for x in each], pa.string())]

    return _run(docs, tokenizer, keep, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", form)


def _run(docs: DataFrame, tokenizer: str, keep: Sequence[str], text_col: str, fields: str, form: Callable[[WordBpe, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    mine = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    src = docs.select(*mine, F.col(text_col).cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    added = [f.split(" ")[0] for f in fields.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        try:
            for b in it:
                _, off = X.column(b, "text")
                for i, j in X.chunks(off, GROUP):
                    part = b.slice(i, j - i)
                    made = form(bpe, *bpe.encode([t or "" for t in P.raws(part, "text")]))
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), *made], names=[*names, *added])
        finally:  # a worker lives on after its task, and other operators need its memory
            load.cache_clear()

    ddl = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in names), fields])
    out = P.arrow(src, run, ddl)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *added)
