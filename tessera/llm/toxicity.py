"""Toxicity scores from boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X
from tessera.plans.lineage import cut_at, delete

U = X.U
#: Labelled rows of each class that a model is fitted on at most, in order of a hash of their ids.
MOST_TOXIC, MOST_CLEAN = 3_000, 5_000
#: Terms in the learned lexicon at most, the least log-odds and the least share and number of toxic rows that have a term.
LEXICON_MOST, LEXICON_ODDS, LEXICON_SHARE, LEXICON_ROWS = 4_000, 2.0, 0.01, 3
#: Leading bytes of a word that are terms, beside the whole word.
STEMS = (4, 5, 6, 7, 8)
NEAR = 6
#: Fixed words: insults, and forms of address in the second person.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb jerk fool garbage hate ugly filthy vermin abruti connard imbécile crétin ordure dégoûtant idiota imbécil estúpido basura asqueroso dummkopf trottel abschaum widerlich ekelhaft".split()
ADDRESS = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer usted ustedes vosotros tú ti".split()
FEATURES = ("best_odds", "sum_odds", "hits", "hit_density", "insults", "insult_density", "near_you", "capitals", "exclaims", "punctuation", "obfuscation", "log_words", "densest")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_HIDE = np.zeros(256, bool)
_HIDE[[ord(c) for c in "*$@0134578!"]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the accented letters of western European languages, byte by byte."""
    low = X.LOWER[data]
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    accent = accent[(data[accent] <= 0x9E) & (data[accent] != 0x97)]
    low[accent] = data[accent] | 0x20
    return low


def letter_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters, where bytes beyond ASCII count as letters."""
    return X.word_spans(np.where(_LETTER[data], data, 32).astype(np.uint8), off)


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words, and ``(word, hash)`` of all terms: whole words and their first few bytes."""
    low = lower(data)
    s, e, row = letter_words(data, off)
    c = X.prefix_hash(low)
    at, h = [np.arange(len(s))], [X.stretch(c, s, e)]
    for n in STEMS:
        i = np.flatnonzero(e - s > n)
        at.append(i)
        h.append(X.stretch(c, s[i], s[i] + n) ^ U(0x5851F42D4C957F2D))
    return s, e, row, np.concatenate(at), np.concatenate(h)


def word_hashes(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.r_[0, np.cumsum([len(w) for w in raw])]
    return np.sort(X.stretch(X.prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), off[:-1], off[1:]))


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[i] == h, i


@dataclass
class Lexicon:
    hashes: np.ndarray
    odds: np.ndarray


def learn_lexicon(sets: Sequence[np.ndarray], toxic: np.ndarray) -> Lexicon:
    """Terms that toxic rows have far more often; ``sets`` has the distinct terms of each row."""
    pos = int(toxic.sum())
    neg = len(toxic) - pos
    least = max(LEXICON_ROWS, LEXICON_SHARE * pos)
    bad = [s for s, t in zip(sets, toxic, strict=True) if t]
    if not bad:
        return Lexicon(np.zeros(0, U), np.zeros(0))
    h, n = np.unique(np.concatenate(bad), return_counts=True)
    h, n = h[n >= least], n[n >= least]
    against = np.zeros(len(h), np.int64)
    for s, t in zip(sets, toxic, strict=True):
        if not t:
            ok, i = _find(h, s)
            against[i[ok]] += 1
    odds = np.log((n + 0.5) / (pos + 1)) - np.log((against + 0.5) / (neg + 1))
    top = np.argsort(-odds * np.sqrt(n), kind="stable")
    top = np.sort(top[odds[top] >= LEXICON_ODDS][:LEXICON_MOST])
    return Lexicon(h[top], odds[top])


_INSULTS, _ADDRESS = word_hashes(INSULTS), word_hashes(ADDRESS)


def features(data: np.ndarray, off: np.ndarray, lex: Lexicon) -> np.ndarray:
    """The figures named in FEATURES for each row."""
    rows = len(off) - 1
    s, e, row, at, h = terms(data, off)
    words = len(s)
    n = np.bincount(row, minlength=rows)
    odds = np.zeros(words)
    ok, i = _find(lex.hashes, h)
    np.maximum.at(odds, at[ok], lex.odds[i[ok]])
    insult = _find(_INSULTS, h[:words])[0]
    you = _find(_ADDRESS, h[:words])[0]
    hit = odds > 0
    best, total = np.zeros(rows), np.bincount(row, odds, rows)
    np.maximum.at(best, row, odds)
    hits, ins = np.bincount(row, hit, rows), np.bincount(row, insult, rows)
    # hits with an address within a few words, in the same row
    near = np.zeros(words, bool)
    spot = np.flatnonzero(you)
    for d in range(-NEAR, NEAR + 1):
        j = spot + d
        good = (j >= 0) & (j < words)
        j, o = j[good], spot[good]
        near[j[row[j] == row[o]]] = True
    near &= hit | insult
    # the most hits in any fifty words
    run = np.concatenate([[0], np.cumsum(hit | insult)])
    first = np.cumsum(n) - n
    back = np.maximum(np.arange(words) - 49, first[row])
    densest = np.zeros(rows)
    np.maximum.at(densest, row, (run[1:] - run[back]).astype(float))

    def per_row(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off[1:]] - c[off[:-1]]).astype(float)

    upper = (data >= 65) & (data <= 90)
    letters = per_row(_LETTER[data])
    size = np.maximum(np.diff(off), 1)
    hidden = np.zeros(len(data), bool)
    if len(data) > 2:  # signs and figures between two letters
        hidden[1:-1] = _HIDE[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
    some = np.maximum(n, 1)
    return np.stack([best, total, hits, 100 * hits / some, ins, 100 * ins / some, np.bincount(row, near, rows), per_row(upper) / np.maximum(letters, 1), 100 * per_row(data == 33) / size, per_row(_MARK[data]) / size, 100 * per_row(hidden) / some, np.log1p(n), densest], axis=1)


class Trees:
    """Gradient-boosted trees for log-odds, on features cut into bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, leaf: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf = rounds, depth, rate, bins, leaf
        self.trees: list[list[tuple[int, float, float]]] = []  # heap of (feature, threshold, value)
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        p = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-9)
            node = np.ones(len(y), np.int64)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 << self.depth)
            for k in range(1, 2 << self.depth):
                at = np.flatnonzero(node == k)
                if not len(at):
                    continue
                gs, hs = g[at].sum(), h[at].sum()
                best, which, where = 1e-6, -1, 0
                if k < 1 << self.depth and len(at) >= 2 * self.leaf:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(b[at, f], g[at], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b[at, f], h[at], len(c) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b[at, f], minlength=len(c) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < self.leaf) | (len(at) - nl < self.leaf)] = -1
                        i = int(np.argmax(gain))
                        if gain[i] > best:
                            best, which, where = float(gain[i]), f, i
                if which < 0:
                    tree[k] = (-1, 0.0, self.rate * gs / (hs + 1))
                    score[at] += tree[k][2]
                else:
                    tree[k] = (which, float(cuts[which][where]), 0.0)
                    node[at] = 2 * k + (b[at, which] > where)
            self.trees.append(tree)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            f = np.array([t[0] for t in tree])
            c, v = np.array([t[1] for t in tree]), np.array([t[2] for t in tree])
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[node] >= 0
                node = np.where(inner, 2 * node + (x[np.arange(len(x)), np.maximum(f[node], 0)] > c[node]), node)
            out += v[node]
        return out


def isotonic(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to y over s, as the middle and the level of each step."""
    at = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of s
    for a, b, c in zip(s[at], y[at], w[at], strict=True):
        blocks.append([c, b * c, a * c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    mid: np.ndarray
    level: np.ndarray

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw = self.trees.predict(features(data, off, self.lexicon))
        # between steps along a line, with a small part of the raw score so that order within a step is kept
        return np.clip(0.98 * np.interp(raw, self.mid, self.level) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def fit(texts: Sequence[bytes], toxic: np.ndarray, weight: np.ndarray, folds: int = 3) -> Model:
    """Each fold's features use a lexicon learned without it, so that trees and calibration see what they will meet in new texts."""
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sets: list[np.ndarray] = []
    for i, j in X.chunks(off):
        _, _, row, at, h = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
        order = np.argsort(row[at], kind="stable")
        edge = np.searchsorted(row[at][order], np.arange(j - i + 1))
        sets += [np.unique(h[order[a:b]]) for a, b in zip(edge, edge[1:], strict=False)]
    fold = np.zeros(len(texts), np.int64)
    for c in (0, 1):
        at = np.flatnonzero(toxic == c)
        fold[at] = np.arange(len(at)) % folds
    x = np.zeros((len(texts), len(FEATURES)))
    for k in range(folds):
        lex = learn_lexicon([s for s, f in zip(sets, fold, strict=True) if f != k], toxic[fold != k])
        at = np.flatnonzero(fold == k)
        part = [texts[i] for i in at]
        o = np.r_[0, np.cumsum([len(t) for t in part])].astype(np.int64)
        d = np.frombuffer(b"".join(part), np.uint8)
        x[at] = np.concatenate([features(d[o[i] : o[j]], o[i : j + 1] - o[i], lex) for i, j in X.chunks(o)]) if part else x[at]
    raw = np.zeros(len(texts))
    for k in range(folds):
        if (fold == k).any() and (fold != k).any():
            raw[fold == k] = Trees().fit(x[fold != k], toxic[fold != k], weight[fold != k]).predict(x[fold == k])
    mid, level = isotonic(raw, toxic.astype(float), weight)
    return Model(learn_lexicon(sets, toxic), Trees().fit(x, toxic, weight), mid, level)


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on).

    Labels are read from rows whose ``crc32(id as text) mod 3`` is not 1 only; those with remainder 1 are held out. The model is
    fitted on at most MOST_TOXIC toxic and MOST_CLEAN clean labelled rows, the first of each class in order of
    a hash of the id, weighted back to the classes' shares; everything else runs over all rows. Only the text is an input of the
    score. Rows with a null id are held out; labels with a null id or value, and those without a document, are not used; with
    no usable labels at all every score is 0. Null and empty texts are scored like any other. Repeated rows each get the same score; repeated labels count
    once, as toxic if any is.
    """
    spark = docs.sparkSession
    remainder = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
    marked = labels.select(F.col(id_col).alias("lid"), F.col("toxic").cast("int").alias("toxic")).where("lid is not null and toxic is not null")
    marked = marked.where(F.pmod(F.crc32(F.col("lid").cast("string").cast("binary")), F.lit(3)) != 1).groupBy("lid").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked, mpath = cut_at(marked.join(docs.select(F.col(id_col).alias("lid")), "lid", "left_semi"), "labels")
    total = dict(marked.groupBy("toxic").count().collect())
    first = [F.xxhash64("lid"), F.col("lid")]
    # a sample of bounded size: it may go to every task
    sample = marked.where("toxic = 1").orderBy(*first).limit(MOST_TOXIC).union(marked.where("toxic = 0").orderBy(*first).limit(MOST_CLEAN))
    rows = docs.select(F.col(id_col).alias("lid"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "lid").groupBy("lid").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).orderBy(*first).collect()
    delete(spark, mpath)
    texts, toxic = [(r["text"] or "").encode() for r in rows], np.array([r["toxic"] for r in rows], np.int64)
    weight = np.ones(len(rows))
    del rows
    for c in (0, 1):
        if (toxic == c).any():
            weight[toxic == c] = total.get(c, 0) / (toxic == c).sum()
    model = spark.sparkContext.broadcast(fit(texts, toxic, weight / max(weight.mean(), 1e-9)) if len(texts) else None)

    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), F.coalesce(remainder == 1, F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in it:
            data, off = X.column(b, "text")
            score = np.concatenate([m.score(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in X.chunks(off)]) if m and len(off) > 1 else np.zeros(len(off) - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in [*names, "held_out"]), pa.array(score, pa.float64())], names=[*names, "held_out", "score"])

    ddl = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in names), "held_out boolean", "score double"])
    out = P.arrow(src, run, ddl)
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
