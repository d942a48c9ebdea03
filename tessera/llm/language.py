"""Language of pages and documents from several kinds of evidence, fused by Bayes' rule."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import packed as P
from tessera.llm import text as X
from tessera.plans.lineage import cut_at, delete

U = X.U
#: Labelled texts of each language that the likelihoods are learned from at most, in order of a hash of their ids.
TEXTS_EACH = 400
GRAM_BITS = 14
#: Trigrams of a text depend on each other: they count as so many independent ones at most.
EFFECTIVE = 30.0
#: Weight of the layer above in a prior: registered domain over all, host over registered domain.
KAPPA = 5.0
#: Languages that a country's address suffix suggests.
SUFFIX = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nl": "nl", "it": "it", "pt": "pt", "br": "pt"}
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def visible(page: str | None) -> str:
    """Text of a page without scripts, styles, comments and tags."""
    return html.unescape(_HIDDEN.sub(" ", page or ""))


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every trigram of letters and blanks; other signs count as blanks, runs of blanks as one."""
    low = X.LOWER[data]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    low = low[at].astype(np.uint32)
    row = np.searchsorted(off, at, "right") - 1
    if len(low) < 3:
        return row[:0], low[:0]
    h = (low[:-2] * np.uint32(65599 * 65599 % (1 << 32)) + low[1:-1] * np.uint32(65599) + low[2:]) * np.uint32(2654435761)
    ok = row[:-2] == row[2:]
    return row[:-2][ok], (h >> np.uint32(32 - GRAM_BITS))[ok]


@dataclass
class Likelihood:
    languages: list[str]
    table: np.ndarray  # log probabilities, language by slot

    def of(self, texts: Sequence[str]) -> np.ndarray:
        """Log likelihoods, text by language, relative to the best; all 0 for texts without trigrams."""
        out = np.zeros((len(texts), len(self.languages)))
        raw = [t.encode() for t in texts]
        off = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        for i, j in X.chunks(off):
            row, slot = grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.bincount(row, minlength=j - i)
            for k in range(len(self.languages)):
                mean = np.bincount(row, self.table[k][slot], j - i) / np.maximum(n, 1)
                out[i:j, k] = mean * np.minimum(n, EFFECTIVE)
        return out - out.max(axis=1, keepdims=True) if len(self.languages) else out


def learn(texts: Sequence[str], languages: Sequence[str]) -> Likelihood:
    names = sorted(set(languages))
    table = np.full((len(names), 1 << GRAM_BITS), 0.2)
    for k, name in enumerate(names):
        raw = [t.encode() for t, x in zip(texts, languages, strict=True) if x == name]
        off = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
        _, slot = grams(np.frombuffer(b"".join(raw), np.uint8), off)
        table[k] += np.bincount(slot, minlength=1 << GRAM_BITS)
    return Likelihood(names, np.log(table / table.sum(axis=1, keepdims=True)))


def learn_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Likelihood:
    """Trigram likelihoods of every language that labels a text, each from a bounded sample of its texts; the driver holds one language's texts at a time beside the table."""
    ids = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l")).where("i is not null and l is not null")
    first = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    some = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= TEXTS_EACH)
    got = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).join(F.broadcast(some.select("i").distinct()), "i").where("t is not null and l is not null").orderBy("l", "i", "t")
    parts = []
    for name, rows in groupby(got.toLocalIterator(), lambda r: r["l"]):
        texts = [r["t"] for r in rows]
        parts.append(learn(texts, [name] * len(texts)))
    return Likelihood([x for p in parts for x in p.languages], np.concatenate([np.zeros((0, 1 << GRAM_BITS)), *(p.table for p in parts)]))


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def _evidence(src: DataFrame, model, names: Sequence[str], pages: bool) -> DataFrame:
    """Log likelihood of each language by the text alone, as an array."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in it:
            texts = P.raws(b, "text")
            ll = m.of([visible(t) if pages else t or "" for t in texts])
            keep = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(ll.tolist(), pa.list_(pa.float64()))], names=[*names, "ll"])

    ddl = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in names), "ll array<double>"])
    return P.arrow(src, run, ddl)


def identify(pages: DataFrame | None, docs: DataFrame | None, model: Likelihood, page_cols: tuple[str, str, str] = ("page_id", "url", "html"), doc_cols: tuple[str, str, str] = ("doc_id", "source", "text")) -> DataFrame:
    """One row for each page and document: ``kind``, ``page_id`` or ``doc_id``, ``declared``, ``suffix``, ``host``, ``text_lang``, ``lang``, ``probability``.

    Evidence: the likelihood of the text under each language's trigrams; the language that the page's markup
    declares; that of the address, a path segment that is a language's code or else a country's suffix; and the host's prior. How far the declared
    and the address language can be trusted is their measured agreement with the text over all pages. A host's prior is the mean of
    what the other evidence says of all of its pages but this one, smoothed towards its registered domain, and that
    towards all hosts. Documents have their source for a host, and neither markup nor address.

    Missing evidence (null or empty text, no markup, unreadable address) is neutral. Null ids and repeated rows are carried
    through. A null host is one host, the empty one. Ties go to the language first in the alphabet. Without languages
    (no labelled text) ``lang`` is null.
    """
    spark = (pages if pages is not None else docs).sparkSession
    langs = model.languages
    cast = spark.sparkContext.broadcast(model)
    parts = []
    if pages is not None:
        pid, url, body = page_cols
        src = pages.select(F.col(pid).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(body).cast("string").alias("text"))
        declared = F.lower(F.regexp_extract(F.coalesce(F.col("text"), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
        path = F.regexp_extract(F.lower(F.coalesce(F.col("url"), F.lit(""))), r"^[a-z]+://[^/]*/([a-z]{2})(?:[-_][a-z]+)?(?:[/?#]|$)", 1)
        host = _host(F.col("url"))
        tld = F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIX.items() for x in kv)), F.regexp_extract(host, r"\.([a-z]+)$", 1))
        src = src.select("page_id", F.when(declared != "", declared).alias("declared"), F.when(path.isin(langs), path).otherwise(tld).alias("suffix"), host.alias("host"), "text")
        src = _evidence(src, cast, ["page_id", "declared", "suffix", "host"], True)
        parts.append(src.select(F.lit("page").alias("kind"), "page_id", F.lit(None).cast("long").alias("doc_id"), "declared", "suffix", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), "ll"))
    if docs is not None:
        did, source, body = doc_cols
        src = docs.select(F.col(did).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("host"), F.col(body).cast("string").alias("text"))
        src = _evidence(src, cast, ["doc_id", "host"], False)
        none = F.lit(None).cast("string")
        parts.append(src.select(F.lit("document").alias("kind"), F.lit(None).cast("long").alias("page_id"), "doc_id", none.alias("declared"), none.alias("suffix"), F.concat(F.lit("source:"), "host").alias("host"), F.lit("source:").alias("domain"), "ll"))
    rows, _ = cut_at(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), "evidence")
    ids = ["kind", "page_id", "doc_id", "declared", "suffix", "host"]
    if not langs:
        return rows.select(*ids, F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    codes = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(codes, F.array_position(c, F.array_max(c)).cast("int"))
    rows = rows.withColumn("text_lang", F.when(F.array_min("ll") < 0, best(F.col("ll"))))
    trust = rows.agg(*((F.expr(f"(count_if({c} = text_lang) + 8.0) / (count_if({c} in ({', '.join(repr(x) for x in langs)}) and text_lang is not null) + 10.0)")).alias(c) for c in ("declared", "suffix"))).first()

    def told(col: str) -> Column:
        t = min(max(float(trust[col]), 1.0 / len(langs)), 0.98)
        miss = np.log(max(1 - t, 1e-3) / max(len(langs) - 1, 1))
        return F.when(F.col(col).isin(langs), F.transform(codes, lambda x: F.when(x == F.col(col), F.lit(float(np.log(t)))).otherwise(F.lit(float(miss))))).otherwise(F.array(*[F.lit(0.0)] * len(langs)))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def softmax(c: Column) -> Column:
        e = F.transform(c, lambda x: F.exp(x - F.array_max(c)))
        return F.transform(e, lambda x: x / total(e))

    rows = rows.withColumn("own", add(add(F.col("ll"), told("declared")), told("suffix"))).withColumn("p", softmax(F.col("own")))
    each = range(len(langs))
    hosts, _ = cut_at(rows.groupBy("host", "domain").agg(F.array(*(F.sum(F.get("p", F.lit(i))) for i in each)).alias("ch")), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.get("ch", F.lit(i))) for i in each)).alias("cd"))
    every = hosts.agg(*(F.sum(F.get("ch", F.lit(i))).alias(f"x{i}") for i in each)).first()
    # one row a host with its domain's sums, written so that its size is known before the join: while it is small, the rows of a large host stay where they are read
    priors, _ = cut_at(hosts.join(domains, "domain").select("host", "ch", "cd"), "priors")
    n_all = sum(x or 0.0 for x in every)
    base = F.array(*(F.lit(float(((x or 0.0) + 1.0) / (n_all + len(langs)))) for x in every))
    less = lambda c: F.zip_with(c, F.col("p"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    layer = lambda c, above: F.zip_with(c, above, lambda x, y: (x + KAPPA * y) / (total(c) + KAPPA))
    out = rows.join(priors, "host")
    out = out.withColumn("pd", layer(less(F.col("cd")), base)).withColumn("ph", layer(less(F.col("ch")), F.col("pd")))
    out = out.withColumn("post", softmax(add(F.col("own"), F.transform("ph", lambda x: F.log(x)))))
    return out.select(*ids, "text_lang", best(F.col("post")).alias("lang"), F.array_max("post").alias("probability"))
