"""Readers: corpora as JSON lines, event slices, query and judgment files, place names."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalars as S

#: Columns of an event slice, and those that are read: day, topic, latitude, longitude, address.
SLICE_WIDTH, DAY, ROOT, LAT, LON, URL = 61, 1, 28, 56, 57, 60
ZIP_MOST, TEXT_MOST = 32 << 20, 128 << 20


def read_corpus(spark: SparkSession, path: str, least_bytes: int = 200, base: str = "https://corpus.example/wiki/") -> DataFrame:
    """``(title, body, url)`` of JSON lines; rows without a title or with a short body are left out, bad lines too."""
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])
    raw = spark.read.schema(schema).json(path, mode="PERMISSIVE")
    ok = raw.where("title is not null and title <> ''").where(F.octet_length("body") >= least_bytes)
    return ok.withColumn("url", F.concat(F.lit(base), F.regexp_replace("title", " ", "_")))


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """``(url, title, text, ts)`` of JSON lines; bad lines and rows without a text are skipped."""
    schema = "url string, title string, text string, ts long"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("text is not null and trim(text) <> ''")


def latest_slice(manifest: str) -> tuple[str, str] | None:
    """Digest and address of the first line of three fields that names an export; null without one."""
    for line in manifest.splitlines():
        part = line.split()
        if len(part) == 3 and part[2].endswith(".export.CSV.zip"):
            return part[1].lower(), part[2]
    return None


def read_slices(spark: SparkSession, path: str, digests: dict[str, str] | None = None) -> DataFrame:
    """``(slice, line)`` of zipped event slices; a file that is too large, is no archive or has another digest than stated gives nothing."""
    want = digests or {}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                if len(content) > ZIP_MOST or want.get(name, hashlib.md5(content).hexdigest()) != hashlib.md5(content).hexdigest():
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                        text = f.read(TEXT_MOST + 1)
                except (zipfile.BadZipFile, IndexError):
                    continue
                if len(text) <= TEXT_MOST:
                    lines = text.decode("utf-8", "replace").splitlines()
                    yield pd.DataFrame({"slice": name, "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "slice string, line string")


def parse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds day, root (0 if unreadable), lat, lon, url to lines of tab-separated events; short lines, bad days and lines without a place are left out."""
    f = F.split(line, "\t", -1)
    x = lines.where(F.size(f) >= SLICE_WIDTH).withColumns({"day": S.civil_day(F.get(f, F.lit(DAY))), "root": F.coalesce(F.get(f, F.lit(ROOT)).try_cast("int"), F.lit(0)), "lat": F.get(f, F.lit(LAT)).try_cast("double"), "lon": F.get(f, F.lit(LON)).try_cast("double"), "url": F.get(f, F.lit(URL))})
    return x.where("day is not null and lat between -90 and 90 and lon between -180 and 180")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, query)`` of lines with a tab."""
    p = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(p) == 2).select(F.get(p, F.lit(0)).alias("qid"), F.get(p, F.lit(1)).alias("query"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, doc, grade)`` of lines with exactly four fields and a whole number last."""
    p = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).where(F.size(p) == 4).select(F.get(p, F.lit(0)).alias("qid"), F.get(p, F.lit(2)).alias("doc"), F.get(p, F.lit(3)).try_cast("int").alias("grade"))
    return x.where("grade is not null")


def gazetteer(rows: DataFrame, name: str = "name", ascii_name: str = "asciiname", population: str = "population", order: str = "line") -> DataFrame:
    """``(phrase, lat, lon)``: for each name in lower case the most populous place, of equals the later line."""
    x = rows.select(F.explode(F.array_distinct(F.array(F.lower(name), F.lower(ascii_name)))).alias("phrase"), "lat", "lon", F.col(population).alias("_p"), F.col(order).alias("_o"))
    w = Window.partitionBy("phrase").orderBy(F.desc("_p"), F.desc("_o"))
    return x.where("phrase <> ''").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("phrase", "lat", "lon")


def geo_tag(docs: DataFrame, names: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """``(key, phrase, lat, lon)`` of the first known place: title before the first 500 characters of the text, longer phrases before shorter, then by position.

    Phrases have one to three tokens and begin with a capital.
    """
    tok = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}'-]+"), lambda t: t != "")
    n = lambda k, src: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("_t") - k, F.lit(0))), lambda i: (i + k <= F.size("_t")) & F.get("_t", i).rlike(r"^\p{Lu}")), lambda i: F.struct(F.lit(src).alias("src"), F.lit(3 - k).alias("len"), i.alias("at"), F.lower(F.array_join(F.slice(F.col("_t"), i + 1, k), " ")).alias("phrase")))
    parts = [docs.select(key, tok(c).alias("_t")).select(key, F.explode(F.concat(*(n(k, s) for k in (3, 2, 1)))).alias("g")).select(key, "g.*") for s, c in ((0, F.col(title)), (1, F.substring(F.col(text), 1, 500)))]
    hit = parts[0].union(parts[1]).join(names, "phrase")
    return hit.groupBy(key).agg(F.min_by(F.struct("phrase", "lat", "lon"), F.struct("src", "len", "at")).alias("b")).select(key, "b.*")
