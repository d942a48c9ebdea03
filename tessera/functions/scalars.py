"""Scalar functions as columns: keys, hosts, tokens, intents, features. Columns stay in the JVM."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"
#: Second-level labels before which a registered domain takes three labels.
SECOND_LEVEL = ("co", "com", "net", "org", "ac", "gov", "edu")
#: Words and hints of the query classifier.
QUESTION_WORDS = ("how", "what", "why", "when", "where", "who", "which", "is", "are", "can", "does")
GEO_WORDS = ("near", "nearby", "in", "around", "city", "town", "country", "map", "directions", "weather", "restaurant", "hotel", "airport")
NAV_HINTS = ("login", "sign in", "homepage", "website", "www.", ".com", ".org")
INTENTS = ("question", "geo", "navigational", "keyword")


def key60(c: Column) -> Column:
    """A non-negative 60-bit key of a string, the same in any SQL engine with md5; null for null."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def host(url: Column) -> Column:
    """Host in lower case; the empty string where there is none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def registered_domain(h: Column) -> Column:
    """Last two labels, or three after a second-level label; an address gives null, a single label itself."""
    labels = F.split(F.lower(h), r"\.")
    n = F.size(labels)
    three = (n >= 3) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    take = F.when(three, 3).otherwise(2)
    return F.when(F.lower(h).rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"), None).when(n <= 2, F.lower(h)).otherwise(F.array_join(F.slice(labels, n - take + 1, take), "."))


def tokens(text: Column) -> Column:
    """Runs of letters and figures in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def title_of(text: Column, size: int = 80) -> Column:
    return F.substring(text, 1, size)


def snippet_of(text: Column, size: int = 240) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def title_match_ratio(q: Column, title: Column) -> Column:
    """Share of the distinct query terms of two bytes or more that occur anywhere in the title; 0 without terms."""
    terms = F.array_distinct(F.filter(F.split(F.trim(q), r"\s+"), lambda t: F.octet_length(t) >= 2))
    hit = F.filter(terms, lambda t: F.contains(F.lower(title), F.lower(t)))
    return F.when(F.size(terms) > 0, F.size(hit) / F.size(terms)).otherwise(F.lit(0.0))


def intent(q: Column) -> Column:
    """Navigational hints come before question words and marks, those before words of place; else keyword."""
    low = F.lower(q)
    words = F.filter(F.split(F.trim(low), r"\s+"), lambda w: w != "")
    hint = F.lit(False)
    for h in NAV_HINTS:
        hint = hint | F.contains(low, F.lit(h))
    question = low.endswith("?") | F.get(words, F.lit(0)).isin(*QUESTION_WORDS)
    return F.when(F.size(words) == 0, "keyword").when(hint, "navigational").when(question, "question").when(F.exists(words, lambda w: w.isin(*GEO_WORDS)), "geo").otherwise("keyword")


def intent_index(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, INTENTS)), name).cast("int") - 1


def freshness(ts: Column, now: Column) -> Column:
    """exp(-age in days / 43) between 0 and 1; 0.5 for an unknown time."""
    age = F.greatest(now - ts, F.lit(0)) / 86400.0
    return F.when(ts.isNull() | (ts <= 0), 0.5).otherwise(F.exp(-age / 43.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def geo_closeness(km: Column) -> Column:
    return F.when(km.isNull(), 0.0).otherwise(1 / (1 + km))


def source_count(*present: Column) -> Column:
    out = F.lit(0)
    for p in present:
        out = out + p.isNotNull().cast("int")
    return out


def snippet_norm(snippet: Column) -> Column:
    return F.least(F.octet_length(snippet) / 240.0, F.lit(1.0))


def civil_day(text: Column) -> Column:
    """Days since 1970 of YYYYMMDD; years 1970 to 2200, months 1 to 12, days 1 to 31 unchecked by month; else null."""
    ok = text.rlike(r"^\d{8}$")
    y, m, d = (F.when(ok, F.substring(text, a, n).cast("int")) for a, n in ((1, 4), (5, 2), (7, 2)))
    good = (y >= 1970) & (y <= 2200) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)
    return F.when(good, F.unix_date(F.make_date(y, m, F.lit(1))) + d - 1)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 1e-9, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def length_bucket(q: Column) -> Column:
    n = F.length(q)
    return F.when(n <= 20, 0).when(n <= 40, 1).when(n <= 80, 2).otherwise(3)


def time_bucket(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86400)) / 10800).cast("int")


def bucket_id(i: Column, length: Column, lang: Column, tod: Column, geo: Column) -> Column:
    """A decision context as one number: 2, 2, 4, 3 and 1 bits."""
    part = lambda c, mask, at: F.shiftleft(c.cast("int").bitwiseAND(mask), at)
    return part(i, 3, 0).bitwiseOR(part(length, 3, 2)).bitwiseOR(part(lang, 15, 4)).bitwiseOR(part(tod, 7, 8)).bitwiseOR(part(geo, 1, 11))


def from_bucket_id(b: Column) -> dict[str, Column]:
    part = lambda at, mask: F.shiftright(b, at).bitwiseAND(mask)
    return {"intent": part(0, 3), "len_bucket": part(2, 3), "lang": part(4, 15), "tod_bucket": part(8, 7), "geo": part(11, 1)}


def context_features(i: Column, length: Column, lang: Column, tod: Column, geo: Column) -> Column:
    """One-hot design of 26 numbers: bias, intent, length, language modulo 8, time of day, place."""
    one = lambda c, n: [F.when(c == k, 1.0).otherwise(0.0) for k in range(n)]
    return F.array(F.lit(1.0), *one(F.least(i, F.lit(3)), 4), *one(F.least(length, F.lit(3)), 4), *one(F.pmod(lang, F.lit(8)), 8), *one(F.least(tod, F.lit(7)), 8), geo.cast("int").cast("double"))


def sentences(text: Column) -> Column:
    """Sentences with their end marks: up to and including ``. ! ?`` or a line end."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"([^.!?\n]*[.!?\n]|[^.!?\n]+$)"), F.lit(1)), lambda s: F.trim(s) != "")


def content_hash(text: Column) -> Column:
    """Identity of a text without white space at its ends, as 32 hexadecimal figures."""
    return F.md5(F.regexp_replace(text, r"^\s+|\s+$", "").cast("binary"))


def parse_hash(text: Column) -> Column:
    """Sixteen bytes of 32 hexadecimal figures; else null."""
    return F.when(text.rlike(r"^[0-9a-fA-F]{32}$"), F.unhex(text))


# Lanczos approximation of the gamma function, g = 7, nine terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers, a whole array at once; below one half by reflection."""
    x = np.asarray(x, float)
    small = x < 0.5
    y = np.where(small, 1 - x, x) - 1
    total = LANCZOS[0] + sum(c / (y + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = y + 7.5
    out = 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(total)
    return np.where(small, np.log(np.pi / np.abs(np.sin(np.pi * np.where(small, x, 0.25)))) - out, out)


# The five factors and 0.3275911 are fixed values.
def normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution by a rational approximation (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 - F.when(z < 0, -1.0).otherwise(1.0) * erf)


#: The same in SQL, for oracles; ``z`` stands for the argument.
NORMAL_SF_SQL = "0.5 * (1 - (CASE WHEN {z} < 0 THEN -1.0 ELSE 1.0 END) * (1 - (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (0.254829592 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (1.421413741 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * 1.061405429)))) * exp(-({z} * {z} / 2))))"
