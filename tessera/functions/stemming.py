"""English stems by the published Porter2 rules, as SQL expressions over a table of terms.

Each step is one projection: a CASE over endings, the longest first. The expressions use only what common SQL engines share (the test of
a pattern is named differently), so that one text serves Spark and a check in another engine. Terms are lower-case letters and
figures, so that the rules on apostrophes never apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tables of the published rules.
#: Words with stems of their own.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay as they are after the first step.
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which the first region starts.
BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: Letters before which the ending "li" goes.
BEFORE_LI = "[cdeghkmnrt]"
# End of fixed values.

_REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _cut(n: int, put: str = "") -> str:
    kept = f"left(w, length(w) - {n})"
    return f"concat({kept}, '{put}')" if put else kept


def _ends(s: str) -> str:
    return f"right(w, {len(s)}) = '{s}'"


def _in(region: str, n: int) -> str:
    return f"length(w) - {n} >= {region}"


def _replace(region: str, table: dict[str, str], extra: dict[str, str]) -> str:
    """The longest ending of a table goes or is replaced if it stands in a region; ``extra`` names further conditions."""
    out = []
    for end in sorted(table, key=lambda e: (-len(e), e)):
        cond = _in(region, len(end)) + (f" AND {extra[end]}" if end in extra else "")
        out.append(f"WHEN {_ends(end)} THEN CASE WHEN {cond} THEN {_cut(len(end), table[end])} ELSE w END")
    return "CASE " + " ".join(out) + " ELSE w END"


def steps(matches: str) -> list[tuple[str, dict[str, str]]]:
    """``(name, {column: expression})`` of the projections, one after another, from ``term`` to ``w``; ``matches`` is the engine's pattern test."""
    has = lambda x, pat: f"{matches}({x}, '{pat}')"
    own = " ".join(f"WHEN term = '{a}' THEN '{b}'" for a, b in OWN.items())
    first_y = "CASE WHEN left(term, 1) = 'y' THEN concat('Y', substr(term, 2)) ELSE term END"
    marked = first_y
    for v in "aeiouy":  # a y after a vowel counts as a consonant
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    before = "left(w, length(w) - 1)"
    part = " ".join(f"WHEN right(w, {n}) = '{e}' THEN CASE WHEN {has(f'left(w, length(w) - {n})', '[aeiouy]')} THEN {_cut(n)} END" for e, n in (("ingly", 5), ("edly", 4), ("ing", 3), ("ed", 2)))
    doubled = " ".join(f"WHEN right(part, 2) = '{d}' THEN left(part, length(part) - 1)" for d in DOUBLES)
    done = "stop"
    keep = lambda e: f"CASE WHEN {done} THEN w ELSE {e} END"
    return [
        ("marked", {"own": f"CASE {own} WHEN length(term) <= 2 THEN term END", "w": marked}),
        ("first", {"own": "own", "w": "w", "x1": f"regexp_extract(w, '^({'|'.join(BEGINNINGS)}|{_REGION})', 1)"}),
        ("regions", {"own": "own", "w": "w", "r1": "CASE WHEN x1 = '' THEN length(w) ELSE length(x1) END"}),
        ("second", {"own": "own", "w": "w", "r1": "r1", "x2": f"regexp_extract(substr(w, r1 + 1), '^({_REGION})', 1)"}),
        ("plural", {"own": "own", "r1": "r1", "r2": "CASE WHEN x2 = '' THEN length(w) ELSE r1 + length(x2) END", "w":
            f"CASE WHEN {_ends('sses')} THEN {_cut(2)} WHEN right(w, 3) IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END "
            f"WHEN right(w, 2) IN ('us', 'ss') THEN w WHEN {_ends('s')} AND {has('w', '[aeiouy].+s$')} THEN {_cut(1)} ELSE w END"}),
        ("past", {"own": "own", "r1": "r1", "r2": "r2", "w": "w", "stop": f"own IS NOT NULL OR w IN ({', '.join(repr(k) for k in KEPT)})", "part":
            f"CASE WHEN {_ends('eedly')} OR {_ends('eed')} THEN NULL {part} END"}),
        ("mended", {"own": "own", "r1": "r1", "r2": "r2", "stop": "stop", "w": keep(
            f"CASE WHEN {_ends('eedly')} THEN CASE WHEN {_in('r1', 5)} THEN {_cut(3)} ELSE w END WHEN {_ends('eed')} THEN CASE WHEN {_in('r1', 3)} THEN {_cut(1)} ELSE w END WHEN part IS NULL THEN w "
            f"WHEN right(part, 2) IN ('at', 'bl', 'iz') THEN concat(part, 'e') {doubled} WHEN r1 >= length(part) AND {has('part', _SHORT)} THEN concat(part, 'e') ELSE part END")}),
        ("final_y", {"own": "own", "r1": "r1", "r2": "r2", "stop": "stop", "w": keep(f"CASE WHEN {has('w', '^.+[^aeiouy][yY]$')} THEN {_cut(1, 'i')} ELSE w END")}),
        ("endings_2", {"own": "own", "r1": "r1", "r2": "r2", "stop": "stop", "w": keep(_replace("r1", SECOND, {"ogi": _ends("logi"), "li": has("w", BEFORE_LI + "li$")}))}),
        ("endings_3", {"own": "own", "r1": "r1", "r2": "r2", "stop": "stop", "w": keep(_replace("r1", THIRD, {"ative": _in("r2", 5)}))}),
        ("endings_4", {"own": "own", "r1": "r1", "r2": "r2", "stop": "stop", "w": keep(_replace("r2", dict.fromkeys(FOURTH, ""), {"ion": has("w", "[st]ion$")}))}),
        ("endings_5", {"own": "own", "w": keep(
            f"CASE WHEN {_ends('e')} AND ({_in('r2', 1)} OR ({_in('r1', 1)} AND NOT {has(before, _SHORT)})) THEN {_cut(1)} WHEN {_ends('ll')} AND {_in('r2', 1)} THEN {_cut(1)} ELSE w END")}),
        ("stems", {"stem": "coalesce(own, replace(w, 'Y', 'y'))"}),
    ]


def stems(terms: DataFrame, col: str = "term") -> DataFrame:
    """``(term, stem)`` of each distinct term of a table; null terms are left out."""
    out = terms.select(F.col(col).alias("term")).where("term is not null").distinct()
    for _, cols in steps("rlike"):
        out = out.select("term", *(F.expr(e).alias(c) for c, e in cols.items()))
    # keeps filters on the stem above the cascade, in which they would be written out step by step; needs no further shuffle
    return out.groupBy("term").agg(F.first("stem").alias("stem"))


def stems_sql(terms: str, name: str = "stems") -> str:
    """The same as common table expressions for an engine with ``regexp_matches``: ``name`` has (term, stem) of the relation ``terms``."""
    out, last = [], terms
    for k, (_, cols) in enumerate(steps("regexp_matches")):
        here = f"{name}_{k}"
        out.append(f"{here} AS (SELECT term, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {last})")
        last = here
    return ",\n    ".join([*out, f"{name} AS (SELECT term, stem FROM {last})"])


def stem_tokens(rows: DataFrame, key: str, term: str = "term") -> DataFrame:
    """Rows with one term each, the term replaced by its stem; the stems of distinct terms are joined back."""
    return rows.join(stems(rows, term).withColumnRenamed("term", term), term).withColumn(term, F.col("stem")).drop("stem")
