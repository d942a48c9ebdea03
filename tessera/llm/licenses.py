"""Licence texts and notices by sentence rules, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences (lower case, runs of other than letters and figures as one blank) and their identifiers.
SENTENCES = {
    "MIT-0": "released under the mit license",
    "MIT-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT-2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "AL2-0": "licensed under the apache license version 2 0",
    "AL2-0b": "licensed under the apache license version 2 0 the license",
    "AL2-1": "you may not use this file except in compliance with the license",
    "AL2-2": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "AL2-3": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "AL2-4": "see the license for the specific language governing permissions and limitations under the license",
    "GPL3-0": "this work is licensed under the gnu general public license version 3",
    "GPL2-0": "this work is licensed under the gnu general public license version 2",
    "GPL3-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL2-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GPL-2": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "BSD-1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD-3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD-4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "LGPL21-1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "LGPL3-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AGPL3-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "MPL2-1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "MPL2-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "MPL2-2b": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "ISC-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "UNL-1": "this is free and unencumbered software released into the public domain",
    "CC0-1": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "SPDX-MIT": "spdx license identifier mit",
    "SPDX-AL2": "spdx license identifier apache 2 0",
    "SPDX-BSD2": "spdx license identifier bsd 2 clause",
    "SPDX-BSD3": "spdx license identifier bsd 3 clause",
    "SPDX-GPL2": "spdx license identifier gpl 2 0 only",
    "SPDX-GPL2L": "spdx license identifier gpl 2 0 or later",
    "SPDX-GPL3": "spdx license identifier gpl 3 0 only",
    "SPDX-GPL3L": "spdx license identifier gpl 3 0 or later",
    "SPDX-MPL2": "spdx license identifier mpl 2 0",
    "SPDX-ISC": "spdx license identifier isc",
    "CC-BY-4": "licensed under cc by 4 0",
    "CC-BY-SA-4": "licensed under cc by sa 4 0",
    "CC-BY-NC-4": "licensed under cc by nc 4 0",
    "CC-BY-NC-ND-4": "licensed under cc by nc nd 4 0",
    "CC-BY-4b": "this work is licensed under a creative commons attribution 4 0 international license",
    "ARR-0": "all rights reserved",
}
#: Licences by the runs of identifiers that stand for them, the more telling first.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("apache-2.0-header", "Apache-2.0", ("AL2-0b", "AL2-1", "AL2-2", "AL2-3", "AL2-4")),
    ("apache-2.0-terms", "Apache-2.0", ("AL2-1", "AL2-2")),
    ("apache-2.0-notice", "Apache-2.0", ("AL2-0",)),
    ("apache-2.0-notice-long", "Apache-2.0", ("AL2-0b",)),
    ("mit-text", "MIT", ("MIT-1", "MIT-2")),
    ("mit-notice", "MIT", ("MIT-0",)),
    ("bsd-3-conditions", "BSD-3-Clause", ("BSD-1", "BSD-2", "BSD-3", "BSD-4")),
    ("bsd-conditions", "BSD", ("BSD-1", "BSD-2", "BSD-3")),
    ("gpl-3-text", "GPL-3.0", ("GPL3-1", "GPL-2")),
    ("gpl-3-grant", "GPL-3.0", ("GPL3-1",)),
    ("gpl-3-notice", "GPL-3.0", ("GPL3-0",)),
    ("gpl-2-text", "GPL-2.0", ("GPL2-1", "GPL-2")),
    ("gpl-2-grant", "GPL-2.0", ("GPL2-1",)),
    ("gpl-2-notice", "GPL-2.0", ("GPL2-0",)),
    ("lgpl-2.1-grant", "LGPL-2.1", ("LGPL21-1",)),
    ("lgpl-3-grant", "LGPL-3.0", ("LGPL3-1",)),
    ("agpl-3-grant", "AGPL-3.0", ("AGPL3-1",)),
    ("mpl-2-header", "MPL-2.0", ("MPL2-1", "MPL2-2")),
    ("mpl-2-header-http", "MPL-2.0", ("MPL2-1", "MPL2-2b")),
    ("mpl-2-terms", "MPL-2.0", ("MPL2-1",)),
    ("isc-text", "ISC", ("ISC-1",)),
    ("unlicense-text", "Unlicense", ("UNL-1",)),
    ("cc0-waiver", "CC0-1.0", ("CC0-1",)),
    ("mit-identifier", "MIT", ("SPDX-MIT",)),
    ("apache-2.0-identifier", "Apache-2.0", ("SPDX-AL2",)),
    ("bsd-2-identifier", "BSD-2-Clause", ("SPDX-BSD2",)),
    ("bsd-3-identifier", "BSD-3-Clause", ("SPDX-BSD3",)),
    ("gpl-2-identifier", "GPL-2.0", ("SPDX-GPL2",)),
    ("gpl-2-later-identifier", "GPL-2.0", ("SPDX-GPL2L",)),
    ("gpl-3-identifier", "GPL-3.0", ("SPDX-GPL3",)),
    ("gpl-3-later-identifier", "GPL-3.0", ("SPDX-GPL3L",)),
    ("mpl-2-identifier", "MPL-2.0", ("SPDX-MPL2",)),
    ("isc-identifier", "ISC", ("SPDX-ISC",)),
    ("cc-by-nc-nd-4.0-notice", "CC-BY-NC-ND-4.0", ("CC-BY-NC-ND-4",)),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", ("CC-BY-NC-4",)),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", ("CC-BY-SA-4",)),
    ("cc-by-4.0-notice", "CC-BY-4.0", ("CC-BY-4",)),
    ("cc-by-4.0-work", "CC-BY-4.0", ("CC-BY-4b",)),
    ("all-rights-reserved", "Proprietary", ("ARR-0",)),
)
#: Each known sentence holds one of these, so that texts without any need no splitting.
HINTS = ("licen", "permi", "copyright", "redistribut", "warrant", "rights", "public domain", "mpl", "contributors")
#: Where sentences end in the SQL, which knows those on one line only, and what normalising makes a blank of.
ENDS, OTHER = r"\n|[.?;]+[^\p{L}\p{N}]+|[.?;]+\z", r"[^\p{L}\p{N}]+"

#: Where a known sentence may begin or end; it may also run on over any of these, as texts are wrapped.
EDGES = r"(?:\n|[.?;:]+(?:[^\p{L}\p{N}]|\z))[^\p{L}\p{N}]*"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    low = F.lower(text)
    known = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    # words with a blank between, or a line end where there is an edge; the longer sentences are tried first
    flat = F.trim(F.regexp_replace(F.regexp_replace(low, EDGES, "\n"), r"[^\p{L}\p{N}\n]+", " "))
    flat = F.concat(F.lit("\n"), F.replace(flat, F.lit(" \n"), F.lit("\n")), F.lit("\n"))
    any_of = "|".join(s.replace(" ", r"[ \n]") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    ids = F.transform(F.regexp_extract_all(flat, F.lit(rf"(?<=\n)(?:{any_of})(?=\n)"), F.lit(0)), lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | F.contains(low, F.lit(h))
    return F.when(hint, ids).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` with ``sentence_ids``, ``rules`` and ``licenses`` (arrays of strings) of every row.

    Known sentences are looked for in the normalised text. They begin and end where a sentence, a clause or a line does, and may be
    wrapped over lines, with comment marks or blank lines between. The identifiers that are found, in order, are matched against the rules: a rule holds if its identifiers follow one another with
    no other known sentence between. ``rules`` and ``licenses`` are in the order of RULES, each licence once. Null and empty texts have none;
    rows are handled one by one, so that repeats, null ids and an empty table need no rule.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    ids = docs.select(*kept, sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("sentence_ids"))
    joined = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    holds = [(rule, lic, F.contains(joined, F.lit(" " + "  ".join(seq) + " "))) for rule, lic, seq in RULES]
    rules = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, _, c in holds)))
    licenses = F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(x)) for _, x, c in holds))))
    none = F.array().cast("array<string>")
    some = F.size("sentence_ids") > 0
    return ids.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "sentence_ids", F.when(some, rules).otherwise(none).alias("rules"), F.when(some, licenses).otherwise(none).alias("licenses"))


def oracle_sql() -> str:
    """The same over ``documents`` in SQL, with arrays joined by commas."""
    known = " UNION ALL ".join(f"SELECT '{s}' AS s, '{i}' AS i" for i, s in SENTENCES.items())
    holds = [(r, x, f"contains(j, ' {'  '.join(seq)} ')") for r, x, seq in RULES]
    rules = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, _, c in holds)
    best: dict[str, list[str]] = {}
    for _, x, c in holds:
        best.setdefault(x, []).append(c)
    lics = ", ".join(f"CASE WHEN {' OR '.join(c)} THEN '{x}' END" for x, c in best.items())
    return rf"""
        WITH k AS ({known}),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        p AS (SELECT r, regexp_split_to_array(lower(text), '{ENDS}') AS parts FROM d),
        s AS (SELECT r, unnest(range(1, len(parts) + 1)) AS n, unnest(parts) AS part FROM p),
        f AS (SELECT r, n, k.i FROM s JOIN k ON k.s = trim(regexp_replace(part, '{OTHER}', ' ', 'g'))),
        g AS (SELECT r, string_agg(i, ',' ORDER BY n) AS ids, ' ' || string_agg(i, '  ' ORDER BY n) || ' ' AS j FROM f GROUP BY r)
        SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(concat_ws(',', {rules}), '') AS rules, coalesce(concat_ws(',', {lics}), '') AS licenses
        FROM d LEFT JOIN g USING (r)"""
