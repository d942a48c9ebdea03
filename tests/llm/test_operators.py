"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import gzip
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, language, licenses, order, packed, quality, storage, toxicity, warc
from tessera.llm import text as X
from tessera.llm.jaccard_join import jaccard_groups, parts_of
from tessera.llm.suffix_dedup import remove_repeats, remove_repeats_plainly
from tests.compare import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kind string, bucket string, rk string, setid string, host string, block string"
vocabulary = [a + b for a in ("ka", "lo", "mi", "ter", "un") for b in ("ra", "so", "ne", "ti", "ou", "ble", "ng")]


def words(rnd, n):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "s", None, "k", "b", "r", "i", "h", "x") for r in rows], EXTRA)


def key(v):
    return tuple((x is None, x if x is not None else 0) for x in v)


def shingle_set(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def components(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if d is not None or least.get(r) is not None else None
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append(" ".join(w))
    return out


def test_jaccard_groups(spark):
    rnd = random.Random(7)
    texts = [None, "", " \n\t ", "one", "ONE", "one two three four", "one two three four five", "A b C d E f"]
    passage = words(rnd, 25)
    texts += [words(rnd, 30) + " " + passage + " " + words(rnd, 40) for _ in range(25)]
    base = words(rnd, 120)
    texts += near_copies(rnd, base, 40, 8) + [base, base]
    for n in (6, 9, 14, 33, 60, 300, 2500):
        t = words(rnd, n)
        texts += [t, t.upper(), *near_copies(rnd, t, 4, max(1, n // 50))]
    rows = list(enumerate(texts, 100))
    rnd.shuffle(rows)
    got = [tuple(r) for r in jaccard_groups(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=key) == sorted(components(rows), key=key)


def test_jaccard_groups_edges(spark):
    empty = table(spark, [(1, "x")]).limit(0)
    assert jaccard_groups(empty).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (7, "z")]
    got = sorted((tuple(r) for r in jaccard_groups(table(spark, rows)).select("doc_id", "component_id").collect()), key=key)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (7, 7)], key=key)


def test_cells_lose_no_pair(monkeypatch):
    """Cells of pivots with small limits against all pairs by brute force, and crowds that are joined round by round."""
    rnd = np.random.default_rng(5)
    base = [rnd.integers(0, 1 << 62, 90).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.r_[b[rnd.permutation(90)[: rnd.integers(78, 91)]], rnd.integers(0, 1 << 62, rnd.integers(0, 9)).astype(np.uint64)]) for b in base for _ in range(25)]
    sets += [np.unique(rnd.integers(0, 1 << 62, 85).astype(np.uint64)) for _ in range(8)]
    sid, size = rnd.permutation(len(sets)).astype(np.int64), np.array([len(s) for s in sets])
    link = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (size[i] + size[j] - c)}
    bits = [jaccard_join.parity(s) for s in sets]
    for small, few in ((4, 12), (16, 12), (10**6, 8)):
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        monkeypatch.setattr(jaccard_join, "PIVOTS", few)
        cells = jaccard_join.Cells(sid, np.arange(len(sets)), size, bits, 80)
        reach, got, n = cells.reach(np.arange(len(sets))), set(), 0
        for home, guest, d in cells.divide(np.arange(len(sets)), reach):
            i, j, all_ = cells.open_pairs(home, guest, d, reach, True)
            assert all_
            got |= {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
            n += 1
        assert link <= got and (n > 1) == (small < 10**6)
    crowd = np.arange(25)
    i, j, all_ = cells.open_pairs(crowd, crowd[:0], np.zeros(25, np.int64), reach, False)
    assert not all_ and 0 < len(i) <= jaccard_join.COVERS * len(crowd)


def test_jaccard_groups_of_a_crowd(spark):
    rnd = random.Random(17)
    texts = near_copies(rnd, words(rnd, 60), 150, 7) + near_copies(rnd, words(rnd, 90), 60, 14)
    rows = list(enumerate(texts))
    got = [tuple(r) for r in jaccard_groups(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(components(rows))


def test_parts_leave_no_gap():
    for cls in range(0, 40):
        m, spare = parts_of(cls, 80)
        largest = int(np.ceil(1.25 ** (cls + 1)))
        assert m - spare > 2 * largest * 20 // 180


def test_remove_repeats(spark):
    rnd = random.Random(3)
    base = [words(rnd, rnd.randrange(20, 400)) for _ in range(25)]
    rows = list(enumerate(base))
    for i in range(40):
        a, b = rnd.choice(base), rnd.choice(base)
        x, y, n = rnd.randrange(len(a)), rnd.randrange(len(b)), rnd.choice([300, 399, 400, 401, 700])
        rows.append((1000 + i, b[:y] + a[x : x + n] + b[y:]))
    rows += [(1, base[0]), (None, None), (None, ""), (3000, "ab" * 500), (3001, "ñ" * 260), (3002, "x" * 400), (3003, "x" * 399)]
    out = remove_repeats(table(spark, rows), keep=["doc_id", "rk"]).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    want = [(d, *e) for (d, _), e in zip(rows, remove_repeats_plainly([t for _, t in rows]), strict=True)]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    assert any(0 < w[2] < w[1] for w in want)
    assert remove_repeats(table(spark, rows).limit(0)).collect() == []


def repeated_words(texts, n, length=400):
    """Brute force: what is left of each text without its words in any run of n that stands elsewhere too, and without repeats of bytes."""
    at = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    raw = [(t or "").encode() for t in texts]
    runs = collections.Counter(tuple(x[2] for x in w[i : i + n]) for w in at for i in range(len(w) - n + 1))
    strings = collections.Counter(d[i : i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for w, d in zip(at, raw, strict=True):
        gone, hit = bytearray(len(d)), set()
        for i in range(len(w) - n + 1):
            if runs[tuple(x[2] for x in w[i : i + n])] > 1:
                hit.update(range(i, i + n))
        for i in hit:
            a, b = w[i][0], w[i + 1][0] if i + 1 in hit else w[i][1]
            gone[a:b] = b"\1" * (b - a)
        for i in range(len(d) - length + 1):
            if strings[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g))
    return out


def test_remove_repeated_words(spark):
    rnd = random.Random(8)
    base = [words(rnd, rnd.randrange(20, 300)) for _ in range(20)] + [" ".join(rnd.choice("abcdefgh") for _ in range(200)) for _ in range(10)]
    texts = [*base, None, "", "a " * 50, "b " * 51, "c " * 52, "d " * 700, "漢字" * 90, "vor 漢字" * 90 + "x", "漢字" * 90]
    for i in range(60):
        a, b = rnd.choice(base).split(), rnd.choice(base).split()
        x, y, n = rnd.randrange(len(a)), rnd.randrange(len(b)), rnd.choice([30, 49, 50, 51, 52, 80])
        texts.append((" \n" if i % 7 == 0 else " ").join(b[:y] + ["é"] + a[x : x + n] + b[y:]))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(table(spark, rows), words=51).collect()}
    want = repeated_words(texts, 51)
    assert [got[i] for i, _ in rows] == want
    assert want != repeated_words(texts, 10**6)
    assert remove_repeats(table(spark, rows).limit(0), words=51).collect() == []


def test_order_round_trip(spark):
    PT = pytest.importorskip("public_tokenizers")
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(order.slots(np.arange(n), n, b"k").tolist()) == list(range(n))
    assert (order.slots(np.arange(1000), 1000, b"a") != order.slots(np.arange(1000), 1000, b"b")).any()
    tokens = (PT.path("byte_bpe_50k.tiktoken"), PT.PATTERN)
    rnd = random.Random(2)
    rows = [(i, words(rnd, rnd.randrange(300))) for i in range(60)] + [(None, None), (3, ""), (3, "x " * 5000)]
    made, where, folder = order.materialise(table(spark, rows).repartition(3), tokens, length=64, per_shard=20)
    coder = order.RankTokens(*tokens)
    at = where.orderBy("first_token").collect()
    n = -(-sum(r["n_tokens"] for r in at) // 64)
    stream = np.stack(list(order.read_slots(folder, 0, n + 9, 64, 20)))[order.slots(np.arange(n), n, b"epoch-0").astype(int)].ravel()
    texts = collections.Counter((d, tuple(coder.encode(t or "").tolist())) for d, t in rows)
    assert texts == collections.Counter((r["doc_id"], tuple(stream[r["first_token"] : r["first_token"] + r["n_tokens"]].tolist())) for r in at)
    assert sum(r["sequences"] for r in made.collect()) == n and len(list(order.read_slots(folder, n - 3, 9, 64, 20))) == 3
    empty = order.materialise(table(spark, rows).limit(0), tokens)
    assert empty[0].count() == 0 and empty[1].count() == 0


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(covered)


def test_quality(spark):
    rnd = random.Random(4)
    texts = [None, "", "\n\n", "a\n a\na\na", "x y z x y z", "ñé #1|<>\nñé #1|<>", "x " * 3000, *(words(rnd, rnd.randrange(120)) for _ in range(30))]
    rows = list(enumerate(texts)) + [(None, "again"), (None, "again")]
    got = quality.quality(table(spark, rows)).collect()
    want = [(d, *brute_quality(t)) for d, t in rows]
    assert sorted([tuple(r[:6]) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and (not r["kept"] or not r["base_failed"])
    good = " ".join(f"w{i}" for i in range(60))
    hosts = spark.createDataFrame([(i, good if h == "fine" or i % 20 == 0 else "bad", h) for i, h in enumerate(["fine"] * 200 + ["poor"] * 200)] + [(900, good, None)], "doc_id long, text string, source string")
    kept = {(r["host_rate"] is None, round(r["host_rate"] or 0, 1), r["kept"]) for r in quality.quality(hosts).where("not base_failed").collect()}
    assert {k[2] for k in kept if k[1] > 0.5} == {False} and {k[2] for k in kept if k[1] < 0.5} == {True}
    assert quality.quality(table(spark, rows).limit(0)).count() == 0


def test_licenses(spark):
    rows = [(1, "Prose first.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nno."), (3, "All rights reserved. Licensed under CC BY-NC 4.0."), (4, "This licence is unknown."), (5, None), (6, ""), (6, "ALL RIGHTS RESERVED")]
    got = [(r["doc_id"], list(r["licenses"])) for r in licenses.scan_licenses(table(spark, rows)).collect()]
    assert sorted(got) == sorted([(1, ["MIT"]), (2, ["Apache-2.0"]), (3, ["CC-BY-NC-4.0", "Proprietary"]), (4, []), (5, []), (6, []), (6, ["Proprietary"])])
    plan = licenses.scan_licenses(table(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_wrapped_over_lines(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    gpl = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
    want = [(mit, ["mit-text"]), (bsd, ["bsd-conditions"]), (gpl.format(":", ",", 3), ["gpl-3-text", "gpl-3-grant"]), (gpl.format(";", ";", 2), ["gpl-2-text", "gpl-2-grant"]), (apache, ["apache-2.0-header", "apache-2.0-terms", "apache-2.0-notice-long"])]
    # on a single line nothing ends the Apache header's address
    forms = [lambda t: "Title\n\n" + t, lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint x;", lambda t: "".join(f"# {x}\r\n" for x in t.split("\n")), lambda t: " ".join(t.split())]
    cases = [(f(t), rules) for t, rules in want for f in (forms if t != apache else forms[:3])] + [("not all rights reserved", []), ("all rights\nreserved by none", []), ("x: all rights\nreserved", ["all-rights-reserved"])]
    got = {r["doc_id"]: list(r["rules"]) for r in licenses.scan_licenses(table(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [rules for _, rules in cases]


def test_licenses_of_other_families(spark):
    """Expected licences are written down by hand, not taken from the module's rules."""
    cases = [
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", ["GPL-2.0"]),
        ("# SPDX-License-Identifier: MIT\n", ["MIT"]),
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", ["MPL-2.0"]),
        ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", ["Unlicense"]),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", ["ISC"]),
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n", ["LGPL-2.1"]),
        ("    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU Affero General Public License as\n    published by the Free Software Foundation, either version 3 of the\n    License, or (at your option) any later version.\n", ["AGPL-3.0"]),
        ("We mention the MIT license, and public domain works.", []),
    ]
    got = {r["doc_id"]: list(r["licenses"]) for r in licenses.scan_licenses(table(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [x for _, x in cases]


def test_bpe_matches_the_library(spark):
    PT = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = PT.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rnd = random.Random(0)
    pool = [chr(c) for c in [*range(0, 0x180), *range(0x370, 0x400), 0x130, 0x3A3, 0x1C, 0x85, 0x2028, 0x200B, 0xFEFF, 0x301, 0x1F600, 0x3000, 0xAC00, 0x1100, 0x1161, 0x660]]
    texts = ["".join(rnd.choice(pool) if rnd.random() < 0.7 else rnd.choice(["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", " ", "aaaa"]) for _ in range(rnd.randrange(40))) for _ in range(500)]
    rows = list(enumerate([None, "", "x" * 20000, *texts, "twice", "twice"]))
    got = {r["doc_id"]: r for r in bpe.encode_decode(table(spark, rows), path).collect()}
    for i, t in rows:
        e = lib.encode(t or "", add_special_tokens=False)
        assert list(got[i]["ids"]) == e.ids and got[i]["decoded"] == lib.decode(e.ids, skip_special_tokens=False)
    coder = bpe.WordBpe(path)
    assert coder.decode(lib.encode(texts[3], add_special_tokens=False).ids) == got[6]["decoded"]
    assert bpe.encode_digest(table(spark, rows).limit(0), path).count() == 0


def distance(p, t):
    row = np.zeros(len(t) + 1, int)
    for i in range(1, len(p) + 1):
        new = np.empty_like(row)
        new[0] = i
        for j in range(1, len(t) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[i - 1] != t[j - 1]))
        row = new
    return int(row.min())


def test_leaks(spark):
    rnd = random.Random(5)
    items = [words(rnd, rnd.randrange(8, 25)) for _ in range(12)] + ["tiny", None, " "]
    docs = [None, "", "tiny", words(rnd, 50)]
    for n in (12, 13, 18, 19, 25, 29, 38, 39):  # lengths at which the lemma asks for shorter q-grams
        items.append("".join(rnd.choice("abcdefghij") for _ in range(n)))
        for _ in range(6):
            t = list(items[-1])
            for _ in range(rnd.randrange(5)):
                t[rnd.randrange(len(t))] = rnd.choice(["", "q", "zz"])
            docs.append(words(rnd, 5) + " " + "".join(t) + " " + words(rnd, 5))
    for s in items[:12]:
        for _ in range(3):
            t = list(s.upper() if rnd.random() < 0.3 else s)
            for _ in range(rnd.randrange(int(len(t) * 0.14))):
                x = rnd.randrange(len(t))
                t[x : x + rnd.randrange(2)] = rnd.choice(["", "q", "zz"])
            docs.append(words(rnd, 12) + "  " + "".join(t) + "\n" + words(rnd, 12))
    norm = lambda x: " ".join((x or "").lower().split())
    want = set()
    for d, t in enumerate(docs):
        for i, s in enumerate(items):
            m = len(norm(s))
            most = m * 8 // 100
            if m and (e := distance(norm(s), norm(t))) <= most:
                want.add((d, i, e))
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {tuple(r) for r in decontaminate.leaks(table(spark, list(enumerate(docs))), it).collect()}
    assert got == want and len(want) > 10
    assert decontaminate.leaks(table(spark, []), it).count() == 0 and decontaminate.leaks(table(spark, [(1, "x")]), it.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    assert hit / got["toxic"].sum() > 0.85 and hit / (got["predicted"] == 1).sum() > 0.95 and got["score"].between(0, 1).all()


def test_toxicity_edges(spark):
    rows = [(i, "you are an idiot and a moron" if i % 4 == 0 else f"plain words number {i}") for i in range(80)] + [(None, None), (200, ""), (3, "x " * 50000)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.score_toxicity(table(spark, rows), labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0} and toxicity.score_toxicity(table(spark, rows).limit(0), labels).count() == 0


def test_isotonic():
    mid, level = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(level) == [0, 0.5, 1] and list(mid) == [1, 2.5, 4]


def test_language(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = language.learn_likelihood(docs.where("doc_id % 2 = 0"))
    got = language.identify(None, docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert got.where("lang = truth").count() / got.count() > 0.97
    pages = spark.createDataFrame([(1, "https://a.example/fr/x", "<html lang='fr'><body></body></html>"), (2, "https://a.example/fr/y", None), (None, None, ""), (1, "bad", "<p>the and of the and")], "page_id long, url string, html string")
    rows = language.identify(pages, None, model).collect()
    assert len(rows) == 4 and [r["lang"] for r in rows if r["page_id"] == 2] == ["fr"]
    none = language.identify(pages, None, language.learn_likelihood(docs.limit(0))).collect()
    assert {r["lang"] for r in none} == {None}


def test_language_of_more_than_64(spark):
    rows = []
    for k in range(70):
        rnd = random.Random(k)
        own = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rnd.choice(own) for _ in range(40)), f"l{k:02d}") for i in range(3 if k < 66 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    model = language.learn_likelihood(docs)
    assert model.languages == [f"l{k:02d}" for k in range(70)]
    got = {r["doc_id"]: r["lang"] for r in language.identify(None, docs.where("doc_id >= 6400"), model).collect()}
    assert got == {d: x for d, _, x in rows if d >= 6400}


def test_archives(spark):
    big = "<p>é" + "x" * 1200 + "</p>"
    rows = [(1, "http://www.b.example/2", big), (2, "http://a.example/1?q=1#f", big), (9, "http://a.example/1?q=1", big), (9, "http://a.example/1?q=1", big), (None, "http://a.example/\n1", big), (3, None, None), (4, "x", "small"), (5, "y", "small"), (None, "z", "n" * 1000), (6, "http://b.example:8080/", "")]
    back, index, folder = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in back.collect())
    n = len(big.encode())
    assert got == collections.Counter({(1, n, "revisit", 9): 1, (2, n, "revisit", 9): 1, (9, n, "response", None): 2, (None, n, "revisit", 9): 1, (3, 0, "response", None): 1, (4, 5, "response", None): 1, (5, 5, "response", None): 1, (None, 1000, "response", None): 1, (6, 0, "response", None): 1})
    keys = [(r["key"], r["ts"]) for r in index.orderBy("part", "seq").collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    fs, base = storage.at(folder)
    raw = b"".join(gzip.decompress(fs.open_input_file(f"{base}/{r['file']}").read()) for r in index.select("file").distinct().collect())
    assert raw.count(b"WARC/1.1\r\n") == len(rows)
    empty = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_loser_tree():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rnd.randrange(50), i) for i in range(rnd.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_cells_of_more_groups_than_pivots(monkeypatch):
    """Groups of near copies among unrelated sets: most sets are in a cell of their group, and comparisons stay far below all pairs."""
    rnd = np.random.default_rng(11)
    base = [rnd.integers(0, 1 << 62, 80).astype(np.uint64) for _ in range(60)]
    sets = [np.unique(np.r_[b[rnd.permutation(80)[:76]], rnd.integers(0, 1 << 62, 3).astype(np.uint64)]) for b in base for _ in range(20)]
    sets += [rnd.integers(0, 1 << 62, 80).astype(np.uint64) for _ in range(200)]
    sid, size = rnd.permutation(len(sets)).astype(np.int64), np.array([len(s) for s in sets])
    cells = jaccard_join.Cells(sid, np.arange(len(sets)), size, [jaccard_join.parity(s) for s in sets], 80)
    reach = cells.reach(np.arange(len(sets)))
    made = list(cells.divide(np.arange(len(sets)), reach))
    assert len(made) >= 50 and sum(len(h) + len(g) for h, g, _ in made[:-1]) < 2 * 60 * 20
    got = set()
    for home, guest, d in made:
        i, j, _ = cells.open_pairs(home, guest, d, reach, True)
        got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(g * 20 + i, g * 20 + j) for g in range(60) for i in range(20) for j in range(i + 1, 20) if 100 * (c := len(np.intersect1d(sets[g * 20 + i], sets[g * 20 + j]))) >= 80 * (size[g * 20 + i] + size[g * 20 + j] - c)} <= got


def test_small_regions_are_compared_together(monkeypatch):
    """Many small regions, some of them crowds, take a few calls, lose no pair, and a crowd gives links to a few pivots until all are asked for."""
    J = jaccard_join
    rnd = np.random.default_rng(3)
    base = [rnd.integers(0, 1 << 62, 70).astype(np.uint64) for _ in range(40)]
    sets = [np.unique(np.r_[b[rnd.permutation(70)[: rnd.integers(60, 71)]], rnd.integers(0, 1 << 62, rnd.integers(0, 6)).astype(np.uint64)]) for b in base for _ in range(20)]
    sid, size = rnd.permutation(len(sets)).astype(np.int64), np.array([len(s) for s in sets])
    groups = [np.arange(20 * g, 20 * g + 20) for g in range(40)] + [np.sort(rnd.choice(len(sets), rnd.integers(5, 40), replace=False)) for _ in range(400)]
    doc, sig = np.concatenate(groups), np.repeat(np.arange(len(groups), dtype=np.uint64), [len(g) for g in groups])
    order = np.argsort(doc, kind="stable")
    raw = [packed.pack(sid, sid, size, sig[order], doc[order].astype(np.uint32), np.frombuffer(b"".join(J.parity(s) for s in sets), np.uint8))]
    link = {(int(min(sid[i], sid[j])), int(max(sid[i], sid[j]))) for g in groups for i in g for j in g if i < j and 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (size[i] + size[j] - c)}
    calls, plain = [], J.Cells.may_link
    monkeypatch.setattr(J.Cells, "may_link", lambda self, i, j: (calls.append(len(i)), plain(self, i, j))[1])
    whole = [r for b in J._join_regions(80, True)(raw) for r in b.to_pylist()]
    assert len(calls) < 40 and link <= {(r["a"], r["b"]) for r in whole}
    part = [r for b in J._join_regions(80, False)(raw) for r in b.to_pylist()]
    crowded = {r["a"] for r in part if r["kind"] == J.CROWDED}
    assert crowded and crowded <= set(range(40)) and len(calls) < 80
    pairs = {(r["a"], r["b"]) for r in part if r["kind"] == J.PAIR}
    cover = [sum((min(x, y), max(x, y)) in pairs for x in sid[groups[g]].tolist() for y in sid[groups[g]].tolist() if x < y) for g in crowded]
    assert max(cover) < 190 and link - {p for g in crowded for x in sid[groups[g]].tolist() for y in sid[groups[g]].tolist() for p in [(x, y)]} <= pairs


@pytest.mark.parametrize("much", [1024, 3])
def test_jaccard_groups_that_share_a_line(spark, monkeypatch, much):
    """Texts that share a line, some of them near copies, dealt out without the line where ``much`` is small."""
    monkeypatch.setattr(jaccard_join, "MUCH", much)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    rnd = random.Random(17)
    line = " ".join(f"line{i}" for i in range(30))
    own = [[f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([4, 25, 60]))] for _ in range(160)]
    rows = [(i, line + " " + " ".join(ws)) for i, ws in enumerate(own)]
    rows += [(1000 + i, line + " " + " ".join(ws[: len(ws) - 1 - i % 3])) for i, ws in enumerate(own[:80])]
    got = {r.doc_id: r.component_id for r in jaccard_groups(table(spark, rows)).collect()}
    sets = {i: shingled(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(sets)


def shingled(text, k=5):
    ws = text.lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(len(ws) - k, 0) + 1)}


class Held:
    """What a broadcast variable looks like to a task."""

    def __init__(self, keys):
        self.value = np.zeros(1 << 17, np.uint64)
        k = np.mod(np.asarray(keys, np.int64), 1 << 23)
        np.bitwise_or.at(self.value, k >> 6, np.uint64(1) << (k & 63).astype(np.uint64))


def comparisons(texts, monkeypatch, rounds=3):
    """Bitmaps compared, pairs found and undivided regions, the rounds' tasks run here one after another with classes left as they are."""
    J, P = jaccard_join, packed
    done = [0]
    plain = J.Cells.may_link
    monkeypatch.setattr(J.Cells, "may_link", lambda self, i, j: (done.__setitem__(0, done[0] + len(i)), plain(self, i, j))[1])

    def reduced(batches, reduce):
        blocks = {}
        for b in batches:
            for r in b.to_pylist():
                blocks.setdefault(r["bucket"], []).append(r["block"])
        return [r for raw in blocks.values() for b in reduce(raw) for r in b.to_pylist()]

    def regions(batch, *how):
        met = reduced(J._regions(5, 80, 8, *how)(iter([batch])), J._meet(8))
        raw = [r["sigs"] for r in met if r["kind"] == J.MEMBER]
        sigs = {r["setid"]: r["sigs"] for b in (J._collected(raw) if raw else []) for r in b.to_pylist()}
        cols = {"setid": list(sigs), "comp": list(sigs), "n": [about[s][0] for s in sigs], "turn": [how[1] if how else 0] * len(sigs), "sigs": list(sigs.values()), "bits": [about[s][1] for s in sigs]}
        return pa.record_batch(cols, pa.schema([("setid", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("turn", pa.int64()), ("sigs", pa.list_(pa.binary())), ("bits", pa.binary())]))

    batch = pa.record_batch({"text": pa.array(texts)})
    data, off = X.column(batch, "text")
    n, first, _, h = J._sets(data, off, 5)
    ids = J._identity(n, first, h)
    about = {int(s): (int(m), J.parity(h[f : f + m])) for s, m, f in zip(ids, n, first, strict=True)}
    where = {int(s): i for i, s in enumerate(ids)}
    members, again, common, pairs, flagged = [regions(batch)], None, None, set(), 0
    for r in range(rounds):
        got = reduced((b for m in members for b in J._deal_members(8, again, r)(iter([m]))), J._join_regions(80, r == rounds - 1))
        pairs |= {(x["a"], x["b"]) for x in got if x["kind"] == J.PAIR}
        undivided = Held([x["a"] for x in got if x["kind"] == J.UNDIVIDED])
        again = Held([x["a"] for x in got if x["kind"] == J.CROWDED])
        flagged += sum(x["kind"] == J.UNDIVIDED for x in got)
        theirs = {x["setid"] for m in members for b in J._members_of(undivided)(iter([m])) for x in b.to_pylist()}
        if not theirs:
            break
        mine = pa.record_batch({"text": pa.array([texts[where[s]] for s in sorted(theirs)])})
        shown = [x["h"] for b in J._in_common(5, 80, undivided, common, r)(iter([mine])) for x in b.to_pylist()]
        more = Held(shown)
        if common is not None:
            more.value |= common.value
        common = more
        members.append(regions(mine, common, r + 1))
    return done[0], len(pairs), flagged


def test_unrelated_sets_that_share_a_line(monkeypatch):
    rnd = random.Random(23)
    line = " ".join(f"line{i}" for i in range(16))
    texts = [f"{line} " + " ".join(f"w{rnd.randrange(10**7)}" for _ in range(100)) for _ in range(4000)]
    monkeypatch.setattr(jaccard_join, "MUCH", 128)
    few, _, _ = comparisons(texts[:1000], monkeypatch)
    many, pairs, undivided = comparisons(texts, monkeypatch)
    assert undivided > 0 and pairs == 0 and max(few / 1000, many / 4000) < 100  # all pairs would be 500 and 2,000 for each text


@pytest.mark.parametrize("buckets", [4, 64])
def test_alike_sets_meet_in_one_region_however_many_buckets(buckets):
    """Pairs and threes that share dozens of parts: rows of pairs, regions and bitmaps sent do not grow with the number of buckets."""
    J, P = jaccard_join, packed
    rnd = random.Random(29)
    texts, linked = [], set()
    for g in range(60):
        ws = [f"w{rnd.randrange(10**7)}" for _ in range(150)]
        alike = [ws, [*ws[:-1], "x"], [*ws[:-1], "y"]][: 2 + g % 2]
        linked |= {(len(texts) + i, len(texts) + j) for i in range(len(alike)) for j in range(i + 1, len(alike))}
        texts += [" ".join(x) for x in alike]
    batch = pa.record_batch({"text": pa.array(texts)})
    n, first, _, h = J._sets(*X.column(batch, "text"), 5)
    ids = J._identity(n, first, h)
    about = {int(s): (int(m), J.parity(h[f : f + m])) for s, m, f in zip(ids, n, first, strict=True)}

    def by_bucket(batches, bucket="bucket", block="block"):
        out = {}
        for b in batches:
            for r in b.to_pylist():
                out.setdefault(r[bucket], []).append(r[block])
        return list(out.values())

    met = [b for raw in by_bucket(J._regions(5, 80, buckets)(iter([batch]))) for b in J._meet(buckets)(raw)]
    assert {r["kind"] for b in met for r in b.to_pylist()} == {J.MEMBER}
    sigs = {r["setid"]: r["sigs"] for raw in by_bucket(met, "a", "sigs") for b in J._collected(raw) for r in b.to_pylist()}
    assert len(sigs) == len(texts) and max(len(b"".join(x)) // 8 for x in sigs.values()) <= 4
    cols = {"setid": list(sigs), "comp": list(sigs), "n": [about[s][0] for s in sigs], "turn": [0] * len(sigs), "sigs": list(sigs.values()), "bits": [about[s][1] for s in sigs]}
    members = pa.record_batch(cols, pa.schema([("setid", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("turn", pa.int64()), ("sigs", pa.list_(pa.binary())), ("bits", pa.binary())]))
    dealt = by_bucket(J._deal_members(buckets)(iter([members])))
    assert sum(len(P.unpack(x)[0]) for raw in dealt for x in raw) <= 2 * len(texts)
    got = [(r["a"], r["b"]) for raw in dealt for b in J._join_regions(80, False)(raw) for r in b.to_pylist() if r["kind"] == J.PAIR]
    assert set(got) == {tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in linked} and len(got) < 1.5 * len(linked)


def test_wide_bitmaps_are_compared_in_bounded_pieces():
    """Many comparisons of long sets, most of them of the same few pairs, hold little memory at once."""
    rnd = np.random.default_rng(31)
    held = rnd.integers(0, 1 << 63, (40, 1024)).astype(np.uint64)
    i, j = rnd.integers(0, 40, (2, 20_000))
    tracemalloc.start()
    got = jaccard_join._apart(held, i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = rnd.integers(0, 20_000, 50)
    assert got[some].tolist() == np.bitwise_count(held[i[some]] ^ held[j[some]]).sum(axis=1).tolist() and peak < 60 << 20
    narrow = held[:, :3]
    assert jaccard_join._apart(narrow, i, j).tolist() == np.bitwise_count(narrow[i] ^ narrow[j]).sum(axis=1).tolist()


def test_bpe_tables_equal_single_look_ups():
    PT = pytest.importorskip("public_tokenizers")
    coder = bpe.WordBpe(PT.path("word_bpe_49k.json"))
    words = ["hello", "naïve", "", "é", "abab" * 9, "hello"]
    ids = coder.merge_all(words)
    assert ids[2] == [] and ids[0] == ids[5] and all("".join(coder.names[i] for i in x).endswith(coder.end) for x in ids if x)
    flat = np.array([i for x in ids for i in x])
    assert coder.decode(flat) == coder.decode(flat.tolist()) and coder.decode(np.array([], int)) == ""
    assert coder.decode(np.array([flat[0], 10**6])) == coder.names[int(flat[0])]
    found = coder._index(np.array([coder.first[97], coder.last[98]]), np.array([True, False]))
    assert found == {p: [0] for p in [(coder.first[97], coder.last[98])] if p in coder.rank}
