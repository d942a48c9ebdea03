"""Periodic runs, tokenizer alignment and fingerprint links against brute force."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import public_tokenizers as T
import pytest
import xxhash

from tessera.llm import simhash_join as S
from tessera.llm import token_align as A
from tessera.llm.periodic import maximal_runs, periodic_runs, run_digest
from tessera.llm.queries import QUERIES, periodic_tail
from tests.compare import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FILES = (T.path("byte_bpe_50k.json"), T.PATTERN, T.path("piece_bpe_32k.model"))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def runs_of(ws, least, times):
    n, out = len(ws), set()
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            seg = ws[i : j + q]
            if len(seg) >= max(least, times * q) and not any(all(seg[k] == seg[k + p] for k in range(len(seg) - p)) for p in range(1, q)):
                out.add((i, len(seg), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(ws) if i not in gone)


def periodic_texts(seed, count):
    rnd, out = random.Random(seed), []
    for _ in range(count):
        n, k = rnd.randint(0, 90), rnd.choice([1, 2, 3, 40])
        ws = [string.ascii_letters[rnd.randrange(k)] for _ in range(n)]
        if n and rnd.random() < 0.7:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randint(3, 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        out.append(ws)
    return out


@pytest.mark.parametrize("least,times", [(2, 2), (6, 3), (24, 3), (0, 4)])
def test_runs_against_all_periods(least, times):
    for ws in periodic_texts(least, 400):
        sym = np.array([*map(ord, ws), 1 << 20])
        s, e, q = maximal_runs(sym, least, times)
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == runs_of(ws, least, times)


def test_run_table(spark):
    rows = [(i, " ".join(ws)) for i, ws in enumerate(periodic_texts(9, 150))]
    long = " ".join(["la"] * 60_000) + " end " + " ".join(str(i % 999) for i in range(40_000))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a\tb\n" * 30), (None, "x " * 40), (5, rows[5][1]), (1004, long)]
    df = frame(spark, [(*r, "y") for r in rows], "doc_id long, text string, runs string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed.encode()) for r in periodic_runs(df).collect())
    want = []
    for i, t in rows:
        ws = WORD.findall((t or "").encode())
        runs = runs_of(ws, 24, 3) if i != 1004 else [(0, 60_000, 1), (60_001, 40_000, 999)]
        want.append((i if i is not None else -1, len(ws), runs, collapsed(ws, runs)))
    assert got == sorted(want)
    assert periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(df, times=1)


def test_run_digest(spark):
    rows = [(1, "a " * 24 + "b " * 30), (2, "a b " * 15 + "c d " * 15), (3, "a b c d e f g h i " * 3 + "a"), (4, "none")]
    got = {r.doc_id: r for r in run_digest(periodic_runs(frame(spark, rows))).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (2, 24, 30, 1, 30000)
    assert (got[2].start, got[2].length, got[2].period) == (0, 30, 2)
    assert (got[3].n_runs, got[3].exponent_milli) == (1, 28 * 1000 // 9)
    assert (got[4].n_runs, got[4].start, got[4].exponent_milli) == (0, None, None)
    assert got[1].runs_sha256 == hashlib.sha256(b"0,24,1\n24,30,1\n").hexdigest() and got[4].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].collapsed_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_op11_over_its_table(spark):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ws = periodic_tail(d.doc_id, WORD.findall((d.text or "").encode()))
        if len(ws) > 400:
            continue
        runs = runs_of(ws, 24, 3)
        assert got[d.doc_id].n_runs == len(runs)
        assert got[d.doc_id].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert got[d.doc_id].collapsed_sha256 == hashlib.sha256(collapsed(ws, runs)).hexdigest()
    assert any(r.n_runs for r in got.values())


def plain_alignment(rows):
    """By the libraries themselves and by overlapping all tokens of a text."""
    import sentencepiece
    from tokenizers import Tokenizer

    from tessera.llm.bpe import byte_letters

    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    byte = {c: b for b, c in enumerate(byte_letters())}
    piece = lambda i: bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
    links, out = {}, {}
    for key, text in rows:
        a = b = []
        raw = (" " + (text or "")).encode()
        if text:
            e = t.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(map(byte.__getitem__, t.id_to_token(i)))) for i in e.ids]
            b = [(i, piece(i)) for i in m.encode(text)]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            out[key], links[key] = (0, 0, 0, ""), []
            continue
        spans = []
        for side in (a, b):
            at, got = 0, []
            for i, x in side:
                got.append((at, at + len(x), i))
                at += len(x)
            spans.append(got)
        links[key] = [(i, j) for x, y, i in spans[0] for u, v, j in spans[1] if x < v and u < y]
        cuts = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for x, y, i in side if low < y <= c) for side in spans))
            low = c
        out[key] = (len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = collections.Counter(x for k in links for x in links[k])
    top = collections.Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return {k: (*out[k][:3], len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), out[k][3]) for k, ls in links.items()}


TEXTS = ["", None, " ", "hello world", "Hello, wörld!  two  blanks\n\n\ttab", "<|endoftext|> and </s> <s> <unk> <0x41>", "日本語のテキスト 😀😀", "▁under", "the the the", "a" * 300, "1234567 89", "ﬁ ligature ½  x", "é combining", "\x00nul", "trailing  "]


def test_alignment_against_all_overlaps(spark):
    rnd = random.Random(3)
    mixed = ["".join(rnd.choice("ab e\n\t.,éß日😀<|>1▁") for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    rows = list(enumerate(TEXTS + mixed + mixed[:5]))
    df = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, n_a int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in A.align_tokenizers(df, *FILES).collect()}
    assert got == plain_alignment(rows)
    assert A.align_tokenizers(df.limit(0), *FILES).collect() == []


def test_op12_over_its_table(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_token_align"](spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {k: (v[0], v[1], v[3]) for k, v in got.items()} == {k: (v[0], v[1], v[3]) for k, v in got.items() if v[3] == v[0] + v[1] - v[2]}
    short = [d for d in docs if len(d[1] or "") < 3000]
    want = plain_alignment(short)
    assert all(got[k][:4] == want[k][:4] and got[k][6] == want[k][6] for k, _ in short)


def test_counts_survive_shards_and_packing(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD", 3)
    key = np.array([1, 5, (7 << 32) | 2, (7 << 32) | 9, 90 << 32])
    assert all((x == y).all() for x, y in zip(A.expand(A.squeeze(key, np.arange(5))), (key, np.arange(5)), strict=True))
    pairs = spark.createDataFrame([(A.squeeze(key[i:], np.arange(5)[i:] + 1),) for i in range(5)], "pairs binary").repartition(2)
    from tessera.plans.lineage import new_path

    folder = new_path(spark, "counts")
    made = A.write_shards(A.partial_counts(pairs), folder).collect()
    counts = A.Counts(folder, [(r.shard, r.first, r.size) for r in made])
    assert counts.of(key).tolist() == [1, 4, 9, 16, 25]


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def same_partition(x, y):
    return len(set(zip(x, y, strict=True))) == len(set(x)) == len(set(y))


@pytest.mark.parametrize("hot,many", [(4096, 8), (4, 2), (1, 2), (4096, 1000)])
def test_near_links_against_all_pairs(spark, monkeypatch, hot, many):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "MANY", many)
    rng = np.random.default_rng(hot + many)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(700)], np.uint64)
    half = seeds[:5, None] & np.uint64(0xFFFFFFFF) | (rng.integers(0, 1 << 31, (5, 60), dtype=np.uint64) << np.uint64(32))  # one segment in common only
    fps = np.unique(np.r_[seeds[rng.integers(0, 60, 700)] ^ flips, half.ravel(), seeds[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)), [np.uint64(0), np.uint64(1 << 63), np.uint64(7)]])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    links = {(r.a, r.b) for r in S.near_links(df).collect()}
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert int(fps[at[a]] ^ fps[at[b]]).bit_count() <= 3
        root[find(at[a])] = find(at[b])
    assert same_partition([find(i) for i in range(len(fps))], plain_components(fps))


def test_forest_of_a_crowd_is_small():
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(5000)], np.uint64))
    a, b = S.forest(fps)
    assert len(a) == len(fps) - 1
    pairs = S.entry_pairs(np.zeros(len(fps), np.uint64), fps, np.ones(len(fps), bool))
    assert pairs.shape[1] == len(fps) - 1


def plain_fingerprint(text):
    ws = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORD.findall((text or "").encode())]
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64(x, seed=42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_groups(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ABC"]
    base = [[rnd.choice(vocab) for _ in range(300)] for _ in range(6)]
    rows = [(i, " ".join(w if rnd.random() > 0.004 else "zz" for w in base[i % 6])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t"), (103, "one"), (104, "One"), (105, "a b"), (106, "a b c"), (107, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (108, "x y " * 30_000)]
    df = frame(spark, [(*r, "c") for r in rows], "doc_id long, text string, fp string").repartition(4)
    got = S.simhash_groups(df).collect()
    fps = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    comp = plain_components(fps)
    want = sorted((-1 if i is None else i, f"{f:016x}", min(j for (j, _), c in zip(rows, comp, strict=True) if c == comp[k] and j is not None)) for k, ((i, _), f) in enumerate(zip(rows, fps.tolist(), strict=True)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert S.simhash_groups(df.limit(0)).collect() == []


def test_op13_over_its_table(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash_join"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got.keys() == {d.doc_id for d in docs} and all(got[d.doc_id][0] == f"{plain_fingerprint(d.text):016x}" for d in docs)
    fps = np.array([int(got[d.doc_id][0], 16) for d in docs], np.uint64)
    assert same_partition([got[d.doc_id][1] for d in docs], plain_components(fps))


def test_names_of_stores():
    from tessera.llm.storage import at, named

    assert named("s3a://b/k") == "s3://b/k" and named("wasbs://c@a.example/x") == "abfss://c@a.example/x"
    assert named("/tmp/x") == "file:///tmp/x" and named("file:///tmp/x") == "file:///tmp/x" and at("/tmp/x")[1] == "/tmp/x"
