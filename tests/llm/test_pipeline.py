"""The pipeline's stages against brute force on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import near_copies, words


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    clean = [words(rnd, 120) for _ in range(30)]
    toxic = [words(rnd, 40) + " idiot moron scum worthless idiot " + words(rnd, 40) for _ in range(30)]
    passage, leak = words(rnd, 90), words(rnd, 30)
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(toxic)]
    rows += [(200 + i, t) for i, t in enumerate(near_copies(rnd, clean[0], 3, 1))] + [(300, words(rnd, 60) + " " + passage), (301, passage + " " + words(rnd, 60)), (400, words(rnd, 50) + " " + leak.upper() + " " + words(rnd, 50)), (500, None), (None, "no id")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i in [*range(30), *range(100, 130)]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(seen["toxicity"]) == {d for d, _ in rows if d is None or not 100 <= d < 130}
    assert set(seen["jaccard_join"]) == set(seen["toxicity"]) - {200, 201, 202}
    assert set(seen["suffix_dedup"]) == set(seen["jaccard_join"])
    assert passage not in seen["suffix_dedup"][300]["text"] and passage not in seen["suffix_dedup"][301]["text"] and seen["suffix_dedup"][5]["text"] == clean[5]
    assert set(seen["decontaminate"]) == set(seen["suffix_dedup"]) - {400}
    assert all(r["n_tokens"] == len(r["ids"]) for r in seen["bpe"].values()) and set(seen["bpe"]) == set(seen["decontaminate"])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["n_tokens"] for r in got.select("doc_id", "n_tokens").collect()} == {d: r["n_tokens"] for d, r in seen["bpe"].items()}


def test_repeats_of_over_50_short_words_go(spark):
    rnd = random.Random(12)
    short = lambda n: " ".join(rnd.choice("abcdefghijkl") for _ in range(n))
    long, fifty = short(51), short(50)
    rows = [(1, words(rnd, 60) + " " + long), (2, long + " " + words(rnd, 60)), (3, words(rnd, 60) + " " + fifty), (4, fifty + " " + words(rnd, 60)), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    texts = dict(rows)
    assert len(long.encode()) == 101 and [got[d]["text"] for d in (1, 2)] == [texts[1][:-101], texts[2][101:]]
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert [got[d]["text"] for d in (3, 4, None)] == [texts[3], texts[4], None]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "some text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, setid string").withColumn("other", F.lit(1))
    assert dict(corpus_pipeline.STAGES)[name](spark, none, str(tmp_path)).count() == 0


COLS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_are_told_apart_by_id_and_text(spark, tmp_path):
    rnd = random.Random(13)
    a, b, c, leak = words(rnd, 60), words(rnd, 60), words(rnd, 60), words(rnd, 30)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c), (None, a), (None, None), (7, None), (8, "")]
    table = lambda r: spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in r], COLS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, table(rows), "").collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (5, b), (None, c), (None, None), (7, None), (8, "")], key=repr)
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, a + " " + leak), (5, b), (None, leak), (None, c), (6, None)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_leaks(spark, table(rows), str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(5, b), (None, c), (6, None)], key=repr)


def test_cuts_keep_replacement_characters_and_whole_letters(spark):
    rnd = random.Random(14)
    passage = "é".join(words(rnd, 90).split(" "))  # one word of many bytes, so that only bytes repeat
    rows = [(1, "\ufffd begin à" + passage + "è end \ufffd"), (2, "other â" + passage + "ê tail"), (3, "\ufffd alone")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLS)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    assert len(passage.encode()) > 400
    # both letters around the passage begin with the same byte in the two texts: it goes with the passage, and so does the rest of the letter
    assert got[1] in ("\ufffd begin " + x + y + " end \ufffd" for x in ("", "à") for y in ("", "è"))
    assert got[2] in ("other " + x + y + " tail" for x in ("", "â") for y in ("", "ê")) and got[3] == "\ufffd alone"
