"""Phrase collocations: fingerprints that collide, odd rows, blocks."""

import numpy as np
import pyarrow as pa
import pytest

from fleetskein.llm import collocations

SCHEMA = "doc_id long, text string, lang string, rank string, phrase string, n string, block string, words string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, *"zzzzz") for k, (t, lang) in enumerate(rows)], SCHEMA)


def test_cut():
    words, per = collocations.cut(pa.array(["The CAT, the cat\tsat. ", None, "", " é!É\nx", "a"]))
    assert [w.decode() for w in words.to_pylist()] == ["the", "cat", "the", "cat", "sat", "é", "É", "x", "a"]
    assert per.tolist() == [2, 3, 1, 1, 1, 1] and len(collocations.cut(pa.array([None, ".,"], pa.string()))[1]) == 0


def test_scores_cuts_and_covered_phrases(spark):
    rows = [("big red dog", "en")] * 40 + [("big red", "en")] * 60 + [("red dog runs", None)] * 30 + [("dog", "en")] * 7 + [(None, "en"), ("", None), ("x. y", "en")]
    found = [tuple(r) for r in collocations.collocations(docs(spark, rows)).collect()]
    n = 40 * 3 + 60 * 2 + 7 + 2
    assert sorted(found) == sorted([
        ("en", 1, "big red", 100, 100, 100, n, 1_000_000),
        ("en", 2, "big red dog", 40, 100, 47, n, 40 * 2_000_000 // 147),
        ("und", 1, "red dog runs", 30, 30, 30, 90, 1_000_000),
    ])


def test_overlapping_occurrences_count(spark):
    rows = [("ha " * 40, "en"), ("ha ha, ha", "en")]
    found = {r.phrase: r for r in collocations.collocations(docs(spark, rows), cover=101).collect()}
    assert {p: r.a for p, r in found.items()} == {"ha ha": 40, "ha ha ha": 38, "ha ha ha ha": 37} and all(r.n == 43 for r in found.values())


def test_colliding_fingerprints_change_nothing(spark, monkeypatch):
    """With eight fingerprints in all, nearly everything is a candidate; counts by words are what decides."""
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(["a", "b", "c", "dd", "e,"], 30)), str(rng.choice(["en", "de"]))) for _ in range(60)]
    expected = sorted(map(tuple, collocations.collocations(docs(spark, rows), least=20).collect()))
    plain = collocations._frequent
    monkeypatch.setattr(collocations, "_frequent", lambda found, least: plain(found.withColumn("fp", found["fp"] % 4), least))
    assert sorted(map(tuple, collocations.collocations(docs(spark, rows), least=20).collect())) == expected and len(expected) > 20


def test_many_small_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(["one", "two", "three", "four.", "five"], 40)), "en") for _ in range(200)]
    expected = sorted(map(tuple, collocations.collocations(docs(spark, rows)).collect()))
    monkeypatch.setattr(collocations, "BLOCK", 300)
    assert sorted(map(tuple, collocations.collocations(docs(spark, rows).repartition(5)).collect())) == expected


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one word each.", "en")]])
def test_nothing_frequent(spark, rows):
    assert collocations.collocations(docs(spark, rows)).count() == 0


def test_long_text_and_top(spark):
    rows = [(" ".join(f"w{k % 50}" for k in range(200_000)), "en")]
    found = collocations.collocations(docs(spark, rows), top=3, cover=101).collect()
    assert [r.phrase for r in found] == ["w0 w1", "w0 w1 w2", "w0 w1 w2 w3"] and all(r.a == 4000 for r in found) and found[0].n == 200_000
